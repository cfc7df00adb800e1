"""Panel GMM: recovery, plain matrices, gaps; Hausman-Taylor on written-out columns."""

import random

import numpy as np
import pytest

from statloom.operators.panel_gmm import dynamic_panel_gmm, hausman_taylor, system_gmm

SCHEMA = "unit long, t long, y double, x double"


def simulate(units=300, periods=7, rho=0.5, beta=1.0, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(units):
        eta, x = rng.normal(), 0.0
        y = eta / (1 - rho) + rng.normal()
        for t in range(-15, periods):
            x = 0.5 * x + rng.normal() + 0.3 * eta
            y = rho * y + beta * x + eta + rng.normal()
            if t >= 0:
                rows.append((i, 2000 + t, float(y), float(x)))
    return rows


def plain(rows, lo=2, hi=4):
    """Arellano-Bond with one exogenous predictor, written out in dense matrices."""
    by = {}
    for u, t, y, x in rows:
        by.setdefault(u, {})[t] = (y, x)
    ts = sorted({r[1] for r in rows})
    cols = [(t, k) for t in ts for k in range(lo, hi + 1) if t - k >= ts[0]]
    per = []
    for u in by.values():
        eq = [t for t in sorted(u) if t - 1 in u and t - 2 in u]
        if not eq:
            continue
        y = np.array([u[t][0] - u[t - 1][0] for t in eq])
        x = np.array([[u[t - 1][0] - u[t - 2][0], u[t][1] - u[t - 1][1]] for t in eq])
        z = np.array([[u[t - k][0] if t == s and t - k in u else 0.0 for s, k in cols] + [u[t][1] - u[t - 1][1]] for t in eq])
        h = np.array([[2.0 if a == b else -1.0 if abs(a - b) == 1 else 0.0 for b in eq] for a in eq])
        per.append((y, x, z, h))
    zx, zy = sum(z.T @ x for y, x, z, h in per), sum(z.T @ y for y, x, z, h in per)
    w = np.linalg.pinv(sum(z.T @ h @ z for y, x, z, h in per))
    b1 = np.linalg.solve(zx.T @ w @ zx, zx.T @ w @ zy)
    s = sum(np.outer(e, e) for e in (z.T @ (y - x @ b1) for y, x, z, h in per))
    w = np.linalg.pinv(s)
    b2 = np.linalg.solve(zx.T @ w @ zx, zx.T @ w @ zy)
    g = zy - zx @ b2
    return b2, np.sqrt(np.diag(np.linalg.inv(zx.T @ w @ zx))), float(g @ w @ g), sum(len(p[0]) for p in per), len(cols) + 1


def test_difference_gmm(spark):
    rows = simulate()
    rng = random.Random(0)
    rows = [r for r in rows if rng.random() > 0.03]            # gaps: no equation may cross one
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["term"]: r for r in dynamic_panel_gmm(df, "y", ["x"], "unit", "t").collect()}
    b, se, j, n, k = plain(rows)
    lag, x = got["lag_y"], got["x"]
    assert np.allclose([lag["coef"], x["coef"]], b, atol=1e-8) and np.allclose([lag["se_uncorrected"], x["se_uncorrected"]], se, rtol=1e-6)
    assert abs(lag["sargan"] - j) < 1e-6 * j and lag["equations"] == n and lag["instruments"] == k
    assert abs(lag["coef"] - 0.5) < 0.12 and abs(x["coef"] - 1) < 0.1
    assert lag["se"] > lag["se_uncorrected"] and lag["ar1_p"] < 0.01 and lag["ar2_p"] > 0.01 and lag["sargan_p"] > 0.01
    again = {r["term"]: r for r in dynamic_panel_gmm(df.repartition(9), "y", ["x"], "unit", "t").collect()}
    assert abs(again["lag_y"]["coef"] - lag["coef"]) < 1e-9


def test_system_gmm(spark):
    df = spark.createDataFrame(simulate(units=400, rho=0.8, seed=5), SCHEMA)
    sys_ = {r["term"]: r for r in system_gmm(df, "y", ["x"], "unit", "t", endogenous=["x"], collapse=True).collect()}
    dif = {r["term"]: r for r in dynamic_panel_gmm(df, "y", ["x"], "unit", "t", endogenous=["x"], collapse=True).collect()}
    assert abs(sys_["lag_y"]["coef"] - 0.8) < 0.1 and abs(sys_["x"]["coef"] - 1) < 0.2
    assert all(r["se"] > r["se_uncorrected"] for r in sys_.values())
    assert sys_["lag_y"]["se"] < dif["lag_y"]["se"] and sys_["lag_y"]["equations"] > dif["lag_y"]["equations"]


def test_refusals(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 1.0), (1, 1, 2.0, 1.0), (1, 3, 2.0, 0.0)], SCHEMA)
    with pytest.raises(ValueError, match="twice"):
        dynamic_panel_gmm(df, "y", ["x"], "unit", "t")
    with pytest.raises(ValueError, match="three periods"):
        dynamic_panel_gmm(df.where("t = 1"), "y", ["x"], "unit", "t")


def test_hausman_taylor(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        a = rng.normal()
        z1, z2 = float(rng.normal()), float(a + rng.normal())
        for t in range(rng.integers(3, 9)):
            x1, x2 = rng.normal() + 1.5 * z2, a + rng.normal()
            rows.append((i, float(1 + x1 + 2 * x2 + 0.5 * z1 + 0.7 * z2 + a + rng.normal()), float(x1), float(x2), z1, z2))
    df = spark.createDataFrame(rows, "unit long, y double, x1 double, x2 double, z1 double, z2 double")
    got = {r["term"]: r for r in hausman_taylor(df, "y", ["x1", "x2", "z1", "z2"], "unit", ["x2", "z2"]).collect()}
    u, m = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
    size = np.bincount(u)[u]
    mean = np.array([np.bincount(u, m[:, k])[u] / size for k in range(5)]).T
    dev = m - mean
    n, g = len(rows), len(set(u))
    bw = np.linalg.lstsq(dev[:, 1:3], dev[:, 0], rcond=None)[0]
    s2e = ((dev[:, 0] - dev[:, 1:3] @ bw) ** 2).sum() / (n - g - 2)
    tsls = lambda y, x, z: np.linalg.lstsq(z @ np.linalg.lstsq(z, x, rcond=None)[0], y, rcond=None)[0]
    one = np.ones((n, 1))
    r = mean[:, 0] - mean[:, 1:3] @ bw
    x, z = np.hstack([one, mean[:, 3:]]), np.hstack([one, mean[:, [1, 3]]])
    e = r - x @ tsls(r, x, z)
    first = np.unique(u, return_index=True)[1]
    s2u = max(0, (e @ e) / n - s2e / (g / (1 / size[first]).sum()))
    th = (1 - np.sqrt(s2e / (s2e + size * s2u)))[:, None]
    star = m - th * mean
    b = tsls(star[:, 0], np.hstack([1 - th, star[:, 1:]]), np.hstack([one, dev[:, 1:3], mean[:, [1, 3]]]))
    assert np.allclose([got[t]["coef"] for t in ("intercept", "x1", "x2", "z1", "z2")], b, atol=1e-8)
    assert got["z1"]["time_invariant"] and not got["x1"]["time_invariant"] and abs(got["z2"]["coef"] - 0.7) < 0.35
    with pytest.raises(ValueError, match="fewer exogenous"):
        hausman_taylor(df, "y", ["x2", "z1", "z2"], "unit", ["x2", "z2"])
