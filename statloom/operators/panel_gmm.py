"""Dynamic panels: difference and system GMM, and the Hausman-Taylor estimator.

A unit's periods are one array, and every task adds up the moment blocks of its units (Z'X, Z'HZ, Z'uu'Z, ...), so a few
arrays whose size depends on the instruments alone reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import dist
from ..plans.frames import collect_bounded, complete, cut_lineage, fetch, need, refuse, rows_frame
from ..plans.gram import Gram, gram, weighted_gram
from .linear import COEF, coef_rows

MOST_INSTRUMENTS = 600     # beyond, the two-step weights are no use, and the blocks too large for one row each
MOST_PERIODS = 400


class Design:
    """Equations and instruments of a dynamic panel, from a unit's values by period.

    Difference equations: period t needs t, t - 1 and t - 2 of the outcome and t, t - 1 of the predictors, all present, so
    no difference or lag crosses a gap. Level equations (system) need t and t - 1. A missing instrument is zero.
    """

    def __init__(self, periods: Sequence[int], k: int, endogenous: Sequence[int], lags: tuple[int, int], system: bool, collapse: bool):
        self.first, self.k, self.endogenous, self.system = periods[0], k, list(endogenous), system
        self.columns: dict[tuple, int] = {}
        lo, hi = lags
        at = sorted(periods)
        for v, low in [(0, max(2, lo)), *[(1 + e, lo) for e in self.endogenous]]:
            for t in at:
                for lag in range(low, hi + 1):
                    if t - lag >= at[0]:
                        self.columns.setdefault(("d", v, None if collapse else t, lag), len(self.columns))
                if system and t - max(low - 1, 1) - 1 >= at[0]:
                    self.columns.setdefault(("l", v, None if collapse else t), len(self.columns))
        for x in range(k):
            if x not in self.endogenous:
                self.columns.setdefault(("x", 1 + x), len(self.columns))
        if system:
            self.columns.setdefault(("one",), len(self.columns))
        self.lags, self.collapse = lags, collapse

    def unit(self, times: list[int], values: np.ndarray):
        """(y, X, Z, M, level, t) of a unit's equations; M are the weights of its periods' errors in each equation."""
        row = {t: i for i, t in enumerate(times)}
        lo, hi = self.lags
        ys, xs, zs, ms, level, ts = [], [], [], [], [], []
        width = self.k + 1 + self.system
        gmm = [(0, max(2, lo)), *[(1 + e, lo) for e in self.endogenous]]
        for kind in ("d", "l") if self.system else ("d",):
            for t in times:
                if t - 1 not in row or (kind == "d" and t - 2 not in row):
                    continue
                a, b = values[row[t]], values[row[t - 1]]
                z, m = np.zeros(len(self.columns)), np.zeros(len(times))
                m[row[t]] = 1
                x = np.zeros(width)
                if kind == "d":
                    c = values[row[t - 2]]
                    y, x[0], x[1:self.k + 1], m[row[t - 1]] = a[0] - b[0], b[0] - c[0], a[1:] - b[1:], -1
                else:
                    y, x[0], x[1:self.k + 1], x[-1] = a[0], b[0], a[1:], 1
                for v, low in gmm:
                    if kind == "d":
                        for lag in range(low, hi + 1):
                            j = self.columns.get(("d", v, None if self.collapse else t, lag))
                            if j is not None and t - lag in row:
                                z[j] = values[row[t - lag]][v]
                    else:
                        back = max(low - 1, 1)
                        j = self.columns.get(("l", v, None if self.collapse else t))
                        if j is not None and t - back in row and t - back - 1 in row:
                            z[j] = values[row[t - back]][v] - values[row[t - back - 1]][v]
                for v in range(1, self.k + 1):
                    j = self.columns.get(("x", v))
                    if j is not None:
                        z[j] = a[v] - b[v] if kind == "d" else a[v]
                if kind == "l":
                    z[self.columns[("one",)]] = 1
                ys.append(y), xs.append(x), zs.append(z), ms.append(m), level.append(kind == "l"), ts.append(t)
        if not ys:
            return None
        return np.array(ys), np.array(xs), np.array(zs), np.array(ms), np.array(level), np.array(ts)


def summed(units: DataFrame, names: Sequence[str], design: Design, blocks: Callable) -> dict[str, np.ndarray]:
    """Sums over units of the arrays that `blocks(y, X, Z, M, level, t)` gives by name: a task sends one row for each name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for cells in b.column(0).to_pylist():
                made = design.unit([c["t"] for c in cells], np.array([c["v"] for c in cells], float))
                if made is not None:
                    for k, a in blocks(*made).items():
                        total[k] = total[k] + a if k in total else np.array(a, float)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([list(a.shape) for a in total.values()], pa.list_(pa.int64())), pa.array([a.ravel().tolist() for a in total.values()], pa.list_(pa.float64()))], ["k", "shape", "a"])

    parts = units.select("cells").mapInArrow(run, "k string, shape array<bigint>, a array<double>")
    cells = parts.select("k", "shape", F.posexplode("a").alias("i", "v")).groupBy("k", "shape", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in cells.groupBy("k", "shape").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("a")).collect():      # one row for each block
        out[r["k"]] = np.array([c["v"] for c in r["a"]]).reshape([int(n) for n in r["shape"]])
    return out


def _gmm(df: DataFrame, outcome: str, predictors: Sequence[str], unit: str, time: str, endogenous: Sequence[str], lags: tuple[int, int], system: bool, collapse: bool) -> DataFrame:
    xs = list(predictors)
    need(df, outcome, *xs, unit, time)
    refuse(not xs, "a predictor is needed")
    refuse(not set(endogenous) <= set(xs), "endogenous columns must be predictors")
    refuse(lags[0] < 1 or lags[1] < max(2, lags[0]), "lags must reach from 1 or more to 2 or more")
    d = complete(df, [outcome, *xs, time], [unit])
    refuse(not d.where(F.col(time) != F.floor(time)).isEmpty(), "periods must be whole numbers")
    span = fetch(d, lo=F.min(time), hi=F.max(time))
    refuse(span["lo"] is None or span["hi"] - span["lo"] < 2, "three periods are needed")
    refuse(span["hi"] - span["lo"] >= MOST_PERIODS, f"more than {MOST_PERIODS} periods: dynamic panels are short")
    refuse(not d.groupBy(unit, time).count().where("count > 1").isEmpty(), "a unit has a period twice")
    cell = F.struct(F.col(time).cast("bigint").alias("t"), F.array(outcome, *xs).alias("v"))
    units = cut_lineage(d.groupBy(unit).agg(F.sort_array(F.collect_list(cell)).alias("cells")).select("cells"))
    design = Design(list(range(int(span["lo"]), int(span["hi"]) + 1)), len(xs), [xs.index(e) for e in endogenous], lags, system, collapse)
    refuse(len(design.columns) > MOST_INSTRUMENTS, f"{len(design.columns)} instruments: collapse them or narrow the lags")

    one = summed(units, xs, design, lambda y, x, z, m, level, t: {"zx": z.T @ x, "zy": z.T @ y, "h": (mz := m.T @ z).T @ mz, "n": np.array([len(y), 1.0, (~level).sum()])})
    refuse(not one, "no unit has three periods in a row")
    zx, zy = one["zx"], one["zy"]
    p = zx.shape[1]
    w1 = np.linalg.pinv(one["h"], hermitian=True)
    bread1 = np.linalg.pinv(zx.T @ w1 @ zx, hermitian=True)
    b1 = bread1 @ zx.T @ w1 @ zy

    def second(y, x, z, m, level, t):
        e = z.T @ (y - x @ b1)
        return {"s": np.outer(e, e), **{f"d{j}": -(np.outer(c := z.T @ x[:, j], e) + np.outer(e, c)) for j in range(p)}}

    two = summed(units, xs, design, second)
    w2 = np.linalg.pinv(two["s"], hermitian=True)
    v2 = np.linalg.pinv(zx.T @ w2 @ zx, hermitian=True)
    b2 = v2 @ zx.T @ w2 @ zy
    left = zy - zx @ b2
    # Windmeijer: the second step's errors carry the first step's estimate in its weights.
    v1 = bread1 @ zx.T @ w1 @ two["s"] @ w1 @ zx @ bread1
    lead = np.column_stack([-v2 @ zx.T @ w2 @ two[f"d{j}"] @ w2 @ left for j in range(p)])
    v = v2 + lead @ v2 + v2 @ lead.T + lead @ v1 @ lead.T
    j = float(left @ w2 @ left)
    free = int(np.linalg.matrix_rank(two["s"], hermitian=True)) - p

    def serial(y, x, z, m, level, t):
        e = y - x @ b2
        out = {}
        at = {int(k): i for i, k in enumerate(t) if not level[i]}
        for lag in (1, 2):
            own = [i for k, i in at.items() if k - lag in at]
            ago = [at[k - lag] for k in at if k - lag in at]
            s = float(e[own] @ e[ago])
            out[f"r{lag}"] = np.concatenate([[s, s * s], x[own].T @ e[ago], (z.T @ e) * s])
        return out

    third = summed(units, xs, design, serial)
    tests = []
    for lag in (1, 2):
        a = third[f"r{lag}"]
        r, r2, q, zr = a[0], a[1], a[2:2 + p], a[2 + p:]
        var = r2 - 2 * q @ v2 @ zx.T @ w2 @ zr + q @ v @ q
        stat = r / math.sqrt(var) if var > 0 else float("nan")
        tests += [stat, dist.p_two_sided(stat) if var > 0 else float("nan")]
    terms = [f"lag_{outcome}", *xs, *(["intercept"] if system else [])]
    plain = np.sqrt(np.maximum(np.diag(v2), 0))
    rows = [(*c, float(u), j, free, dist.chi2_sf(j, free) if free > 0 else None, *tests, int(one["n"][1]), int(one["n"][0]), len(design.columns)) for c, u in zip(coef_rows(terms, b2, v), plain)]
    return rows_frame(df.sparkSession, COEF + ", se_uncorrected double, sargan double, sargan_df bigint, sargan_p double, ar1 double, ar1_p double, ar2 double, ar2_p double, units bigint, equations bigint, instruments bigint", rows)


def dynamic_panel_gmm(df: DataFrame, outcome: str, predictors: Sequence[str], unit: str, time: str, endogenous: Sequence[str] = (), lags: tuple[int, int] = (2, 4), collapse: bool = False) -> DataFrame:
    """Arellano-Bond difference GMM in two steps with Windmeijer's errors, Sargan's test, AR(1) and AR(2).

    The outcome's lags (at least the second) and those of endogenous predictors are instruments period by period (one
    column per lag if `collapse`); other predictors stand for themselves in differences. Periods are whole numbers, once
    per unit; differences and lags never cross a gap. Rows with a missing value go.
    """
    return _gmm(df, outcome, predictors, unit, time, endogenous, lags, False, collapse)


def system_gmm(df: DataFrame, outcome: str, predictors: Sequence[str], unit: str, time: str, endogenous: Sequence[str] = (), lags: tuple[int, int] = (2, 4), collapse: bool = False) -> DataFrame:
    """Blundell-Bond system GMM: the difference equations of `dynamic_panel_gmm` and level equations with an intercept.

    Level equations are instrumented by the latest earlier differences; other predictors stand for themselves. The first
    step weighs both kinds with the covariances, across kinds as well, that independent errors would give them.
    """
    return _gmm(df, outcome, predictors, unit, time, endogenous, lags, True, collapse)


def _raw_2sls(g: Gram, y: str, xs: Sequence[str], zs: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """Two-stage least squares from uncentred moments: (beta, bread, rss)."""
    raw, at = g.raw(), {n: i for i, n in enumerate(g.names)}
    sub = lambda a, b: raw[np.ix_([at[i] for i in a], [at[i] for i in b])]
    iz = np.linalg.pinv(sub(zs, zs), hermitian=True)
    xz = sub(xs, zs)
    bread = np.linalg.pinv(xz @ iz @ xz.T, hermitian=True)
    b = bread @ xz @ iz @ sub(zs, [y])[:, 0]
    v = np.concatenate([[1.0], -b])
    m = sub([y, *xs], [y, *xs])
    return b, bread, float(v @ m @ v)


def hausman_taylor(df: DataFrame, outcome: str, predictors: Sequence[str], unit: str, endogenous: Sequence[str] = ()) -> DataFrame:
    """Coefficients of time-varying and time-invariant predictors, some of which go with the unit effect (`endogenous`).

    Instruments are all within deviations, the unit means of the exogenous time-varying predictors and the exogenous
    time-invariant ones; rows are theta-transformed by the variance components. Which predictors vary is read from the
    data. At least as many exogenous time-varying as endogenous time-invariant predictors are needed.
    """
    xs = list(predictors)
    need(df, outcome, *xs, unit)
    refuse(not set(endogenous) <= set(xs), "endogenous columns must be predictors")
    cols = [outcome, *xs]
    d = complete(df, cols, [unit])
    g = gram(d, cols)
    m = cut_lineage(d.groupBy(unit).agg(F.count(F.lit(1)).cast("double").alias("__t"), *[F.avg(c).alias(f"__m_{c}") for c in cols]))
    means = weighted_gram(m, [f"__m_{c}" for c in cols], F.col("__t"))[()]
    n, units = g.n, means.rows
    within = Gram(cols, n, g.mean, g.cross - means.cross)
    varies = [x for x in xs if within.sub([x], [x])[0, 0] > 1e-9 * max(g.sub([x], [x])[0, 0], 1e-300)]
    still = [x for x in xs if x not in varies]
    refuse(not still, "no predictor is constant within the units: use random or fixed effects")
    free = [x for x in varies if x not in endogenous]
    kept = [x for x in still if x not in endogenous]
    refuse(not varies, "no predictor varies within the units")
    refuse(len(free) < len(still) - len(kept), "fewer exogenous time-varying than endogenous time-invariant predictors")
    iw = np.linalg.pinv(within.sub(varies, varies), hermitian=True)
    bw = iw @ within.sub(varies, [outcome])[:, 0]
    s2e = float(within.sub([outcome], [outcome])[0, 0] - within.sub(varies, [outcome])[:, 0] @ bw) / (n - units - len(varies))
    # Unit means of what the varying predictors leave, on the constant ones, every unit counted with its periods.
    rest = F.col(f"__m_{outcome}") - sum([F.col(f"__m_{x}") * F.lit(float(b)) for x, b in zip(varies, bw)], F.lit(0.0))
    mid = m.select("__t", rest.alias("__r"), F.lit(1.0).alias("__one"), *[F.col(f"__m_{x}").alias(x) for x in xs])
    names = ["__one", "__r", *xs]
    root = F.sqrt("__t")
    scaled = gram(mid.select(*[(F.col(c) * root).alias(c) for c in names]), names)
    _, _, rss = _raw_2sls(scaled, "__r", ["__one", *still], ["__one", *free, *kept])
    tbar = units / fetch(m, h=F.sum(1 / F.col("__t")))["h"]
    s2u = max(0.0, rss / n - s2e / tbar)
    theta = 1 - F.sqrt(F.lit(s2e) / (F.lit(s2e) + F.col("__t") * F.lit(s2u)))
    j = d.join(m, unit).withColumn("__th", theta)
    star = [(F.col(c) - F.col("__th") * F.col(f"__m_{c}")).alias(c) for c in cols]
    z = j.select((1 - F.col("__th")).alias("__one"), *star, F.lit(1.0).alias("__c"), *[(F.col(x) - F.col(f"__m_{x}")).alias(f"__d_{x}") for x in varies], *[F.col(f"__m_{x}").alias(f"__b_{x}") for x in [*free, *kept]])
    ins = ["__c", *[f"__d_{x}" for x in varies], *[f"__b_{x}" for x in [*free, *kept]]]
    b, bread, rss = _raw_2sls(gram(z, ["__one", *cols, *ins]), outcome, ["__one", *xs], ins)
    v = bread * rss / (n - len(xs) - 1)
    return rows_frame(df.sparkSession, COEF + ", time_invariant boolean, endogenous boolean, sigma_u2 double, sigma_e2 double, units bigint, n bigint",
                      [(*c, t in still, t in endogenous, s2u, s2e, int(units), int(n)) for c, t in zip(coef_rows(["intercept", *xs], b, v), ["intercept", *xs])])
