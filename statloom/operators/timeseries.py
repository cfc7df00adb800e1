"""Time series: forecasts per key, decomposition, breaks, trend, multivariate dynamics, financial risk."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import dist
from ..plans.frames import complete, cut_lineage, fetch, need, num, one_row, refuse, rows_frame
from ..plans.gram import Gram, gram, ols
from ..plans.mle import fit_mle
from ..plans.order import concordance, quantiles
from ..plans.series import blocks, numeric_time, positions

SERIES_LIMIT = 1_000_000       # longest single series a recursion may run over in one task


def _series(df: DataFrame, value: str, order: str, keys: Sequence[str], least: int) -> DataFrame:
    """Keyed series ready for a recursion; a series too long for one task is refused, never cut."""
    need(df, value, order, *keys)
    d = df.select(*keys, F.col(order).alias("__o"), num(value).alias("v")).dropna(subset=["v", "__o"])
    s = fetch(d.groupBy(*keys).count() if keys else d.agg(F.count(F.lit(1)).alias("count")), lo=F.min("count"), hi=F.max("count"))
    refuse(s["lo"] is None or s["lo"] < least, f"every series needs {least} points")
    refuse(s["hi"] > SERIES_LIMIT, f"a series has {s['hi']} points; aggregate it to at most {SERIES_LIMIT} periods first")
    return d if keys else d.withColumn("series", F.lit("all"))


def _map(df, d, keys, fn, schema):
    ks = list(keys) or ["series"]
    head = ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in ks)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf.sort_values("__o")["v"].to_numpy(float))
        for i, k in enumerate(ks):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return d.groupBy(*ks).applyInPandas(run, f"{head}, {schema}")


def _holt(y, a, b, g, m):
    """Additive level-trend-season recursion: one-step errors and the final state."""
    n = len(y)
    if m > 1 and n >= 2 * m:
        level, trend = y[:m].mean(), ((y[m:2 * m] - y[:m]).mean() / m if b is not None else 0.0)
        season = list(y[:m] - level)
    else:
        level, trend, season, m = y[0], (y[1] - y[0] if b is not None else 0.0), [0.0], 1
    sse = 0.0
    for t in range(n):
        s = season[t % m] if g is not None else 0.0
        e = y[t] - (level + trend + s)
        sse += e * e
        new = level + trend + a * e
        if b is not None:
            trend = trend + a * b * e
        level = new
        if g is not None:
            season[t % m] = s + g * (1 - a) * e
    return sse, level, trend, season, m


def _best_holt(y, use_trend, m):
    grid = [0.05, 0.2, 0.4, 0.6, 0.8]
    use_season = m > 1 and len(y) >= 2 * m
    best = min(((_holt(y, a, b, g, m)[0], a, b, g) for a in grid for b in (grid if use_trend else [None]) for g in (grid if use_season else [None])), key=lambda t: t[0])
    _, a, b, g = best
    step = 0.1
    while step > 0.004:
        moved = False
        for da, db, dg in ((step, 0, 0), (-step, 0, 0), (0, step, 0), (0, -step, 0), (0, 0, step), (0, 0, -step)):
            c = [min(max(a + da, 0.001), 0.999), None if b is None else min(max(b + db, 0.0), 0.999), None if g is None else min(max(g + dg, 0.0), 0.999)]
            s = _holt(y, *c, m)[0]
            if s < best[0] * (1 - 1e-9):
                best = (s, *c)
                moved = True
        _, a, b, g = best
        if not moved:
            step /= 2
    return best


def exponential_smoothing(df: DataFrame, value: str, order: str, keys: Sequence[str] = (), h: int = 12, trend: bool = True, period: int = 1) -> DataFrame:
    """Additive Holt-Winters per key: smoothing parameters by squared error, h-step forecasts."""
    d = _series(df, value, order, keys, 8)

    def fit(y):
        sse, a, b, g = _best_holt(y, trend, period)
        _, level, tr, season, m = _holt(y, a, b, g, period)
        n = len(y)
        return pd.DataFrame({"step": np.arange(1, h + 1), "forecast": [level + tr * k + (season[(n + k - 1) % m] if g is not None else 0.0) for k in range(1, h + 1)],
                             "alpha": a, "beta": b if b is not None else np.nan, "gamma": g if g is not None else np.nan, "rmse": math.sqrt(sse / n)})

    return _map(df, d, keys, fit, "step bigint, forecast double, alpha double, beta double, gamma double, rmse double")


def theta_method(df: DataFrame, value: str, order: str, keys: Sequence[str] = (), h: int = 12) -> DataFrame:
    """Simple smoothing plus half the drift of a linear trend."""
    d = _series(df, value, order, keys, 8)

    def fit(y):
        t = np.arange(len(y))
        slope = np.cov(t, y)[0, 1] / np.var(t, ddof=1)
        _, a, _, _ = _best_holt(y, False, 1)
        level = y[0]
        for v in y:
            level += a * (v - level)
        n = len(y)
        k = np.arange(1, h + 1)
        return pd.DataFrame({"step": k, "forecast": level + slope / 2 * (k - 1 + (1 - (1 - a) ** n) / a), "alpha": a, "drift": slope / 2})

    return _map(df, d, keys, fit, "step bigint, forecast double, alpha double, drift double")


def croston(df: DataFrame, value: str, order: str, keys: Sequence[str] = (), alpha: float = 0.1) -> DataFrame:
    """Smoothed size and interval of an intermittent series, demand rate and the bias-corrected rate."""
    d = _series(df, value, order, keys, 2)

    def fit(y):
        z = p = None
        gap = 1
        for v in y:
            if v > 0:
                z, p = (v, gap) if z is None else (z + alpha * (v - z), p + alpha * (gap - p))
                gap = 1
            else:
                gap += 1
        rate = z / p if z is not None else 0.0
        return pd.DataFrame({"size": [z or 0.0], "interval": [float(p or 0)], "rate": [rate], "sba_rate": [rate * (1 - alpha / 2)], "nonzero": [int((y > 0).sum())]})

    return _map(df, d, keys, fit, "size double, interval double, rate double, sba_rate double, nonzero bigint")


def stl_decomposition(df: DataFrame, value: str, order: str, keys: Sequence[str], period: int) -> DataFrame:
    """Centred moving-average trend, seasonal means and remainder, with the strengths of both."""
    ks = list(keys)
    d = df.select(*ks, F.col(order).alias("t"), num(value).alias("v")).dropna(subset=["v", "t"])
    w = Window.partitionBy(*ks).orderBy("t")
    half = period // 2
    d = d.withColumn("i", F.row_number().over(w) - 1)
    frame = w.rowsBetween(-half, half)
    edge = (F.lag("v", half).over(w) + F.lead("v", half).over(w)) / 2
    full = F.count("v").over(frame) == 2 * half + 1
    tr = (F.sum("v").over(frame) - edge) / period if period % 2 == 0 else F.avg("v").over(frame)
    d = d.withColumn("trend", F.when(full, tr)).withColumn("phase", F.col("i") % period)
    ph = d.groupBy(*ks, "phase").agg(F.avg(F.col("v") - F.col("trend")).alias("s"))
    mid = ph.groupBy(*ks).agg(F.avg("s").alias("m"))
    t = d.join(ph.join(mid, ks).select(*ks, "phase", (F.col("s") - F.col("m")).alias("seasonal")), [*ks, "phase"])
    t = t.withColumn("remainder", F.col("v") - F.col("trend") - F.col("seasonal"))
    st = t.groupBy(*ks).agg(F.greatest(F.lit(0.0), 1 - F.var_pop("remainder") / F.var_pop(F.col("remainder") + F.col("seasonal"))).alias("seasonal_strength"),
                            F.greatest(F.lit(0.0), 1 - F.var_pop("remainder") / F.var_pop(F.col("remainder") + F.col("trend"))).alias("trend_strength"))
    return t.join(st, ks).select(*ks, "t", "v", "trend", "seasonal", "remainder", "seasonal_strength", "trend_strength")


def structural_breaks(df: DataFrame, value: str, order: str, keys: Sequence[str] = (), penalty_mult: float = 2.0) -> DataFrame:
    """Mean segments by binary segmentation on the gain in squared error."""
    d = _series(df, value, order, keys, 30)

    def fit(y):
        n = len(y)
        c, c2 = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(y * y)])
        least = max(5, n // 20)
        pen = penalty_mult * math.log(n) * np.var(np.diff(y), ddof=1) / 2
        cost = lambda a, b: c2[b] - c2[a] - (c[b] - c[a]) ** 2 / (b - a)
        segs, done = [(0, n)], []
        while segs:
            a, b = segs.pop()
            if b - a < 2 * least:
                done.append((a, b))
                continue
            k = np.arange(a + least, b - least + 1)
            gain = cost(a, b) - (c2[b] - c2[a] - (c[k] - c[a]) ** 2 / (k - a) - (c[b] - c[k]) ** 2 / (b - k))
            j = int(gain.argmax())
            if gain[j] > pen:
                segs += [(a, int(k[j])), (int(k[j]), b)]
            else:
                done.append((a, b))
        done.sort()
        return pd.DataFrame({"segment": np.arange(1, len(done) + 1), "start": [a for a, _ in done], "end": [b - 1 for _, b in done], "mean": [y[a:b].mean() for a, b in done], "sd": [y[a:b].std(ddof=1) for a, b in done]})

    return _map(df, d, keys, fit, "segment bigint, start bigint, end bigint, mean double, sd double")


def mann_kendall_trend(df: DataFrame, value: str, time: str, alpha: float = 0.05, sen: bool = True) -> DataFrame:
    """S, its tie-corrected z, and the exact Sen slope on rank time with its rank interval; no pairs are formed."""
    from .groups import theil_sen
    need(df, value, time)
    d = df.select(F.col(time).alias("t"), num(value).alias("v")).dropna()
    p = positions(d, "t", (), "i").select(F.col("i").cast("double").alias("i"), "v")
    n = p.count()
    refuse(n < 4, "four points are needed")
    c = concordance(p.withColumn("w", F.lit(1)), "i", "v", "w").collect()[0]
    s = c["concordant"] - c["discordant"]
    ties = fetch(p.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("c")), t=F.sum(F.col("c") * (F.col("c") - 1) * (2 * F.col("c") + 5)))["t"]
    var = (n * (n - 1) * (2 * n + 5) - ties) / 18
    z = (s - np.sign(s)) / math.sqrt(var) if var > 0 else 0.0
    med = lo = hi = float("nan")
    if sen:
        total = n * (n - 1) // 2
        ca = dist.norm_ppf(1 - alpha / 2) * math.sqrt(var)
        a = min(max(int(round((total - ca) / 2)) - 1, 0), total - 1)
        b = min(max(int(round((total + ca) / 2)), 0), total - 1)
        med, lo, hi = theil_sen(p, "i", "v", [0.5, a / (total - 1), b / (total - 1)])
    return one_row(df.sparkSession, n=int(n), s=s, var_s=var, z=float(z), tau=s / (n * (n - 1) / 2), sen_slope=med, sen_low=lo, sen_high=hi, p=dist.p_two_sided(float(z)))


def flow_duration_curve(df: DataFrame, value: str) -> DataFrame:
    """Flows at exceedance probabilities i/(n+1), the Q90/Q50 ratio and the mid-range slope."""
    d = complete(df, [value])
    n = d.count()
    refuse(n < 5, "five values are needed")
    ps = [0.05, 0.10, 0.50, 0.90, 0.95, 0.33, 0.66]
    at = [min(max(((1 - p) * (n + 1) - 1) / (n - 1), 0.0), 1.0) for p in ps]
    v = quantiles(d, value, at)
    slope = (math.log(v[5]) - math.log(v[6])) / 0.33 if v[5] > 0 and v[6] > 0 else float("nan")
    return one_row(df.sparkSession, n=n, q5=v[0], q10=v[1], q50=v[2], q90=v[3], q95=v[4], q90_q50=v[3] / v[2] if v[2] else float("nan"), slope=slope)


def idf_curve(df: DataFrame, duration: str, intensity: str, most: int = 200) -> DataFrame:
    """Rainfall intensity a / (d + b)^c by damped Gauss-Newton on aggregated Jacobian products."""
    d = complete(df, [duration, intensity]).where(F.col(intensity) > 0)
    s = fetch(d, n=F.count(F.lit(1)), v=F.var_pop(intensity), mx=F.max(intensity), md=F.avg(duration))
    refuse(s["n"] < 4, "four points are needed")
    th = np.array([math.log(s["mx"] * (s["md"] + 1) ** 0.7), math.log(max(s["md"] / 5, 0.1)), 0.7])   # ln a, ln b, c

    def at(t):
        b = math.exp(t[1])
        u = F.col(duration) + F.lit(b)
        f = F.lit(math.exp(t[0])) * F.pow(u, F.lit(-t[2]))
        e = F.col(intensity) - f
        j = [f, -f * F.lit(t[2] * b) / u, -f * F.log(u)]
        r = fetch(d, sse=F.sum(e * e), **{f"g{i}": F.sum(j[i] * e) for i in range(3)}, **{f"h{i}{k}": F.sum(j[i] * j[k]) for i in range(3) for k in range(i, 3)})
        h = np.array([[r[f"h{min(i, k)}{max(i, k)}"] for k in range(3)] for i in range(3)])
        return r["sse"], np.array([r[f"g{i}"] for i in range(3)]), h

    sse, g, h = at(th)
    lam = 1e-3
    for _ in range(most):
        step = np.linalg.solve(h + lam * np.diag(np.diag(h)), g)
        new = at(th + step)
        if new[0] < sse:
            gain = sse - new[0]
            th, (sse, g, h), lam = th + step, new, max(lam / 10, 1e-12)
            if gain < 1e-13 * (1 + sse) or np.abs(step).max() < 1e-10:
                break
        else:
            lam *= 10
            if lam > 1e12:
                break
    return one_row(df.sparkSession, n=int(s["n"]), a=math.exp(th[0]), b=math.exp(th[1]), c=float(th[2]), r2=1 - sse / (s["v"] * s["n"]), rmse=math.sqrt(sse / s["n"]))


# --- multivariate dynamics ------------------------------------------------------------------------

def with_lags(df: DataFrame, order: str, cols: Sequence[str], lags: int) -> DataFrame:
    """Columns c_l0 ... c_lK over time order; long series are cut into blocks with a halo."""
    d = complete(df, cols, [order])
    b, part = blocks(d, order, halo=lags)
    w = Window.partitionBy(*part).orderBy("__i")
    return b.select("__i", "__own", *[(F.col(c) if k == 0 else F.lag(c, k).over(w)).alias(f"{c}_l{k}") for c in cols for k in range(lags + 1)]).where("__own").dropna().drop("__own")


def _var_gram(df, order, cols, lags):
    t = with_lags(df, order, cols, lags)
    return gram(t, [f"{c}_l{k}" for c in cols for k in range(lags + 1)])


def var_granger(df: DataFrame, order: str, series: Sequence[str], max_lag: int = 4) -> DataFrame:
    """VAR order by AIC on a common sample and Granger F for every ordered pair; one Gram serves all."""
    cs = list(series)
    refuse(len(cs) < 2, "two series are needed")
    g = _var_gram(df, order, cs, max_lag)

    def resid_cov(p):
        xs = [f"{c}_l{k}" for c in cs for k in range(1, p + 1)]
        ys = [f"{c}_l0" for c in cs]
        return (g.sub(ys, ys) - g.sub(ys, xs) @ np.linalg.pinv(g.sub(xs, xs), hermitian=True) @ g.sub(xs, ys)) / g.n

    aic = {p: np.linalg.slogdet(resid_cov(p))[1] + 2 * len(cs) * (len(cs) * p + 1) / g.n for p in range(1, max_lag + 1)}
    p = min(aic, key=aic.get)
    rows = []
    for y in cs:
        allx = [f"{c}_l{k}" for c in cs for k in range(1, p + 1)]
        full = ols(g, f"{y}_l0", allx)
        for x in cs:
            if x != y:
                red = ols(g, f"{y}_l0", [c for c in allx if c not in {f"{x}_l{k}" for k in range(1, p + 1)}])
                f = ((red.rss - full.rss) / p) / (full.rss / full.df)
                rows.append((x, y, p, f, dist.f_sf(f, p, full.df), aic[p], int(g.n)))
    return rows_frame(df.sparkSession, "cause string, effect string, lag bigint, f double, p double, aic double, n bigint", rows)


# Asymptotic critical values (Engle-Granger two-variable 5%, Johansen trace 5% with constant).
ADF5, EG5 = -2.86, -3.34
TRACE5 = {1: 3.84, 2: 15.49, 3: 29.80, 4: 47.86, 5: 69.82}


def adf(g: Gram, level: str, diff: str, lagged: Sequence[str]) -> float:
    f = ols(g, diff, [level, *lagged])
    return float(f.beta[1] / f.se[1])


def cointegration_vecm(df: DataFrame, order: str, series: Sequence[str]) -> DataFrame:
    """Johansen trace from product-moment matrices of differences and levels, Engle-Granger residual ADF, and the VECM."""
    cs = list(series)
    k = len(cs)
    t = with_lags(df, order, cs, 2)
    z = t.select(*[(F.col(f"{c}_l0") - F.col(f"{c}_l1")).alias(f"d_{c}") for c in cs], *[F.col(f"{c}_l1").alias(f"y_{c}") for c in cs], *[(F.col(f"{c}_l1") - F.col(f"{c}_l2")).alias(f"l_{c}") for c in cs],
                 *[F.col(f"{c}_l0").alias(c) for c in cs])
    d, y, l = ([f"{p}_{c}" for c in cs] for p in "dyl")
    g = gram(z, [*d, *y, *l, *cs])
    ill = np.linalg.pinv(g.sub(l, l), hermitian=True)
    part = lambda a, b: (g.sub(a, b) - g.sub(a, l) @ ill @ g.sub(l, b)) / g.n
    s00, s01, s11 = part(d, d), part(d, y), part(y, y)
    lam, vec = np.linalg.eig(np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01)))
    o = np.argsort(-lam.real)
    lam, vec = np.clip(lam.real[o], 0, 1 - 1e-12), vec.real[:, o]
    trace = [float(-g.n * np.log(1 - lam[r:]).sum()) for r in range(k)]
    beta = vec[:, 0] / vec[0, 0]
    alpha = s01 @ beta / (beta @ s11 @ beta)
    f = ols(g, cs[0], cs[1:])
    res = with_lags(df.select(order, (F.col(cs[0]) - sum([F.col(c) * F.lit(float(b)) for c, b in zip(cs[1:], f.beta[1:])], F.lit(float(f.beta[0])))).alias("e")), order, ["e"], 2)
    ge = gram(res.select((F.col("e_l0") - F.col("e_l1")).alias("de"), F.col("e_l1").alias("e1"), (F.col("e_l1") - F.col("e_l2")).alias("dl")), ["de", "e1", "dl"])
    eg = adf(ge, "e1", "de", ["dl"])
    return rows_frame(df.sparkSession, "series string, rank_null bigint, trace double, critical5 double, beta double, alpha double, adf_level double, engle_granger_t double, cointegrated boolean, n bigint",
                      [(c, r, trace[r], TRACE5.get(k - r), float(beta[r]), float(alpha[r]), adf(g, f"y_{c}", f"d_{c}", [f"l_{c}"]), eg, eg < EG5, int(g.n)) for r, c in enumerate(cs)])


def ardl_bounds(df: DataFrame, order: str, outcome: str, regressors: Sequence[str], max_lag: int = 2) -> DataFrame:
    """Error-correction form with the lag order by AIC, the bounds F test and long-run coefficients."""
    xs = list(regressors)
    cs = [outcome, *xs]
    t = with_lags(df, order, cs, max_lag + 1)
    z = t.select(*[F.col(f"{c}_l1").alias(f"L_{c}") for c in cs], *[(F.col(f"{c}_l{k}") - F.col(f"{c}_l{k + 1}")).alias(f"D{k}_{c}") for c in cs for k in range(max_lag + 1)])
    g = gram(z, z.columns)
    best = None
    for p in range(1, max_lag + 1):
        for q in range(0, max_lag + 1):
            terms = [f"L_{c}" for c in cs] + [f"D{k}_{outcome}" for k in range(1, p + 1)] + [f"D{k}_{x}" for x in xs for k in range(q + 1)]
            f = ols(g, f"D0_{outcome}", terms)
            a = g.n * math.log(f.rss / g.n) + 2 * len(f.terms)
            if best is None or a < best[0]:
                best = (a, p, q, terms, f)
    a, p, q, terms, f = best
    red = ols(g, f"D0_{outcome}", [c for c in terms if not c.startswith("L_")])
    m = len(cs)
    stat = ((red.rss - f.rss) / m) / (f.rss / f.df)
    ect = float(f.beta[1])
    # 5% bounds, unrestricted intercept, by number of regressors.
    lo, hi = {1: (4.94, 5.73), 2: (3.79, 4.85), 3: (3.23, 4.35), 4: (2.86, 4.01)}.get(len(xs), (2.62, 3.79))
    verdict = "cointegrated" if stat > hi else "not cointegrated" if stat < lo else "inconclusive"
    return rows_frame(df.sparkSession, "regressor string, long_run double, ect double, ect_t double, f double, bound_low double, bound_high double, verdict string, p bigint, q bigint, n bigint",
                      [(x, float(-f.beta[2 + i] / ect), ect, float(ect / f.se[1]), float(stat), lo, hi, verdict, p, q, int(g.n)) for i, x in enumerate(xs)])


# --- financial risk -------------------------------------------------------------------------------

def returns_of(df: DataFrame, value: str, order: str, is_returns: bool | None = None) -> DataFrame:
    """Return series: as given, or log price differences when the column looks like a price
    (all positive, and trending with r >= .30 or lag-one autocorrelation >= .90)."""
    d = complete(df, [value], [order]).withColumnRenamed(value, "v")
    if is_returns is None:
        b, part = blocks(d, order, halo=1)
        w = Window.partitionBy(*part).orderBy("__i")
        t = b.withColumn("l", F.lag("v").over(w)).where("__own")
        s = fetch(t, lo=F.min("v"), c=F.covar_pop("v", F.col("__i").cast("double")), v=F.var_pop("v"), vi=F.var_pop(F.col("__i").cast("double")),
                  cl=F.covar_pop("v", "l"), vl=F.var_pop("l"))
        r = abs(s["c"]) / math.sqrt(s["v"] * s["vi"]) if s["v"] else 0.0
        ac = s["cl"] / math.sqrt(s["v"] * s["vl"]) if s["v"] and s["vl"] else 0.0
        is_returns = not (s["lo"] > 0 and (r >= 0.30 or ac >= 0.90))
    if is_returns:
        return positions(d, order, ()).select(F.col("__i").alias("i"), F.col("v").alias("r"))
    b, part = blocks(d, order, halo=1)
    w = Window.partitionBy(*part).orderBy("__i")
    return b.select(F.col("__i").alias("i"), "__own", (F.log("v") - F.log(F.lag("v").over(w))).alias("r")).where("__own").drop("__own").dropna()


def value_at_risk(df: DataFrame, value: str, order: str, is_returns: bool | None = None, alphas: Sequence[float] = (0.95, 0.99)) -> DataFrame:
    """Historical, Gaussian and Cornish-Fisher VaR with expected shortfall of losses."""
    d = cut_lineage(returns_of(df, value, order, is_returns).select((-F.col("r")).alias("l")))
    s = fetch(d, n=F.count(F.lit(1)), m=F.avg("l"), sd=F.stddev_samp("l"))
    n, m, sd = s["n"], s["m"], s["sd"]
    refuse(n < 30 or not sd, "thirty returns that vary are needed")
    c = F.col("l") - F.lit(m)
    p = fetch(d, m2=F.avg(c ** 2), m3=F.avg(c ** 3), m4=F.avg(c ** 4))
    g1, g2 = p["m3"] / p["m2"] ** 1.5, p["m4"] / p["m2"] ** 2 - 3
    sk = math.sqrt(n * (n - 1)) / (n - 2) * g1
    ku = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    points = []
    for a, hv in zip(alphas, quantiles(d, "l", alphas)):
        z = dist.norm_ppf(a)
        zc = z + (z * z - 1) * sk / 6 + (z ** 3 - 3 * z) * ku / 24 - (2 * z ** 3 - 5 * z) * sk * sk / 36
        points.append((a, z, hv, m + sd * zc))
    beyond = lambda v: F.avg(F.when(F.col("l") >= F.lit(v), F.col("l")))
    t = fetch(d, **{f"h{i}": beyond(hv) for i, (_, _, hv, _) in enumerate(points)}, **{f"c{i}": beyond(cf) for i, (_, _, _, cf) in enumerate(points)})
    rows = [(float(a), int(n), hv, t[f"h{i}"], m + sd * z, m + sd * dist.norm_pdf(z) / (1 - a), cf, t[f"c{i}"], sk, ku) for i, (a, z, hv, cf) in enumerate(points)]
    return rows_frame(df.sparkSession, "alpha double, n bigint, var_historical double, es_historical double, var_gaussian double, es_gaussian double, var_cornish_fisher double, es_cornish_fisher double, skewness double, excess_kurtosis double", rows)


def extreme_value(df: DataFrame, value: str, order: str, is_returns: bool | None = None, quantile: float = 0.95, alphas: Sequence[float] = (0.95, 0.99, 0.999)) -> DataFrame:
    """Peaks over threshold: generalised Pareto by maximum likelihood on the exceedances, and tail VaR."""
    d = returns_of(df, value, order, is_returns).select((-F.col("r")).alias("l"))
    u = quantiles(d, "l", [quantile])[0]
    n = d.count()
    e = d.where(F.col("l") > F.lit(u)).select((F.col("l") - F.lit(u)).alias("x"))
    s = fetch(e, n=F.count(F.lit(1)), m=F.avg("x"))
    refuse(s["n"] < 30, "thirty exceedances are needed")

    def ll(eta, y):
        ls, xi = eta
        w = 1 + xi * y["x"] / np.exp(ls)
        small_xi = np.abs(xi) < 1e-6
        safe = np.where(small_xi, 1.0, xi)
        return np.where(w > 0, -ls - np.where(small_xi, y["x"] / np.exp(ls), (1 + 1 / safe) * np.log(np.maximum(w, 1e-300))), -1e6)

    f = fit_mle(e, ["x"], [("log_sigma", [], True), ("xi", [], True)], ll, [[math.log(s["m"])], [0.05]])
    sg, xi = math.exp(f.beta[0]), float(f.beta[1])
    rows = []
    for p in alphas:
        ratio = n / s["n"] * (1 - p)
        v = u - sg * math.log(ratio) if abs(xi) < 1e-8 else u + sg / xi * (ratio ** -xi - 1)
        rows.append((float(p), u, int(s["n"]), xi, sg, v, (v + sg - xi * u) / (1 - xi) if xi < 1 else None, f.ll))
    return rows_frame(df.sparkSession, "alpha double, threshold double, exceedances bigint, shape double, scale double, var double, es double, loglik double", rows)


def risk_adjusted_return(df: DataFrame, value: str, order: str, is_returns: bool | None = True, periods_per_year: int = 252, rf: float = 0.0) -> DataFrame:
    """Annualised mean and volatility, Sharpe, Sortino, maximum drawdown and Calmar.

    Wealth is a running sum of log growth; the drawdown compares it with its running maximum, both by range offsets.
    """
    from ..plans.order import cumulate
    d = returns_of(df, value, order, is_returns)
    a = fetch(d, n=F.count(F.lit(1)), m=F.avg("r"), sd=F.stddev_samp("r"), dn=F.avg(F.least(F.col("r") - rf, F.lit(0.0)) ** 2))
    refuse(a["n"] < 20 or not a["sd"], "twenty returns that vary are needed")
    c = cumulate(d.withColumn("g", F.log1p("r")), "i", ["g"]).select("i", (F.col("g_before") + F.col("g")).alias("lw"))
    c = cumulate(c, "i", [], extremes=["lw"])
    mdd = fetch(c, d=F.min(F.exp(F.col("lw") - F.greatest("lw", "lw_maxbefore")) - 1))["d"]
    ann, vol = a["m"] * periods_per_year, a["sd"] * math.sqrt(periods_per_year)
    root = math.sqrt(periods_per_year)
    return one_row(df.sparkSession, n=int(a["n"]), annual_return=ann, annual_volatility=vol, sharpe=(a["m"] - rf) / a["sd"] * root,
                   sortino=(a["m"] - rf) / math.sqrt(a["dn"]) * root if a["dn"] > 0 else float("nan"), max_drawdown=mdd, calmar=ann / abs(mdd) if mdd else float("nan"))
