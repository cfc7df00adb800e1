"""Descriptive statistics, correlation and assumption checks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import dist
from ..plans.frames import (clean, collect_bounded, complete, fetch, need, num, numeric_columns, one_row,
                            refuse, rows_frame, text_columns)
from ..plans.gram import gram, ols
from ..plans.order import (average_ranks, concordance, cumulate, group_quantiles, quantiles, sorted_position,
                           value_counts, with_average_rank)


def descriptive_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count/mean/std/min/quartiles/max of numerics and count/unique/top/freq of text, one row per column.

    Numerics come from one aggregate; text columns from one grouped count over the unpivoted columns.
    """
    cols = list(columns or df.columns)
    need(df, *cols)
    nums = [c for c in cols if c in numeric_columns(df)]
    texts = [c for c in cols if c in text_columns(df)]
    spark = df.sparkSession
    out = []
    if nums:
        stats = []
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), num(c).alias("v")) for c in nums])).alias("s")).select("s.*")
        at = group_quantiles(long, "v", [0.25, 0.5, 0.75], ["column"])
        for c in nums:
            v = num(c)
            qs = [F.lit(x).cast("double") for x in at.get((c,), [None] * 3)]
            stats.append(F.struct(
                F.lit(c).alias("column"), F.count(v).alias("n"), F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
                qs[0].alias("q25"), qs[1].alias("q50"), qs[2].alias("q75"), F.max(v).alias("max")))
        one = df.agg(F.array(*stats).alias("s"))
        out.append(one.select(F.explode("s").alias("s")).select("s.*")
                   .select("*", F.lit(None).cast("bigint").alias("unique"),
                           F.lit(None).cast("string").alias("top"), F.lit(None).cast("bigint").alias("freq")))
    if texts:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v"))
                                             for c in texts])).alias("s")).select("s.*").dropna()
        counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("c"))
        # top = most frequent level, smallest first on ties; max_by over a (count, reversed) key.
        best = counts.groupBy("column").agg(
            F.sum("c").alias("n"), F.count(F.lit(1)).alias("unique"),
            F.min(F.struct((-F.col("c")).alias("neg"), F.col("v").alias("v"))).alias("b"))
        null = F.lit(None).cast("double")
        out.append(best.select("column", F.col("n"), *[null.alias(k) for k in
                                                      ("mean", "std", "min", "q25", "q50", "q75", "max")],
                               "unique", F.col("b.v").alias("top"), (-F.col("b.neg")).alias("freq")))
    refuse(not out, "no numeric or text column to describe")
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def _pairwise(df: DataFrame, cols: Sequence[str]) -> list[tuple[str, str, int, float | None]]:
    """Pairwise-complete n and Pearson r for every pair, from one aggregate row."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = []
    for k, (a, b) in enumerate(pairs):
        both = num(a).isNotNull() & num(b).isNotNull()
        x, y = F.when(both, num(a)), F.when(both, num(b))
        aggs += [F.count(x).alias(f"n{k}"), F.covar_pop(x, y).alias(f"c{k}"),
                 F.var_pop(x).alias(f"u{k}"), F.var_pop(y).alias(f"v{k}")]
    r = df.agg(*aggs).collect()[0]
    out = []
    for k, (a, b) in enumerate(pairs):
        u, v = r[f"u{k}"], r[f"v{k}"]
        rho = r[f"c{k}"] / math.sqrt(u * v) if u and v and u > 0 and v > 0 else None
        out.append((a, b, r[f"n{k}"], rho))
    return out


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson matrix over the numeric columns in long form (col_a, col_b, n, r)."""
    cols = list(columns or numeric_columns(df))
    refuse(len(cols) < 2, "correlation needs two numeric columns")
    return rows_frame(df.sparkSession, "col_a string, col_b string, n bigint, r double", _pairwise(df, cols))


def _corr_p(r: float, n: float, controls: int = 0) -> float:
    dof = n - 2 - controls
    if dof <= 0 or r is None:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    return dist.t_two_sided(r * math.sqrt(dof / (1 - r * r)), dof)


def kendall_counts(df: DataFrame, x: str, y: str) -> dict:
    """Concordant, discordant and tied pairs of two numeric columns without forming pairs."""
    pts = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))
    cd = concordance(pts, x, y, "w").collect()
    c, d = (cd[0][0], cd[0][1]) if cd else (0.0, 0.0)

    def ties(*by):
        return df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("t")).agg(
            F.sum(F.col("t") * (F.col("t") - 1) / 2)).collect()[0][0] or 0.0

    n = df.count()
    return {"n": n, "c": c, "d": d, "tx": ties(x), "ty": ties(y), "n0": n * (n - 1) / 2}


def pearson_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r with Fisher interval, Spearman on average ranks, Kendall tau-b by exact pair counts."""
    d = complete(df, [x, y])
    g = gram(d, [x, y])
    refuse(g.n < 4, "correlation needs four complete rows")
    r = g.corr()[0, 1]
    ranked = with_average_rank(with_average_rank(d, x, "rx"), y, "ry")
    rho = gram(ranked, ["rx", "ry"]).corr()[0, 1]
    k = kendall_counts(d, x, y)
    tau = (k["c"] - k["d"]) / math.sqrt((k["n0"] - k["tx"]) * (k["n0"] - k["ty"]))
    z, half = math.atanh(max(min(r, 1 - 1e-15), -1 + 1e-15)), dist.Z95 / math.sqrt(g.n - 3)
    n = g.n
    tau_z = 3 * tau * math.sqrt(n * (n - 1)) / math.sqrt(2 * (2 * n + 5))
    return one_row(df.sparkSession, n=int(n), pearson_r=r, r_squared=r * r, spearman_rho=rho, kendall_tau_b=tau,
                   ci_low=math.tanh(z - half), ci_high=math.tanh(z + half), pearson_p=_corr_p(r, n),
                   spearman_p=_corr_p(rho, n), kendall_p=dist.p_two_sided(tau_z))


def partial_correlation(df: DataFrame, x: str, y: str, covariates: Sequence[str]) -> DataFrame:
    """Correlation of x and y given covariates, from the inverse covariance matrix."""
    covs = list(covariates)
    d = complete(df, [x, y, *covs])
    g = gram(d, [x, y, *covs])
    refuse(g.n <= len(covs) + 3, "too few complete rows")
    prec = np.linalg.inv(g.corr())
    r = -prec[0, 1] / math.sqrt(prec[0, 0] * prec[1, 1])
    r0 = g.corr()[0, 1]
    dof = g.n - 2 - len(covs)
    z, half = math.atanh(r), dist.Z95 / math.sqrt(g.n - len(covs) - 3)
    return one_row(df.sparkSession, n=int(g.n), k=len(covs), zero_order_r=r0, partial_r=r, dof=int(dof),
                   t=r * math.sqrt(dof / (1 - r * r)), p=_corr_p(r, g.n, len(covs)),
                   ci_low=math.tanh(z - half), ci_high=math.tanh(z + half))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Pairwise r with p and Benjamini-Hochberg p, strongest first. Spearman ranks complete rows."""
    cols = list(columns or numeric_columns(df))
    refuse(method not in ("pearson", "spearman"), "method is pearson or spearman")
    if method == "spearman":
        d = complete(df, cols)
        for c in cols:
            d = with_average_rank(d, c, f"__rank_{c}")
        g = gram(d, [f"__rank_{c}" for c in cols])
        cm = g.corr()
        got = [(a, b, int(g.n), cm[i, j]) for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    else:
        got = _pairwise(df, cols)
    ps = [_corr_p(r, n) if r is not None else 1.0 for _, _, n, r in got]
    adj = dist.bh_adjust(ps)
    rows = sorted([(a, b, n, r, p, f) for (a, b, n, r), p, f in zip(got, ps, adj)],
                  key=lambda t: -abs(t[3] or 0))
    return rows_frame(df.sparkSession, "col_a string, col_b string, n bigint, r double, p double, p_fdr double", rows)


def vif_multicollinearity(df: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """VIF, tolerance and the condition indices of the unit-length-scaled design."""
    xs = list(predictors)
    refuse(len(xs) < 2, "two predictors are needed")
    g = gram(complete(df, xs), xs)
    inv = np.linalg.inv(g.corr(xs))
    raw = np.zeros((len(xs) + 1,) * 2)
    raw[1:, 1:] = g.raw()
    raw[0, 0], raw[0, 1:], raw[1:, 0] = g.n, g.n * g.mean, g.n * g.mean
    scale = np.sqrt(np.diag(raw))
    ev = np.linalg.eigvalsh(raw / np.outer(scale, scale))
    cond = math.sqrt(ev[-1] / max(ev[0], 1e-300))
    rows = [(c, inv[i, i], 1 / inv[i, i], 1 - 1 / inv[i, i], cond) for i, c in enumerate(xs)]
    return rows_frame(df.sparkSession, "predictor string, vif double, tolerance double, r2 double, condition_number double", rows)


def heteroskedasticity_test(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """Breusch-Pagan (Koenker) and White: n R-squared of squared residuals on X, or on X, X^2 and products."""
    xs = list(predictors)
    d = complete(df, [outcome, *xs])
    fit = ols(gram(d, [outcome, *xs]), outcome, xs)
    e = d.withColumn("__e2", (F.col(outcome) - fit.predict()) ** 2)
    # Centred products span the same space and keep the moments well scaled.
    g0 = gram(d, xs)
    sd = np.sqrt(np.diag(g0.cross) / g0.n)
    zs = [((F.col(c) - F.lit(float(m))) / F.lit(float(s))).alias(c) for c, m, s in zip(xs, g0.mean, sd)]
    e = e.select("__e2", *zs)
    aux = list(xs)
    for i, a in enumerate(xs):
        for b in xs[i:]:
            name = f"__{a}_{b}"
            e = e.withColumn(name, F.col(a) * F.col(b))
            aux.append(name)
    g = gram(e, ["__e2", *aux])
    rows = []
    for test, cols in (("breusch_pagan", xs), ("white", aux)):
        rank = int(np.linalg.matrix_rank(g.sub(cols, cols), hermitian=True))
        r2 = ols(g, "__e2", cols).r2
        lm = g.n * r2
        f = (r2 / rank) / ((1 - r2) / (g.n - rank - 1))
        rows.append((test, int(g.n), rank, lm, dist.chi2_sf(lm, rank), f, dist.f_sf(f, rank, g.n - rank - 1)))
    return rows_frame(df.sparkSession, "test string, n bigint, df bigint, lm double, lm_p double, f double, f_p double", rows)


def influence_diagnostics(df: DataFrame, outcome: str, predictors: Sequence[str], id_col: str) -> DataFrame:
    """Per row: leverage, studentised residual, Cook's D, DFFITS and the usual flags; one pass after the fit."""
    xs = list(predictors)
    d = complete(df, [outcome, *xs], [id_col])
    g = gram(d, [outcome, *xs])
    fit = ols(g, outcome, xs)
    inv, mx = fit.unscaled[1:, 1:], g.mean[g.at(xs)]
    p, n = len(xs) + 1, fit.n
    h = F.lit(1.0 / n)
    for i, a in enumerate(xs):
        for j, b in enumerate(xs):
            h = h + F.lit(float(inv[i, j])) * (F.col(a) - F.lit(float(mx[i]))) * (F.col(b) - F.lit(float(mx[j])))
    e = F.col(outcome) - fit.predict()
    s2 = fit.sigma2
    t = d.select(F.col(id_col), h.alias("leverage"), e.alias("residual"))
    loo = (F.lit(fit.rss) - F.col("residual") ** 2 / (1 - F.col("leverage"))) / F.lit(float(fit.df - 1))
    t = t.withColumn("studentized", F.col("residual") / F.sqrt(loo * (1 - F.col("leverage"))))
    t = t.withColumn("cooks_d", F.col("residual") ** 2 * F.col("leverage")
                     / (F.lit(p * s2) * (1 - F.col("leverage")) ** 2))
    t = t.withColumn("dffits", F.col("studentized") * F.sqrt(F.col("leverage") / (1 - F.col("leverage"))))
    return t.withColumn("high_leverage", F.col("leverage") > F.lit(2.0 * p / n)) \
            .withColumn("high_cooks", F.col("cooks_d") > F.lit(4.0 / n)) \
            .withColumn("high_dffits", F.abs("dffits") > F.lit(2 * math.sqrt(p / n)))


# --- distributions -----------------------------------------------------------------------------

POSITIVE = ("lognorm", "gamma", "weibull", "expon", "pareto")


def _digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    i = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def _trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def weibull_shape(d: DataFrame, time: str, event: Column | None = None, start: float = 1.0) -> tuple[float, float, float, float]:
    """Censored two-parameter Weibull by Newton on the profile equation; one aggregate per step.

    Returns (shape, scale, log-likelihood, events).
    """
    ev = F.lit(1.0) if event is None else event.cast("double")
    base = fetch(d, r=F.sum(ev), sl=F.sum(ev * F.log(time)), ml=F.avg(F.log(time)), mx=F.max(time))
    r, mean_ln, mx = float(base["r"]), base["sl"] / base["r"], float(base["mx"])
    u = F.col(time) / F.lit(mx)                     # scaled so that powers stay in range
    lu = F.log(u)
    k = start
    for _ in range(100):
        s = fetch(d, a=F.sum(F.pow(u, F.lit(k))), b=F.sum(F.pow(u, F.lit(k)) * lu),
                  c=F.sum(F.pow(u, F.lit(k)) * lu * lu))
        f = s["b"] / s["a"] - 1 / k - (mean_ln - math.log(mx))
        slope = (s["c"] * s["a"] - s["b"] ** 2) / s["a"] ** 2 + 1 / (k * k)
        new = k - f / slope
        new = new if new > 0 else k / 2
        done = abs(new - k) < 1e-10 * k
        k = new
        if done:
            break
    a = fetch(d, a=F.sum(F.pow(u, F.lit(k))))["a"]
    scale = mx * (a / r) ** (1 / k)
    ll = r * math.log(k) - r * k * math.log(scale) + (k - 1) * base["sl"] - r
    return k, scale, ll, r


def gamma_mle(mean: float, mean_log: float) -> float:
    s = math.log(mean) - mean_log
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        step = (math.log(k) - _digamma(k) - s) / (1 / k - _trigamma(k))
        k = k - step if k - step > 0 else k / 2
        if abs(step) < 1e-12 * k:
            break
    return k


def fit_family(d: DataFrame, v: str, family: str) -> dict:
    """Maximum likelihood of one family from aggregates: parameters, log-likelihood, count of parameters."""
    a = fetch(d, n=F.count(v), m=F.avg(v), s=F.stddev_pop(v), lo=F.min(v),
              ml=F.avg(F.when(F.col(v) > 0, F.log(v))), sl=F.stddev_pop(F.when(F.col(v) > 0, F.log(v))))
    n, m, s, lo = float(a["n"]), a["m"], a["s"], a["lo"]
    if family in POSITIVE and lo <= 0:
        return {}
    if family == "norm":
        ll = -n / 2 * (math.log(2 * math.pi * s * s) + 1)
        return {"params": (m, s), "ll": ll, "k": 2, "n": n}
    if family == "expon":
        # Location at the minimum, as the usual two-parameter fit does.
        sc = m - lo
        return {"params": (lo, sc), "ll": -n * (math.log(sc) + 1), "k": 2, "n": n}
    if family == "lognorm":
        mu, sg = a["ml"], a["sl"]
        return {"params": (mu, sg), "ll": -n / 2 * (math.log(2 * math.pi * sg * sg) + 1) - n * mu, "k": 2, "n": n}
    if family == "gamma":
        k = gamma_mle(m, a["ml"])
        th = m / k
        return {"params": (k, th), "ll": n * ((k - 1) * a["ml"] - m / th - k * math.log(th) - math.lgamma(k)), "k": 2, "n": n}
    if family == "weibull":
        k, sc, ll, _ = weibull_shape(d, v)
        return {"params": (k, sc), "ll": ll, "k": 2, "n": n}
    if family == "pareto":
        al = 1 / (a["ml"] - math.log(lo))
        return {"params": (al, lo), "ll": n * (math.log(al) + al * math.log(lo) - (al + 1) * a["ml"]), "k": 2, "n": n}
    raise ValueError(f"unknown family {family}")


def cdf_of(family: str, params: tuple, x: float) -> float:
    a, b = params
    if family == "norm":
        return dist.norm_cdf((x - a) / b)
    if family == "expon":
        return 1 - math.exp(-max(x - a, 0) / b)
    if family == "lognorm":
        return dist.norm_cdf((math.log(x) - a) / b) if x > 0 else 0.0
    if family == "gamma":
        return dist.gamma_p(a, x / b)
    if family == "weibull":
        return 1 - math.exp(-((x / b) ** a)) if x > 0 else 0.0
    return 1 - (b / x) ** a if x > b else 0.0


def quantile_of(family: str, params: tuple, p: float) -> float:
    a, b = params
    if family == "norm":
        return a + b * dist.norm_ppf(p)
    if family == "expon":
        return a - b * math.log(1 - p)
    if family == "lognorm":
        return math.exp(a + b * dist.norm_ppf(p))
    if family == "gamma":
        return b * dist.gamma_ppf(p, a, 1.0)
    if family == "weibull":
        return b * (-math.log(1 - p)) ** (1 / a)
    return b * (1 - p) ** (-1 / a)


def cdf_column(family: str, params: tuple, v: str) -> Column:
    """CDF of a fitted family as a column (gamma needs an Arrow batch function)."""
    a, b = (F.lit(float(z)) for z in params)
    x = F.col(v)
    if family == "norm":
        return dist.norm_cdf_col((x - a) / b)
    if family == "expon":
        return 1 - F.exp(-F.greatest(x - a, F.lit(0.0)) / b)
    if family == "lognorm":
        return dist.norm_cdf_col((F.log(x) - a) / b)
    if family == "weibull":
        return 1 - F.exp(-F.pow(x / b, a))
    if family == "pareto":
        return 1 - F.pow(b / x, a)
    k, th = float(params[0]), float(params[1])

    @F.pandas_udf(T.DoubleType())
    def gcdf(s):
        return s.map(lambda z: dist.gamma_p(k, z / th))

    return gcdf(x)


def ks_distance(d: DataFrame, v: str, family: str, params: tuple) -> float:
    """Kolmogorov-Smirnov distance on distinct values with their cumulative counts."""
    r = average_ranks(d, v)
    n = d.count()
    f = cdf_column(family, params, v)
    t = r.withColumn("__f", f).select(F.greatest(
        (F.col("n_before") + F.col("n")) / F.lit(float(n)) - F.col("__f"),
        F.col("__f") - F.col("n_before") / F.lit(float(n))).alias("d"))
    return t.agg(F.max("d")).collect()[0][0]


def distribution_fit(df: DataFrame, column: str) -> DataFrame:
    """Maximum-likelihood families ranked by AIC, with BIC and the KS distance."""
    d = complete(df, [column])
    rows = []
    for fam in ("norm", "lognorm", "gamma", "weibull", "expon"):
        f = fit_family(d, column, fam)
        if f:
            rows.append((fam, *f["params"], f["ll"], 2 * f["k"] - 2 * f["ll"],
                         f["k"] * math.log(f["n"]) - 2 * f["ll"], ks_distance(d, column, fam, f["params"])))
    rows.sort(key=lambda t: t[4])
    return rows_frame(df.sparkSession, "family string, param1 double, param2 double, loglik double, aic double, "
                      "bic double, ks double, aic_rank bigint", [(*r, i + 1) for i, r in enumerate(rows)])


def goodness_of_fit(df: DataFrame, column: str, family: str = "norm") -> DataFrame:
    """KS, Anderson-Darling and Cramer-von Mises against a fitted family.

    Sums over tied values use closed forms of the ranks inside the tie, so only distinct values are ordered.
    """
    d = complete(df, [column])
    fit = fit_family(d, column, family)
    refuse(not fit, f"{family} needs positive values")
    n = fit["n"]
    r = average_ranks(d, column).withColumn("__f", cdf_column(family, fit["params"], column))
    f = F.greatest(F.least(F.col("__f"), F.lit(1 - 1e-12)), F.lit(1e-12))
    b, c = F.col("n_before").cast("double"), F.col("n").cast("double")
    s1 = c * b + c * (c + 1) / 2                                   # sum of ranks i in the tie block
    s2 = c * b * b + b * c * (c + 1) + c * (c + 1) * (2 * c + 1) / 6   # sum of i^2
    nn = F.lit(n)
    ad = (2 * s1 - c) * F.log(f) + (2 * c * nn - 2 * s1 + c) * F.log(1 - f)
    cvm = c * f * f - 2 * f * (2 * s1 - c) / (2 * nn) + (4 * s2 - 4 * s1 + c) / (4 * nn * nn)
    got = fetch(r, ad=F.sum(ad), cvm=F.sum(cvm), ks=F.max(F.greatest((b + c) / nn - F.col("__f"), F.col("__f") - b / nn)))
    return one_row(df.sparkSession, family=family, n=int(n), param1=float(fit["params"][0]), param2=float(fit["params"][1]),
                   ks=got["ks"], anderson_darling=-n - got["ad"] / n, cramer_von_mises=1 / (12 * n) + got["cvm"])


@F.pandas_udf(T.DoubleType())
def inverse_normal(p: pd.Series) -> pd.Series:
    """Standard normal quantile per Arrow batch: rational start (A&S 26.2.23), then Newton steps on erfc."""
    v = p.to_numpy(float)
    q = np.minimum(v, 1 - v)
    t = np.sqrt(-2 * np.log(q))
    # Coefficients of Abramowitz & Stegun 26.2.23.
    x = -(t - (2.515517 + 0.802853 * t + 0.010328 * t * t)
          / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t ** 3))
    erfc = np.frompyfunc(math.erfc, 1, 1)
    for _ in range(3):
        cdf = 0.5 * erfc(-x / math.sqrt(2)).astype(float)
        x = x - (cdf - q) * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
    return pd.Series(np.where(v < 0.5, x, -x))


def qq_analysis(df: DataFrame, column: str, id_col: str) -> DataFrame:
    """Sorted values against normal quantiles at (i - 0.5)/n: PPCC, least-squares line, one row."""
    d = complete(df, [column], [id_col])
    n = float(d.count())
    refuse(n < 3, "three rows are needed")
    pos = sorted_position(d, column, [id_col], "i")
    t = pos.select(F.col(column).alias("y"), inverse_normal((F.col("i") - 0.5) / F.lit(n)).alias("q"))
    g = gram(t, ["y", "q"])
    slope = g.cross[0, 1] / g.cross[1, 1]
    return one_row(df.sparkSession, n=int(n), ppcc=g.corr()[0, 1], slope=slope, intercept=g.mean[0] - slope * g.mean[1])


def kernel_density(df: DataFrame, column: str, bandwidth: str = "silverman", grid: int = 1000) -> DataFrame:
    """Gaussian density on an even grid from binned counts, with local maxima of at least 1% of the peak.

    Values are first counted in bins an eighth of a bandwidth wide, so the kernel sum runs over bins that
    lie within eight bandwidths of a grid point, whatever the number of rows.
    """
    d = complete(df, [column])
    a = fetch(d, n=F.count(column), s=F.stddev_samp(column), lo=F.min(column), hi=F.max(column))
    quart = quantiles(d, column, [0.25, 0.75])
    n, s = float(a["n"]), a["s"]
    refuse(n < 5 or not s, "kernel density needs five rows that vary")
    iqr = quart[1] - quart[0]
    spread = min(s, iqr / 1.349) if iqr > 0 else s
    silverman, scott = 0.9 * spread * n ** -0.2, s * n ** -0.2
    h = silverman if bandwidth == "silverman" else scott if bandwidth == "scott" else float(bandwidth)
    lo, hi = a["lo"] - 3 * h, a["hi"] + 3 * h
    step = (hi - lo) / (grid - 1)
    width = h / 8
    bins = (d.groupBy(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)).alias("b"))
            .agg(F.count(F.lit(1)).alias("c"), F.avg(column).alias("v")))
    # Each bin reaches the grid points within eight bandwidths only.
    first = F.greatest(F.ceil((F.col("v") - F.lit(lo + 8 * h)) / F.lit(step)), F.lit(0))
    last = F.least(F.floor((F.col("v") - F.lit(lo - 8 * h)) / F.lit(step)), F.lit(grid - 1))
    reach = bins.withColumn("g", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    z = (F.lit(lo) + F.col("g") * F.lit(step) - F.col("v")) / F.lit(h)
    dens = reach.groupBy("g").agg((F.sum(F.col("c") * F.exp(-z * z / 2)) / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density"))
    full = df.sparkSession.range(grid).select(F.col("id").cast("int").alias("g")).join(dens, "g", "left")
    w = Window.orderBy("g")                          # `grid` rows: a fixed, small table
    dd = F.coalesce(F.col("density"), F.lit(0.0))
    t = full.select("g", (F.lit(lo) + F.col("g") * F.lit(step)).alias("x"), dd.alias("density"))
    t = t.select("*", F.lag("density").over(w).alias("p"), F.lead("density").over(w).alias("s"),
                 F.max("density").over(Window.partitionBy()).alias("peak"))
    mode = (F.col("density") > F.col("p")) & (F.col("density") >= F.col("s")) & (F.col("density") >= 0.01 * F.col("peak"))
    return t.select(F.col("g").cast("bigint").alias("grid_point"), "x", "density", F.coalesce(mode, F.lit(False)).alias("is_mode"),
                    F.lit(h).alias("bandwidth"), F.lit(silverman).alias("silverman"), F.lit(scott).alias("scott"))


def tail_index(df: DataFrame, column: str, k_frac: float = 0.10, tail: str = "upper") -> DataFrame:
    """Hill estimator over k and its median over the 20-60% band of k.

    Only values that can be among the k_max + 1 largest are ordered: a quantile cut keeps the sort small,
    ties at a value share its log, so ranks come from distinct values expanded over their counts.
    """
    d = complete(df, [column])
    d = d.select((F.col(column) if tail == "upper" else -F.col(column)).alias("x")).where("x > 0")
    n = d.count()
    refuse(n < 10, "ten positive values are needed")
    frac = min(max(k_frac, 0.02), 0.5)
    k_max = max(5, min(int(frac * n), n - 2))
    r = average_ranks(d, "x").select("x", "n", F.lit(n).alias("total"), "n_before")
    # rank from the top of the first copy: total - n_before - n + 1
    top = r.withColumn("ahead", F.col("total") - F.col("n_before") - F.col("n")).where(F.col("ahead") <= k_max)
    top = top.withColumn("s", F.col("n") * F.log("x"))
    run = cumulate(top.select("x", "n", "ahead", "s"), "x", ["s"], descending=True)
    # k runs over positions whose next order statistic differs; within a tie the sum is linear in k.
    nxt = Window.orderBy(F.col("x").desc())
    each = run.withColumn("k", F.explode(F.expr("sequence(ahead, least(ahead + n, %d))" % (k_max + 1))))
    each = each.where((F.col("k") >= 1) & (F.col("k") > F.col("ahead")))
    # X(k+1) for k = position of this copy minus one: use pairs (k-1 terms above, this value).
    h = each.select((F.col("k") - 1).cast("bigint").alias("k"),
                    ((F.col("s_before") + (F.col("k") - 1 - F.col("ahead")) * F.log("x")) / (F.col("k") - 1)
                     - F.log("x")).alias("mean_excess")).where("k >= 1 and mean_excess > 0")
    return h.select("k", (1 / F.col("mean_excess")).alias("alpha"),
                    F.col("k").between(F.lit(int(round(0.2 * k_max))), F.lit(int(round(0.6 * k_max)))).alias("in_band"))


def tail_index_stable(df: DataFrame, column: str, k_frac: float = 0.10, tail: str = "upper") -> DataFrame:
    t = tail_index(df, column, k_frac, tail)
    med = quantiles(t.where("in_band"), "alpha", [0.5])[0]
    return t.agg(F.count(F.lit(1)).alias("n_k"), F.lit(med).alias("alpha"))


def finite_mixture(df: DataFrame, column: str, max_k: int = 5, seed: int = 0) -> DataFrame:
    """One-dimensional Gaussian mixtures k = 1..max_k by BIC (MLlib EM)."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler
    d = complete(df, [column])
    n = d.count()
    refuse(n < 10, "ten rows are needed")
    v = VectorAssembler(inputCols=[column], outputCol="f").transform(d).select("f").persist()
    rows = []
    try:
        one = fit_family(d, column, "norm")
        rows.append((1, one["ll"], 2 * math.log(n) - 2 * one["ll"], one["params"][0], one["params"][0]))
        for k in range(2, max_k + 1):
            m = GaussianMixture(k=k, featuresCol="f", seed=seed, maxIter=100, tol=1e-3).fit(v)
            ll = m.summary.logLikelihood
            means = [float(g.mean[0]) for g in m.gaussians]
            rows.append((k, ll, (3 * k - 1) * math.log(n) - 2 * ll, min(means), max(means)))
    finally:
        v.unpersist()
    best = min(r[2] for r in rows)
    return rows_frame(df.sparkSession, "k bigint, loglik double, bic double, min_mean double, max_mean double, "
                      "is_best boolean, delta_bic_vs_one double",
                      [(*r, r[2] == best, rows[0][2] - r[2]) for r in rows])


def loss_distribution(df: DataFrame, loss: str) -> DataFrame:
    """Severity families by AIC; VaR from the best family, TVaR from losses at or above VaR, at 95 and 99."""
    d = complete(df, [loss]).where(F.col(loss) > 0)
    fits = {f: fit_family(d, loss, f) for f in ("lognorm", "gamma", "pareto", "weibull")}
    aic = {f: 2 * v["k"] - 2 * v["ll"] for f, v in fits.items()}
    best = min(aic, key=aic.get)
    var = {a: quantile_of(best, fits[best]["params"], a) for a in (0.95, 0.99)}
    emp = quantiles(d, loss, [0.95, 0.99])
    t = fetch(d, t95=F.avg(F.when(F.col(loss) >= emp[0], F.col(loss))), t99=F.avg(F.when(F.col(loss) >= emp[1], F.col(loss))))
    rows = [(f, *fits[f]["params"], aic[f], f == best, *( (var[0.95], var[0.99]) if f == best else (None, None)),
             emp[0], emp[1], t["t95"], t["t99"]) for f in fits]
    return rows_frame(df.sparkSession, "family string, param1 double, param2 double, aic double, is_best boolean, "
                      "var95 double, var99 double, empirical_var95 double, empirical_var99 double, "
                      "tvar95 double, tvar99 double", rows)


# --- autocorrelation ---------------------------------------------------------------------------

def _autocorr(df: DataFrame, value: str, order: str, keys: Sequence[str], nlags: int) -> list[dict]:
    """Per key: n and autocorrelations 1..nlags, from one windowed pass per key.

    A key's series is first taken as given (one row per time); the lags are window offsets in time order.
    """
    d = df.select(*keys, F.col(order).alias("__o"), num(value).alias("v")).dropna()
    w = Window.partitionBy(*keys).orderBy("__o")
    m = d.groupBy(*keys).agg(F.avg("v").alias("m")) if keys else d.agg(F.avg("v").alias("m"))
    c = (d.join(m, list(keys)) if keys else d.crossJoin(F.broadcast(m))).withColumn("c", F.col("v") - F.col("m"))
    c = c.select(*keys, "c", *[(F.col("c") * F.lag("c", k).over(w)).alias(f"p{k}") for k in range(1, nlags + 1)])
    rows = collect_bounded(c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c") ** 2).alias("s0"),
                                                *[F.sum(f"p{k}").alias(f"s{k}") for k in range(1, nlags + 1)]), "series")
    out = []
    for r in rows:
        refuse(not r["s0"], "a series is constant")
        out.append({"key": tuple(r[k] for k in keys), "n": r["n"], "s0": r["s0"],
                    "rho": [(r[f"s{k}"] or 0.0) / r["s0"] for k in range(1, nlags + 1)]})
    return out


def _durbin_levinson(gamma: Sequence[float]) -> list[float]:
    """Partial autocorrelations from autocovariances 0..K."""
    phi: list[float] = []
    v = gamma[0]
    out = []
    for k in range(1, len(gamma)):
        a = (gamma[k] - sum(phi[j] * gamma[k - 1 - j] for j in range(len(phi)))) / v
        phi = [phi[j] - a * phi[len(phi) - 1 - j] for j in range(len(phi))] + [a]
        v *= 1 - a * a
        out.append(a)
    return out


def acf_pacf(df: DataFrame, value: str, order: str, keys: Sequence[str] = (), nlags: int = 20) -> DataFrame:
    """ACF and Yule-Walker PACF by lag with the 1.96/sqrt(n) band, and the AR/MA hint."""
    rows = []
    keys = list(keys)
    for s in _autocorr(df, value, order, keys, nlags):
        n, rho = s["n"], s["rho"]
        # "modified" Yule-Walker: autocovariances with denominator n - k scaled back by n
        pac = _durbin_levinson([1.0, *rho])
        band = 1.96 / math.sqrt(n)

        def run(x):
            for i, v in enumerate(x):
                if abs(v) <= band:
                    return i
            return len(x)

        for k in range(nlags):
            rows.append((*s["key"], k + 1, n, rho[k], pac[k], band, abs(rho[k]) > band, abs(pac[k]) > band,
                         run(pac), run(rho)))
    ks = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows_frame(df.sparkSession, (ks + ", " if ks else "") +
                      "lag bigint, n bigint, acf double, pacf double, band double, acf_out boolean, pacf_out boolean, "
                      "ar_hint bigint, ma_hint bigint", rows)


def ljung_box(df: DataFrame, value: str, order: str, keys: Sequence[str] = (), lags: int | None = None) -> DataFrame:
    """Q = n(n+2) sum rho_k^2/(n-k) and its chi-square p per series."""
    keys = list(keys)
    most = lags or 10
    rows = []
    for s in _autocorr(df, value, order, keys, most):
        n = s["n"]
        m = lags or (10 if n >= 50 else max(1, n // 5))
        qv = n * (n + 2) * sum(r * r / (n - k - 1) for k, r in enumerate(s["rho"][:m]))
        rows.append((*s["key"], n, m, qv, dist.chi2_sf(qv, m)))
    ks = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows_frame(df.sparkSession, (ks + ", " if ks else "") + "n bigint, lags bigint, q double, p double", rows)


def hurst_exponent(df: DataFrame, value: str, order: str, keys: Sequence[str] = (), sizes: int = 12) -> DataFrame:
    """Rescaled range over a geometric grid of window sizes; the log-log slope is H.

    Every row is replicated once per size (a fixed factor) and grouped by (key, size, block), so the
    cumulative deviations are short windows, never one long one.
    """
    keys = list(keys)
    d = df.select(*keys, F.col(order).alias("__o"), num(value).alias("v")).dropna()
    w = Window.partitionBy(*keys).orderBy("__o")
    d = d.withColumn("i", F.row_number().over(w) - 1)
    longest = d.agg(F.max("i")).collect()[0][0] + 1
    refuse(longest < 20, "twenty points are needed")
    grid = sorted({int(round(x)) for x in np.geomspace(8, longest // 2, sizes)})
    e = d.withColumn("size", F.explode(F.array(*[F.lit(g) for g in grid])))
    n_key = d.groupBy(*keys).agg((F.max("i") + 1).alias("n")) if keys else d.agg((F.max("i") + 1).alias("n"))
    e = (e.join(n_key, keys) if keys else e.crossJoin(F.broadcast(n_key)))
    e = e.where(F.col("size") <= F.floor(F.col("n") / 2))
    e = e.withColumn("b", F.floor(F.col("i") / F.col("size"))).where(F.col("b") < F.floor(F.col("n") / F.col("size")))
    blk = [*keys, "size", "b"]
    full = Window.partitionBy(*blk)
    e = e.withColumn("dev", F.col("v") - F.avg("v").over(full))
    e = e.withColumn("cum", F.sum("dev").over(full.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    rs = e.groupBy(*blk).agg(((F.max("cum") - F.min("cum")) / F.nullif(F.stddev_pop("v"), F.lit(0.0))).alias("rs"))
    pts = rs.groupBy(*keys, "size").agg(F.avg("rs").alias("rs")).where("rs > 0")
    lx, ly = F.log("size"), F.log("rs")
    g = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("sizes"), F.covar_pop(lx, ly).alias("c"), F.var_pop(lx).alias("vx"),
                               F.var_pop(ly).alias("vy")).where("sizes >= 3")
    h = F.col("c") / F.col("vx")
    return g.select(*keys, F.col("sizes").cast("bigint").alias("sizes"), h.alias("hurst"),
                    F.try_divide(F.col("c") ** 2, F.col("vx") * F.col("vy")).alias("r2"),
                    F.when(h < 0.45, "mean_reverting").when(h > 0.55, "persistent").otherwise("random_walk").alias("regime"))


def missingness_diagnosis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing-data patterns with their frequency (one letter per column: 1 missing, 0 present)."""
    cols = list(columns or df.columns)
    need(df, *cols)
    nums = set(numeric_columns(df))
    flag = {c: (num(c).isNull() if c in nums else F.col(c).isNull()) for c in cols}
    pat = F.concat(*[F.when(flag[c], "1").otherwise("0") for c in cols])
    t = df.select(pat.alias("pattern"), sum([F.when(flag[c], 1).otherwise(0) for c in cols], F.lit(0)).alias("m"))
    return t.groupBy("pattern").agg(F.max("m").cast("bigint").alias("n_missing"), F.count(F.lit(1)).alias("rows"))


def missing_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = list(columns or df.columns)
    nums = set(numeric_columns(df))
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(num(c).isNull() if c in nums else F.col(c).isNull(), 1)
                                                    .otherwise(0)).alias(f"m{i}") for i, c in enumerate(cols)]).collect()[0]
    return rows_frame(df.sparkSession, "column string, n_missing bigint, rate double",
                      [(c, r[f"m{i}"] or 0, (r[f"m{i}"] or 0) / r["n"]) for i, c in enumerate(cols)])


def mcar_screen(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Association screen: each null flag on the other numeric columns by logistic fit, LR chi-square each."""
    from .glm import logit_fit
    nums = [c for c in columns if c in numeric_columns(df)]
    rows = []
    for c in nums:
        others = [o for o in nums if o != c]
        d = df.select(F.when(num(c).isNull(), 1.0).otherwise(0.0).alias("__y"), *[num(o).alias(o) for o in others]).dropna()
        t = fetch(d, n=F.count(F.lit(1)), k=F.sum("__y"))
        if not others or not t["k"] or t["k"] == t["n"]:
            continue
        f = logit_fit(d, "__y", others)
        lr = 2 * (f.ll - f.ll0)
        rows.append((c, int(t["n"]), int(t["k"]), len(others), lr, dist.chi2_sf(lr, len(others))))
    return rows_frame(df.sparkSession, "column string, n bigint, n_missing bigint, df bigint, lr_chi2 double, p double", rows)
