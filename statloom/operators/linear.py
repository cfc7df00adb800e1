"""Linear, panel, generalised linear and limited-outcome models."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dist
from ..functions.special import lgamma, norm_logcdf, norm_logpdf, softplus
from ..plans.frames import (binary01, collect_bounded, complete, fetch, level_key, levels_of, need, num, one_row, refuse, rows_frame)
from ..plans.gram import Fit, Gram, gram, gram_by, merge, ols, r2_of, robust_vcov, weighted_gram
from ..plans.mle import Mle, fit_mle
from .glm import _logit, linear, logit_fit, newton_glm

COEF = "term string, coef double, se double, t double, p double"


def coef_rows(terms, beta, vcov, dof=None):
    for t, b, v in zip(terms, beta, np.diag(vcov)):
        s = math.sqrt(max(v, 0))
        z = b / s if s > 0 else float("nan")
        p = (dist.t_two_sided(z, dof) if dof else dist.p_two_sided(z)) if s > 0 else float("nan")
        yield t, float(b), s, float(z), p


def _ols(df, y, xs, other=()):
    xs = list(xs)
    refuse(not xs, "a predictor is needed")
    d = complete(df, [y, *xs], other)
    return d, ols(gram(d, [y, *xs]), y, xs)


def ols_regression(df: DataFrame, outcome: str, predictors: Sequence[str], cluster: str | None = None) -> DataFrame:
    """OLS with HC1 or cluster-robust errors, R-squared and F."""
    d, f = _ols(df, outcome, predictors, [cluster] if cluster else [])
    v = robust_vcov(d, f, outcome, cluster)
    k = len(f.terms) - 1
    fs = (f.r2 / k) / ((1 - f.r2) / f.df)
    return rows_frame(df.sparkSession, COEF + ", n bigint, r2 double, adj_r2 double, f double",
                      [(*r, int(f.n), f.r2, 1 - (1 - f.r2) * (f.n - 1) / f.df, fs) for r in coef_rows(f.terms, f.beta, v, f.df)])


def is_balanced(d: DataFrame, unit: str, time: str) -> bool:
    """One row for every unit in every period."""
    cells = fetch(d.groupBy(unit, time).count(), n=F.count(F.lit(1)), most=F.max("count"))
    units, times = d.select(unit).distinct().count(), d.select(time).distinct().count()
    return cells["most"] == 1 and cells["n"] == units * times


def demean(d: DataFrame, cols: Sequence[str], unit: str, time: str | None, most: int = 500, tol: float = 1e-13) -> DataFrame:
    """Within transformation: exact in one step for balanced panels, alternating projections otherwise."""
    from ..plans.frames import cut_lineage
    t = d
    us = [unit] + ([time] if time else [])
    if not time or is_balanced(t, unit, time):
        m = t.groupBy(unit).agg(*[F.avg(c).alias(f"__u_{c}") for c in cols])
        t = t.join(m, unit)
        if time:
            m2 = t.groupBy(time).agg(*[F.avg(c).alias(f"__t_{c}") for c in cols])
            g = t.agg(*[F.avg(c).alias(f"__g_{c}") for c in cols])
            t = t.join(m2, time).crossJoin(F.broadcast(g))
        return t.select(*[c for c in d.columns if c not in cols], *[
            (F.col(c) - F.col(f"__u_{c}") - (F.col(f"__t_{c}") - F.col(f"__g_{c}") if time else F.lit(0.0))).alias(c) for c in cols])
    size = fetch(t, **{c: F.max(F.abs(c)) for c in cols})
    for _ in range(most):
        for u in us:
            m = t.groupBy(u).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
            t = t.join(m, u).select(*[c for c in d.columns if c not in cols], *[(F.col(c) - F.col(f"__m_{c}")).alias(c) for c in cols])
        t = cut_lineage(t)
        err = fetch(t.groupBy(unit).agg(*[F.avg(c).alias(c) for c in cols]), **{c: F.max(F.abs(c)) for c in cols})
        if all(e is None or e <= tol * s for e, s in zip(err, size)):
            return t
    refuse(True, f"the two-way means had not settled after {most} rounds")


def within_fit(d: DataFrame, y: str, xs: Sequence[str], unit: str, time: str | None) -> tuple[Fit, np.ndarray, float]:
    """Fixed-effects slopes with unit-cluster covariance. Returns (fit without meaning for its intercept, vcov, within R2)."""
    xs = list(xs)
    w = demean(d, [y, *xs], unit, time).persist()
    try:
        g = gram(w, [y, *xs])
        f = ols(g, y, xs)
        from ..plans.gram import score_meat
        resid = F.col(y) - f.predict()
        m, groups = score_meat(w, xs, resid, cluster=unit)
        inv = f.unscaled[1:, 1:]
        n, k = g.n, len(xs)
        v = groups / (groups - 1) * (n - 1) / (n - k) * inv @ m[1:, 1:] @ inv
        return f, v, f.r2
    finally:
        w.unpersist()


def panel_fixed_effects(df: DataFrame, outcome: str, predictors: Sequence[str], unit: str, time: str | None) -> DataFrame:
    """Two-way fixed effects with errors clustered by unit."""
    d = complete(df, [outcome, *predictors], [unit] + ([time] if time else []))
    f, v, r2 = within_fit(d, outcome, predictors, unit, time)
    return rows_frame(df.sparkSession, COEF + ", n bigint, within_r2 double", [(*r, int(f.n), r2) for r in coef_rows(f.terms[1:], f.beta[1:], v)])


def did(df: DataFrame, outcome: str, treatment: str, unit: str, time: str, controls: Sequence[str] = ()) -> DataFrame:
    """Two-way fixed-effects difference in differences on a treatment indicator that changes within units."""
    vary = fetch(df.groupBy(unit).agg(F.count_distinct(treatment).alias("k")), s=F.avg(F.when(F.col("k") > 1, 1.0).otherwise(0.0)))["s"]
    refuse(not vary, "the treatment never changes within a unit")
    return panel_fixed_effects(df, outcome, [treatment, *controls], unit, time)


# --- binary and categorical -----------------------------------------------------------------------

def logistic_regression(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """Coefficients, odds ratios, pseudo R-squared, and the separation warning."""
    xs = list(predictors)
    y, *_ = binary01(df, outcome)
    d = complete(df.select(y.alias("__y"), *xs), ["__y", *xs])
    f = logit_fit(d, "__y", xs)
    rows = [(t, b, s, z, p, math.exp(min(b, 700)), math.exp(min(b - dist.Z95 * s, 700)), math.exp(min(b + dist.Z95 * s, 700)), int(f.n), f.ll, 1 - f.ll / f.ll0, bool(s > 50 and p > 0.99))
            for t, b, s, z, p in f.table()]
    return rows_frame(df.sparkSession, COEF + ", odds_ratio double, or_low double, or_high double, n bigint, loglik double, pseudo_r2 double, separation boolean", rows)


def _categories(df, outcome, xs, most=12):
    d = complete(df, xs, [outcome])
    lv = levels_of(d, outcome, 200)
    refuse(not 2 <= len(lv) <= most, f"two to {most} outcome levels are needed")
    code = F.create_map(*[x for i, v in enumerate(lv) for x in (F.lit(v), F.lit(float(i)))])[F.col(outcome)]
    return d.select(code.alias("__y"), *xs), lv


def _mnl_ll(k):
    def ll(eta, y):
        m = np.vstack([np.zeros_like(eta[0])] + list(eta))
        top = m.max(0)
        lse = top + np.log(np.exp(m - top).sum(0))
        return m[y["__y"].astype(int), np.arange(m.shape[1])] - lse
    return ll


def multinomial_logit(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """Relative risk ratios of every level against the first, McFadden R-squared."""
    xs = list(predictors)
    d, lv = _categories(df, outcome, xs)
    f = fit_mle(d, ["__y"], [(str(v), xs, True) for v in lv[1:]], _mnl_ll(len(lv)))
    cnt = [r["count"] for r in d.groupBy("__y").count().collect()]
    ll0 = sum(c * math.log(c / f.n) for c in cnt)
    return rows_frame(df.sparkSession, "level string, " + COEF + ", rrr double, base string, n bigint, loglik double, mcfadden_r2 double",
                      [(*t.split(":", 1), b, s, z, p, math.exp(b), str(lv[0]), int(f.n), f.ll, 1 - f.ll / ll0) for t, b, s, z, p in f.rows()])


mnl_choice = multinomial_logit


def conditional_logit(df: DataFrame, choice_id: str, chosen: str, attributes: Sequence[str], cost: str | None = None, most: int = 50) -> DataFrame:
    """McFadden's model on alternative attributes; exactly one chosen row per set; WTP against the cost.

    A step sums exp(x'b) and its products per choice set, then aggregates the sets: two grouped sums, no window.
    """
    xs = list(attributes)
    k = len(xs)
    d = complete(df, [chosen, *xs], [choice_id])
    bad = d.groupBy(choice_id).agg(F.sum(chosen).alias("s")).where("s <> 1").limit(1).count()
    refuse(bad > 0, "every choice set needs exactly one chosen alternative")
    mom = fetch(d, **{f"s{i}": F.stddev_pop(c) for i, c in enumerate(xs)}, **{f"m{i}": F.avg(c) for i, c in enumerate(xs)})
    sc = np.array([mom[f"s{i}"] or 1.0 for i in range(k)])
    z = d.select(choice_id, F.col(chosen).alias("c"), *[((F.col(c) - F.lit(mom[f"m{i}"])) / F.lit(float(sc[i]))).alias(f"x{i}") for i, c in enumerate(xs)]).persist()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def at(b):
        eta = sum([F.col(f"x{i}") * F.lit(float(b[i])) for i in range(k)], F.lit(0.0))
        w = F.exp(eta)
        g = z.groupBy(choice_id).agg(F.sum(F.col("c") * eta).alias("u"), F.sum(w).alias("s0"), *[F.sum(F.col("c") * F.col(f"x{i}")).alias(f"c{i}") for i in range(k)],
                                     *[F.sum(w * F.col(f"x{i}")).alias(f"s{i + 1}") for i in range(k)], *[F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in pairs])
        r = fetch(g, n=F.count(F.lit(1)), ll=F.sum(F.col("u") - F.log("s0")), **{f"g{i}": F.sum(F.col(f"c{i}") - F.col(f"s{i + 1}") / F.col("s0")) for i in range(k)},
                  **{f"h{i}_{j}": F.sum(F.col(f"q{i}_{j}") / F.col("s0") - F.col(f"s{i + 1}") * F.col(f"s{j + 1}") / F.col("s0") ** 2) for i, j in pairs})
        h = np.zeros((k, k))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        return r["ll"], np.array([r[f"g{i}"] for i in range(k)]), h, r["n"]

    try:
        b = np.zeros(k)
        ll, g, h, n = at(b)
        ll0 = ll
        for _ in range(most):
            step = np.linalg.lstsq(h, g, rcond=None)[0]
            if float(g @ step) < 1e-9 * (1 + abs(ll)):
                break
            f = 1.0
            while True:
                c = at(b + f * step)
                if c[0] >= ll or f < 1e-3:
                    break
                f /= 2
            b = b + f * step
            ll, g, h, n = c
    finally:
        z.unpersist()
    beta, v = b / sc, np.linalg.pinv(h, hermitian=True) / np.outer(sc, sc)
    bc = beta[xs.index(cost)] if cost in xs else None
    return rows_frame(df.sparkSession, COEF + ", wtp double, sets bigint, loglik double, mcfadden_r2 double",
                      [(*r, -r[1] / bc if bc and r[0] != cost else None, n, ll, 1 - ll / ll0) for r in coef_rows(xs, beta, v)])


def _ordered_ll(levels: int, probit: bool):
    def cdf_log(a, b):
        """log(F(b) - F(a)) for a < b, either end may be infinite."""
        if probit:
            flip = np.where(np.isfinite(a), a, -1.0) > 0
            lo, hi = np.where(flip, -b, a), np.where(flip, -a, b)
            lh, ll_ = norm_logcdf(np.clip(hi, -38, 38)), norm_logcdf(np.clip(lo, -38, 38))
            return lh + np.log1p(-np.exp(np.minimum(ll_ - lh, -1e-15)))
        lh = np.where(np.isfinite(b), -softplus(-np.clip(b, -700, 700)), 0.0)
        ll_ = np.where(np.isfinite(a), -softplus(-np.clip(a, -700, 700)), -800.0)
        return lh + np.log1p(-np.exp(np.minimum(ll_ - lh, -1e-15)))

    def ll(eta, y):
        xb, cuts = eta[0], [eta[1]]
        for e in eta[2:]:
            cuts.append(cuts[-1] + np.exp(e))
        c = np.vstack([np.full_like(xb, -np.inf)] + cuts + [np.full_like(xb, np.inf)])
        k = y["__y"].astype(int)
        r = np.arange(len(xb))
        return cdf_log(c[k, r] - xb, c[k + 1, r] - xb)
    return ll


def ordered_fit(df: DataFrame, outcome: str, predictors: Sequence[str], probit: bool = False) -> tuple[Mle, list, np.ndarray, float]:
    xs = list(predictors)
    d, lv = _categories(df, outcome, xs)
    refuse(len(lv) < 3, "three ordered levels are needed")
    cnt = {int(r["__y"]): r["count"] for r in d.groupBy("__y").count().collect()}
    n = sum(cnt.values())
    cum = np.cumsum([cnt[i] for i in range(len(lv) - 1)]) / n
    th = [dist.norm_ppf(c) if probit else math.log(c / (1 - c)) for c in cum]
    start = [[0.0] * len(xs), [th[0]]] + [[math.log(max(b - a, 1e-6))] for a, b in zip(th, th[1:])]
    blocks = [("x", xs, False)] + [(f"cut{i + 1}", [], True) for i in range(len(lv) - 1)]
    # Columns without intercept are not centred, so centre them here: cutpoints absorb the shift.
    m = fetch(d, **{f"m{i}": F.avg(c) for i, c in enumerate(xs)})
    c = d.select("__y", *[(F.col(x) - F.lit(m[f"m{i}"])).alias(x) for i, x in enumerate(xs)])
    f = fit_mle(c, ["__y"], blocks, _ordered_ll(len(lv), probit), start)
    cuts = [f.beta[len(xs)]]
    for e in f.beta[len(xs) + 1:]:
        cuts.append(cuts[-1] + math.exp(e))
    shift = sum(b * m[f"m{i}"] for i, b in enumerate(f.beta[:len(xs)]))
    ll0 = sum(v * math.log(v / n) for v in cnt.values())
    return f, lv, np.array(cuts) + shift, ll0


def _ordered_frame(df, xs, res):
    f, lv, cuts, ll0 = res
    k = len(xs)
    lr = 2 * (f.ll - ll0)
    rows = [(t.split(":")[-1], b, s, z, p, math.exp(b)) for t, b, s, z, p in list(f.rows())[:k]]
    rows += [(f"cut_{a}|{b}", float(c), None, None, None, None) for a, b, c in zip(lv, lv[1:], cuts)]
    return rows_frame(df.sparkSession, COEF + ", exp_coef double, n bigint, loglik double, mcfadden_r2 double, lr_chi2 double, lr_p double",
                      [(*r, int(f.n), f.ll, 1 - f.ll / ll0, lr, dist.chi2_sf(lr, k)) for r in rows])


def ordered_logit(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """Proportional odds with cutpoints and odds ratios."""
    return _ordered_frame(df, list(predictors), ordered_fit(df, outcome, predictors))


proportional_odds_logit = ordered_logit


def ordered_probit(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    return _ordered_frame(df, list(predictors), ordered_fit(df, outcome, predictors, True))


def brant_test(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """Binary logits of y > k and a Wald test of equal slopes per predictor (independent-split covariance)."""
    xs = list(predictors)
    d, lv = _categories(df, outcome, xs)
    refuse(len(lv) < 3, "three ordered levels are needed")
    fits = [logit_fit(d.withColumn("__b", F.when(F.col("__y") > k, 1.0).otherwise(0.0)), "__b", xs) for k in range(len(lv) - 1)]
    rows = []
    m = len(fits)
    for i, x in enumerate(xs):
        b = np.array([f.beta[i + 1] for f in fits])
        w = 1 / np.array([f.vcov[i + 1, i + 1] for f in fits])
        mean = (w * b).sum() / w.sum()
        chi = float((w * (b - mean) ** 2).sum())
        rows.append((x, float(b.min()), float(b.max()), float(b.max() - b.min()), chi, m - 1, dist.chi2_sf(chi, m - 1)))
    return rows_frame(df.sparkSession, "predictor string, min_slope double, max_slope double, spread double, chi2 double, df bigint, p double", rows)


# --- counts ---------------------------------------------------------------------------------------

def _count_data(df, y, xs):
    d = complete(df, [y, *xs])
    r = fetch(d, lo=F.min(y), m=F.avg(y))
    refuse(r["lo"] is None or r["lo"] < 0, "the outcome must be a non-negative count")
    return d, r["m"]


def poisson_fit(df, y, xs):
    d, m = _count_data(df, y, xs)
    return d, newton_glm(d, y, xs, lambda yy, eta: (yy * eta - F.exp(eta), yy - F.exp(eta), F.exp(eta)), np.array([math.log(max(m, 1e-9))]))


def poisson_regression(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """Incidence-rate ratios and the Pearson dispersion."""
    xs = list(predictors)
    d, f = poisson_fit(df, outcome, xs)
    mu = F.exp(linear(xs, f.beta))
    phi = fetch(d, x=F.sum((F.col(outcome) - mu) ** 2 / mu))["x"] / (f.n - len(xs) - 1)
    return rows_frame(df.sparkSession, COEF + ", irr double, n bigint, dispersion double", [(t, b, s, z, p, math.exp(b), int(f.n), phi) for t, b, s, z, p in f.table()])


def _nb(eta, y, la):
    a = np.exp(np.clip(-la, -30, 30))                   # 1 / alpha
    mu = np.exp(np.clip(eta, -30, 30))
    return lgamma(y + a) - lgamma(a) - lgamma(y + 1) - a * np.log1p(mu / a) + y * (np.log(mu) - np.log(mu + a))


def _pois(eta, y):
    return y * eta - np.exp(np.clip(eta, -30, 30)) - lgamma(y + 1)


def count_fits(df: DataFrame, outcome: str, predictors: Sequence[str], kinds: Sequence[str]) -> dict[str, Mle]:
    xs = list(predictors)
    d, m = _count_data(df, outcome, xs)
    d = d.select(F.col(outcome).alias("__y"), *xs)
    zero = fetch(d, z=F.avg(F.when(F.col("__y") == 0, 1.0).otherwise(0.0)), v=F.var_samp("__y"))
    b0 = [math.log(max(m, 1e-9)), *[0.0] * len(xs)]
    z0 = min(max((zero["z"] - math.exp(-m)) / max(1 - math.exp(-m), 1e-6), 0.02), 0.95)
    a0 = math.log(min(max((zero["v"] - m) / (m * m), 1e-2), 10.0)) if m > 0 else 0.0

    def zi(base):
        def ll(eta, y):
            yy = y["__y"]
            f = base(eta[0], yy, *eta[2:])
            lz = eta[1]
            return np.where(yy == 0, np.logaddexp(lz, f), f) - softplus(lz)
        return ll

    mod = {"poisson": ([("mu", xs, True)], lambda e, y: _pois(e[0], y["__y"]), [b0]),
           "negbin": ([("mu", xs, True), ("log_alpha", [], True)], lambda e, y: _nb(e[0], y["__y"], e[1]), [b0, [a0]]),
           "zip": ([("mu", xs, True), ("zero", xs, True)], zi(_pois), [b0, [math.log(z0 / (1 - z0)), *[0.0] * len(xs)]]),
           "zinb": ([("mu", xs, True), ("zero", [], True), ("log_alpha", [], True)], zi(_nb), [b0, [math.log(z0 / (1 - z0))], [a0]])}
    return {k: fit_mle(d, ["__y"], *mod[k]) for k in kinds}


def _count_frame(df, fits, main):
    f = fits[main]
    rows = [(t, b, s, z, p, math.exp(min(b, 700)), int(f.n), f.ll, f.aic, *[fits[k].aic for k in fits if k != main]) for t, b, s, z, p in f.rows()]
    more = "".join(f", aic_{k} double" for k in fits if k != main)
    return rows_frame(df.sparkSession, COEF + ", exp_coef double, n bigint, loglik double, aic double" + more, rows)


def negative_binomial_regression(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    return _count_frame(df, count_fits(df, outcome, predictors, ["negbin", "poisson"]), "negbin")


def zero_inflated_poisson(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    return _count_frame(df, count_fits(df, outcome, predictors, ["zip", "poisson"]), "zip")


def zero_inflated_negbin(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    return _count_frame(df, count_fits(df, outcome, predictors, ["zinb", "zip", "poisson"]), "zinb")


def tweedie_glm(df: DataFrame, outcome: str, predictors: Sequence[str], power: float = 1.5) -> DataFrame:
    """Log-link Tweedie regression (MLlib), 1 < power < 2."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    refuse(not 1 < power < 2, "the variance power lies between 1 and 2")
    xs = list(predictors)
    d = complete(df, [outcome, *xs])
    v = VectorAssembler(inputCols=xs, outputCol="features").transform(d)
    m = GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, labelCol=outcome, maxIter=50).fit(v)
    s = m.summary
    b = [float(m.intercept), *[float(c) for c in m.coefficients]]
    se = [s.coefficientStandardErrors[-1], *s.coefficientStandardErrors[:-1]]
    return rows_frame(df.sparkSession, COEF + ", exp_coef double, dispersion double, deviance double",
                      [(t, bb, ss, bb / ss, dist.p_two_sided(bb / ss), math.exp(bb), s.dispersion, s.deviance) for t, bb, ss in zip(["intercept", *xs], b, se)])


# --- limited outcomes -----------------------------------------------------------------------------

def _start(d, y, xs):
    f = ols(gram(d, [y, *xs]), y, xs)
    return list(f.beta), 0.5 * math.log(max(f.rss / f.n, 1e-12))


def _limited(df, y, xs, ll, extra=()):
    d = complete(df, [y, *xs]).select(F.col(y).alias("__y"), *xs)
    b, ls = _start(d, "__y", list(xs))
    return fit_mle(d, ["__y"], [("mu", list(xs), True), ("log_sigma", [], True)], ll, [b, [ls]])


def _mle_frame(df, f: Mle):
    return rows_frame(df.sparkSession, COEF + ", n bigint, loglik double, aic double", [(*r, int(f.n), f.ll, f.aic) for r in f.rows()])


def tobit_regression(df: DataFrame, outcome: str, predictors: Sequence[str], limit: float = 0.0, side: str = "left") -> DataFrame:
    """Type I tobit with a left or right limit; refused without mass at the limit."""
    left = side == "left"
    at = F.col(outcome) <= limit if left else F.col(outcome) >= limit
    refuse(fetch(df, c=F.sum(F.when(at, 1).otherwise(0)))["c"] in (None, 0), "no observation at the limit")

    def ll(eta, y):
        mu, ls = eta
        s = np.exp(ls)
        cens = y["__y"] <= limit if left else y["__y"] >= limit
        z = (y["__y"] - mu) / s
        zc = (limit - mu) / s
        return np.where(cens, norm_logcdf(zc if left else -zc), norm_logpdf(z) - ls)

    return _mle_frame(df, _limited(df, outcome, predictors, ll))


def truncated_regression(df: DataFrame, outcome: str, predictors: Sequence[str], limit: float = 0.0, side: str = "left") -> DataFrame:
    left = side == "left"
    d = df.where(F.col(outcome) > limit if left else F.col(outcome) < limit)

    def ll(eta, y):
        mu, ls = eta
        s = np.exp(ls)
        t = (limit - mu) / s
        return norm_logpdf((y["__y"] - mu) / s) - ls - norm_logcdf(-t if left else t)

    return _mle_frame(df, _limited(d, outcome, predictors, ll))


def probit_fit(d: DataFrame, y: str, xs: Sequence[str]) -> Mle:
    p = fetch(d, p=F.avg(y))["p"]
    refuse(p is None or not 0 < p < 1, "the outcome has one level only")
    return fit_mle(d, [y], [("", list(xs), True)], lambda e, yy: norm_logcdf(np.where(yy[y] > 0.5, e[0], -e[0])), [[dist.norm_ppf(p), *[0.0] * len(xs)]])


def heckman_selection(df: DataFrame, outcome: str, predictors: Sequence[str], selection: Sequence[str]) -> DataFrame:
    """Two-step selection model: probit of observing the outcome on all rows, then OLS with the inverse Mills ratio."""
    xs, zs = list(predictors), list(selection)
    need(df, outcome, *xs, *zs)
    d = df.select(num(outcome).alias("__o"), *[num(c).alias(c) for c in dict.fromkeys([*xs, *zs])]).dropna(subset=zs)
    d = d.withColumn("__s", F.when(F.col("__o").isNull(), 0.0).otherwise(1.0))
    f = probit_fit(d, "__s", zs)
    e = linear(zs, f.beta)
    mills = F.exp(-0.5 * e * e) / F.lit(math.sqrt(2 * math.pi)) / dist.norm_cdf_col(e)
    o = d.where("__s = 1").select("__o", *[F.col(c).alias(c) for c in xs], mills.alias("__lambda")).dropna()
    fit = ols(gram(o, ["__o", *xs, "__lambda"]), "__o", [*xs, "__lambda"])
    return rows_frame(df.sparkSession, "step string, " + COEF + ", n bigint",
                      [("selection", t.split(":")[-1], b, s, z, p, int(f.n)) for t, b, s, z, p in f.rows()]
                      + [("outcome", *r, int(fit.n)) for r in coef_rows(["intercept", *xs, "lambda"], fit.beta, fit.vcov, fit.df)])


def regularized_regression(df: DataFrame, outcome: str, predictors: Sequence[str], method: str = "lasso", alphas: Sequence[float] = (0.001, 0.01, 0.1, 1.0),
                           l1_ratio: float = 0.5, folds: int = 5, seed: int = 0) -> DataFrame:
    """Lasso, ridge or elastic net on standardised columns with the penalty chosen by cross-validation (MLlib)."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    xs = list(predictors)
    d = complete(df, [outcome, *xs])
    g = gram(d, [outcome, *xs])
    sd = np.sqrt(np.diag(g.cross) / g.n)
    z = d.select(outcome, *[((F.col(c) - F.lit(float(g.mean[i + 1]))) / F.lit(float(sd[i + 1] or 1.0))).alias(c) for i, c in enumerate(xs)])
    v = VectorAssembler(inputCols=xs, outputCol="features").transform(z).select("features", F.col(outcome).alias("label")).persist()
    try:
        lr = LinearRegression(elasticNetParam={"lasso": 1.0, "ridge": 0.0, "elastic_net": l1_ratio}[method], standardization=False, maxIter=100)
        grid = ParamGridBuilder().addGrid(lr.regParam, [float(a * sd[0]) for a in alphas]).build()
        cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="rmse"), numFolds=folds, seed=seed).fit(v)
        m = cv.bestModel
        r2 = m.evaluate(v).r2
    finally:
        v.unpersist()
    return rows_frame(df.sparkSession, "predictor string, standardized_coef double, kept boolean, alpha double, cv_rmse double, r2 double",
                      [(x, float(c), abs(c) > 1e-12, float(m.getRegParam()), float(min(cv.avgMetrics)), r2) for x, c in zip(xs, m.coefficients)])


def pls_coefficients(g: Gram, y: str, xs: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Partial least squares on standardised moments: coefficients and VIP with k components."""
    c = g.corr([*xs, y])
    sxx, sxy = c[:-1, :-1], c[:-1, -1]
    p = len(xs)
    w_all, p_all, q_all = [], [], []
    r = sxy.copy()
    basis = []
    for _ in range(k):
        w = r.copy()
        w /= np.linalg.norm(w) or 1.0
        rw = w.copy()
        for rr, pp in zip(basis, p_all):
            rw -= rr * (pp @ w)
        t2 = rw @ sxx @ rw
        if t2 < 1e-12:
            break
        load = sxx @ rw / t2
        qv = (rw @ sxy) / t2
        w_all.append(w)
        basis.append(rw)
        p_all.append(load)
        q_all.append((qv, t2))
        r = r - load * qv * t2
    b = sum((rr * qv for rr, (qv, _) in zip(basis, q_all)), np.zeros(p))
    ss = np.array([qv * qv * t2 for qv, t2 in q_all])
    vip = np.sqrt(p * sum((s * w * w for s, w in zip(ss, w_all)), np.zeros(p)) / ss.sum())
    return b, vip


def pls_regression(df: DataFrame, outcome: str, predictors: Sequence[str], id_col: str, n_components: int | None = None, folds: int = 5) -> DataFrame:
    """PLS with the component count chosen by cross-validated R-squared; fold moments come from one pass."""
    xs = list(predictors)
    d = complete(df, [outcome, *xs], [id_col])
    fold = F.pmod(F.xxhash64(id_col), F.lit(folds)).cast("int")
    parts = gram_by(d.withColumn("__fold", fold), [outcome, *xs], "__fold")
    total = merge(list(parts.values()))
    best, score = n_components, None
    if best is None:
        for k in range(1, min(len(xs), 10) + 1):
            sse = 0.0
            for f, test in parts.items():
                train = merge([g for ff, g in parts.items() if ff != f])
                b, _ = pls_coefficients(train, outcome, xs, k)
                sd = np.sqrt(np.diag(train.cross) / train.n)
                raw = b * sd[0] / sd[1:]
                shift = (test.mean[0] - train.mean[0]) - raw @ (test.mean[1:] - train.mean[1:])
                v = np.concatenate([[1.0], -raw])
                sse += float(v @ test.cross @ v + test.n * shift * shift)
            r2 = 1 - sse / total.cross[0, 0]
            if score is None or r2 > score + 1e-9:
                best, score = k, r2
    b, vip = pls_coefficients(total, outcome, xs, best)
    sd = np.sqrt(np.diag(total.cross))
    return rows_frame(df.sparkSession, "predictor string, coef double, standardized_coef double, vip double, components bigint, cv_r2 double",
                      [(x, float(b[i] * sd[0] / sd[i + 1]), float(b[i]), float(vip[i]), best, score) for i, x in enumerate(xs)])


# --- mixed and panel ------------------------------------------------------------------------------

def mixed_effects(df: DataFrame, outcome: str, predictors: Sequence[str], group: str) -> DataFrame:
    """Random-intercept model by REML; groups of one size share their sums, so the variance ratio is profiled on
    a table with one row per distinct group size."""
    xs = list(predictors)
    cols = [outcome, *xs]
    d = complete(df, cols, [group])
    g = gram(d, cols)
    c = d.select(group, *[(F.col(v) - F.lit(float(m))).alias(v) for v, m in zip(cols, g.mean)])
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    s = c.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(cols)])
    rows = collect_bounded(s.groupBy("n").agg(F.count(F.lit(1)).alias("g"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)],
                                              *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"q{i}_{j}") for i, j in pairs]), "group sizes")
    sizes = np.array([r["n"] for r in rows], float)
    cnt = np.array([r["g"] for r in rows], float)
    s1 = np.array([[r[f"s{i}"] for i in range(k)] for r in rows])
    q = np.zeros((len(rows), k, k))
    for a, r in enumerate(rows):
        for i, j in pairs:
            q[a, i, j] = q[a, j, i] = r[f"q{i}_{j}"]
    n, p = g.n, len(xs) + 1

    def reml(lr):
        th = math.exp(lr)                       # sigma_u^2 / sigma_e^2
        w = th / (1 + sizes * th)
        m = g.cross - (w[:, None, None] * q).sum(0)
        top = np.concatenate([[n - (w * cnt * sizes ** 2).sum()], -(w * sizes) @ s1])
        full = np.zeros((k + 1, k + 1))         # order: intercept, outcome, predictors
        full[1:, 1:] = m
        full[0, :] = full[:, 0] = top
        xi = [0, *range(2, k + 1)]
        xx, xy, yy = full[np.ix_(xi, xi)], full[xi, 1], full[1, 1]
        b = np.linalg.solve(xx, xy)
        rss = yy - xy @ b
        s2 = rss / (n - p)
        ll = -0.5 * ((n - p) * math.log(s2) + (cnt * np.log1p(sizes * th)).sum() + np.linalg.slogdet(xx)[1] + (n - p))
        return ll, b, np.linalg.inv(xx) * s2, s2, th * s2

    lo, hi = -18.0, 8.0
    gr = (math.sqrt(5) - 1) / 2
    a, b_ = hi - gr * (hi - lo), lo + gr * (hi - lo)
    fa, fb = reml(a)[0], reml(b_)[0]
    for _ in range(80):
        if fa < fb:
            lo, a, fa = a, b_, fb
            b_ = lo + gr * (hi - lo)
            fb = reml(b_)[0]
        else:
            hi, b_, fb = b_, a, fa
            a = hi - gr * (hi - lo)
            fa = reml(a)[0]
    ll, b, v, s2, su = reml((lo + hi) / 2)
    b = b.copy()
    b[0] = g.mean[0] + b[0] - sum(b[i + 1] * g.mean[i + 1] for i in range(len(xs)))
    t = np.eye(p)
    t[0, 1:] = -g.mean[1:]
    v = t @ v @ t.T
    return rows_frame(df.sparkSession, COEF + ", sigma_u2 double, sigma_e2 double, icc double, groups bigint, n bigint",
                      [(*r, su, s2, su / (su + s2), int(cnt.sum()), int(n)) for r in coef_rows(["intercept", *xs], b, v)])


def _panel_moments(df, y, xs, unit):
    """Within and between moments of a panel, from the per-unit sums of one grouped pass."""
    cols = [y, *xs]
    d = complete(df, cols, [unit])
    g = gram(d, cols)
    m = d.groupBy(unit).agg(F.count(F.lit(1)).cast("double").alias("__t"), *[F.avg(c).alias(c) for c in cols])
    b = weighted_gram(m, cols, F.col("__t"))[()]
    units = b.rows
    tbar = units / fetch(m, h=F.sum(1 / F.col("__t")))["h"]
    within = Gram(cols, g.n, g.mean, g.cross - b.cross)
    plain = gram(m, cols)
    return d, g, within, b, plain, units, tbar


def swamy_arora(df: DataFrame, y: str, xs: Sequence[str], unit: str):
    """Fixed and random effects from the same moments: (beta_fe, V_fe, beta_re with intercept, V_re, theta, ...)."""
    xs = list(xs)
    d, g, w, b, plain, units, tbar = _panel_moments(df, y, xs, unit)
    k = len(xs)
    iw = np.linalg.pinv(w.sub(xs, xs), hermitian=True)
    bfe = iw @ w.sub(xs, [y])[:, 0]
    s2e = float(w.sub([y], [y])[0, 0] - w.sub(xs, [y])[:, 0] @ bfe) / (g.n - units - k)
    fb = ols(plain, y, xs)
    s2u = max(0.0, fb.rss / (units - k - 1) - s2e / tbar)
    # Quasi-demeaning by unit: theta_i depends on the unit's number of periods.
    th = F.lit(1.0) - F.sqrt(F.lit(s2e) / (F.lit(s2e) + F.col("__t") * F.lit(s2u)))
    m = d.groupBy(unit).agg(F.count(F.lit(1)).cast("double").alias("__t"), *[F.avg(c).alias(f"__m_{c}") for c in [y, *xs]])
    z = d.join(m, unit).withColumn("__th", th).select((1 - F.col("__th")).alias("__one"), *[(F.col(c) - F.col("__th") * F.col(f"__m_{c}")).alias(c) for c in [y, *xs]])
    r = gram(z, ["__one", y, *xs])
    raw = r.raw()
    xi = [0, *range(2, k + 2)]
    xx = raw[np.ix_(xi, xi)]
    inv = np.linalg.pinv(xx, hermitian=True)
    bre = inv @ raw[xi, 1]
    rss = float(raw[1, 1] - raw[xi, 1] @ bre)
    s2 = rss / (g.n - k - 1)
    return {"fe": bfe, "vfe": iw * s2e, "re": bre, "vre": inv * s2, "s2e": s2e, "s2u": s2u, "theta": float(1 - math.sqrt(s2e / (s2e + tbar * s2u))), "n": int(g.n), "units": units}


def _hausman(r) -> tuple[float, int, float]:
    d = r["fe"] - r["re"][1:]
    v = r["vfe"] - r["vre"][1:, 1:]
    h = float(d @ np.linalg.pinv(v, hermitian=True) @ d)
    k = len(d)
    return h, k, dist.chi2_sf(h, k) if h > 0 else 1.0


def random_effects(df: DataFrame, outcome: str, predictors: Sequence[str], unit: str) -> DataFrame:
    """Swamy-Arora random effects with the Hausman verdict."""
    r = swamy_arora(df, outcome, predictors, unit)
    h, k, p = _hausman(r)
    return rows_frame(df.sparkSession, COEF + ", theta double, sigma_u2 double, sigma_e2 double, hausman double, hausman_p double, n bigint",
                      [(*x, r["theta"], r["s2u"], r["s2e"], h, p, r["n"]) for x in coef_rows(["intercept", *predictors], r["re"], r["vre"])])


def hausman_test(df: DataFrame, outcome: str, predictors: Sequence[str], unit: str) -> DataFrame:
    r = swamy_arora(df, outcome, predictors, unit)
    h, k, p = _hausman(r)
    return rows_frame(df.sparkSession, "term string, fixed double, random double, difference double, hausman double, df bigint, p double, prefer string",
                      [(t, float(a), float(b), float(a - b), h, k, p, "fixed" if p < 0.05 else "random") for t, a, b in zip(predictors, r["fe"], r["re"][1:])])


def mundlak(df: DataFrame, outcome: str, predictors: Sequence[str], unit: str) -> DataFrame:
    """Random effects with the unit means added; joint Wald test on the means."""
    xs = list(predictors)
    d = complete(df, [outcome, *xs], [unit])
    m = d.groupBy(unit).agg(*[F.avg(c).alias(f"{c}_mean") for c in xs])
    ms = [f"{c}_mean" for c in xs]
    # The within variance of the means is zero, so the variance components come from the original predictors.
    base = swamy_arora(d, outcome, xs, unit)
    s2e, s2u = base["s2e"], base["s2u"]
    j = d.join(m, unit)
    t = j.groupBy(unit).agg(F.count(F.lit(1)).cast("double").alias("__t"), *[F.avg(c).alias(f"__m_{c}") for c in [outcome, *xs, *ms]])
    z = j.join(t, unit).withColumn("__th", 1 - F.sqrt(F.lit(s2e) / (F.lit(s2e) + F.col("__t") * F.lit(s2u))))
    z = z.select((1 - F.col("__th")).alias("__one"), *[(F.col(c) - F.col("__th") * F.col(f"__m_{c}")).alias(c) for c in [outcome, *xs, *ms]])
    g = gram(z, ["__one", outcome, *xs, *ms])
    raw = g.raw()
    xi = [0, *range(2, len(g.names))]
    inv = np.linalg.pinv(raw[np.ix_(xi, xi)], hermitian=True)
    b = inv @ raw[xi, 1]
    s2 = float(raw[1, 1] - raw[xi, 1] @ b) / (g.n - len(xi))
    v = inv * s2
    k = len(xs)
    w = float(b[1 + k:] @ np.linalg.pinv(v[1 + k:, 1 + k:], hermitian=True) @ b[1 + k:])
    return rows_frame(df.sparkSession, COEF + ", wald_means double, wald_p double, n bigint", [(*x, w, dist.chi2_sf(w, k), int(g.n)) for x in coef_rows(["intercept", *xs, *ms], b, v)])


def first_difference(df: DataFrame, outcome: str, predictors: Sequence[str], unit: str, time: str) -> DataFrame:
    """Differences of consecutive periods inside a unit, no intercept, errors clustered by unit."""
    xs = list(predictors)
    d = complete(df, [outcome, *xs, time], [unit])
    # Consecutive periods meet by an equi-join on (unit, period), so a long unit is no single task.
    prev = d.select(unit, (F.col(time) + 1).alias(time), *[F.col(c).alias(f"__p_{c}") for c in [outcome, *xs]])
    z = d.join(prev, [unit, time]).select(unit, *[(F.col(c) - F.col(f"__p_{c}")).alias(c) for c in [outcome, *xs]])
    g = gram(z, [outcome, *xs])
    raw = g.raw()
    inv = np.linalg.pinv(raw[1:, 1:], hermitian=True)
    b = inv @ raw[1:, 0]
    from ..plans.gram import score_meat
    e = F.col(outcome) - sum([F.col(x) * F.lit(float(v)) for x, v in zip(xs, b)], F.lit(0.0))
    m, groups = score_meat(z, xs, e, cluster=unit)
    k = len(xs)
    v = groups / (groups - 1) * (g.n - 1) / (g.n - k) * inv @ m[1:, 1:] @ inv
    fe, _, _ = within_fit(d, outcome, xs, unit, None)
    return rows_frame(df.sparkSession, COEF + ", fixed_effects double, n bigint", [(*r, float(f), int(g.n)) for r, f in zip(coef_rows(xs, b, v), fe.beta[1:])])


# --- instruments, frontiers, importance -----------------------------------------------------------

def tsls(g: Gram, y: str, xs: Sequence[str], zs: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """Two-stage least squares slopes from centred moments: (beta, bread, rss)."""
    xz, zz, zy = g.sub(xs, zs), g.sub(zs, zs), g.sub(zs, [y])[:, 0]
    iz = np.linalg.pinv(zz, hermitian=True)
    a = np.linalg.pinv(xz @ iz @ xz.T, hermitian=True)
    b = a @ xz @ iz @ zy
    v = np.concatenate([[1.0], -b])
    m = g.sub([y, *xs], [y, *xs])
    return b, a, float(v @ m @ v)


def iv_regression(df: DataFrame, outcome: str, endogenous: Sequence[str], instruments: Sequence[str], controls: Sequence[str] = ()) -> DataFrame:
    """2SLS with robust errors, first-stage F, Wu-Hausman and, when over-identified, Sargan."""
    en, ins, ex = list(endogenous), list(instruments), list(controls)
    refuse(not ins or len(ins) < len(en), "as many instruments as endogenous columns are needed")
    d = complete(df, [outcome, *en, *ins, *ex])
    g = gram(d, list(dict.fromkeys([outcome, *en, *ins, *ex])))
    refuse(g.n < 30, "thirty complete rows are needed")
    xs, zs = [*en, *ex], [*ins, *ex]
    b, a, rss = tsls(g, outcome, xs, zs)
    b0 = g.mean[g.at([outcome])[0]] - b @ g.mean[g.at(xs)]
    xz, iz = g.sub(xs, zs), np.linalg.pinv(g.sub(zs, zs), hermitian=True)
    proj = xz @ iz                                              # projected regressors from centred instruments
    e = F.col(outcome) - F.lit(float(b0)) - sum([F.col(x) * F.lit(float(v)) for x, v in zip(xs, b)], F.lit(0.0))
    zc = {z: F.col(z) - F.lit(float(g.mean[g.at([z])[0]])) for z in zs}
    hat = [sum([zc[z] * F.lit(float(proj[i, j])) for j, z in enumerate(zs)], F.lit(0.0)).alias(f"h{i}") for i in range(len(xs))]
    t = d.select(e.alias("e"), *hat)
    pr = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    r = fetch(t, **{f"m{i}_{j}": F.sum(F.col("e") ** 2 * F.col(f"h{i}") * F.col(f"h{j}")) for i, j in pr})
    m = np.zeros((len(xs),) * 2)
    for i, j in pr:
        m[i, j] = m[j, i] = r[f"m{i}_{j}"]
    v = g.n / (g.n - len(xs) - 1) * a @ m @ a
    first = []
    for x in en:
        full, red = ols(g, x, zs), ols(g, x, ex) if ex else None
        rr = red.rss if red else float(g.sub([x], [x])[0, 0])
        first.append(((rr - full.rss) / len(ins)) / (full.rss / full.df))
    # Wu-Hausman: add first-stage residuals; they are linear in the columns, so moments suffice.
    names = [*g.names]
    trans = np.eye(len(names))
    cross = g.cross
    extra = []
    for x in en:
        f = ols(g, x, zs)
        w = np.zeros(len(names))
        w[names.index(x)] = 1
        for z, c in zip(zs, f.beta[1:]):
            w[names.index(z)] -= c
        extra.append(w)
    tm = np.vstack([trans, extra])
    g2 = Gram(names + [f"__v{i}" for i in range(len(en))], g.n, tm @ g.mean, tm @ cross @ tm.T)
    r0, r1 = ols(g2, outcome, xs), ols(g2, outcome, [*xs, *[f"__v{i}" for i in range(len(en))]])
    wu = ((r0.rss - r1.rss) / len(en)) / (r1.rss / r1.df)
    over = len(ins) - len(en)
    sargan = None
    if over > 0:
        vv = np.zeros(len(names))
        vv[names.index(outcome)] = 1
        for x, c in zip(xs, b):
            vv[names.index(x)] -= c
        g3m = np.vstack([trans, vv])
        g3 = Gram(names + ["__e"], g.n, g3m @ g.mean, g3m @ cross @ g3m.T)
        sargan = g.n * ols(g3, "__e", zs).r2
    return rows_frame(df.sparkSession, COEF + ", n bigint, first_stage_f double, wu_hausman double, wu_hausman_p double, sargan double, sargan_p double",
                      [(*r, int(g.n), float(min(first)), float(wu), dist.f_sf(wu, len(en), r1.df), sargan, dist.chi2_sf(sargan, over) if sargan is not None else None)
                       for r in coef_rows(xs, b, v)])


def gam(df: DataFrame, outcome: str, predictors: Sequence[str], knots: int = 10) -> DataFrame:
    """Additive P-splines: linear-B-spline bases with a second-difference penalty, lambda by GCV from one Gram."""
    xs = list(predictors)
    d = complete(df, [outcome, *xs])
    r = fetch(d, **{f"lo{i}": F.min(c) for i, c in enumerate(xs)}, **{f"hi{i}": F.max(c) for i, c in enumerate(xs)})
    cols, spans = [], []
    z = [F.col(outcome).alias("__y")]
    for i, c in enumerate(xs):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        refuse(lo == hi, f"{c} is constant")
        h = (hi - lo) / (knots - 1)
        names = []
        for k in range(knots):
            nm = f"b{i}_{k}"
            z.append(F.greatest(1 - F.abs((F.col(c) - F.lit(lo + k * h)) / F.lit(h)), F.lit(0.0)).alias(nm))
            names.append(nm)
        spans.append((len(cols), len(cols) + knots))
        cols += names
    g = gram(d.select(*z), ["__y", *cols])
    sxx, sxy, syy = g.cross[1:, 1:], g.cross[1:, 0], g.cross[0, 0]
    dm = np.diff(np.eye(knots), 2, axis=0)
    best = None
    for lam in np.geomspace(1e-4, 1e6, 41):
        pen = np.zeros_like(sxx)
        for a, b in spans:
            pen[a:b, a:b] = dm.T @ dm
        reg = sxx + lam * pen + 1e-8 * np.trace(sxx) / len(sxx) * np.eye(len(sxx))
        inv = np.linalg.inv(reg)
        beta = inv @ sxy
        hat = inv @ sxx
        edf = 1 + np.trace(hat)
        rss = syy - 2 * beta @ sxy + beta @ sxx @ beta
        gcv = g.n * rss / (g.n - edf) ** 2
        if best is None or gcv < best[0]:
            best = (gcv, lam, beta, hat, edf, rss)
    gcv, lam, beta, hat, edf, rss = best
    rows = [(c, float(np.trace(hat[a:b, a:b])), float(beta[a:b].max() - beta[a:b].min()), float(lam), float(gcv), float(1 - rss / syy), float(edf), int(g.n)) for c, (a, b) in zip(xs, spans)]
    return rows_frame(df.sparkSession, "term string, edf double, effect_range double, lambda double, gcv double, r2 double, total_edf double, n bigint", rows)


def _subset_r2(g: Gram, y: str, xs: Sequence[str]) -> dict[tuple, float]:
    refuse(len(xs) > 12, "at most twelve predictors: all subsets are fitted")
    return {s: r2_of(g, y, list(s)) for k in range(len(xs) + 1) for s in combinations(xs, k)}


def dominance_analysis(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """General dominance: incremental R-squared averaged within and over subset sizes."""
    xs = list(predictors)
    g = gram(complete(df, [outcome, *xs]), [outcome, *xs])
    r2 = _subset_r2(g, outcome, xs)
    total = r2[tuple(xs)]
    rows = []
    for x in xs:
        per = []
        for k in range(len(xs)):
            inc = [r2[tuple(sorted((*s, x), key=xs.index))] - v for s, v in r2.items() if len(s) == k and x not in s]
            per.append(sum(inc) / len(inc))
        gd = sum(per) / len(per)
        rows.append((x, gd, gd / total if total > 0 else None, r2[(x,)], total - r2[tuple(c for c in xs if c != x)], total))
    return rows_frame(df.sparkSession, "predictor string, general_dominance double, share double, r2_alone double, r2_unique double, r2_total double", rows)


def relative_weights(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """Johnson's relative weights from the correlation matrix."""
    xs = list(predictors)
    g = gram(complete(df, [outcome, *xs]), [outcome, *xs])
    c = g.corr([*xs, outcome])
    ev, vec = np.linalg.eigh(c[:-1, :-1])
    lam = vec @ np.diag(np.sqrt(np.maximum(ev, 0))) @ vec.T
    beta = np.linalg.pinv(lam) @ c[:-1, -1]
    w = (lam ** 2) @ (beta ** 2)
    return rows_frame(df.sparkSession, "predictor string, weight double, share double, r2_total double", [(x, float(a), float(a / w.sum()), float(w.sum())) for x, a in zip(xs, w)])


def commonality_analysis(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """Unique and common variance components by inclusion-exclusion of subset R-squared."""
    xs = list(predictors)
    g = gram(complete(df, [outcome, *xs]), [outcome, *xs])
    r2 = _subset_r2(g, outcome, xs)
    full = r2[tuple(xs)]
    rows = []
    for k in range(1, len(xs) + 1):
        for s in combinations(xs, k):
            rest = tuple(x for x in xs if x not in s)
            val = 0.0
            for j in range(k + 1):
                for t in combinations(s, j):
                    keep = tuple(sorted((*rest, *t), key=xs.index))
                    val += (-1) ** (j + 1) * r2[keep]
            rows.append(("+".join(s), k, val, val / full if full > 0 else None))
    return rows_frame(df.sparkSession, "component string, order bigint, commonality double, share double", rows)


def bayesian_model_averaging(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """BIC weights over all subsets: inclusion probabilities and averaged coefficients."""
    xs = list(predictors)
    refuse(len(xs) > 12, "at most twelve predictors")
    g = gram(complete(df, [outcome, *xs]), [outcome, *xs])
    fits = [(s, ols(g, outcome, s)) for k in range(len(xs) + 1) for s in combinations(xs, k)]
    bic = np.array([g.n * math.log(f.rss / g.n) + (len(s) + 1) * math.log(g.n) for s, f in fits])
    w = np.exp(-(bic - bic.min()) / 2)
    w /= w.sum()
    rows = []
    for x in xs:
        inc = [(wi, f) for wi, (s, f) in zip(w, fits) if x in s]
        mean = sum(wi * f.beta[f.terms.index(x)] for wi, f in inc)
        second = sum(wi * (f.vcov[f.terms.index(x), f.terms.index(x)] + f.beta[f.terms.index(x)] ** 2) for wi, f in inc)
        rows.append((x, float(sum(wi for wi, _ in inc)), float(mean), math.sqrt(max(second - mean ** 2, 0)), len(fits), float(w.max())))
    return rows_frame(df.sparkSession, "predictor string, pip double, mean double, sd double, models bigint, top_model_weight double", rows)


def oster_delta(df: DataFrame, outcome: str, treatment: str, controls: Sequence[str], r_max: float | None = None) -> DataFrame:
    """Coefficient stability: delta that would explain the effect away and the bias-adjusted effect."""
    cs = list(controls)
    g = gram(complete(df, [outcome, treatment, *cs]), [outcome, treatment, *cs])
    s, l = ols(g, outcome, [treatment]), ols(g, outcome, [treatment, *cs])
    b0, b1, r0, r1 = s.beta[1], l.beta[1], s.r2, l.r2
    rm = max(min(1.3 * r1, 1.0) if r_max is None else r_max, r1)
    den = (b0 - b1) * (rm - r1)
    delta = b1 * (r1 - r0) / den if den else float("inf")
    adj = b1 - (b0 - b1) * (rm - r1) / (r1 - r0) if r1 != r0 else float("nan")
    return one_row(df.sparkSession, n=int(g.n), beta_short=float(b0), r2_short=r0, beta_long=float(b1), r2_long=r1, r_max=rm, delta=float(delta), beta_adjusted=float(adj))


def evalue(df: DataFrame, outcome: str, exposure: str, controls: Sequence[str] = ()) -> DataFrame:
    """E-value of an exposure: odds ratio for a two-level outcome, standardised difference otherwise."""
    cs = list(controls)
    lv = df.select(outcome).dropna().distinct().limit(3).count()
    xv = df.select(exposure).dropna().distinct().limit(3).count()
    if lv == 2:
        y, *_ = binary01(df, outcome)
        d = complete(df.select(y.alias("__y"), F.col(exposure).alias("__x"), *cs), ["__y", "__x", *cs])
        f = logit_fit(d, "__y", ["__x", *cs])
        p0 = fetch(d, p=F.avg("__y"))["p"]
        est, n = math.exp(f.beta[1]), f.n
        rr = est if p0 <= 0.15 else math.sqrt(est)
        kind = "odds_ratio"
    else:
        d = complete(df, [outcome, exposure])
        cut = None
        if xv != 2:
            from ..plans.order import quantiles
            cut = quantiles(d, exposure, [0.5])[0]
            hi = F.col(exposure) > F.lit(cut)
        else:
            hi = F.col(exposure) == F.lit(fetch(d, m=F.max(exposure))["m"])
        r = fetch(d, n=F.count(F.lit(1)), m1=F.avg(F.when(hi, F.col(outcome))), m0=F.avg(F.when(~hi, F.col(outcome))), v1=F.var_samp(F.when(hi, F.col(outcome))),
                  v0=F.var_samp(F.when(~hi, F.col(outcome))), n1=F.sum(F.when(hi, 1).otherwise(0)))
        n, n1 = r["n"], r["n1"]
        sp = math.sqrt(((n1 - 1) * r["v1"] + (n - n1 - 1) * r["v0"]) / (n - 2))
        est = (r["m1"] - r["m0"]) / sp
        rr, kind = math.exp(0.91 * est), "smd"
    refuse(n < 10, "ten rows are needed")
    e = rr if rr >= 1 else 1 / rr
    return one_row(df.sparkSession, n=int(n), kind=kind, estimate=est, rr=rr, e_value=e + math.sqrt(e * (e - 1)))


def sfa(df: DataFrame, output: str, inputs: Sequence[str]) -> DataFrame:
    """Cobb-Douglas stochastic frontier with half-normal inefficiency and the mean technical efficiency."""
    xs = list(inputs)
    d = complete(df, [output, *xs]).where(" and ".join(f"`{c}` > 0" for c in [output, *xs]))
    d = d.select(F.log(output).alias("__y"), *[F.log(c).alias(c) for c in xs])
    b, ls = _start(d, "__y", xs)

    def ll(eta, y):
        mu, lv, lu = eta
        sv, su = np.exp(lv), np.exp(lu)
        s = np.sqrt(sv * sv + su * su)
        e = y["__y"] - mu
        return math.log(2) - np.log(s) + norm_logpdf(e / s) + norm_logcdf(-e * su / (sv * s))

    b[0] += 0.5 * math.exp(ls)
    f = fit_mle(d, ["__y"], [("mu", xs, True), ("log_sigma_v", [], True), ("log_sigma_u", [], True)], ll, [b, [ls - 0.3], [ls - 0.3]], most=15, tol=1e-6)
    k = len(xs) + 1
    sv, su = math.exp(f.beta[k]), math.exp(f.beta[k + 1])
    s2 = sv * sv + su * su
    e = F.col("__y") - linear(xs, f.beta[:k])
    mstar, sstar = -e * F.lit(su * su / s2), F.lit(sv * su / math.sqrt(s2))
    te = F.exp(-mstar + sstar * sstar / 2) * dist.norm_cdf_col(mstar / sstar - sstar) / F.greatest(dist.norm_cdf_col(mstar / sstar), F.lit(1e-300))
    m = fetch(d.select(te.alias("te")), m=F.avg("te"), lo=F.min("te"), hi=F.max("te"))
    return rows_frame(df.sparkSession, COEF + ", n bigint, loglik double, mean_te double, min_te double, max_te double", [(*r, int(f.n), f.ll, m["m"], m["lo"], m["hi"]) for r in f.rows()])
