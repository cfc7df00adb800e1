"""Contingency tables, epidemiology, survey weighting, conjugate Bayes, capture histories and set-theoretic analysis."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dist
from ..plans.frames import (binary01, collect_bounded, complete, fetch, level_key, levels_of, need, num, one_row, refuse,
                            rows_frame)
from ..plans.gram import gram
from ..plans.order import average_ranks, cumulate, group_quantiles, quantiles, sorted_position


def crosstab(df: DataFrame, a: str, b: str) -> tuple[np.ndarray, list, list]:
    """Dense counts of two factors with levels in order."""
    rows = collect_bounded(complete(df, [], [a, b]).groupBy(a, b).count(), "table cells")
    refuse(not rows, "no complete rows")
    la = sorted({r[0] for r in rows}, key=level_key)
    lb = sorted({r[1] for r in rows}, key=level_key)
    m = np.zeros((len(la), len(lb)))
    ia, ib = {v: i for i, v in enumerate(la)}, {v: i for i, v in enumerate(lb)}
    for r in rows:
        m[ia[r[0]], ib[r[1]]] = r["count"]
    return m, la, lb


def expected(m: np.ndarray) -> np.ndarray:
    return np.outer(m.sum(1), m.sum(0)) / m.sum()


def chi_square_test(df: DataFrame, var1: str, var2: str | None = None, expected_props: Sequence[float] | None = None) -> DataFrame:
    """Independence (with Yates for 2x2, bias-corrected V, sparse cells) or goodness of fit for one column."""
    spark = df.sparkSession
    if var2 is None:
        rows = collect_bounded(complete(df, [], [var1]).groupBy(var1).count(), f"levels of {var1}")
        o = np.array([r["count"] for r in sorted(rows, key=lambda r: level_key(r[0]))], float)
        e = np.full(len(o), 1.0) if expected_props is None else np.asarray(expected_props, float)
        refuse(len(e) != len(o), "expected needs one value per level")
        e = e / e.sum() * o.sum()
        x = float(((o - e) ** 2 / e).sum())
        return one_row(spark, n=int(o.sum()), chi2=x, df=len(o) - 1, sparse_cells=int((e < 5).sum()), p=dist.chi2_sf(x, len(o) - 1))
    m, _, _ = crosstab(df, var1, var2)
    refuse(min(m.shape) < 2, "both columns need two levels")
    e = expected(m)
    n, (r, c) = m.sum(), m.shape
    x = float(((m - e) ** 2 / e).sum())
    dof = (r - 1) * (c - 1)
    yates = float((np.maximum(abs(m - e) - 0.5, 0) ** 2 / e).sum()) if m.shape == (2, 2) else float("nan")
    phi2 = max(0.0, x / n - (c - 1) * (r - 1) / (n - 1))
    rr, cc = r - (r - 1) ** 2 / (n - 1), c - (c - 1) ** 2 / (n - 1)
    v = math.sqrt(phi2 / min(rr - 1, cc - 1))
    return one_row(spark, n=int(n), chi2=x, df=dof, yates_chi2=yates, cramers_v=v, sparse_cells=int((e < 5).sum()),
                   p=dist.chi2_sf(x, dof), yates_p=dist.chi2_sf(yates, 1) if yates == yates else float("nan"))


def _table22(df, a, b):
    x, *_ = binary01(df, a)
    y, *_ = binary01(df, b)
    r = fetch(complete(df, [], [a, b]), a=F.sum(x * y), b=F.sum(x * (1 - y)), c=F.sum((1 - x) * y), d=F.sum((1 - x) * (1 - y)))
    return float(r["a"]), float(r["b"]), float(r["c"]), float(r["d"])


def fisher_exact(df: DataFrame, var1: str, var2: str) -> DataFrame:
    """2x2 exact test: hypergeometric tails and the conditional maximum-likelihood odds ratio."""
    m, la, lb = crosstab(df, var1, var2)
    refuse(m.shape != (2, 2), "Fisher's test needs a 2x2 table")
    a, b, c, d = m.ravel()
    r1, c1, n = a + b, a + c, m.sum()
    lo, hi = max(0.0, r1 + c1 - n), min(r1, c1)
    mean = r1 * c1 / n
    sd = math.sqrt(max(r1 * c1 * (n - r1) * (n - c1) / (n * n * max(n - 1, 1)), 1.0))
    far = max(60 * sd, abs(a - mean) + 20 * sd) + 50
    k = np.arange(max(lo, math.floor(min(mean, a) - far)), min(hi, math.ceil(max(mean, a) + far)) + 1)
    lg = np.vectorize(math.lgamma)
    logp = -(lg(k + 1) + lg(r1 - k + 1) + lg(c1 - k + 1) + lg(n - r1 - c1 + k + 1))
    logp -= logp.max()
    p = np.exp(logp)
    p /= p.sum()
    pa = p[k == a][0]
    two = float(p[p <= pa * (1 + 1e-7)].sum())

    def mean_at(t):
        w = logp + k * t
        w = np.exp(w - w.max())
        return (k * w).sum() / w.sum()

    if a <= lo:
        odds = 0.0
    elif a >= hi:
        odds = float("inf")
    else:
        odds = math.exp(dist._bisect(mean_at, -50.0, 50.0, a))
    return one_row(df.sparkSession, n=int(n), a=int(a), b=int(b), c=int(c), d=int(d),
                   sample_odds_ratio=a * d / (b * c) if b * c else float("inf"), conditional_odds_ratio=odds, p_two_sided=min(two, 1.0),
                   p_less=float(p[k <= a].sum()), p_greater=float(p[k >= a].sum()))


def mcnemar_test(df: DataFrame, var1: str, var2: str) -> DataFrame:
    """Exact binomial when the discordant pairs are fewer than 25, else continuity-corrected chi-square."""
    a, b, c, d = _table22(df, var1, var2)
    small = b + c < 25
    x = float("nan") if small or b + c == 0 else (abs(b - c) - 1) ** 2 / (b + c)
    return one_row(df.sparkSession, n=int(a + b + c + d), b=int(b), c=int(c), method="exact" if small else "chi2", statistic=x,
                   odds_ratio=b / c if c else float("inf"),
                   p=dist.binom_two_sided_half(int(min(b, c)), int(b + c)) if small else dist.chi2_sf(x, 1))


def loglinear(df: DataFrame, factor_a: str, factor_b: str) -> DataFrame:
    """Cells with expected counts and adjusted residuals, and G-squared beside Pearson."""
    m, la, lb = crosstab(df, factor_a, factor_b)
    refuse(min(m.shape) < 2, "both factors need two levels")
    e, n = expected(m), m.sum()
    g2 = float(2 * (m[m > 0] * np.log(m[m > 0] / e[m > 0])).sum())
    x2 = float(((m - e) ** 2 / e).sum())
    dof = (m.shape[0] - 1) * (m.shape[1] - 1)
    adj = (m - e) / np.sqrt(e * np.outer(1 - m.sum(1) / n, 1 - m.sum(0) / n))
    p = dist.chi2_sf(g2, dof)
    return rows_frame(df.sparkSession, "level_a string, level_b string, observed bigint, expected double, adjusted_residual double, "
                      "g2 double, pearson double, df bigint, p double",
                      [(str(a), str(b), m[i, j], e[i, j], adj[i, j], g2, x2, dof, p) for i, a in enumerate(la) for j, b in enumerate(lb)])


def cmh_test(df: DataFrame, exposure: str, outcome: str, stratum: str) -> DataFrame:
    """Mantel-Haenszel odds ratio, continuity-corrected chi-square and Breslow-Day over strata."""
    x, *_ = binary01(df, exposure)
    y, *_ = binary01(df, outcome)
    d = complete(df.select(x.alias("x"), y.alias("y"), F.col(stratum).alias("s")), ["x", "y"], ["s"])
    rows = collect_bounded(d.groupBy("s").agg(F.sum(F.col("x") * F.col("y")).alias("a"), F.sum(F.col("x") * (1 - F.col("y"))).alias("b"),
                                              F.sum((1 - F.col("x")) * F.col("y")).alias("c"),
                                              F.sum((1 - F.col("x")) * (1 - F.col("y"))).alias("d")), "strata")
    t = np.array([[r["a"], r["b"], r["c"], r["d"]] for r in rows], float)
    t = t[t.sum(1) > 1]
    a, b, c, dd = t.T
    n = t.sum(1)
    mh = (a * dd / n).sum() / (b * c / n).sum()
    ea = (a + b) * (a + c) / n
    va = (a + b) * (c + dd) * (a + c) * (b + dd) / (n * n * (n - 1))
    x2 = (abs((a - ea).sum()) - 0.5) ** 2 / va.sum()
    bd = 0.0
    for ai, bi, ci, di in t:
        r1, c1, ni = ai + bi, ai + ci, ai + bi + ci + di
        qa, qb, qc = 1 - mh, ni - r1 - c1 + mh * (r1 + c1), -mh * r1 * c1
        if abs(qa) < 1e-12:
            e = -qc / qb
        else:
            roots = np.roots([qa, qb, qc]).real
            e = next(v for v in sorted(roots) if max(0, r1 + c1 - ni) - 1e-9 <= v <= min(r1, c1) + 1e-9)
        v = 1 / (1 / e + 1 / (r1 - e) + 1 / (c1 - e) + 1 / (ni - r1 - c1 + e))
        bd += (ai - e) ** 2 / v
    k = len(t)
    return one_row(df.sparkSession, strata=k, n=int(n.sum()), mh_odds_ratio=float(mh), cmh_chi2=float(x2), breslow_day=float(bd),
                   p=dist.chi2_sf(x2, 1), breslow_day_p=dist.chi2_sf(bd, k - 1) if k > 1 else float("nan"))


def ordinal_association(df: DataFrame, var1: str, var2: str) -> DataFrame:
    """Gamma, tau-b and both Somers D from the level table by two-dimensional cumulative sums."""
    m, _, _ = crosstab(df, var1, var2)
    n = m.sum()

    def strict(t):                          # sum over cells strictly below and to the right
        c = t[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1]
        out = np.zeros_like(t)
        out[:-1, :-1] = c[1:, 1:]
        return out

    con, dis = float((m * strict(m)).sum()), float((m * strict(m[:, ::-1])[:, ::-1]).sum())
    n0 = n * (n - 1) / 2
    tx = (m.sum(1) * (m.sum(1) - 1) / 2).sum()
    ty = (m.sum(0) * (m.sum(0) - 1) / 2).sum()
    return one_row(df.sparkSession, n=int(n), concordant=con, discordant=dis, gamma=(con - dis) / (con + dis),
                   tau_b=float((con - dis) / math.sqrt((n0 - tx) * (n0 - ty))), somers_d_y_given_x=float((con - dis) / (n0 - tx)),
                   somers_d_x_given_y=float((con - dis) / (n0 - ty)))


def epi_risk_measures(df: DataFrame, exposure: str, outcome: str, ci: float = 0.95) -> DataFrame:
    """RR, OR (Woolf), RD (Wald), NNT and attributable shares; 0.5 is added when a cell is empty."""
    a, b, c, d = _table22(df, exposure, outcome)
    n = a + b + c + d
    corrected = min(a, b, c, d) == 0
    if corrected:
        a, b, c, d = a + 0.5, b + 0.5, c + 0.5, d + 0.5
    z = dist.norm_ppf((1 + ci) / 2)
    r1, r0 = a / (a + b), c / (c + d)
    rr, orr, rd = r1 / r0, a * d / (b * c), r1 - r0
    srr = math.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))
    sor = math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    srd = math.sqrt(r1 * (1 - r1) / (a + b) + r0 * (1 - r0) / (c + d))
    pe = (a + b) / (a + b + c + d)
    return one_row(df.sparkSession, n=int(n), risk_exposed=r1, risk_unexposed=r0, rr=rr, rr_low=rr * math.exp(-z * srr), rr_high=rr * math.exp(z * srr),
                   odds_ratio=orr, or_low=orr * math.exp(-z * sor), or_high=orr * math.exp(z * sor), rd=rd, rd_low=rd - z * srd, rd_high=rd + z * srd,
                   nnt=1 / rd if rd else float("inf"), ar_percent=(rr - 1) / rr * 100, par_percent=pe * (rr - 1) / (1 + pe * (rr - 1)) * 100,
                   corrected=corrected)


def roc_points(df: DataFrame, truth: str, score: str) -> tuple[DataFrame, float, float]:
    """Distinct scores from the highest with true and false positives at or above each."""
    y, *_ = binary01(df, truth)
    d = complete(df.select(y.alias("y"), F.col(score).alias("s")), ["y", "s"])
    v = d.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    t = fetch(v, p=F.sum("pos"), n=F.sum("neg"))
    refuse(not t["p"] or not t["n"], "the truth column has one class only")
    c = cumulate(v, "s", ["pos", "neg"])      # sums over lower scores
    p, n = float(t["p"]), float(t["n"])
    return c.withColumn("tp", F.lit(p) - F.col("pos_before")).withColumn("fp", F.lit(n) - F.col("neg_before")), p, n


def roc_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    pts, p, n = roc_points(df, truth, score)
    return pts.select(F.col("s").alias("threshold"), (F.col("tp") / p).alias("tpr"), (F.col("fp") / n).alias("fpr"))


def diagnostic_test_eval(df: DataFrame, truth: str, score: str, ci: float = 0.95) -> DataFrame:
    """AUC with DeLong interval (flipped below one half), Youden cut and the accuracy measures there."""
    pts, p, n = roc_points(df, truth, score)
    # Placement values at each distinct score: share of the other class below, ties half.
    v10 = (F.col("neg_before") + F.col("neg") / 2) / n
    v01 = (F.lit(p) - F.col("pos_before") - F.col("pos") / 2) / p
    r = fetch(pts, auc=F.sum(F.col("pos") * v10) / p, a2=F.sum(F.col("pos") * v10 * v10), b1=F.sum(F.col("neg") * v01),
              b2=F.sum(F.col("neg") * v01 * v01))
    auc = r["auc"]
    flipped = auc < 0.5
    if p > 1 and n > 1:
        s10 = (r["a2"] - p * auc * auc) / (p - 1)
        s01 = (r["b2"] - n * auc * auc) / (n - 1)
        se = math.sqrt(max(s10 / p + s01 / n, 0))
    else:
        q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
        se = math.sqrt((auc * (1 - auc) + (p - 1) * (q1 - auc ** 2) + (n - 1) * (q2 - auc ** 2)) / (p * n))
    auc = 1 - auc if flipped else auc
    if flipped:                              # positive when the score is at or below the cut
        tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
        first = -F.col("s")
    else:
        tp, fp, first = F.col("tp"), F.col("fp"), F.col("s")
    j = F.round(tp / p - fp / n, 12)
    # First maximum along descending score: the highest score wins ties.
    best = pts.select(F.max(F.struct(j.alias("j"), first.alias("o"), F.col("s").alias("s"), tp.alias("tp"), fp.alias("fp"))).alias("b")).select("b.*").collect()[0]
    tpv, fpv = best["tp"], best["fp"]
    z = dist.norm_ppf((1 + ci) / 2)
    sens, spec = tpv / p, 1 - fpv / n
    ppv = dist.wilson(tpv, tpv + fpv, z)
    npv = dist.wilson(n - fpv, (n - fpv) + (p - tpv), z)
    ws, wc = dist.wilson(tpv, p, z), dist.wilson(n - fpv, n, z)
    return one_row(df.sparkSession, n_pos=int(p), n_neg=int(n), auc=auc, auc_se=se, flipped=bool(flipped), cutoff=best["s"], youden=sens + spec - 1,
                   sensitivity=sens, specificity=spec, ppv=ppv[0], npv=npv[0], lr_plus=sens / (1 - spec) if spec < 1 else float("inf"),
                   lr_minus=(1 - sens) / spec if spec > 0 else float("inf"), auc_low=max(0.0, auc - z * se), auc_high=min(1.0, auc + z * se),
                   sens_low=ws[1], sens_high=ws[2], spec_low=wc[1], spec_high=wc[2])


def reliability_bins(df: DataFrame, prob: str, outcome: str, bins: int = 10) -> DataFrame:
    """Equal-width bins on [0, 1] with mean prediction, observed share and Wilson interval."""
    k = min(max(int(bins), 3), 20)
    d = complete(df, [prob, outcome])
    b = F.least(F.floor(F.col(prob) * k), F.lit(k - 1)).cast("bigint")
    t = d.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_predicted"), F.avg(outcome).alias("observed"))
    z = dist.Z95
    pz, nz = F.col("observed"), F.col("n").cast("double")
    mid = (pz + z * z / (2 * nz)) / (1 + z * z / nz)
    half = z * F.sqrt(pz * (1 - pz) / nz + z * z / (4 * nz * nz)) / (1 + z * z / nz)
    return t.select("*", F.greatest(F.lit(0.0), mid - half).alias("wilson_low"), F.least(F.lit(1.0), mid + half).alias("wilson_high"))


def calibration_assessment(df: DataFrame, prob: str, outcome: str, id_col: str, groups: int = 10, bins: int = 10) -> DataFrame:
    """Brier score with its decomposition over bins, Hosmer-Lemeshow on equal-count groups, recalibration line."""
    from .glm import logit_fit
    d = complete(df, [prob, outcome], [id_col])
    n = d.count()
    brier = fetch(d, b=F.avg((F.col(prob) - F.col(outcome)) ** 2), o=F.avg(outcome))
    rb = collect_bounded(reliability_bins(d, prob, outcome, bins), "bins")
    rel = sum(r["n"] * (r["mean_predicted"] - r["observed"]) ** 2 for r in rb) / n
    res = sum(r["n"] * (r["observed"] - brier["o"]) ** 2 for r in rb) / n
    pos = sorted_position(d, prob, [id_col], "__i")
    g = F.least(F.floor((F.col("__i") - 1) * groups / F.lit(n)), F.lit(groups - 1))
    hl = collect_bounded(pos.groupBy(g.alias("g")).agg(F.sum(prob).alias("e"), F.sum(outcome).alias("o"), F.count(F.lit(1)).alias("n")), "groups")
    stat = sum((r["o"] - r["e"]) ** 2 / r["e"] + (r["o"] - r["e"]) ** 2 / (r["n"] - r["e"]) for r in hl if 0 < r["e"] < r["n"])
    used = len(hl)
    pc = F.least(F.greatest(F.col(prob), F.lit(1e-6)), F.lit(1 - 1e-6))
    f = logit_fit(d.select(F.col(outcome).alias("__y"), F.log(pc / (1 - pc)).alias("lp")), "__y", ["lp"])
    return one_row(df.sparkSession, n=n, brier=brier["b"], reliability=rel, resolution=res, uncertainty=brier["o"] * (1 - brier["o"]),
                   hosmer_lemeshow=stat, hl_groups=used, slope=float(f.beta[1]), intercept=float(f.beta[0]),
                   hl_p=dist.chi2_sf(stat, used - 2) if used > 2 else float("nan"))


# --- survey weighting -----------------------------------------------------------------------------

def _weighted(w: Column, y: Column) -> dict:
    return {"n": F.count(F.lit(1)), "sw": F.sum(w), "sw2": F.sum(w * w), "swy": F.sum(w * y),
            "swwy": F.sum(w * w * y), "swwyy": F.sum(w * w * y * y)}


def weighted_estimation(df: DataFrame, value: str, weight: str, group: str | None = None) -> DataFrame:
    """Design-weighted mean, total, linearised SE, design effect and effective n; overall or per group."""
    d = complete(df, [value, weight], [group] if group else [])
    low = fetch(d, m=F.min(weight), n=F.count(F.lit(1)))
    refuse(low["n"] < 3, "three rows are needed")
    refuse(low["m"] <= 0, "weights must be positive")
    w, y = F.col(weight), F.col(value)
    t = (d.groupBy(group) if group else d.groupBy()).agg(*[v.alias(k) for k, v in _weighted(w, y).items()])
    mean = F.col("swy") / F.col("sw")
    ss = F.col("swwyy") - 2 * mean * F.col("swwy") + mean * mean * F.col("sw2")
    n = F.col("n").cast("double")
    return t.select(*([group] if group else []), F.col("n"), mean.alias("mean"),
                    F.sqrt(F.greatest(F.try_divide(n, n - 1) * ss, F.lit(0.0)) / (F.col("sw") ** 2)).alias("se"),
                    F.col("swy").alias("total"), (n * F.col("sw2") / F.col("sw") ** 2).alias("deff"),
                    (F.col("sw") ** 2 / F.col("sw2")).alias("n_eff"))


def post_weights(df: DataFrame, stratum: str, props: Mapping, weight: str | None = None) -> DataFrame:
    """Rows with `post_weight`; a level without a population share is refused."""
    need(df, stratum, weight)
    w = num(weight) if weight else F.lit(1.0)
    d = df.where(F.col(stratum).isNotNull()).withColumn("__w", w)
    cells = collect_bounded(d.groupBy(stratum).agg(F.sum("__w").alias("s")), f"levels of {stratum}")
    gone = [r[stratum] for r in cells if r[stratum] not in props]
    refuse(bool(gone), f"no population share for {gone}")
    total, ptot = sum(r["s"] for r in cells), sum(props.values())
    fac = F.create_map(*[x for r in cells for x in (F.lit(r[stratum]), F.lit(float(props[r[stratum]] / ptot / (r["s"] / total))))])
    return d.withColumn("post_weight", F.col("__w") * fac[F.col(stratum)])


def poststratification(df: DataFrame, stratum: str, props: Mapping, value: str, weight: str | None = None) -> DataFrame:
    """Mean before and after calibration to population shares, with Kish efficiency."""
    d = post_weights(df, stratum, props, weight)
    r = d.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("__w") * F.col(value)) / F.sum("__w")).alias("mean_before"),
              (F.sum(F.col("post_weight") * F.col(value)) / F.sum("post_weight")).alias("mean_after"),
              (F.sum("post_weight") ** 2 / (F.count(F.lit(1)) * F.sum(F.col("post_weight") ** 2))).alias("kish_efficiency"),
              F.min("post_weight").alias("min_weight"), F.max("post_weight").alias("max_weight"))
    return r


def rake_cells(cells: list[tuple], margins: Sequence[Mapping], max_iter: int = 50, tol: float = 1e-7):
    """Iterative proportional fitting on collapsed cells: (key tuple, weight) -> (weights, steps, error)."""
    w = np.array([c[1] for c in cells], float)
    tot = w.sum()
    idx = []
    for v, m in enumerate(margins):
        s = sum(m.values())
        present = {c[0][v] for c in cells}
        refuse(not present <= set(m), f"no target for levels {sorted(map(str, present - set(m)))}")
        idx.append([(np.array([c[0][v] == lv for c in cells]), t / s) for lv, t in m.items() if lv in present])
    err = math.inf
    steps = 0
    for steps in range(1, max_iter + 1):
        for groups in idx:
            for mask, share in groups:
                w[mask] *= share * tot / w[mask].sum()
        err = max(abs(w[mask].sum() / w.sum() - share) for groups in idx for mask, share in groups)
        if err < tol:
            break
    return w, steps, err


def raking(df: DataFrame, rake_vars: Sequence[str], margins: Mapping[str, Mapping], weight: str | None = None,
           max_iter: int = 50, tol: float = 1e-7) -> DataFrame:
    """Rows with `rake_weight`: the loop runs on the cell table, the cell factor is joined back once."""
    vs = list(rake_vars)
    refuse(len(vs) < 2, "two margins are needed")
    need(df, *vs, weight)
    w = num(weight) if weight else F.lit(1.0)
    d = df.withColumn("__w", w)
    rows = collect_bounded(d.groupBy(*vs).agg(F.sum("__w").alias("s")), "raking cells")
    cells = [(tuple(r[v] for v in vs), r["s"]) for r in rows]
    new, steps, err = rake_cells(cells, [margins[v] for v in vs], max_iter, tol)
    fields = ", ".join(f"`{v}` {df.schema[v].dataType.simpleString()}" for v in vs)
    f = rows_frame(df.sparkSession, fields + ", __f double", [(*k, float(x / s)) for (k, s), x in zip(cells, new)])
    return (d.join(F.broadcast(f), vs).withColumn("rake_weight", F.col("__w") * F.col("__f")).drop("__w", "__f")
            .withColumn("rake_steps", F.lit(steps)).withColumn("rake_error", F.lit(float(err))))


def raking_margins(df: DataFrame, rake_vars: Sequence[str], margins: Mapping[str, Mapping]) -> DataFrame:
    """Weighted shares per level after raking."""
    r = raking(df, rake_vars, margins)
    long = r.select("rake_weight", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in rake_vars])).alias("s"))
    t = long.groupBy("s.variable", "s.level").agg(F.count(F.lit(1)).alias("n"), F.sum("rake_weight").alias("weight"))
    return t.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("variable")))


# --- conjugate Bayes ------------------------------------------------------------------------------

def beta_interval(a: float, b: float, level: float = 0.95, kind: str = "equal") -> tuple[float, float]:
    lo, hi = (1 - level) / 2, (1 + level) / 2
    if kind == "equal":
        return dist.beta_ppf(lo, a, b), dist.beta_ppf(hi, a, b)
    best = None
    for t in np.linspace(0, 1 - level, 201):
        x, y = dist.beta_ppf(t, a, b), dist.beta_ppf(min(t + level, 1.0), a, b)
        if best is None or y - x < best[1] - best[0]:
            best = (x, y)
    return best


def bayesian_proportion(df: DataFrame, outcome: str, group: str | None = None, prior_a: float = 1.0, prior_b: float = 1.0,
                        ci: float = 0.95, ref: float = 0.5, interval: str = "equal") -> DataFrame:
    """Beta posterior of a proportion, overall or per group."""
    y, *_ = binary01(df, outcome)
    d = df.select(y.alias("y"), *([F.col(group)] if group else [F.lit("all").alias("group")])).dropna()
    g = group or "group"
    rows = collect_bounded(d.groupBy(g).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")), "groups")
    out = []
    for r in sorted(rows, key=lambda r: level_key(r[g])):
        a, b = prior_a + r["k"], prior_b + r["n"] - r["k"]
        lo, hi = beta_interval(a, b, ci, interval)
        out.append((str(r[g]), r["n"], int(r["k"]), a / (a + b), (a - 1) / (a + b - 2) if a > 1 and b > 1 else None,
                    dist.beta_ppf(0.5, a, b), lo, hi, 1 - dist.beta_i(a, b, ref)))
    return rows_frame(df.sparkSession, "level string, n bigint, successes bigint, posterior_mean double, posterior_mode double, "
                      "posterior_median double, ci_low double, ci_high double, p_above_ref double", out)


def prob_b_above_a(a1, b1, a2, b2) -> float:
    """P(theta_2 > theta_1) for independent Beta variables by quadrature around the second posterior."""
    x, w = np.polynomial.legendre.leggauss(400)
    m = a2 / (a2 + b2)
    s = math.sqrt(a2 * b2 / ((a2 + b2) ** 2 * (a2 + b2 + 1)))
    lo, hi = max(0.0, m - 12 * s), min(1.0, m + 12 * s)
    x = (hi - lo) / 2 * x + (hi + lo) / 2
    w = w * (hi - lo) / 2
    lb = math.lgamma(a2 + b2) - math.lgamma(a2) - math.lgamma(b2)
    f = np.exp(lb + (a2 - 1) * np.log(x) + (b2 - 1) * np.log1p(-x))
    return float(min(1.0, max(0.0, (w * f * np.array([dist.beta_i(a1, b1, v) for v in x])).sum() / (w * f).sum())))


def bayesian_ab_test(df: DataFrame, outcome: str, group: str, prior_a: float = 1.0, prior_b: float = 1.0, seed: int = 42) -> DataFrame:
    """Two arms in level order: posterior means, P(B > A), relative lift and expected loss."""
    y, *_ = binary01(df, outcome)
    d = df.select(y.alias("y"), F.col(group)).dropna()
    rows = sorted(collect_bounded(d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")), "arms"), key=lambda r: level_key(r[group]))
    refuse(len(rows) != 2, "two arms are needed")
    (a1, b1), (a2, b2) = [(prior_a + r["k"], prior_b + r["n"] - r["k"]) for r in rows]
    rng = np.random.default_rng(seed)
    s1, s2 = rng.beta(a1, b1, 200_000), rng.beta(a2, b2, 200_000)
    m1, m2 = a1 / (a1 + b1), a2 / (a2 + b2)
    return one_row(df.sparkSession, arm_a=str(rows[0][group]), arm_b=str(rows[1][group]), n_a=int(rows[0]["n"]), n_b=int(rows[1]["n"]),
                   mean_a=m1, mean_b=m2, difference=m2 - m1, p_b_above_a=prob_b_above_a(a1, b1, a2, b2), lift=float(((s2 - s1) / s1).mean()),
                   loss_a=float(np.maximum(s2 - s1, 0).mean()), loss_b=float(np.maximum(s1 - s2, 0).mean()))


def bayesian_poisson_rate(df: DataFrame, outcome: str, exposure: str | None = None, group: str | None = None,
                          prior_shape: float = 0.001, prior_rate: float = 0.001, ci: float = 0.95) -> DataFrame:
    """Gamma posterior of a rate with an overdispersion flag, overall or per group."""
    e = num(exposure) if exposure else F.lit(1.0)
    d = df.select(num(outcome).alias("y"), e.alias("e"), (F.col(group) if group else F.lit("all")).alias("g")).dropna()
    rows = collect_bounded(d.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum("e").alias("e"),
                                              F.var_samp("y").alias("v"), F.avg("y").alias("m")), "groups")
    out = []
    for r in sorted(rows, key=lambda r: level_key(r["g"])):
        a, b = prior_shape + r["y"], prior_rate + r["e"]
        out.append((str(r["g"]), r["n"], r["y"], r["e"], a / b, a / (b * b), (r["v"] or 0.0) / r["m"] if r["m"] else None,
                    bool(r["v"] is not None and r["m"] and r["v"] / r["m"] > 1.5),
                    dist.gamma_ppf((1 - ci) / 2, a, b), dist.gamma_ppf((1 + ci) / 2, a, b)))
    return rows_frame(df.sparkSession, "level string, n bigint, events double, exposure double, posterior_mean double, posterior_var double, "
                      "dispersion double, overdispersed boolean, ci_low double, ci_high double", out)


# --- capture histories ----------------------------------------------------------------------------

def capture_recapture(df: DataFrame, occasions: Sequence[str]) -> DataFrame:
    """Chapman for two occasions, Schnabel for more; the equal-catchability MLE beside it."""
    oc = list(occasions)
    refuse(len(oc) < 2, "two occasions are needed")
    d = complete(df, oc)
    c = [F.when(F.col(o) > 0, 1.0).otherwise(0.0) for o in oc]
    seen = [F.lit(0.0)]
    for x in c:
        seen.append(F.greatest(seen[-1], x))
    aggs = {"obs": F.sum(seen[-1])}
    for i in range(len(oc)):
        aggs |= {f"c{i}": F.sum(c[i]), f"m{i}": F.sum(seen[i]), f"r{i}": F.sum(seen[i] * c[i])}
    r = fetch(d, **aggs)
    obs = float(r["obs"])
    refuse(obs < 8, "eight marked individuals are needed")
    if len(oc) == 2:
        n1, n2, m2 = r["c0"], r["c1"], r["r1"]
        est = (n1 + 1) * (n2 + 1) / (m2 + 1) - 1
        var = (n1 + 1) * (n2 + 1) * (n1 - m2) * (n2 - m2) / ((m2 + 1) ** 2 * (m2 + 2))
        lo, hi, name = max(est - 1.96 * math.sqrt(var), obs), est + 1.96 * math.sqrt(var), "chapman"
    else:
        ct = sum(r[f"c{i}"] * r[f"m{i}"] for i in range(1, len(oc)))
        rt = sum(r[f"r{i}"] for i in range(1, len(oc)))
        refuse(rt == 0, "no recapture")
        est, name = ct / rt, "schnabel"
        se = math.sqrt(rt) / ct
        lo = max(1 / (1 / est + 1.96 * se), obs)
        hi = 1 / (1 / est - 1.96 * se) if 1 / est > 1.96 * se else float("inf")
    total = sum(r[f"c{i}"] for i in range(len(oc)))
    k = len(oc)

    def score(n):                           # derivative of the profile likelihood of M0, decreasing in n
        p = total / (k * n)
        return n * (1 - (1 - p) ** k) - obs

    m0 = dist._bisect(lambda n: score(n), obs, obs * 1e4, 0.0)
    return one_row(df.sparkSession, method=name, occasions=k, observed=int(obs), captures=int(total), n_hat=float(est), ci_low=float(lo),
                   ci_high=float(hi), m0_mle=float(m0))


def occupancy_model(df: DataFrame, visits: Sequence[str]) -> DataFrame:
    """Constant occupancy and detection by EM on the (visits, detections) counts."""
    vs = list(visits)
    vis = sum([F.when(num(v).isNotNull(), 1).otherwise(0) for v in vs], F.lit(0))
    det = sum([F.when(num(v) > 0, 1).otherwise(0) for v in vs], F.lit(0))
    rows = collect_bounded(df.select(vis.alias("k"), det.alias("d")).where("k > 0").groupBy("k", "d").count(), "histories")
    k = np.array([r["k"] for r in rows], float)
    d = np.array([r["d"] for r in rows], float)
    w = np.array([r["count"] for r in rows], float)
    psi, p = 0.5, 0.5
    for _ in range(5000):
        q0 = psi * (1 - p) ** k
        z = np.where(d > 0, 1.0, q0 / (q0 + 1 - psi))
        npsi, np_ = (w * z).sum() / w.sum(), (w * d).sum() / (w * z * k).sum()
        done = abs(npsi - psi) + abs(np_ - p) < 1e-13
        psi, p = npsi, np_
        if done:
            break

    def ll(a, b):
        ps, pp = 1 / (1 + math.exp(-a)), 1 / (1 + math.exp(-b))
        base = ps * pp ** d * (1 - pp) ** (k - d) + np.where(d == 0, 1 - ps, 0.0)
        return float((w * np.log(base)).sum())

    edge = min(psi, 1 - psi, p, 1 - p) < 1e-6
    se = [float("nan")] * 2
    a0, b0 = (math.log(x / (1 - x)) if 0 < x < 1 else 30.0 for x in (psi, p))
    if not edge:
        h = 1e-4
        hess = np.zeros((2, 2))
        for i in range(2):
            for j in range(2):
                ei, ej = np.eye(2)[i] * h, np.eye(2)[j] * h
                s = lambda u, v: ll(a0 + u * ei[0] + v * ej[0], b0 + u * ei[1] + v * ej[1])
                hess[i, j] = -(s(1, 1) - s(1, -1) - s(-1, 1) + s(-1, -1)) / (4 * h * h)
        cov = np.linalg.pinv(hess, hermitian=True)
        se = [math.sqrt(max(cov[0, 0], 0)) * psi * (1 - psi), math.sqrt(max(cov[1, 1], 0)) * p * (1 - p)]
    naive = float(w[d > 0].sum() / w.sum())
    return one_row(df.sparkSession, sites=int(w.sum()), visits=len(vs), naive=naive, psi=float(psi), p=float(p), psi_se=se[0], p_se=se[1],
                   loglik=ll(a0, b0), aic=4 - 2 * ll(a0, b0))


# --- set-theoretic analysis -----------------------------------------------------------------------

def calibrate_crisp(d: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Median dichotomy: 1 at or above the median."""
    med = {c: quantiles(d, c, [0.5])[0] for c in cols}
    return d.select(*[F.when(F.col(c) >= F.lit(med[c]), 1.0).otherwise(0.0).alias(c) for c in cols],
                    *[c for c in d.columns if c not in cols])


def calibrate_fuzzy(d: DataFrame, cols: Sequence[str], anchors: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Logistic membership with anchors at percentiles; membership .95 at full inclusion."""
    k = math.log(0.95 / 0.05)
    out = []
    for c in cols:
        e, x, i = quantiles(d, c, anchors)
        refuse(not e < x < i, f"the anchors of {c} are not distinct")
        dev = F.col(c) - F.lit(x)
        out.append((1 / (1 + F.exp(-F.lit(k) * dev / F.when(dev >= 0, F.lit(i - x)).otherwise(F.lit(x - e))))).alias(c))
    return d.select(*out, *[c for c in d.columns if c not in cols])


def _truth_table(d: DataFrame, outcome: str, conditions: Sequence[str], incl_cut: float) -> DataFrame:
    """All configurations in one aggregate: n, consistency and PRI of each."""
    cs = list(conditions)
    refuse(not 2 <= len(cs) <= 8, "two to eight conditions")
    y = F.col(outcome)
    aggs, configs = [], list(product([0, 1], repeat=len(cs)))
    for i, cfg in enumerate(configs):
        x = F.least(*[F.col(c) if b else 1 - F.col(c) for c, b in zip(cs, cfg)])
        corner = None
        for c, b in zip(cs, cfg):
            t = (F.col(c) > 0.5) if b else (F.col(c) <= 0.5)
            corner = t if corner is None else corner & t
        aggs.append(F.struct(F.lit("".join(map(str, cfg))).alias("configuration"), F.sum(F.when(corner, 1).otherwise(0)).alias("n"),
                             F.sum(x).alias("sx"), F.sum(F.least(x, y)).alias("sxy"), F.sum(F.least(x, y, 1 - y)).alias("sxyn")))
    t = d.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*").where("n > 0")
    cons = F.try_divide(F.col("sxy"), F.col("sx"))
    return t.select("configuration", "n", cons.alias("consistency"),
                    F.try_divide(F.col("sxy") - F.col("sxyn"), F.col("sx") - F.col("sxyn")).alias("pri"), (cons >= incl_cut).alias("included"))


def csqca(df: DataFrame, outcome: str, conditions: Sequence[str], incl_cut: float = 0.8) -> DataFrame:
    """Crisp truth table by median dichotomy (Boolean minimisation is not part of it)."""
    cols = [outcome, *conditions]
    return _truth_table(calibrate_crisp(complete(df, cols), cols), outcome, conditions, incl_cut)


def fsqca(df: DataFrame, outcome: str, conditions: Sequence[str], anchors: Sequence[float] = (0.1, 0.5, 0.9), incl_cut: float = 0.8) -> DataFrame:
    cols = [outcome, *conditions]
    return _truth_table(calibrate_fuzzy(complete(df, cols), cols, anchors), outcome, conditions, incl_cut)


def fsqca_sufficiency(df: DataFrame, outcome: str, conditions: Sequence[str], anchors: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    cols = [outcome, *conditions]
    d = calibrate_fuzzy(complete(df, cols), cols, anchors)
    y = F.col(outcome)
    st = [F.struct(F.lit(c).alias("condition"), F.sum(F.least(F.col(c), y)).alias("m"), F.sum(c).alias("x"), F.sum(y).alias("y")) for c in conditions]
    t = d.agg(F.array(*st).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return t.select("condition", (F.col("m") / F.col("x")).alias("consistency"), (F.col("m") / F.col("y")).alias("coverage"))


def panel_qca(df: DataFrame, outcome: str, conditions: Sequence[str], unit: str, time: str, anchors: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Pooled, per-period (between) and per-unit (within) consistency of the conjunction, with the distances."""
    cols = [outcome, *conditions]
    d = calibrate_fuzzy(complete(df, cols, [unit, time]), cols, anchors)
    x = F.least(*[F.col(c) for c in conditions]) if len(conditions) > 1 else F.col(conditions[0])
    base = d.select(F.least(x, F.col(outcome)).alias("m"), x.alias("x"), F.col(outcome).alias("y"), unit, time)

    def part(kind, key):
        k = F.lit("all") if key is None else F.col(key).cast("string")
        return base.groupBy(k.alias("key")).agg((F.sum("m") / F.sum("x")).alias("consistency"), (F.sum("m") / F.sum("y")).alias("coverage")) \
                   .select(F.lit(kind).alias("level"), "key", "consistency", "coverage")

    parts = {"pooled": part("pooled", None), "between": part("between", time), "within": part("within", unit)}
    out = parts["pooled"].withColumn("distance", F.lit(None).cast("double"))
    for kind in ("between", "within"):
        p = parts[kind]
        tot = p.agg(F.sum("consistency").alias("s"), F.count(F.lit(1)).alias("k"))
        dd = p.crossJoin(tot).agg(F.sqrt(F.sum((F.col("consistency") / F.col("s") - 1 / F.col("k")) ** 2)).alias("distance"))
        out = out.unionByName(p.crossJoin(dd))
    return out


def qca_necessity(df: DataFrame, outcome: str, conditions: Sequence[str], anchors: Sequence[float] = (0.1, 0.5, 0.9),
                  incl_cut: float = 0.9, cov_cut: float = 0.5) -> DataFrame:
    """Necessity of every condition, its negation and every pairwise OR; kept above both cuts."""
    cols = [outcome, *conditions]
    d = calibrate_fuzzy(complete(df, cols), cols, anchors)
    y = F.col(outcome)
    base = {**{c: F.col(c) for c in conditions}, **{f"~{c}": 1 - F.col(c) for c in conditions}}
    terms = dict(base)
    for a, b in combinations(sorted(base), 2):
        if a.lstrip("~") != b.lstrip("~"):
            terms[f"{a}+{b}"] = F.greatest(base[a], base[b])
    st = [F.struct(F.lit(k).alias("term"), F.sum(F.least(x, y)).alias("m"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(1 - x).alias("nx"),
                   F.sum(1 - F.least(x, y)).alias("nm")) for k, x in terms.items()]
    t = d.agg(F.array(*st).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    t = t.select("term", (F.col("m") / F.col("y")).alias("consistency"), (F.col("m") / F.col("x")).alias("coverage"), (F.col("nx") / F.col("nm")).alias("ron"))
    return t.where((F.col("consistency") >= incl_cut) & (F.col("coverage") >= cov_cut))


def nca(df: DataFrame, outcome: str, conditions: Sequence[str]) -> DataFrame:
    """Necessary-condition effect size: empty area above the running maximum of y along x."""
    rows = None
    for c in conditions:
        d = complete(df, [outcome, c]).groupBy(c).agg(F.max(outcome).alias("y"), F.count(F.lit(1)).alias("n"))
        s = fetch(d, n=F.sum("n"), x0=F.min(c), x1=F.max(c), y1=F.max("y"))
        y0 = fetch(complete(df, [outcome, c]), y0=F.min(outcome))["y0"]
        refuse(s["n"] < 20, "twenty rows are needed")
        refuse(s["x1"] <= s["x0"] or s["y1"] <= y0, f"{c} or the outcome is constant")
        up = cumulate(d.select(F.col(c).alias("x"), "y"), "x", [], extremes=["y"])
        up = up.select("x", F.greatest("y", "y_maxbefore").alias("ceil"), (-F.col("x")).alias("neg"))
        nx = cumulate(up, "x", [], extremes=["neg"], descending=True)
        width = -F.col("neg_maxbefore") - F.col("x")
        dv = F.coalesce(F.sum((F.lit(s["y1"]) - F.col("ceil")) * width), F.lit(0.0)) / F.lit((s["x1"] - s["x0"]) * (s["y1"] - y0))
        t = nx.agg(dv.alias("d")).select(F.lit(c).alias("condition"), "d", F.when(F.col("d") < 0.1, "negligible").when(F.col("d") < 0.3, "medium")
                                         .when(F.col("d") < 0.5, "large").otherwise("very large").alias("necessity"))
        rows = t if rows is None else rows.unionByName(t)
    return rows


def pmc_index(df: DataFrame, groups: Mapping[str, Sequence[str]], policy: str) -> DataFrame:
    """First-level variable scores (mean of their indicators) and the PMC index with its rating.

    Indicators outside [0, 1] are min-max scaled; a missing cell counts as 0.
    """
    ind = [c for g in groups.values() for c in g]
    need(df, policy, *ind)
    r = fetch(df, **{f"lo{i}": F.min(num(c)) for i, c in enumerate(ind)}, **{f"hi{i}": F.max(num(c)) for i, c in enumerate(ind)})
    e = {}
    for i, c in enumerate(ind):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        v = num(c)
        if lo is not None and (lo < 0 or hi > 1):
            v = (v - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.lit(0.0)
        e[c] = F.coalesce(v, F.lit(0.0))
    score = {g: sum([e[c] for c in cs], F.lit(0.0)) / len(cs) for g, cs in groups.items()}
    t = df.select(F.col(policy), *[s.alias(f"x_{g}") for g, s in score.items()])
    t = t.withColumn("pmc", sum([F.col(f"x_{g}") for g in groups], F.lit(0.0)))
    ratio = F.col("pmc") / len(groups)
    return t.withColumn("pmc_ratio", ratio).withColumn(
        "rating", F.when(F.col("pmc_ratio") >= 0.9, "perfect").when(F.col("pmc_ratio") >= 0.7, "excellent")
        .when(F.col("pmc_ratio") >= 0.5, "acceptable").otherwise("poor"))
