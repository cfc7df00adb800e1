"""Group comparison, designed experiments, rank tests, resampling tests, agreement and reliability."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dist
from ..plans import resample
from ..plans.design import Cells
from ..plans.frames import (LEVEL_LIMIT, clean, collect_bounded, complete, cut_lineage, fetch, level_key, levels_of, need, num, one_row, refuse,
                            rows_frame)
from ..plans.gram import Gram, gram, gram_by, merge, ols, weighted_gram
from ..plans.order import (average_ranks, cumulate, dense_rank, group_quantiles, in_order, near_quantile, quantiles, range_bounds, running,
                           select_ranks, with_average_rank)


def group_moments(d: DataFrame, y: str, g: str) -> list[tuple]:
    """(level, n, mean, sample variance) per level in level order."""
    rows = collect_bounded(d.groupBy(g).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"),
                                            F.var_samp(y).alias("v")), f"levels of {g}")
    return sorted([(r[g], float(r["n"]), float(r["m"]), float(r["v"]) if r["v"] is not None and r["n"] > 1 else float("nan"))
                   for r in rows], key=lambda t: level_key(t[0]))


def welch_anova(mom: list[tuple]) -> tuple[float, float, float]:
    k = len(mom)
    if any(not v > 0 for _, _, _, v in mom):
        return (float("nan"),) * 3
    w = np.array([n / v for _, n, _, v in mom])
    m = np.array([t[2] for t in mom])
    n = np.array([t[1] for t in mom])
    mw = (w * m).sum() / w.sum()
    a = (((1 - w / w.sum()) ** 2) / (n - 1)).sum()
    f = ((w * (m - mw) ** 2).sum() / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * a)
    return float(f), float(k - 1), float((k * k - 1) / (3 * a))


def oneway(mom: list[tuple]) -> dict:
    n = sum(t[1] for t in mom)
    grand = sum(t[1] * t[2] for t in mom) / n
    ssb = sum(t[1] * (t[2] - grand) ** 2 for t in mom)
    ssw = sum((t[1] - 1) * t[3] for t in mom)
    k = len(mom)
    msw = ssw / (n - k)
    f = ssb / (k - 1) / msw if msw > 0 else float("nan")
    return {"n": n, "k": k, "ssb": ssb, "ssw": ssw, "msw": msw, "f": f, "p": dist.f_sf(f, k - 1, n - k),
            "eta2": ssb / (ssb + ssw), "omega2": (ssb - (k - 1) * msw) / (ssb + ssw + msw)}


def levene(d: DataFrame, y: str, g: str, center: str = "median") -> tuple[float, float]:
    """Brown-Forsythe F and p: one-way ANOVA of absolute deviations from group centres."""
    if center == "median":
        mid = {k[0]: v[0] for k, v in group_quantiles(d, y, [0.5], [g]).items()}
    else:
        mid = {t[0]: t[2] for t in group_moments(d, y, g)}
    z = d.withColumn("__dev", F.abs(F.col(y) - F.create_map(*[x for k, v in mid.items() for x in (F.lit(k), F.lit(v))])[F.col(g)]))
    o = oneway(group_moments(z, "__dev", g))
    return o["f"], o["p"]


def group_comparison(df: DataFrame, outcome: str, group: str) -> DataFrame:
    """Two levels: Welch t. Three or more: Welch ANOVA. Levene beside it. A level with one row is refused."""
    d = complete(df, [outcome], [group])
    mom = group_moments(d, outcome, group)
    refuse(len(mom) < 2, "two groups are needed")
    refuse(any(t[1] < 2 for t in mom), "a group has fewer than two rows")
    lf, lp = levene(d, outcome, group)
    if len(mom) == 2:
        (_, n1, m1, v1), (_, n2, m2, v2) = mom
        se2 = v1 / n1 + v2 / n2
        stat = (m1 - m2) / math.sqrt(se2)
        df2 = se2 ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
        return one_row(df.sparkSession, test="welch_t", groups=2, n=int(n1 + n2), statistic=stat, df1=1.0, df2=df2,
                       mean_difference=m1 - m2, p=dist.t_two_sided(stat, df2), levene_f=lf, levene_p=lp)
    f, d1, d2 = welch_anova(mom)
    return one_row(df.sparkSession, test="welch_anova", groups=len(mom), n=int(sum(t[1] for t in mom)), statistic=f,
                   df1=d1, df2=d2, mean_difference=float("nan"), p=dist.f_sf(f, d1, d2), levene_f=lf, levene_p=lp)


def anova_oneway(df: DataFrame, outcome: str, group: str) -> DataFrame:
    """F, eta and omega squared, Welch F and the median-centred Levene test."""
    d = complete(df, [outcome], [group])
    mom = group_moments(d, outcome, group)
    refuse(len(mom) < 2 or any(t[1] < 2 for t in mom), "two groups of at least two rows are needed")
    o = oneway(mom)
    wf, _, wd = welch_anova(mom)
    lf, lp = levene(d, outcome, group)
    return one_row(df.sparkSession, n=int(o["n"]), groups=o["k"], f=o["f"], eta_squared=o["eta2"], omega_squared=o["omega2"],
                   welch_f=wf, welch_df2=wd, levene_f=lf, p=o["p"], welch_p=dist.f_sf(wf, o["k"] - 1, wd), levene_p=lp)


def tukey_hsd(df: DataFrame, outcome: str, group: str) -> DataFrame:
    """All level pairs with the studentised-range statistic and p."""
    d = complete(df, [outcome], [group])
    return _tukey(df, group_moments(d, outcome, group))


def _tukey(df, mom, msw=None, dof=None):
    o = oneway(mom) if msw is None else None
    msw = o["msw"] if msw is None else msw
    dof = o["n"] - o["k"] if dof is None else dof
    rows = []
    for i, a in enumerate(mom):
        for b in mom[i + 1:]:
            qv = abs(a[2] - b[2]) / math.sqrt(msw / 2 * (1 / a[1] + 1 / b[1]))
            rows.append((str(a[0]), str(b[0]), a[2] - b[2], qv, dist.studentized_range_sf(qv, len(mom), dof)))
    return rows_frame(df.sparkSession, "group_a string, group_b string, difference double, q double, p double", rows)


def ancova(df: DataFrame, outcome: str, group: str, covariates: Sequence[str]) -> DataFrame:
    """Type II F and partial eta squared of the factor and covariates, with the slope-homogeneity F.

    All nested models come from the per-level moments of one grouped pass.
    """
    cov = list(covariates)
    d = complete(df, [outcome, *cov], [group])
    parts = gram_by(d, [outcome, *cov], group)
    keys = sorted(parts, key=level_key)
    k, p = len(keys), len(cov)
    refuse(k < 2 or any(parts[g].n <= p + 1 for g in keys), "too few rows in a group")
    total = merge(list(parts.values()))
    pooled = sum(g.cross for g in parts.values())
    n = total.n

    def rss(c, xs):
        if not xs:
            return c[0, 0]
        i = [1 + cov.index(x) for x in xs]
        return c[0, 0] - c[0, i] @ np.linalg.pinv(c[np.ix_(i, i)], hermitian=True) @ c[i, 0]

    full = rss(pooled, cov)
    dof = n - k - p
    rows = []
    tests = [(group, rss(total.cross, cov) - full, k - 1)] + [
        (c, rss(pooled, [x for x in cov if x != c]) - full, 1) for c in cov]
    for name, ss, df1 in tests:
        f = ss / df1 / (full / dof)
        rows.append((name, ss, df1, dof, f, ss / (ss + full), dist.f_sf(f, df1, dof)))
    sep = sum(rss(g.cross, cov) for g in parts.values())
    df1, df2 = (k - 1) * p, n - k * (p + 1)
    f = ((full - sep) / df1) / (sep / df2)
    rows.append(("slope_homogeneity", full - sep, df1, df2, f, (full - sep) / full, dist.f_sf(f, df1, df2)))
    return rows_frame(df.sparkSession, "term string, ss double, df1 double, df2 double, f double, partial_eta2 double, p double", rows)


def adjusted_means(df: DataFrame, outcome: str, group: str, covariates: Sequence[str]) -> DataFrame:
    """Group means at the overall covariate means under common slopes."""
    cov = list(covariates)
    parts = gram_by(complete(df, [outcome, *cov], [group]), [outcome, *cov], group)
    total = merge(list(parts.values()))
    pooled = sum(g.cross for g in parts.values())
    b = np.linalg.pinv(pooled[1:, 1:], hermitian=True) @ pooled[1:, 0]
    return rows_frame(df.sparkSession, "level string, n bigint, mean double, adjusted_mean double",
                      [(str(k), int(parts[k].n), parts[k].mean[0],
                        float(parts[k].mean[0] - b @ (parts[k].mean[1:] - total.mean[1:]))) for k in sorted(parts, key=level_key)])


def to_long(df: DataFrame, subject: str, measures: Sequence[str], within: str = "condition", value: str = "value") -> DataFrame:
    """Wide measures to one row per subject and condition."""
    need(df, subject, *measures)
    return df.select(F.col(subject), F.explode(F.array(*[F.struct(F.lit(m).alias(within), num(m).alias(value))
                                                         for m in measures])).alias("__s")).select(subject, "__s.*")


def repeated_measures_anova(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Within-subject F with Mauchly's W and Greenhouse-Geisser / Huynh-Feldt epsilons.

    Everything follows from the k x k covariance of the conditions over complete subjects.
    """
    ms = list(measures)
    k = len(ms)
    refuse(k < 2, "two conditions are needed")
    g = gram(complete(df, ms), ms)
    n = g.n
    s = g.cov()
    grand = g.mean.mean()
    ss_cond = n * ((g.mean - grand) ** 2).sum()
    c = np.eye(k) - np.ones((k, k)) / k
    ss_err = np.trace(c @ g.cross @ c)
    d1, d2 = k - 1, (k - 1) * (n - 1)
    f = ss_cond / d1 / (ss_err / d2)
    # Orthonormal contrasts: Helmert rows.
    h = np.array([[1.0] * i + [-i] + [0.0] * (k - i - 1) for i in range(1, k)])
    h /= np.linalg.norm(h, axis=1)[:, None]
    t = h @ s @ h.T
    ev = np.linalg.eigvalsh(t)
    gg = ev.sum() ** 2 / (d1 * (ev ** 2).sum())
    hf = min(1.0, (n * d1 * gg - 2) / (d1 * (n - 1 - d1 * gg)))
    w = np.linalg.det(t) / (np.trace(t) / d1) ** d1
    chi = -(n - 1 - (2 * d1 * d1 + d1 + 2) / (6 * d1)) * math.log(w) if k > 2 and w > 0 else float("nan")
    mdf = d1 * (d1 + 1) / 2 - 1
    return one_row(df.sparkSession, n=int(n), conditions=k, f=float(f), ss_condition=float(ss_cond), ss_error=float(ss_err),
                   partial_eta2=float(ss_cond / (ss_cond + ss_err)), mauchly_w=float(w), epsilon_gg=float(gg), epsilon_hf=float(hf),
                   p=dist.f_sf(f, d1, d2), p_gg=dist.f_sf(f, d1 * gg, d2 * gg), p_hf=dist.f_sf(f, d1 * hf, d2 * hf),
                   mauchly_p=dist.chi2_sf(chi, mdf) if mdf > 0 and chi == chi else float("nan"))


def _anova_table(df: DataFrame, cells: Cells, terms, extra=()):
    tests, rss, dof = cells.type2(terms)
    refuse(dof <= 0, "no residual degrees of freedom")
    ms = rss / dof
    rows = []
    for t, ss, d1 in tests:
        f = ss / d1 / ms if d1 > 0 and ms > 0 else float("nan")
        rows.append((":".join(t), ss, float(d1), f, ss / (ss + rss), ss / cells.tss, dist.f_sf(f, d1, dof)))
    rows.append(("residual", rss, float(dof), None, None, None, None))
    rows += list(extra)
    return rows_frame(df.sparkSession, "term string, ss double, df double, f double, partial_eta2 double, eta2 double, p double", rows)


def factorial_anova(df: DataFrame, outcome: str, factor_a: str, factor_b: str) -> DataFrame:
    """A x B Type II with interaction; every cell needs more than one row on average."""
    cells = Cells(complete(df, [outcome], [factor_a, factor_b]), outcome, [factor_a, factor_b])
    refuse(cells.total_n <= len(cells.key), "one row per cell leaves no error for the interaction")
    return _anova_table(df, cells, [(factor_a,), (factor_b,), (factor_a, factor_b)])


def rcbd(df: DataFrame, outcome: str, treatment: str, block: str) -> DataFrame:
    """Randomised complete blocks: treatment + block, Type II."""
    cells = Cells(complete(df, [outcome], [treatment, block]), outcome, [treatment, block])
    return _anova_table(df, cells, [(treatment,), (block,)])


def rcbd_anova(df: DataFrame, outcome: str, treatment: str, block: str) -> DataFrame:
    """Blocks ANOVA with the relative efficiency of blocking, one row."""
    cells = Cells(complete(df, [outcome], [treatment, block]), outcome, [treatment, block])
    tests, rss, dof = cells.type2([(treatment,), (block,)])
    b, t = len(cells.levels[block]), len(cells.levels[treatment])
    mse, msb = rss / dof, tests[1][1] / tests[1][2]
    re = ((b - 1) * msb + b * (t - 1) * mse) / ((b * t - 1) * mse)
    f = tests[0][1] / tests[0][2] / mse
    return one_row(df.sparkSession, n=int(cells.total_n), treatments=t, blocks=b, f_treatment=f, f_block=msb / mse,
                   eta2_treatment=tests[0][1] / cells.tss, relative_efficiency=re, p_treatment=dist.f_sf(f, t - 1, dof))


def _check_square(cells: Cells, t: str, r: str, c: str) -> None:
    k = len(cells.levels[t])
    ok = len(cells.levels[r]) == k == len(cells.levels[c]) and len(cells.key) == k * k
    for f in (r, c):
        ok = ok and len({(key[cells.factors.index(f)], key[cells.factors.index(t)]) for key in cells.key}) == k * k
    refuse(not ok, "not a Latin square: every treatment must stand once in each row and column")


def latin_square(df: DataFrame, outcome: str, treatment: str, row: str, col: str) -> DataFrame:
    """Treatment + row + column on a validated t x t square."""
    cells = Cells(complete(df, [outcome], [treatment, row, col]), outcome, [treatment, row, col])
    _check_square(cells, treatment, row, col)
    return _anova_table(df, cells, [(treatment,), (row,), (col,)])


def latin_square_anova(df: DataFrame, outcome: str, treatment: str, row: str, col: str) -> DataFrame:
    t = latin_square(df, outcome, treatment, row, col)
    return t.select("term", "ss", "df", "f", "eta2", "p")


def split_plot(df: DataFrame, outcome: str, block: str, whole_plot: str, sub_plot: str) -> DataFrame:
    """Two error strata on a complete balanced design: A on Block x A, B and A x B on the residual."""
    cells = Cells(complete(df, [outcome], [block, whole_plot, sub_plot]), outcome, [block, whole_plot, sub_plot])
    b, a, s = (len(cells.levels[f]) for f in (block, whole_plot, sub_plot))
    refuse(len(cells.key) != a * b * s or len(set(cells.n)) != 1, "the design must be complete and balanced")
    r = cells.n[0]
    lv = cells.levels
    m = np.zeros((b, a, s))
    for key, mean in zip(cells.key, cells.m):
        m[lv[block].index(key[0]), lv[whole_plot].index(key[1]), lv[sub_plot].index(key[2])] = mean
    g = m.mean()
    mb, ma, ms_ = m.mean((1, 2)), m.mean((0, 2)), m.mean((0, 1))
    ss_b = r * a * s * ((mb - g) ** 2).sum()
    ss_a = r * b * s * ((ma - g) ** 2).sum()
    ss_ba = r * s * ((m.mean(2) - mb[:, None] - ma[None, :] + g) ** 2).sum()
    ss_s = r * a * b * ((ms_ - g) ** 2).sum()
    ss_as = r * b * ((m.mean(0) - ma[:, None] - ms_[None, :] + g) ** 2).sum()
    ss_e = cells.tss - ss_b - ss_a - ss_ba - ss_s - ss_as
    d_e = cells.total_n - 1 - (b - 1) - (a - 1) - (a - 1) * (b - 1) - (s - 1) - (a - 1) * (s - 1)
    d_ba = (a - 1) * (b - 1)
    rows = [(block, ss_b, b - 1, None, None, None)]
    naive = ss_a / (a - 1) / ((ss_e + ss_ba) / (d_e + d_ba))
    for name, ss, d1, es, ed in ((whole_plot, ss_a, a - 1, ss_ba, d_ba), (sub_plot, ss_s, s - 1, ss_e, d_e),
                                 (f"{whole_plot}:{sub_plot}", ss_as, (a - 1) * (s - 1), ss_e, d_e)):
        f = ss / d1 / (es / ed)
        rows.append((name, ss, d1, f, ss / (ss + es), dist.f_sf(f, d1, ed)))
    rows.insert(2, ("whole_plot_error", ss_ba, d_ba, None, None, None))
    rows.append(("residual", ss_e, d_e, None, None, None))
    rows.append((f"naive_{whole_plot}", ss_a, a - 1, naive, None, dist.f_sf(naive, a - 1, d_e + d_ba)))
    return rows_frame(df.sparkSession, "term string, ss double, df double, f double, partial_eta2 double, p double",
                      [(t, ss, float(d), f, e, p) for t, ss, d, f, e, p in rows])


split_plot_anova = split_plot


def response_surface(df: DataFrame, outcome: str, factors: Sequence[str]) -> DataFrame:
    """Second-order polynomial and its stationary point (max, min or saddle by eigenvalue signs)."""
    fs = list(factors)
    d = complete(df, [outcome, *fs])
    g0 = gram(d, fs)
    mid, sd = g0.mean, np.sqrt(np.diag(g0.cross) / g0.n)
    z = d.select(outcome, *[((F.col(f) - F.lit(float(m))) / F.lit(float(s))).alias(f) for f, m, s in zip(fs, mid, sd)])
    terms = list(fs)
    quad = {}
    for i, a in enumerate(fs):
        for j in range(i, len(fs)):
            name = f"__q{i}_{j}"
            z = z.withColumn(name, F.col(a) * F.col(fs[j]))
            quad[(i, j)] = name
            terms.append(name)
    fit = ols(gram(z, [outcome, *terms]), outcome, terms)
    co = dict(zip(fit.terms, fit.beta))
    b = np.array([co[f] for f in fs])
    bm = np.zeros((len(fs),) * 2)
    for (i, j), name in quad.items():
        bm[i, j] += co[name] / 2
        bm[j, i] += co[name] / 2
    ev = np.linalg.eigvalsh(bm)
    xs = -0.5 * np.linalg.solve(bm, b)
    shape = "maximum" if (ev < 0).all() else "minimum" if (ev > 0).all() else "saddle"
    ys = float(fit.beta[0] + 0.5 * b @ xs)
    return rows_frame(df.sparkSession, "factor string, stationary double, eigenvalue double, shape string, predicted double, r2 double",
                      [(f, float(mid[i] + sd[i] * xs[i]), float(ev[i]), shape, ys, fit.r2) for i, f in enumerate(fs)])


def _ge_matrix(df, outcome, genotype, environment):
    cells = Cells(complete(df, [outcome], [genotype, environment]), outcome, [genotype, environment])
    gs, es = cells.levels[genotype], cells.levels[environment]
    refuse(len(cells.key) != len(gs) * len(es), "every genotype must occur in every environment")
    refuse(len(gs) < 3 or len(es) < 3, "three genotypes and three environments are needed")
    m = np.zeros((len(gs), len(es)))
    for key, v in zip(cells.key, cells.m):
        m[gs.index(key[0]), es.index(key[1])] = v
    return gs, es, m


def _signed_svd(x):
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    for k in range(len(s)):                        # sign: largest loading positive
        if vt[k, np.argmax(np.abs(vt[k]))] < 0:
            vt[k] *= -1
            u[:, k] *= -1
    return u, s, vt


def ammi(df: DataFrame, outcome: str, genotype: str, environment: str) -> DataFrame:
    """Genotype and environment scores of the doubly centred cell means, with ASV and IPCA shares."""
    gs, es, m = _ge_matrix(df, outcome, genotype, environment)
    inter = m - m.mean(1)[:, None] - m.mean(0)[None, :] + m.mean()
    u, s, vt = _signed_svd(inter)
    share = s ** 2 / (s ** 2).sum()
    rows = []
    for kind, names, sc, mean in (("genotype", gs, u * np.sqrt(s), m.mean(1)), ("environment", es, vt.T * np.sqrt(s), m.mean(0))):
        for i, nme in enumerate(names):
            asv = math.sqrt((s[0] ** 2 / s[1] ** 2 * sc[i, 0]) ** 2 + sc[i, 1] ** 2)
            rows.append((kind, str(nme), mean[i], sc[i, 0], sc[i, 1], asv, share[0], share[1]))
    return rows_frame(df.sparkSession, "kind string, name string, mean double, ipca1 double, ipca2 double, asv double, "
                      "ipca1_share double, ipca2_share double", rows)


def gge_biplot(df: DataFrame, outcome: str, genotype: str, environment: str) -> DataFrame:
    """Winner per environment by the rank-2 reconstruction of environment-centred means."""
    gs, es, m = _ge_matrix(df, outcome, genotype, environment)
    u, s, vt = _signed_svd(m - m.mean(0)[None, :])
    share = s ** 2 / (s ** 2).sum()
    approx = (u[:, :2] * s[:2]) @ vt[:2]
    return rows_frame(df.sparkSession, "environment string, winner string, pc1 double, pc2 double, pc1_share double, pc2_share double",
                      [(str(e), str(gs[int(np.argmax(approx[:, j]))]), vt[0, j] * s[0], vt[1, j] * s[1], share[0], share[1])
                       for j, e in enumerate(es)])


# --- effect sizes and rank tests ------------------------------------------------------------------

def _two(df, outcome, group):
    d = complete(df, [outcome], [group])
    mom = group_moments(d, outcome, group)
    refuse(len(mom) != 2, f"{group} must have exactly two levels")
    refuse(any(t[1] < 2 for t in mom), "a group has fewer than two rows")
    return d, mom


def rank_sum(d: DataFrame, outcome: str, group: str, first) -> dict:
    """Rank sum of the first level and the tie term, from distinct values."""
    r = average_ranks(d, outcome, a=F.col(group) == F.lit(first))
    t = fetch(r, n=F.sum("n"), n1=F.sum("a"), r1=F.sum(F.col("a") * F.col("avg_rank")),
              ties=F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")))
    n, n1 = float(t["n"]), float(t["n1"])
    return {"n": n, "n1": n1, "n2": n - n1, "u": float(t["r1"]) - n1 * (n1 + 1) / 2, "ties": float(t["ties"])}


def _d_frame(df, outcome, group, ci):
    d, mom = _two(df, outcome, group)
    (l1, n1, m1, v1), (l2, n2, m2, v2) = mom
    sp = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    dd = (m1 - m2) / sp
    u = rank_sum(d, outcome, group, l1)["u"]
    se = math.sqrt((n1 + n2) / (n1 * n2) + dd * dd / (2 * (n1 + n2)))
    z = dist.norm_ppf((1 + ci) / 2)
    j = 1 - 3 / (4 * (n1 + n2) - 9)
    return dict(group_1=str(l1), group_2=str(l2), n1=int(n1), n2=int(n2), pooled_sd=sp, d=dd, g=dd * j, se=se, z=z, j=j,
                cles=u / (n1 * n2), glass=(m1 - m2) / math.sqrt(v2))


def cohens_d(df: DataFrame, outcome: str, group: str, ci: float = 0.95) -> DataFrame:
    """Standardised mean difference with common-language effect size; levels in sorted order."""
    s = _d_frame(df, outcome, group, ci)
    return one_row(df.sparkSession, group_1=s["group_1"], group_2=s["group_2"], n1=s["n1"], n2=s["n2"], cohens_d=s["d"],
                   cles=s["cles"], glass_delta=s["glass"], ci_low=s["d"] - s["z"] * s["se"], ci_high=s["d"] + s["z"] * s["se"])


def hedges_g(df: DataFrame, outcome: str, group: str, ci: float = 0.95) -> DataFrame:
    s = _d_frame(df, outcome, group, ci)
    se = s["se"] * s["j"]
    return one_row(df.sparkSession, group_1=s["group_1"], group_2=s["group_2"], n1=s["n1"], n2=s["n2"], hedges_g=s["g"],
                   correction=s["j"], ci_low=s["g"] - s["z"] * se, ci_high=s["g"] + s["z"] * se)


def cliffs_delta(df: DataFrame, outcome: str, group: str) -> DataFrame:
    """2 AUC - 1 from ranks with the Romano bands."""
    d, mom = _two(df, outcome, group)
    r = rank_sum(d, outcome, group, mom[0][0])
    delta = 2 * r["u"] / (r["n1"] * r["n2"]) - 1
    a = abs(delta)
    band = "negligible" if a < 0.147 else "small" if a < 0.33 else "medium" if a < 0.474 else "large"
    return one_row(df.sparkSession, n1=int(r["n1"]), n2=int(r["n2"]), cliffs_delta=delta, magnitude=band)


DIFFERENCE_CELLS = 2048    # cells of neighbouring values whose differences are told apart on the driver


def pair_difference_quantile(d: DataFrame, value: str, group: str, first,
                             probs: Sequence[float] = (0.5,), fan: int = 32, cells: int = DIFFERENCE_CELLS) -> list[float]:
    """Exact order statistics of all differences a - b without forming them.

    Distinct values are cut into cells. From the cells' ends and totals (one row each) the driver knows which pairs of
    cells lie below or above a difference t as a whole, which brackets the wanted ranks. Only cells that the bracket cuts
    meet: each cell of a is written once beside the b that it must be compared with, and a pass over them counts the pairs
    with a - b <= t for several t. The bracket shrinks until it meets float precision; no row moves between passes.
    """
    a_here = F.col(group) == F.lit(first)
    ab = cut_lineage(d.groupBy(F.col(value).alias("x")).agg(F.sum(a_here.cast("bigint")).alias("ca"), F.sum((~a_here).cast("bigint")).alias("cb")))
    bounds = np.array(range_bounds(ab, "x", cells))

    def celled(batches):
        for b in batches:
            x = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, x, "left")), *b.columns], names=["cell", "x", "ca", "cb"])

    placed = ab.mapInArrow(celled, "cell bigint, x double, ca bigint, cb bigint")
    sides = {}
    for side in ("ca", "cb"):
        rows = collect_bounded(placed.where(f"{side} > 0").groupBy("cell").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(side).alias("n")).orderBy("cell"), "cells", cells + 1)
        sides[side] = [np.array([r[c] for r in rows]) for c in ("cell", "lo", "hi", "n")]
    (ka, alo, ahi, na), (kb, blo, bhi, nb) = sides["ca"], sides["cb"]
    upto = np.concatenate([[0], np.cumsum(nb)])
    total = int(na.sum()) * int(nb.sum())

    def cut(t0, t1):
        """Per cell of a: the first cell of b not above every t, and the first that is within t0 as a whole."""
        return np.searchsorted(bhi + t1, alo, "left"), np.searchsorted(blo + t0, ahi, "left")

    def sure(first_in) -> int:
        return sum(int(n) * int(upto[-1] - upto[j]) for n, j in zip(na, first_in))

    def most(t) -> int:
        return sure(cut(t, t)[0])

    def least(t) -> int:
        return sure(cut(t, t)[1])

    def counter(t0, t1):
        """Counts for any t in [t0, t1]: whole cells from their totals, the others from rows laid side by side once."""
        lo, hi = cut(t0, t1)
        base = sure(hi)
        met = np.flatnonzero(hi > lo)
        # Cells of b meet a run of cells of a, as both ends move up with the cell of a.
        start = np.searchsorted(hi, np.arange(len(kb)), "right")
        stop = np.searchsorted(lo, np.arange(len(kb)), "right")
        a_cells = set(ka[met].tolist())
        at = {int(c): (int(s), int(e)) for c, s, e in zip(kb, start, stop)}

        def deal(batches):
            for b in batches:
                cell, x, ca, cb = (b.column(i).to_numpy() for i in range(4))
                own = (ca > 0) & np.isin(cell, list(a_cells))
                runs = np.array([at.get(int(c), (0, 0)) for c in cell], np.int64).reshape(-1, 2)
                times = np.where(cb > 0, np.maximum(runs[:, 1] - runs[:, 0], 0), 0)
                which = np.repeat(np.arange(len(cell)), times)
                step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[cell[own], ka[runs[which, 0] + step]].astype(np.int64)), pa.array(np.r_[np.ones(own.sum(), bool), np.zeros(len(which), bool)]),
                                                  pa.array(np.r_[x[own], x[which]]), pa.array(np.r_[ca[own], cb[which]])], names=["i", "a", "x", "c"])

        def side_by_side(t: pa.Table) -> pa.Table:
            x, c, of_a = t.column("x").to_numpy(), t.column("c").to_numpy(), t.column("a").to_numpy()
            made = []
            for side in (of_a, ~of_a):
                o = np.argsort(x[side], kind="stable")
                made += [pa.array([x[side][o]], pa.list_(pa.float64())), pa.array([c[side][o]], pa.list_(pa.int64()))]
            return pa.table(made, names=["ax", "ac", "bx", "bc"])

        dealt = placed.mapInArrow(deal, "i bigint, a boolean, x double, c bigint").groupBy("i").applyInArrow(side_by_side, "ax array<double>, ac array<bigint>, bx array<double>, bc array<bigint>")
        dealt = cut_lineage(dealt)

        def at_most(ts):
            def run(batches):
                found = [0] * len(ts)
                for b in batches:
                    for row in range(len(b)):
                        ax, ac, bx, bc = (b.column(i)[row].values.to_numpy() for i in range(4))
                        n_from = np.concatenate([np.cumsum(bc[::-1])[::-1], [0]])
                        for k, t in enumerate(ts):
                            found[k] += int((ac * n_from[np.searchsorted(bx + t, ax, "left")]).sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ts))), pa.array(found, pa.int64())], names=["k", "c"])

            got = {r["k"]: r["c"] for r in dealt.mapInArrow(run, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c")).collect()}
            return {t: base + got.get(k, 0) for k, t in enumerate(ts)}

        return at_most, int((hi - lo)[met].sum())

    def bracket(rank, lo, hi):
        """Ends that the cells vouch for: fewer than `rank` at the lower one, at least as many at the upper one."""
        ends = []
        for reached in (most, least):
            a, b = lo, hi
            for _ in range(60):
                m = a + (b - a) / 2
                if not a < m < b:
                    break
                a, b = (a, m) if reached(m) >= rank else (m, b)
            ends.append(a if reached is most else b)
        return ends

    ranks = sorted({f(p * (total - 1)) + 1 for p in probs for f in (math.floor, math.ceil)})
    span = (float(alo[0] - bhi[-1]), float(ahi[-1] - blo[0]))
    lo, hi = span[0] - 1e-9 * (abs(span[0]) + 1), span[1] + 1e-9 * (abs(span[1]) + 1)
    out = {}
    for near in _close(ranks):
        t0, t1 = bracket(near[0], lo, hi)[0], bracket(near[-1], lo, hi)[1]
        # A bracket that cuts many cells (few very frequent values) is halved first; one difference cuts two for each cell at most.
        while True:
            first_cut, last_cut = cut(t0, t1)
            m = t0 + (t1 - t0) / 2
            if np.maximum(last_cut - first_cut, 0).sum() <= 16 * (len(ka) + len(kb)) or not t0 < m < t1:
                break
            n = counter(m, m)[0]([m])[m]
            if near[0] <= n < near[-1]:
                break
            t0, t1 = (t0, m) if n >= near[-1] else (m, t1)
        out |= select_ranks(counter(t0, t1)[0], near, t0, t1, fan)
    res = []
    for p in probs:
        h = p * (total - 1)
        f, c = math.floor(h) + 1, math.ceil(h) + 1
        res.append(out[f] + (h - math.floor(h)) * (out[c] - out[f]))
    return res


def _close(ranks: Sequence[int]) -> list[list[int]]:
    """Ascending ranks in runs of neighbours, which share a bracket."""
    out: list[list[int]] = []
    for r in ranks:
        if out and r - out[-1][-1] <= 1:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def mann_whitney(df: DataFrame, outcome: str, group: str, hodges_lehmann: bool = True) -> DataFrame:
    """U, tie-corrected z, rank-biserial, and the exact Hodges-Lehmann shift (no pair cap)."""
    d, mom = _two(df, outcome, group)
    r = rank_sum(d, outcome, group, mom[0][0])
    n, n1, n2, u = r["n"], r["n1"], r["n2"], r["u"]
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - r["ties"] / (n * (n - 1))))
    z = (u - n1 * n2 / 2) / sd if sd > 0 else float("nan")
    shift = u - n1 * n2 / 2
    zc = (abs(shift) - 0.5) / sd if sd > 0 else float("nan")
    hl = pair_difference_quantile(d, outcome, group, mom[0][0])[0] if hodges_lehmann else float("nan")
    return one_row(df.sparkSession, n1=int(n1), n2=int(n2), u=u, z=z, rank_biserial=1 - 2 * u / (n1 * n2),
                   hodges_lehmann=hl, p=min(1.0, dist.p_two_sided(max(zc, 0.0))))


def _rank_groups(d, outcome, group):
    """Per level: n, mean rank; and N and the tie term."""
    vg = d.groupBy(outcome, group).agg(F.count(F.lit(1)).alias("c"))
    r = average_ranks(d, outcome)
    t = fetch(r, n=F.sum("n"), ties=F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")))
    rows = collect_bounded(vg.join(r.select(outcome, "avg_rank"), outcome).groupBy(group).agg(
        F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("avg_rank")) / F.sum("c")).alias("mr")), f"levels of {group}")
    return sorted([(x[group], float(x["n"]), float(x["mr"])) for x in rows], key=lambda v: level_key(v[0])), float(t["n"]), float(t["ties"])


def _keep_levels(d, group):
    rows = collect_bounded(d.groupBy(group).count(), f"levels of {group}")
    ok = [r[group] for r in rows if r["count"] >= 2]
    refuse(not 3 <= len(ok) <= 12, "three to twelve groups of at least two rows are needed")
    return d if len(ok) == len(rows) else d.where(F.col(group).isin(ok))


def kruskal_wallis(df: DataFrame, outcome: str, group: str) -> DataFrame:
    """Tie-corrected H and eta squared; levels with one row are left out."""
    d = _keep_levels(complete(df, [outcome], [group]), group)
    g, n, ties = _rank_groups(d, outcome, group)
    k = len(g)
    h = 12 / (n * (n + 1)) * sum(c * m * m for _, c, m in g) - 3 * (n + 1)
    h /= 1 - ties / (n ** 3 - n)
    return one_row(df.sparkSession, n=int(n), groups=k, h=h, eta_squared=max(0.0, (h - k + 1) / (n - k)), p=dist.chi2_sf(h, k - 1))


def dunn_test(df: DataFrame, outcome: str, group: str) -> DataFrame:
    d = _keep_levels(complete(df, [outcome], [group]), group)
    g, n, ties = _rank_groups(d, outcome, group)
    s2 = n * (n + 1) / 12 - ties / (12 * (n - 1))
    m = len(g) * (len(g) - 1) / 2
    rows = []
    for i, a in enumerate(g):
        for b in g[i + 1:]:
            z = (a[2] - b[2]) / math.sqrt(s2 * (1 / a[1] + 1 / b[1]))
            rows.append((str(a[0]), str(b[0]), z, dist.p_two_sided(z), min(1.0, m * dist.p_two_sided(z))))
    return rows_frame(df.sparkSession, "group_a string, group_b string, z double, p double, p_bonferroni double", rows)


def friedman_test(df: DataFrame, subject: str, conditions: Sequence[str]) -> DataFrame:
    """Q, Kendall's W and the Nemenyi critical difference; ranks inside a row need no shuffle."""
    cs = list(conditions)
    k = len(cs)
    refuse(k < 3, "three conditions are needed")
    d = complete(df, cs)
    less = lambda c: sum([F.when(F.col(o) < F.col(c), 1.0).otherwise(0.0) for o in cs], F.lit(0.0))
    same = lambda c: sum([F.when(F.col(o) == F.col(c), 1.0).otherwise(0.0) for o in cs], F.lit(0.0))
    aggs = {f"r{i}": F.sum(less(c) + (same(c) + 1) / 2) for i, c in enumerate(cs)}
    # sum over tie blocks of t^3 - t equals sum over entries of t^2 - 1
    ties = sum([same(c) * same(c) - 1 for c in cs], F.lit(0.0))
    r = fetch(d, n=F.count(F.lit(1)), ties=F.sum(ties), **aggs)
    n = float(r["n"])
    sums = [r[f"r{i}"] for i in range(k)]
    qv = (12 / (n * k * (k + 1)) * sum(s * s for s in sums) - 3 * n * (k + 1)) / (1 - r["ties"] / (n * k * (k * k - 1)))
    return one_row(df.sparkSession, n=int(n), conditions=k, q=qv, kendall_w=qv / (n * (k - 1)),
                   **{f"mean_rank_{c}": s / n for c, s in zip(cs, sums)}, p=dist.chi2_sf(qv, k - 1),
                   nemenyi_cd=dist._bisect(lambda v: 1 - dist.studentized_range_sf(v, k, 1e6), 0.0, 20.0, 0.95)
                   / math.sqrt(2) * math.sqrt(k * (k + 1) / (6 * n)))


# --- resampling -----------------------------------------------------------------------------------

def permutation_test(df: DataFrame, outcome: str, group: str, id_col: str, n_perm: int = 9999, seed: int = 42) -> DataFrame:
    """Mean difference (two levels) or F (more) against uniform relabelings; p = (1 + #>=)/(n_perm + 1)."""
    d = complete(df, [outcome], [group, id_col])
    mom = group_moments(d, outcome, group)
    refuse(len(mom) < 2, "two groups are needed")
    sizes = np.array([t[1] for t in mom])
    tot = fetch(d, s=F.sum(outcome), v=F.var_pop(outcome), n=F.count(F.lit(1)))
    s = resample.permuted_sums(d, id_col, outcome, [int(x) for x in sizes], n_perm, seed)
    means = s / sizes
    if len(mom) == 2:
        obs = mom[0][2] - mom[1][2]
        hits = int((np.abs(means[:, 0] - means[:, 1]) >= abs(obs) - 1e-12 * abs(obs)).sum())
    else:
        o = oneway(mom)
        obs, n, k = o["f"], o["n"], o["k"]
        sst = tot["v"] * tot["n"]
        ssb = (sizes * (means - tot["s"] / n) ** 2).sum(1)
        fs = (ssb / (k - 1)) / ((sst - ssb) / (n - k))
        hits = int((fs >= obs * (1 - 1e-12)).sum())
    return one_row(df.sparkSession, n=int(sizes.sum()), groups=len(mom), statistic=float(obs), n_perm=n_perm,
                   hits=hits, p=(1 + hits) / (n_perm + 1))


def bootstrap_ci(df: DataFrame, column: str, id_col: str, statistic: str = "mean", column2: str | None = None,
                 n_boot: int = 2000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """BCa interval for mean, std or correlation; the median uses the exact bootstrap law of an order statistic."""
    cols = [column] + ([column2] if statistic == "corr" else [])
    d = complete(df, cols, [id_col])
    if statistic == "median":
        n = d.count()
        ks = []
        for p in ((1 - ci) / 2, (1 + ci) / 2):
            # P(bootstrap median <= x_(k)) = P(Bin(n, k/n) >= (n+1)/2)
            lo, hi = 1, n
            while lo < hi:
                mid = (lo + hi) // 2
                if dist.beta_i((n + 1) // 2, n - (n + 1) // 2 + 1, mid / n) >= p:
                    hi = mid
                else:
                    lo = mid + 1
            ks.append(lo)
        got = quantiles(d, column, [0.5, (ks[0] - 1) / max(n - 1, 1), (ks[1] - 1) / max(n - 1, 1)])
        return one_row(df.sparkSession, statistic=statistic, n=n, estimate=got[0], ci_low=got[1], ci_high=got[2], n_boot=0)
    g, reps = resample.replicate_grams(d, id_col, cols, n_boot, seed)
    n = g.n
    if statistic == "mean":
        theta, vals = float(g.mean[0]), np.array([r.mean[0] for r in reps])
        sk = fetch(d, s=F.sum((F.col(column) - F.lit(theta)) ** 3))["s"]
        acc = sk / (6 * float(g.cross[0, 0]) ** 1.5)
    elif statistic == "std":
        theta = math.sqrt(g.cross[0, 0] / (n - 1))
        vals = np.array([math.sqrt(max(r.cross[0, 0], 0) / (r.n - 1)) for r in reps])
        m, v = float(g.mean[0]), g.cross[0, 0] / n
        e = (F.col(column) - F.lit(m)) ** 2 - F.lit(v)            # influence of the variance
        t = fetch(d, a=F.sum(e * e * e), b=F.sum(e * e))
        acc = t["a"] / (6 * t["b"] ** 1.5)
    else:
        refuse(statistic != "corr", "statistic is mean, median, std or corr")
        theta = float(g.corr()[0, 1])
        vals = np.array([r.cross[0, 1] / math.sqrt(r.cross[0, 0] * r.cross[1, 1]) for r in reps])
        sd = np.sqrt(np.diag(g.cross) / n)
        zx = (F.col(cols[0]) - F.lit(float(g.mean[0]))) / F.lit(float(sd[0]))
        zy = (F.col(cols[1]) - F.lit(float(g.mean[1]))) / F.lit(float(sd[1]))
        e = zx * zy - F.lit(theta / 2) * (zx * zx + zy * zy)
        t = fetch(d, a=F.sum(e * e * e), b=F.sum(e * e))
        acc = t["a"] / (6 * t["b"] ** 1.5)
    lo, hi = resample.bca(theta, vals, acc, ci)
    return one_row(df.sparkSession, statistic=statistic, n=int(n), estimate=theta, ci_low=lo, ci_high=hi, n_boot=n_boot)


def wls(g: Gram, y: str, xs: Sequence[str]) -> np.ndarray:
    """Intercept and slopes from weighted moments."""
    b = np.linalg.pinv(g.sub(xs, xs), hermitian=True) @ g.sub(xs, [y])[:, 0]
    return np.concatenate([[g.mean[g.at([y])[0]] - g.mean[g.at(xs)] @ b], b])


def predictor(xs: Sequence[str], beta) -> "F.Column":
    e = F.lit(float(beta[0]))
    for x, b in zip(xs, beta[1:]):
        e = e + F.col(x) * F.lit(float(b))
    return e


def robust_regression(df: DataFrame, outcome: str, predictors: Sequence[str], tune: float = 1.345, most: int = 50) -> DataFrame:
    """Huber M-estimate by reweighting (MAD scale) beside OLS, and the exact Theil-Sen slope for one predictor."""
    xs = list(predictors)
    d = cut_lineage(complete(df, [outcome, *xs]))
    fit = ols(gram(d, [outcome, *xs]), outcome, xs)
    beta, mad, settled = fit.beta, None, False
    for _ in range(most):
        e = F.col(outcome) - predictor(xs, beta)
        mad = near_quantile(d, F.abs(e), 0.5, mad)
        s = mad / 0.6744897501960817
        refuse(not s, "the residual scale is zero")
        w = F.when(F.abs(e) <= tune * s, F.lit(1.0)).otherwise(F.lit(tune * s) / F.abs(e))
        new = wls(weighted_gram(d, [outcome, *xs], w)[()], outcome, xs)
        settled = np.max(np.abs(new - beta)) < 1e-8 * (1 + np.max(np.abs(beta)))
        beta = new
        if settled:
            break
    refuse(not settled, f"the weights do not settle in {most} rounds")
    sen = [None] * (len(xs) + 1)
    if len(xs) == 1:
        sl = theil_sen(d, xs[0], outcome)[0]
        sen = [quantiles(d, outcome, [0.5])[0] - sl * quantiles(d, xs[0], [0.5])[0], sl]
    return rows_frame(df.sparkSession, "term string, ols double, huber double, theil_sen double",
                      [(t, o, h, ts) for t, o, h, ts in zip(["intercept", *xs], fit.beta, beta, sen)])


SLOPE_BLOCK = 1 << 14      # points of neighbouring x whose pairs one task counts
SLOPE_RANGE = 1 << 18      # points of neighbouring residuals that one task compares between blocks, about
SLOPE_RANGES = 512         # ranges of residuals at most


def concordant_in(xr: np.ndarray, r: np.ndarray, w: np.ndarray) -> float:
    """Weighted pairs with xr and r in the same strict order, by the bits of xr."""
    first = np.argsort(r, kind="stable")
    xr, r, w = xr[first], r[first], w[first]
    out = 0.0
    for bit in range(int(xr.max(initial=0)).bit_length()):
        block = xr >> (bit + 1)
        order = np.argsort(block, kind="stable")
        k, v, side, c = block[order], r[order], (xr[order] >> bit) & 1, w[order]
        low = np.concatenate([[0.0], np.cumsum(np.where(side == 0, c, 0.0))[:-1]])
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        new[1:] |= v[1:] != v[:-1]
        tie = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        out += float((c * (low[tie] - low[start]))[side == 1].sum())
    return out


def theil_sen(d: DataFrame, x: str, y: str, probs: Sequence[float] = (0.5,), fan: int = 6,
              rtol: float = 1e-10, block: int = SLOPE_BLOCK) -> list[float]:
    """Exact median (or other quantiles) of all pairwise slopes with distinct x, without forming pairs.

    For a candidate slope t the pairs above it are the concordant pairs of (x, y - t x). Points are cut into blocks of
    neighbouring x: a task counts the pairs inside a block. For pairs of different blocks the points are also cut into
    ranges of y - t x: a task counts the pairs inside a range, and the ranges' weights by block give all others. An x with more points than a block has one of its own, in which there is nothing to count.
    """
    points = d.groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))
    per = running(in_order(points.groupBy(x).agg(F.count(F.lit(1)).alias("p"), F.sum("w").cast("double").alias("c")), x).withColumn("one", F.lit(1).cast("bigint")), ["p", "one"]).drop("__id")
    per = cut_lineage(per.select(F.col(x).alias("__x"), "p", "c", F.col("one_before").alias("xr"), (2 * F.floor(F.col("p_before") / block) + F.when(F.col("p") > block, 1).otherwise(0)).alias("b")))
    all_of = fetch(per, n=F.sum("c"), t=F.sum(F.col("c") * (F.col("c") - 1) / 2))
    n = all_of["n"]
    total = n * (n - 1) / 2 - all_of["t"]
    refuse(total <= 0, "the predictor is constant")
    named = dense_rank(per, "b", "blk").select("__x", "xr", "blk", (F.col("p") > block).alias("hot"))
    pts = cut_lineage(points.join(named, F.col(x) == F.col("__x")).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col("w").cast("double").alias("w"), "xr", "blk", "hot")
                      .repartition("blk").sortWithinPartitions("blk"))
    several = pts.agg(F.max("blk")).collect()[0][0] > 0

    def inside(ts):
        def run(batches):
            def count(part: pa.Table):
                xr, px, py, w = (part.column(c).to_numpy() for c in ("xr", "x", "y", "w"))
                return [concordant_in(xr - xr.min(), py - t * px, w) for t in ts]

            held, at, total_of = [], None, [0.0] * len(ts)
            for b in batches:
                key = b.column(b.schema.get_field_index("blk")).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
                for lo, hi in zip(cuts, cuts[1:]):
                    if hi > lo:
                        if at is not None and key[lo] != at:
                            total_of = [u + v for u, v in zip(total_of, count(pa.Table.from_batches(held)))]
                            held = []
                        at = key[lo]
                        held.append(b.slice(lo, hi - lo))
            if held:
                total_of = [u + v for u, v in zip(total_of, count(pa.Table.from_batches(held)))]
            yield pa.RecordBatch.from_arrays([pa.array([float(t) for t in ts]), pa.array(total_of)], ["t", "c"])
        return pts.where("not hot").select("x", "y", "w", "xr", "blk").repartition("blk").sortWithinPartitions("blk").mapInArrow(run, "t double, c double").groupBy("t").agg(F.sum("c").alias("c"))

    def between(ts):
        def deal(batches):
            for b in batches:
                px, py = b.column("x").to_numpy(), b.column("y").to_numpy()
                for k, t in enumerate(ts):
                    r = py - t * px
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), k, np.int32)), pa.array(np.searchsorted(bounds, r, "right").astype(np.int32)), b.column("blk"), pa.array(r), b.column("w")], names=["k", "g", "blk", "r", "w"])

        def count(t: pa.Table) -> pa.Table:
            blk, r, w = (t.column(c).to_numpy() for c in ("blk", "r", "w"))
            kinds, at = np.unique(blk, return_inverse=True)
            c = np.zeros(len(kinds))
            c[0] = concordant_in(at.astype(np.int64), r, w)
            fixed = [pa.array(np.full(len(kinds), t.column(n)[0].as_py(), np.int32)) for n in ("k", "g")]
            return pa.table({"k": fixed[0], "g": fixed[1], "blk": kinds, "w": np.bincount(at, w, len(kinds)), "c": c})

        def add(t: pa.Table) -> pa.Table:
            g, blk = (np.unique(t.column(n).to_numpy(), return_inverse=True)[1] for n in ("g", "blk"))
            held = np.zeros((g.max() + 1, blk.max() + 1))
            held[g, blk] = t.column("w").to_numpy()
            below, c = np.zeros(held.shape[1]), float(t.column("c").to_numpy().sum())
            for row in held:
                c += float((np.cumsum(below) - below) @ row)
                below += row
            return pa.table({"k": t.column("k")[:1], "c": [c]})

        e = pts.select("x", "y", "w", F.col("blk").cast("bigint").alias("blk")).mapInArrow(deal, "k int, g int, blk bigint, r double, w double")
        return e.groupBy("k", "g").applyInArrow(count, "k int, g int, blk bigint, w double, c double").groupBy("k").applyInArrow(add, "k int, c double")

    def at_most(ts):
        above = {float(t): 0.0 for t in ts}
        for r in inside(ts).collect():
            above[r["t"]] += r["c"]
        if several:
            for r in between(ts).collect():
                above[float(ts[r["k"]])] += r["c"]
        return {t: total - c for t, c in above.items()}

    ranks = sorted({f(p * (total - 1)) + 1 for p in probs for f in (math.floor, math.ceil)})
    # Start around the least-squares slope and widen until every rank is inside.
    g = gram(d, [x, y])
    slope = g.cross[0, 1] / g.cross[0, 0]
    step = 4 * math.sqrt(max(g.cross[1, 1] - slope * g.cross[0, 1], 1e-300) / (g.n - 1) / g.cross[0, 0]) + 1e-12
    lo, hi = slope - step, slope + step
    # Any bounds of the residuals are right; these make the ranges about equal.
    ranges = min(SLOPE_RANGES, max(8, int(n) // SLOPE_RANGE))
    bounds = np.unique(pts.select((F.col("y") - F.lit(slope) * F.col("x")).alias("r")).approxQuantile("r", [i / ranges for i in range(1, ranges)], 0.25 / ranges)) if several else None
    while True:
        c = at_most([lo, hi])
        if c[lo] < ranks[0] and c[hi] >= ranks[-1]:
            break
        step *= 16
        lo, hi = slope - step, slope + step
    got = select_ranks(at_most, ranks, lo, hi, fan, rtol, (c[lo], c[hi]))
    out = []
    for p in probs:
        h = p * (total - 1)
        a, b = got[math.floor(h) + 1], got[math.ceil(h) + 1]
        out.append(a + (h - math.floor(h)) * (b - a))
    return out


def near_quantile_fit(d: DataFrame, y: str, xs: Sequence[str], tau: float, most: int = 16) -> np.ndarray:
    """A linear quantile fit nearly, by a few rounds of reweighted least squares on the smoothed check loss."""
    xs = list(xs)
    g0 = gram(d, [y, *xs])
    beta = ols(g0, y, xs).beta
    scale = math.sqrt(g0.cross[g0.at([y])[0], g0.at([y])[0]] / g0.n)
    eps = 1e-2 * scale
    for it in range(most):
        e = F.col(y) - predictor(xs, beta)
        a = F.abs(e) + F.lit(eps)
        # Surrogate of the check loss: e^2/(4a) + (tau - 1/2) e; its minimum shifts y by (2 tau - 1) a.
        z = d.withColumn("__t", F.col(y) + F.lit(2 * tau - 1) * a).withColumn("__wq", 1 / a)
        new = wls(weighted_gram(z, ["__t", *xs], F.col("__wq"))[()], "__t", xs)
        move = np.max(np.abs(new - beta)) / (1 + np.max(np.abs(beta)))
        beta = new
        if move < 1e-7:
            if eps < 1e-5 * scale:
                break
            eps /= 4
        elif it % 8 == 7:
            eps = max(eps / 4, 1e-6 * scale)
    return beta


def check_loss_vertex(x: np.ndarray, y: np.ndarray, w: np.ndarray, along: np.ndarray, tau: float, start: np.ndarray) -> tuple[np.ndarray, bool]:
    """Minimiser of along'b + sum w rho(y - x b), by descent from vertex to vertex (rho: check loss at tau), and True; where
    the loss falls without end, the last vertex on the way and False.

    A vertex fits as many rows exactly as there are coefficients. A row leaves it along whose edge the loss falls most,
    and the row where the loss stops falling comes in. Ties are told apart by a tiny shift of y, which the returned
    coefficients do not have.
    """
    m, k = x.shape
    shifted = y + np.random.default_rng(0).uniform(-1, 1, m) * 1e-9 * max(float(np.abs(y).max(initial=0)), 1.0)
    basis: list[int] = []
    free = np.zeros((0, k))
    for i in np.argsort(np.abs(y - x @ start), kind="stable"):
        v = x[i] - free.T @ (free @ x[i])
        if np.linalg.norm(v) > 1e-9 * max(np.linalg.norm(x[i]), 1e-300):
            basis.append(int(i))
            free = np.vstack([free, v / np.linalg.norm(v)])
            if len(basis) == k:
                break
    refuse(len(basis) < k, "the predictors are collinear")
    for _ in range(50 * (m + k)):
        inv = np.linalg.inv(x[basis])
        r = shifted - x @ (inv @ shifted[basis])
        r[basis] = 0
        slope = np.where(r > 0, tau, tau - 1) * w
        slope[basis] = 0
        lam = inv.T @ (along - x.T @ slope)
        up, down = lam - w[basis] * tau, -lam - w[basis] * (1 - tau)
        gain = np.maximum(up, down)
        j = int(np.argmax(gain))
        if gain[j] <= 1e-9 * max(float(w.sum()), 1.0):
            return inv @ y[basis], True
        step = x @ inv[:, j] * (-1 if up[j] > down[j] else 1)
        step[np.abs(step) <= 1e-11 * (np.abs(x) @ np.abs(inv[:, j]))] = 0      # a row that does not move must not come in
        with np.errstate(divide="ignore", invalid="ignore"):
            t = r / step
        t[basis] = -1
        ahead = np.flatnonzero((t > 0) & np.isfinite(t))
        ahead = ahead[np.argsort(t[ahead], kind="stable")]
        falls = -gain[j] + np.cumsum(w[ahead] * np.abs(step[ahead]))
        stop = np.flatnonzero(falls >= 0)
        if not len(stop):
            if len(ahead):
                basis[j] = int(ahead[-1])
            return np.linalg.solve(x[basis], y[basis]), False
        basis[j] = int(ahead[stop[0]])
    raise ValueError("the quantile fit does not settle")


MIDDLE = 4000              # rows around the fit that the driver solves exactly


def _fit_spread(d: DataFrame, y: str, xs: Sequence[str], beta: np.ndarray, share: float) -> Column:
    """How far the fit may be off at a row, up to a factor: the sandwich of the nearest rows and all, 1 where those do not span the predictors."""
    cols = [F.lit(1.0), *[F.col(c) for c in xs]]
    k = len(cols)
    size = F.abs(F.col(y) - predictor(xs, beta))
    near = size <= F.lit(near_quantile(d, size, share))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    s = fetch(d, **{f"a{i}_{j}": F.sum(cols[i] * cols[j]) for i, j in pairs}, **{f"n{i}_{j}": F.sum(F.when(near, cols[i] * cols[j]).otherwise(0.0)) for i, j in pairs})
    whole, close = (np.array([[s[f"{c}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float) for c in "an")
    unit = np.sqrt(np.maximum(np.diag(whole), 1e-300))
    if np.linalg.cond(close / np.outer(unit, unit)) > 1e10:
        return F.lit(1.0)
    inv = np.linalg.inv(close)
    v = inv @ whole @ inv
    v = (v + v.T) / (2 * np.abs(v[0, 0]))
    form = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            form = form + F.lit(float(v[i, j])) * cols[i] * cols[j]
    return F.sqrt(F.greatest(form, F.lit(1e-12)))


def _check_loss(y: str, xs: Sequence[str], tau: float, beta: np.ndarray) -> Column:
    e = F.col(y) - predictor(xs, beta)
    return F.sum(F.when(e > 0, F.lit(tau) * e).otherwise(F.lit(tau - 1) * e))


def _settled(d: DataFrame, n: int, y: str, xs: Sequence[str], tau: float, beta: np.ndarray, middle: int, most: int) -> tuple[np.ndarray, str | None]:
    """The exact fit, or where it got to and why it is none.

    The solved problem equals the whole one near its start and is nowhere above it. So the way from the start to its
    solution leads down at first, and where far rows change sides the lowest of some places on the way is the next start:
    every round has a smaller loss than the one before.
    """
    cols = [F.lit(1.0), *[F.col(c) for c in xs]]
    for _ in range(most):
        e = F.col(y) - predictor(xs, beta)
        size = F.abs(e) / _fit_spread(d, y, xs, beta, min(1.0, max(middle / n, 0.02)))
        reach = near_quantile(d, size, min(1.0, middle / n))
        far, over = size > F.lit(reach), e > 0
        sums = fetch(d.where(far), **{f"a{i}": F.sum(F.when(over, c).otherwise(0.0)) for i, c in enumerate(cols)}, **{f"b{i}": F.sum(F.when(over, 0.0).otherwise(c)) for i, c in enumerate(cols)})
        along = np.array([-tau * (sums[f"a{i}"] or 0.0) + (1 - tau) * (sums[f"b{i}"] or 0.0) for i in range(len(cols))])
        rows = collect_bounded(d.where(~far).groupBy(y, *xs).agg(F.count(F.lit(1)).alias("__w")), "rows near the fit")
        rows = sorted(tuple(r) for r in rows)
        x = np.array([[1.0, *r[1:-1]] for r in rows])
        spans, whole = np.linalg.matrix_rank(x) == x.shape[1], False
        if spans:
            new, whole = check_loss_vertex(x, np.array([r[0] for r in rows]), np.array([float(r[-1]) for r in rows]), along, tau, beta)
        if not whole:
            if middle >= n:
                return beta, "the check loss has no minimum" if spans else "the predictors are collinear"
            middle = max(middle, min(4 * middle, LEVEL_LIMIT // 2))
            if not spans:
                continue
        moved = F.col(y) - predictor(xs, new)
        crossed = fetch(d.where(far), c=F.sum(F.when((over & (moved < 0)) | (~over & (moved > 0)), 1).otherwise(0)))["c"]
        if whole and not crossed:
            return new, None
        ways = [0.0, *[0.5 ** i for i in range(12)]]
        at = [beta + w * (new - beta) for w in ways]
        loss = fetch(d, **{f"l{i}": _check_loss(y, xs, tau, b) for i, b in enumerate(at)})
        best = int(np.argmin([loss[f"l{i}"] for i in range(len(at))]))
        if best == 0:                       # too far for these places: more rows make the way exact for longer
            middle = max(middle, min(4 * middle, LEVEL_LIMIT // 2))
        beta = at[best]
    return beta, f"the quantile fit does not settle in {most} rounds"


def quantile_fit(d: DataFrame, y: str, xs: Sequence[str], tau: float, middle: int = MIDDLE, most: int = 40) -> np.ndarray:
    """Exact linear quantile fit, intercept first.

    Only the rows near the fit decide it: those far above or below enter through the sum of their predictors, as long as
    they stay on their side. So the nearest rows are fetched (a bounded number, equal ones as one), their problem with
    those sums is solved at a vertex, and one pass counts the far rows that changed sides. None: the fit is exact, as the
    problem is convex. Otherwise the solution is the next start; a fit that does not settle is refused. Where the nearest
    rows hold no minimum, as the start is far from it, the last of their vertices on the way down is the next start, and
    more of them are taken, as where they do not span the predictors.

    The start comes from the fit to a tenth of the rows, theirs from a tenth of those, and so on: the error of a start is
    then less than the reach of the nearest rows at any size. The last fit has all rows.
    """
    xs = list(xs)
    parts = [cut_lineage(d.select(y, *xs))]
    sizes = [parts[0].count()]
    while sizes[-1] > max(10 * middle, 10_000):
        parts.append(cut_lineage(parts[-1].where(F.rand(len(parts)) < 0.1)))
        sizes.append(parts[-1].count())
    beta = None
    for part, n in zip(reversed(parts), reversed(sizes)):
        if beta is None and part is not parts[0] and not np.linalg.matrix_rank(gram(part, xs).cross) == len(xs):
            continue
        beta, why = _settled(part, n, y, xs, tau, near_quantile_fit(part, y, xs, tau) if beta is None else beta, middle, most)
    refuse(why is not None, why)
    return beta


def quantile_regression(df: DataFrame, outcome: str, predictors: Sequence[str], taus: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    xs = list(predictors)
    d = complete(df, [outcome, *xs])
    rows = []
    for t in taus:
        b = quantile_fit(d, outcome, xs, t)
        e = F.col(outcome) - predictor(xs, b)
        below = fetch(d, s=F.avg(F.when(e <= 0, 1.0).otherwise(0.0)))["s"]
        rows += [(float(t), name, float(v), below) for name, v in zip(["intercept", *xs], b)]
    return rows_frame(df.sparkSession, "tau double, term string, coef double, share_below double", rows)


# --- agreement and reliability --------------------------------------------------------------------

def bland_altman(df: DataFrame, method1: str, method2: str) -> DataFrame:
    """Bias, limits of agreement with intervals, share inside, slope of difference on mean."""
    d = complete(df, [method1, method2])
    t = d.select((F.col(method1) - F.col(method2)).alias("d"), ((F.col(method1) + F.col(method2)) / 2).alias("m"))
    g = gram(t, ["d", "m"])
    n = g.n
    refuse(n < 3, "three pairs are needed")
    bias, sd = float(g.mean[0]), math.sqrt(g.cross[0, 0] / (n - 1))
    lo, hi = bias - 1.96 * sd, bias + 1.96 * sd
    inside = fetch(t, s=F.avg(F.when(F.col("d").between(F.lit(lo), F.lit(hi)), 1.0).otherwise(0.0)))["s"]
    tq = dist.t_ppf(0.975, n - 1)
    se = sd * math.sqrt(1 / n + 1.96 ** 2 / (2 * (n - 1)))
    return one_row(df.sparkSession, n=int(n), bias=bias, sd=sd, loa_low=lo, loa_high=hi, share_inside=inside,
                   slope=g.cross[0, 1] / g.cross[1, 1], r=g.corr()[0, 1], bias_ci_low=bias - tq * sd / math.sqrt(n),
                   bias_ci_high=bias + tq * sd / math.sqrt(n), loa_low_ci=lo - tq * se, loa_high_ci=hi + tq * se)


def cohens_kappa(df: DataFrame, rater1: str, rater2: str) -> DataFrame:
    """Kappa with its large-sample SE, linear and quadratic weights, prevalence and bias indices."""
    d = complete(df, [], [rater1, rater2])
    rows = collect_bounded(d.groupBy(rater1, rater2).count(), "rating cells")
    lv = sorted({r[0] for r in rows} | {r[1] for r in rows}, key=level_key)
    k = len(lv)
    m = np.zeros((k, k))
    for r in rows:
        m[lv.index(r[0]), lv.index(r[1])] = r["count"]
    n = m.sum()
    p = m / n
    a, b = p.sum(1), p.sum(0)
    po, pe = np.trace(p), a @ b
    kappa = (po - pe) / (1 - pe)
    s = a[:, None] * 0 + (b[:, None] + a[None, :])          # col share of i + row share of j
    t1 = sum(p[i, i] * (1 - (a[i] + b[i]) * (1 - kappa)) ** 2 for i in range(k))
    t2 = (1 - kappa) ** 2 * sum(p[i, j] * s[i, j] ** 2 for i in range(k) for j in range(k) if i != j)
    t3 = (kappa - pe * (1 - kappa)) ** 2
    se = math.sqrt(max(t1 + t2 - t3, 0) / (n * (1 - pe) ** 2))
    i, j = np.indices((k, k))

    def weighted(w):
        return 1 - (w * p).sum() / (w * np.outer(a, b)).sum() if k > 1 else float("nan")

    pi = p[0, 0] - p[1, 1] if k == 2 else float("nan")
    return one_row(df.sparkSession, n=int(n), categories=k, observed=po, expected=pe, kappa=kappa, se=se,
                   kappa_linear=weighted(abs(i - j) / max(k - 1, 1)), kappa_quadratic=weighted((i - j) ** 2 / max(k - 1, 1) ** 2),
                   ci_low=kappa - 1.96 * se, ci_high=kappa + 1.96 * se, prevalence_index=float(pi),
                   bias_index=float(p[0, 1] - p[1, 0]) if k == 2 else float("nan"),
                   paradox=bool(po >= 0.8 and kappa < 0.4 and abs(pi) >= 0.3))


def fleiss_kappa(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Overall and per-category kappa; counts per row are column expressions, so rows are never shuffled."""
    rs = list(raters)
    m = len(rs)
    d = complete(df, [], rs)
    lv = sorted({v for r in rs for v in levels_of(d, r, 1000)}, key=level_key)
    cnt = {c: sum([F.when(F.col(r) == F.lit(c), 1.0).otherwise(0.0) for r in rs], F.lit(0.0)) for c in lv}
    agree = sum([c * c for c in cnt.values()], F.lit(0.0))
    r = fetch(d, n=F.count(F.lit(1)), a=F.sum((agree - m) / (m * (m - 1))), **{f"c{i}": F.sum(c) for i, c in enumerate(cnt.values())},
              **{f"d{i}": F.sum(c * (m - c)) for i, c in enumerate(cnt.values())})
    n = float(r["n"])
    pj = np.array([r[f"c{i}"] for i in range(len(lv))]) / (n * m)
    pbar, pe = r["a"] / n, float((pj ** 2).sum())
    kappa = (pbar - pe) / (1 - pe)
    qj = pj * (1 - pj)
    se = math.sqrt(2) / (qj.sum() * math.sqrt(n * m * (m - 1))) * math.sqrt(qj.sum() ** 2 - (qj * (1 - 2 * pj)).sum())
    rows = [("overall", int(n), m, kappa, pbar, pe, se, kappa / se, dist.p_two_sided(kappa / se))]
    sj = math.sqrt(2 / (n * m * (m - 1)))
    for i, c in enumerate(lv):
        kj = 1 - r[f"d{i}"] / (n * m * (m - 1) * qj[i])
        rows.append((str(c), int(n), m, kj, None, None, sj, kj / sj, dist.p_two_sided(kj / sj)))
    return rows_frame(df.sparkSession, "category string, n bigint, raters bigint, kappa double, observed double, expected double, "
                      "se double, z double, p double", rows)


def icc(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """Six intraclass correlations from the item covariance (subjects are rows, raters are columns)."""
    its = list(items)
    k = len(its)
    g = gram(complete(df, its), its)
    n = g.n
    j = np.ones(k)
    ssr = j @ g.cross @ j / k
    ssc = n * ((g.mean - g.mean.mean()) ** 2).sum()
    sst = np.trace(g.cross) + ssc
    msr, msc = ssr / (n - 1), ssc / (k - 1)
    mse = (sst - ssr - ssc) / ((n - 1) * (k - 1))
    msw = (sst - ssr) / (n * (k - 1))
    f = msr / mse
    vals = {"icc1": (msr - msw) / (msr + (k - 1) * msw), "icc2": (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n),
            "icc3": (msr - mse) / (msr + (k - 1) * mse), "icc1k": (msr - msw) / msr,
            "icc2k": (msr - mse) / (msr + (msc - mse) / n), "icc3k": (msr - mse) / msr}
    return one_row(df.sparkSession, n=int(n), raters=k, **{a: float(b) for a, b in vals.items()}, msr=float(msr), msc=float(msc),
                   mse=float(mse), msw=float(msw), f=float(f), p=dist.f_sf(f, n - 1, (n - 1) * (k - 1)))


def cronbach_alpha(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """Alpha per scale row and per dropped item, with corrected item-total correlation and Feldt interval."""
    its = list(items)
    k = len(its)
    refuse(k < 2, "two items are needed")
    g = gram(complete(df, its), its)
    s = g.cov()

    def alpha(c):
        m = len(c)
        return m / (m - 1) * (1 - np.trace(c) / c.sum())

    a = alpha(s)
    d1, d2 = g.n - 1, (g.n - 1) * (k - 1)
    rows = [("scale", int(g.n), a, None, 1 - (1 - a) * dist.f_ppf(0.975, d1, d2), 1 - (1 - a) / dist.f_ppf(0.975, d2, d1))]
    for i, c in enumerate(its):
        rest = [x for x in range(k) if x != i]
        rv = s[np.ix_(rest, rest)].sum()
        cit = s[i, rest].sum() / math.sqrt(s[i, i] * rv)
        rows.append((c, int(g.n), alpha(s[np.ix_(rest, rest)]) if k > 2 else None, cit, None, None))
    return rows_frame(df.sparkSession, "item string, n bigint, alpha double, item_total_r double, ci_low double, ci_high double", rows)


def minres_loadings(r: np.ndarray, factors: int, most: int = 500) -> np.ndarray:
    """Principal-axis iteration to the minimum-residual solution."""
    h = 1 - 1 / np.diag(np.linalg.pinv(r, hermitian=True))
    for _ in range(most):
        m = r.copy()
        np.fill_diagonal(m, h)
        ev, vec = np.linalg.eigh(m)
        top = np.argsort(ev)[::-1][:factors]
        load = vec[:, top] * np.sqrt(np.maximum(ev[top], 0))
        new = np.minimum((load ** 2).sum(1), 0.9999)
        if np.max(np.abs(new - h)) < 1e-8:
            break
        h = new
    sign = np.sign(load.sum(0))
    return load * np.where(sign == 0, 1, sign)


def mcdonald_omega(df: DataFrame, items: Sequence[str]) -> DataFrame:
    its = list(items)
    refuse(len(its) < 3, "three items are needed")
    g = gram(complete(df, its), its)
    load = minres_loadings(g.corr(), 1)[:, 0]
    u = (1 - load ** 2).sum()
    return one_row(df.sparkSession, n=int(g.n), items=len(its), omega=float(load.sum() ** 2 / (load.sum() ** 2 + u)),
                   min_loading=float(load.min()), max_loading=float(load.max()))


def varimax(load: np.ndarray, most: int = 200) -> np.ndarray:
    """Orthogonal rotation that maximises the variance of squared loadings."""
    p, k = load.shape
    rot = np.eye(k)
    last = 0.0
    for _ in range(most):
        cur = load @ rot
        u, s, vt = np.linalg.svd(load.T @ (cur ** 3 - cur * (cur ** 2).mean(0)))
        rot = u @ vt
        if s.sum() < last * (1 + 1e-9):
            break
        last = s.sum()
    return load @ rot


def _factor_frame(df, its, g, load, ev):
    r = g.corr()
    inv = np.linalg.pinv(r, hermitian=True)
    part = -inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    off = ~np.eye(len(its), dtype=bool)
    kmo = (r[off] ** 2).sum() / ((r[off] ** 2).sum() + (part[off] ** 2).sum())
    p = len(its)
    chi = -(g.n - 1 - (2 * p + 5) / 6) * math.log(max(np.linalg.det(r), 1e-300))
    bp = dist.chi2_sf(chi, p * (p - 1) / 2)
    rows = []
    for i, c in enumerate(its):
        for f in range(load.shape[1]):
            rows.append((c, f + 1, load[i, f], float((load[i] ** 2).sum()), load.shape[1], ev[f], kmo, chi, bp))
    return rows_frame(df.sparkSession, "item string, factor bigint, loading double, communality double, factors bigint, "
                      "eigenvalue double, kmo double, bartlett_chi2 double, bartlett_p double", rows)


def efa(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """Factors with eigenvalue above one, varimax loadings, KMO and Bartlett."""
    its = list(items)
    g = gram(complete(df, its), its)
    ev = np.sort(np.linalg.eigvalsh(g.corr()))[::-1]
    k = max(1, int((ev > 1).sum()))
    load = minres_loadings(g.corr(), k)
    return _factor_frame(df, its, g, varimax(load) if k > 1 else load, ev)


def factor_analysis(df: DataFrame, features: Sequence[str], n_factors: int | None = None, seed: int = 0) -> DataFrame:
    """Factor count from the caller, else Horn's parallel analysis (95th percentile of Wishart correlations), else Kaiser."""
    its = list(features)
    g = gram(complete(df, its), its)
    r = g.corr()
    ev = np.sort(np.linalg.eigvalsh(r))[::-1]
    if n_factors is None:
        rng = np.random.default_rng(seed)
        p, n = len(its), int(g.n)
        sims = []
        for _ in range(100):
            # Bartlett decomposition of a Wishart: the eigenvalue law of n random rows, at p x p cost.
            t = np.tril(rng.standard_normal((p, p)), -1) + np.diag(np.sqrt(rng.chisquare(n - 1 - np.arange(p))))
            w = t @ t.T
            d = np.sqrt(np.diag(w))
            sims.append(np.sort(np.linalg.eigvalsh(w / np.outer(d, d)))[::-1])
        above = ev > np.quantile(np.array(sims), 0.95, axis=0)
        n_factors = int(np.argmin(above)) if not above.all() else p
        n_factors = n_factors or max(1, int((ev > 1).sum()))
    load = minres_loadings(r, n_factors)
    return _factor_frame(df, its, g, varimax(load) if n_factors > 1 else load, ev)


def dif_detection(df: DataFrame, items: Sequence[str], group: str) -> DataFrame:
    """Mantel-Haenszel odds ratio per item over rest-score strata with the ETS class."""
    its = list(items)
    d = complete(df, its, [group])
    lv = levels_of(d, group, 2)
    refuse(len(lv) != 2, "the group needs two levels")
    total = sum([F.col(i) for i in its], F.lit(0.0))
    long = d.select((F.col(group) == F.lit(lv[1])).alias("ref"), total.alias("tot"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("item"), F.col(i).alias("v")) for i in its])).alias("s"))
    long = long.select("ref", (F.col("tot") - F.col("s.v")).alias("rest"), "s.item", "s.v")
    c = long.groupBy("item", "rest").agg(
        F.sum(F.when(F.col("ref") & (F.col("v") == 1), 1.0).otherwise(0.0)).alias("a"),
        F.sum(F.when(F.col("ref") & (F.col("v") != 1), 1.0).otherwise(0.0)).alias("b"),
        F.sum(F.when(~F.col("ref") & (F.col("v") == 1), 1.0).otherwise(0.0)).alias("c"),
        F.sum(F.when(~F.col("ref") & (F.col("v") != 1), 1.0).otherwise(0.0)).alias("d"))
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    m1, n1, n0 = F.col("a") + F.col("c"), F.col("a") + F.col("b"), F.col("c") + F.col("d")
    m0 = F.col("b") + F.col("d")
    t = c.where((n > 1) & (n1 > 0) & (n0 > 0)).groupBy("item").agg(
        F.sum(F.col("a") * F.col("d") / n).alias("num"), F.sum(F.col("b") * F.col("c") / n).alias("den"),
        F.sum("a").alias("sa"), F.sum(n1 * m1 / n).alias("ea"), F.sum(n1 * n0 * m1 * m0 / (n * n * (n - 1))).alias("va"))
    odds = F.try_divide(F.col("num"), F.col("den"))
    delta = -2.35 * F.log(odds)
    dev = F.greatest(F.abs(F.col("sa") - F.col("ea")) - 0.5, F.lit(0.0))
    return t.select("item", odds.alias("mh_odds_ratio"), F.try_divide(dev * dev, F.col("va")).alias("mh_chi2"), delta.alias("delta_mh"),
                    F.when(F.abs(delta) < 1, "A").when(F.abs(delta) < 1.5, "B").otherwise("C").alias("ets_class"))


# --- multivariate ---------------------------------------------------------------------------------

def manova(df: DataFrame, outcomes: Sequence[str], group: str) -> DataFrame:
    """Wilks, Pillai, Hotelling-Lawley and Roy with F approximations, from per-level moments."""
    ys = list(outcomes)
    parts = gram_by(complete(df, ys, [group]), ys, group)
    refuse(len(parts) < 2, "two groups are needed")
    t = merge(list(parts.values()))
    e = sum(g.cross for g in parts.values())
    h = t.cross - e
    p, q, v = len(ys), len(parts) - 1, t.n - len(parts)
    lam = np.maximum(np.real(np.linalg.eigvals(np.linalg.solve(e, h))), 0)
    s = min(p, q)
    lam = np.sort(lam)[::-1][:s]
    m, n = (abs(p - q) - 1) / 2, (v - p - 1) / 2
    wilks = float(np.prod(1 / (1 + lam)))
    r = v - (p - q + 1) / 2
    tt = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    d2 = r * tt - (p * q - 2) / 2
    fw = (1 - wilks ** (1 / tt)) / wilks ** (1 / tt) * d2 / (p * q)
    pil = float((lam / (1 + lam)).sum())
    fp, a1, a2 = pil / (s - pil) * (2 * n + s + 1) / (2 * m + s + 1), s * (2 * m + s + 1), s * (2 * n + s + 1)
    hl = float(lam.sum())
    fh, b1, b2 = 2 * (s * n + 1) / (s * s * (2 * m + s + 1)) * hl, s * (2 * m + s + 1), 2 * (s * n + 1)
    roy = float(lam[0])
    c1 = max(p, q)
    c2 = v - c1 + q
    rows = [("wilks", wilks, fw, p * q, d2), ("pillai", pil, fp, a1, a2), ("hotelling_lawley", hl, fh, b1, b2),
            ("roy", roy, roy * c2 / c1, c1, c2)]
    return rows_frame(df.sparkSession, "statistic string, value double, f double, df1 double, df2 double, p double",
                      [(a, b, f, float(x), float(y), dist.f_sf(f, x, y)) for a, b, f, x, y in rows])


def hotelling_t2(df: DataFrame, outcomes: Sequence[str], group: str) -> DataFrame:
    ys = list(outcomes)
    parts = gram_by(complete(df, ys, [group]), ys, group)
    refuse(len(parts) != 2, "two groups are needed")
    a, b = (parts[k] for k in sorted(parts, key=level_key))
    p = len(ys)
    s = (a.cross + b.cross) / (a.n + b.n - 2)
    dm = a.mean - b.mean
    t2 = float(a.n * b.n / (a.n + b.n) * dm @ np.linalg.solve(s, dm))
    f = (a.n + b.n - p - 1) / (p * (a.n + b.n - 2)) * t2
    return one_row(df.sparkSession, n1=int(a.n), n2=int(b.n), t2=t2, f=f, df1=p, df2=int(a.n + b.n - p - 1),
                   p=dist.f_sf(f, p, a.n + b.n - p - 1), **{f"diff_{c}": float(v) for c, v in zip(ys, dm)})


def canonical_correlation(df: DataFrame, set_x: Sequence[str], set_y: Sequence[str]) -> DataFrame:
    xs, ys = list(set_x), list(set_y)
    g = gram(complete(df, [*xs, *ys]), [*xs, *ys])

    def root(m):
        ev, vec = np.linalg.eigh(m)
        return vec @ np.diag(1 / np.sqrt(ev)) @ vec.T

    k = root(g.sub(xs, xs)) @ g.sub(xs, ys) @ root(g.sub(ys, ys))
    r = np.clip(np.linalg.svd(k, compute_uv=False), 0, 1)
    rows = []
    p, q = len(xs), len(ys)
    for i, v in enumerate(r):
        lam = float(np.prod(1 - r[i:] ** 2))
        chi = -(g.n - 1 - (p + q + 1) / 2) * math.log(max(lam, 1e-300))
        dof = (p - i) * (q - i)
        rows.append((i + 1, float(v), lam, chi, dof, dist.chi2_sf(chi, dof)))
    return rows_frame(df.sparkSession, "pair bigint, r double, wilks double, chi2 double, df bigint, p double", rows)


def _scores(parts: dict, xs, quadratic: bool):
    """Per class: discriminant score as a column."""
    total = sum(g.n for g in parts.values())
    pooled = sum(g.cross for g in parts.values()) / (total - len(parts))
    out = {}
    for k, g in parts.items():
        cov = g.cross / (g.n - 1) if quadratic else pooled
        inv = np.linalg.pinv(cov, hermitian=True)
        ld = np.linalg.slogdet(cov)[1] if quadratic else 0.0
        e = F.lit(math.log(g.n / total) - 0.5 * ld)
        for i, a in enumerate(xs):
            for j, b in enumerate(xs):
                e = e - F.lit(0.5 * float(inv[i, j])) * (F.col(a) - F.lit(float(g.mean[i]))) * (F.col(b) - F.lit(float(g.mean[j])))
        out[k] = e
    return out


def _argmax(scores: dict):
    ks = sorted(scores, key=level_key)
    best = F.greatest(*[scores[k] for k in ks])
    e = F.lit(str(ks[-1]))
    for k in reversed(ks[:-1]):
        e = F.when(scores[k] == best, F.lit(str(k))).otherwise(e)
    return e


def fold_of(id_col: str, folds: int, seed: int = 0):
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(folds)).cast("int")


def discriminant_analysis(df: DataFrame, group: str, predictors: Sequence[str], id_col: str, folds: int = 5) -> DataFrame:
    """LDA and QDA with cross-validated accuracy; class moments of all folds come from one pass."""
    xs = list(predictors)
    d = complete(df, xs, [group, id_col]).withColumn("__fold", fold_of(id_col, folds))
    key = F.concat_ws("\u0001", F.col("__fold").cast("string"), F.col(group).cast("string"))
    parts = gram_by(d.withColumn("__k", key), xs, "__k")
    by = {}
    for k, g in parts.items():
        f, lv = k.split("\u0001", 1)
        by.setdefault(lv, {})[int(f)] = g
    refuse(len(by) < 2, "two classes are needed")
    label = F.col(group).cast("string")
    hits = {}
    for name, quad in (("lda", False), ("qda", True)):
        pred = None
        for f in range(folds):
            train = {lv: merge([g for ff, g in fs.items() if ff != f]) for lv, fs in by.items()}
            e = _argmax(_scores(train, xs, quad))
            pred = F.when(F.col("__fold") == f, e) if pred is None else pred.when(F.col("__fold") == f, e)
        hits[name] = pred
    r = fetch(d.select(label.alias("y"), *[p.alias(k) for k, p in hits.items()]), n=F.count(F.lit(1)),
              lda=F.avg(F.when(F.col("y") == F.col("lda"), 1.0).otherwise(0.0)),
              qda=F.avg(F.when(F.col("y") == F.col("qda"), 1.0).otherwise(0.0)))
    sizes = {lv: sum(g.n for g in fs.values()) for lv, fs in by.items()}
    return one_row(df.sparkSession, n=int(r["n"]), classes=len(by), lda_accuracy=r["lda"], qda_accuracy=r["qda"],
                   baseline=max(sizes.values()) / r["n"])


def linear_discriminant(df: DataFrame, outcome: str, features: Sequence[str]) -> DataFrame:
    """Discriminant axes with the share of between-class variance and loadings."""
    xs = list(features)
    parts = gram_by(complete(df, xs, [outcome]), xs, outcome)
    refuse(len(parts) < 2, "two classes are needed")
    t = merge(list(parts.values()))
    w = sum(g.cross for g in parts.values()) / (t.n - len(parts))
    b = t.cross - sum(g.cross for g in parts.values())
    ch = np.linalg.inv(np.linalg.cholesky(w))
    ev, vec = np.linalg.eigh(ch @ b @ ch.T)
    top = np.argsort(ev)[::-1][:min(len(xs), len(parts) - 1)]
    axes = ch.T @ vec[:, top]
    share = ev[top] / ev[top].sum()
    rows = []
    for a in range(len(top)):
        s = 1 if axes[np.argmax(np.abs(axes[:, a])), a] > 0 else -1
        rows += [(a + 1, x, float(s * axes[i, a]), float(share[a])) for i, x in enumerate(xs)]
    return rows_frame(df.sparkSession, "axis bigint, feature string, loading double, between_share double", rows)
