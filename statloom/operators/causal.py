"""Causal inference and mediation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dist
from ..plans.frames import binary01, collect_bounded, complete, cut_lineage, fetch, level_key, need, num, one_row, refuse, rows_frame
from ..plans.gram import Gram, gram, gram_by, merge, ols, score_meat, weighted_gram
from ..plans.order import average_ranks, cumulate, quantiles, with_average_rank
from ..plans.resample import replicate_grams
from ..plans.series import positions
from .glm import linear, logit_fit
from .linear import is_balanced, coef_rows, within_fit


def _treated(df, treatment, outcome, covariates, *other):
    t, *_ = binary01(df, treatment)
    need(df, outcome, *covariates, *other)
    return df.select(t.alias("__t"), num(outcome).alias("__y"), *[num(c).alias(c) for c in covariates], *other).dropna()


def propensity(d: DataFrame, covariates: Sequence[str], clip: float = 1e-3) -> Column:
    f = logit_fit(d, "__t", covariates)
    return F.least(F.greatest(1 / (1 + F.exp(-linear(list(covariates), f.beta))), F.lit(clip)), F.lit(1 - clip))


def ipw(df: DataFrame, treatment: str, outcome: str, covariates: Sequence[str]) -> DataFrame:
    """Stabilised inverse-probability weights, weighted difference with HC1 errors, effective sample size."""
    d = _treated(df, treatment, outcome, covariates).withColumn("e", propensity(_treated(df, treatment, outcome, covariates), covariates))
    p = fetch(d, p=F.avg("__t"))["p"]
    w = F.when(F.col("__t") == 1, F.lit(p) / F.col("e")).otherwise(F.lit(1 - p) / (1 - F.col("e")))
    d = d.withColumn("w", w)
    t1 = F.col("__t") == 1
    s = fetch(d, n=F.count(F.lit(1)), w1=F.sum(F.when(t1, F.col("w"))), w0=F.sum(F.when(~t1, F.col("w"))), y1=F.sum(F.when(t1, F.col("w") * F.col("__y"))), y0=F.sum(F.when(~t1, F.col("w") * F.col("__y"))),
              sw=F.sum("w"), sw2=F.sum(F.col("w") ** 2), ext=F.avg(F.when((F.col("e") < 0.05) | (F.col("e") > 0.95), 1.0).otherwise(0.0)))
    m1, m0 = s["y1"] / s["w1"], s["y0"] / s["w0"]
    r = fetch(d, a=F.sum(F.when(t1, (F.col("w") * (F.col("__y") - F.lit(m1))) ** 2)), b=F.sum(F.when(~t1, (F.col("w") * (F.col("__y") - F.lit(m0))) ** 2)))
    n = s["n"]
    se = math.sqrt(n / (n - 2) * (r["a"] / s["w1"] ** 2 + r["b"] / s["w0"] ** 2))
    ate = m1 - m0
    return one_row(df.sparkSession, n=int(n), ate=ate, se=se, ess=s["sw"] ** 2 / s["sw2"], extreme_share=s["ext"], z=ate / se, p=dist.p_two_sided(ate / se))


def aipw(df: DataFrame, treatment: str, outcome: str, covariates: Sequence[str]) -> DataFrame:
    """Augmented weighting with a linear outcome model per arm."""
    xs = list(covariates)
    d = _treated(df, treatment, outcome, xs)
    e = propensity(d, xs)
    g = gram_by(d, ["__y", *xs], "__t")
    mu1, mu0 = ols(g[1.0], "__y", xs).predict(), ols(g[0.0], "__y", xs).predict()
    t, y = F.col("__t"), F.col("__y")
    s = mu1 - mu0 + t * (y - mu1) / e - (1 - t) * (y - mu0) / (1 - e)
    r = fetch(d.select(s.alias("s")), n=F.count(F.lit(1)), m=F.avg("s"), sd=F.stddev_samp("s"))
    se = r["sd"] / math.sqrt(r["n"])
    return one_row(df.sparkSession, n=int(r["n"]), ate=r["m"], se=se, ci_low=r["m"] - dist.Z95 * se, ci_high=r["m"] + dist.Z95 * se, p=dist.p_two_sided(r["m"] / se))


def _g_effect(g: Gram, xs, inter):
    f = ols(g, "__y", ["__t", *xs, *inter])
    b = dict(zip(f.terms, f.beta))
    m = dict(zip(g.names, g.mean))
    return b["__t"] + sum(b[i] * m[x] for i, x in zip(inter, xs))


def g_computation(df: DataFrame, treatment: str, outcome: str, covariates: Sequence[str], id_col: str, n_boot: int = 500, seed: int = 42) -> DataFrame:
    """Standardised effect from an outcome model with treatment interactions; Poisson bootstrap of the moments."""
    xs = list(covariates)
    d = _treated(df, treatment, outcome, xs, id_col)
    inter = [f"__t_{x}" for x in xs]
    d = d.select("*", *[(F.col("__t") * F.col(x)).alias(i) for x, i in zip(xs, inter)])
    g, reps = replicate_grams(d, id_col, ["__y", "__t", *xs, *inter], n_boot, seed)
    est = _g_effect(g, xs, inter)
    v = np.array([_g_effect(r, xs, inter) for r in reps])
    return one_row(df.sparkSession, n=int(g.n), ate=float(est), se=float(v.std(ddof=1)), ci_low=float(np.quantile(v, 0.025)), ci_high=float(np.quantile(v, 0.975)), n_boot=n_boot)


def double_ml(df: DataFrame, treatment: str, outcome: str, controls: Sequence[str], id_col: str, n_folds: int = 5, trees: int = 30, seed: int = 0) -> DataFrame:
    """Cross-fitted interactive model with random-forest nuisances (MLlib); folds by hash of the row id."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor
    xs = list(controls)
    d = _treated(df, treatment, outcome, xs, id_col).withColumn("fold", F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(n_folds)))
    d = VectorAssembler(inputCols=xs, outputCol="f").transform(d).select("__t", "__y", "f", "fold").persist()
    parts = None
    try:
        for k in range(n_folds):
            tr, te = d.where(F.col("fold") != k), d.where(F.col("fold") == k)
            rf = lambda: RandomForestRegressor(featuresCol="f", labelCol="__y", numTrees=trees, maxDepth=5, seed=seed)
            m1 = rf().setPredictionCol("mu1").fit(tr.where("__t = 1"))
            m0 = rf().setPredictionCol("mu0").fit(tr.where("__t = 0"))
            c = RandomForestClassifier(featuresCol="f", labelCol="__t", numTrees=trees, maxDepth=5, seed=seed, probabilityCol="pr", rawPredictionCol="rw", predictionCol="pc").fit(tr)
            s = c.transform(m0.transform(m1.transform(te))).withColumn("e", F.least(F.greatest(vector_to_array("pr")[1], F.lit(0.01)), F.lit(0.99)))
            t, y = F.col("__t"), F.col("__y")
            s = s.select((F.col("mu1") - F.col("mu0") + t * (y - F.col("mu1")) / F.col("e") - (1 - t) * (y - F.col("mu0")) / (1 - F.col("e"))).alias("s"))
            parts = s if parts is None else parts.unionByName(s)
        r = fetch(parts, n=F.count(F.lit(1)), m=F.avg("s"), sd=F.stddev_samp("s"))
    finally:
        d.unpersist()
    se = r["sd"] / math.sqrt(r["n"])
    return one_row(df.sparkSession, n=int(r["n"]), ate=r["m"], se=se, ci_low=r["m"] - dist.Z95 * se, ci_high=r["m"] + dist.Z95 * se, p=dist.p_two_sided(r["m"] / se))


def match_pairs(df: DataFrame, treatment: str, outcome: str, covariates: Sequence[str], id_col: str, caliper: float = 0.2) -> tuple[DataFrame, float]:
    """One-to-one matches without replacement inside the caliper, by rounds of mutual nearest neighbours on the logit.

    Running extremes along the logit give every unit the nearest unit of the other arm below and above it, so no
    candidate pairs are formed. Adjacent runs of the two arms that are each other's nearest pair their units outward
    from the boundary while the distance stays inside the caliper; the pairs leave the pool and the next round
    starts. The closest boundary is always mutual, so the rounds end when no free pair is left inside the caliper.
    """
    xs = list(covariates)
    d = _treated(df, treatment, outcome, xs, id_col)
    f = logit_fit(d, "__t", xs)
    d = d.withColumn("lp", F.round(linear(xs, f.beta), 12))
    width = caliper * fetch(d, s=F.stddev_samp("lp"))["s"]
    pool = d.select(F.col(id_col).alias("id"), "__t", "lp")
    # Units with equal logits pair off by position first; afterwards a block holds one arm only.
    r = cut_lineage(positions(cut_lineage(pool), "id", ["__t", "lp"], "pos"))
    t, c = r.where("__t = 1").select("lp", "pos", F.col("id").alias("treated_id")), r.where("__t = 0").select("lp", "pos", F.col("id").alias("control_id"))
    pairs = cut_lineage(t.join(c, ["lp", "pos"]).select("treated_id", "control_id", F.lit(0.0).alias("distance")))

    def without(pool, new):
        return cut_lineage(pool.join(new.select(F.col("treated_id").alias("id")).union(new.select("control_id")), "id", "left_anti"))

    pool = without(pool, pairs)
    while True:
        b = pool.groupBy("lp").agg(F.max("__t").alias("arm"), F.count(F.lit(1)).alias("n"))
        b = b.select("lp", "arm", "n", F.when(F.col("arm") == 0, F.col("lp")).alias("u"), F.when(F.col("arm") == 1, F.col("lp")).alias("a"),
                     F.when(F.col("arm") == 0, -F.col("lp")).alias("mu"), F.when(F.col("arm") == 1, -F.col("lp")).alias("ma"))
        b = cumulate(cut_lineage(b), "lp", [], extremes=["u", "a"])
        b = cumulate(cut_lineage(b), "lp", [], extremes=["mu", "ma"], descending=True)
        one = F.col("arm") == 1
        left, right = F.when(one, F.col("u_maxbefore")).otherwise(F.col("a_maxbefore")), -F.when(one, F.col("mu_maxbefore")).otherwise(F.col("ma_maxbefore"))
        inf = F.lit(float("inf"))
        b = cut_lineage(b.select("lp", "arm", "n", F.coalesce(left, -inf).alias("l"), F.coalesce(right, inf).alias("r")))
        # A run is a stretch of one arm between two units of the other; it looks to its nearer side.
        runs = b.groupBy("arm", "l", "r").agg(F.min("lp").alias("lo"), F.max("lp").alias("hi"))
        runs = runs.withColumn("go_right", (F.col("r") - F.col("hi")) < (F.col("lo") - F.col("l")))
        x, y = runs.select(*[F.col(k).alias(f"x_{k}") for k in runs.columns]), runs.select(*[F.col(k).alias(f"y_{k}") for k in runs.columns])
        m = x.join(y, (F.col("x_r") == F.col("y_lo")) & (F.col("y_l") == F.col("x_hi"))).where("x_go_right and not y_go_right and y_lo - x_hi <= %r" % width)
        m = cut_lineage(m.select(F.monotonically_increasing_id().alias("k"), "x_arm", "x_l", "x_r", "y_arm", "y_l", "y_r"))
        r = positions(pool, "id", ["lp"], "pos")

        def outward(side, descending):
            key = m.select("k", *[F.col(f"{side}_{c}").alias(c) for c in ("arm", "l", "r")])
            e = cumulate(b.join(key, ["arm", "l", "r"]).select("k", "lp", "n"), "lp", ["n"], ["k"], descending=descending)
            return e.join(r, "lp").select("k", (F.col("n_before") + F.col("pos")).alias("step"), "id", "lp", "__t")

        p = outward("x", True).join(outward("y", False).select("k", "step", F.col("id").alias("id2"), F.col("lp").alias("lp2")), ["k", "step"]).where((F.col("lp2") - F.col("lp")) <= width)
        tr = F.col("__t") == 1
        new = cut_lineage(p.select(F.when(tr, F.col("id")).otherwise(F.col("id2")).alias("treated_id"), F.when(tr, F.col("id2")).otherwise(F.col("id")).alias("control_id"), (F.col("lp2") - F.col("lp")).alias("distance")))
        if new.limit(1).count() == 0:
            break
        pairs = pairs.unionByName(new)
        pool = without(pool, new)
    refuse(pairs.limit(1).count() == 0, "no pair inside the caliper")
    y = d.select(F.col(id_col).alias("id"), "__y", *xs)
    out = pairs.join(y.select(F.col("id").alias("treated_id"), F.col("__y").alias("y1"), *[F.col(x).alias(f"{x}_1") for x in xs]), "treated_id")
    out = out.join(y.select(F.col("id").alias("control_id"), F.col("__y").alias("y0"), *[F.col(x).alias(f"{x}_0") for x in xs]), "control_id")
    return cut_lineage(out), float(width)


def psm(df: DataFrame, treatment: str, outcome: str, covariates: Sequence[str], id_col: str) -> DataFrame:
    """ATT over matched pairs with the paired t test, and the balance of every covariate before and after."""
    xs = list(covariates)
    pairs, width = match_pairs(df, treatment, outcome, xs, id_col)
    s = fetch(pairs, n=F.count(F.lit(1)), m=F.avg(F.col("y1") - F.col("y0")), sd=F.stddev_samp(F.col("y1") - F.col("y0")),
              **{f"b{i}": F.try_divide(F.avg(f"{x}_1") - F.avg(f"{x}_0"), F.sqrt((F.var_samp(f"{x}_1") + F.var_samp(f"{x}_0")) / 2)) for i, x in enumerate(xs)})
    g = gram_by(_treated(df, treatment, outcome, xs), xs, "__t")
    t = s["m"] / (s["sd"] / math.sqrt(s["n"]))
    rows = []
    for i, x in enumerate(xs):
        v = [g[k].cross[i, i] / (g[k].n - 1) for k in (1.0, 0.0)]
        before = (g[1.0].mean[i] - g[0.0].mean[i]) / math.sqrt(sum(v) / 2)
        rows.append((x, before, s[f"b{i}"], int(s["n"]), int(g[1.0].n), s["m"], t, dist.t_two_sided(t, s["n"] - 1), width))
    return rows_frame(df.sparkSession, "covariate string, smd_before double, smd_after double, pairs bigint, treated bigint, att double, t double, p double, caliper double", rows)


def rosenbaum_bounds(df: DataFrame, treatment: str, outcome: str, covariates: Sequence[str], id_col: str, gammas: Sequence[float] = (1.0, 1.25, 1.5, 2.0, 3.0)) -> DataFrame:
    """Upper and lower signed-rank p over the sensitivity grid on matched pairs."""
    pairs, _ = match_pairs(df, treatment, outcome, covariates, id_col)
    d = pairs.select((F.col("y1") - F.col("y0")).alias("d")).where("d <> 0").select(F.abs("d").alias("a"), (F.col("d") > 0).alias("pos"))
    r = average_ranks(d, "a", p=F.col("pos"))
    s = fetch(r, n=F.sum("n"), t=F.sum(F.col("p") * F.col("avg_rank")), r1=F.sum(F.col("n") * F.col("avg_rank")), r2=F.sum(F.col("n") * F.col("avg_rank") ** 2))
    rows = []
    for gm in gammas:
        out = []
        for pr in (gm / (1 + gm), 1 / (1 + gm)):
            out.append(dist.norm_sf((s["t"] - pr * s["r1"]) / math.sqrt(pr * (1 - pr) * s["r2"])))
        rows.append((float(gm), int(s["n"]), s["t"], out[0], out[1], out[0] < 0.05))
    return rows_frame(df.sparkSession, "gamma double, pairs bigint, signed_rank double, p_upper double, p_lower double, robust boolean", rows)


def interrupted_time_series(df: DataFrame, outcome: str, time: str, intervention: float) -> DataFrame:
    """Segmented regression with Newey-West errors and the Durbin-Watson statistic; time is numeric."""
    d = complete(df, [outcome, time])
    z = d.select(F.col(time).alias("t"), F.col(outcome).alias("y"), F.when(F.col(time) >= intervention, 1.0).otherwise(0.0).alias("step")).withColumn("slope", F.col("step") * (F.col("t") - intervention))
    c = fetch(z, n=F.count(F.lit(1)), post=F.sum("step"))
    refuse(c["n"] < 8 or c["post"] < 3 or c["n"] - c["post"] < 3, "three points on each side and eight in all are needed")
    xs = ["t", "step", "slope"]
    f = ols(gram(z, ["y", *xs]), "y", xs)
    from .timeseries import with_lags
    L = int(round(f.n ** 0.25))
    e = z.withColumn("e", F.col("y") - f.predict())
    s = [F.col("e"), *[F.col("e") * F.col(x) for x in xs]]
    sc = e.select("t", "e", *[v.alias(f"s{i}") for i, v in enumerate(s)])
    names = [f"s{i}" for i in range(4)]
    from ..plans.series import blocks
    b, part = blocks(sc, "t", halo=L)
    w = Window.partitionBy(*part).orderBy("__i")
    q = b.select("__own", *names, "e", F.lag("e", 1).over(w).alias("e1"), *[F.lag(nm, k).over(w).alias(f"{nm}_{k}") for nm in names for k in range(1, L + 1)]).where("__own")
    r = fetch(q, dw=F.sum((F.col("e") - F.col("e1")) ** 2) / F.sum(F.col("e") ** 2), **{f"m{i}_{j}": F.sum(F.col(names[i]) * F.col(names[j])) for i in range(4) for j in range(4)},
              **{f"l{k}_{i}_{j}": F.coalesce(F.sum(F.col(names[i]) * F.col(f"{names[j]}_{k}")), F.lit(0.0)) for k in range(1, L + 1) for i in range(4) for j in range(4)})
    m = np.array([[r[f"m{i}_{j}"] for j in range(4)] for i in range(4)])
    for k in range(1, L + 1):
        gk = np.array([[r[f"l{k}_{i}_{j}"] for j in range(4)] for i in range(4)])
        m = m + (1 - k / (L + 1)) * (gk + gk.T)
    v = f.unscaled @ m @ f.unscaled
    return rows_frame(df.sparkSession, "term string, coef double, se double, t double, p double, durbin_watson double, n bigint", [(*x, r["dw"], int(f.n)) for x in coef_rows(f.terms, f.beta, v)])


# --- panels ---------------------------------------------------------------------------------------

def onset(df: DataFrame, unit: str, time: str, treatment: str) -> DataFrame:
    """First treated period per unit (null when never treated)."""
    return df.groupBy(unit).agg(F.min(F.when(num(treatment) > 0, F.col(time))).alias("__g"))


def _event_fit(df, unit, time, treatment, outcome, window):
    d = complete(df, [outcome, treatment, time], [unit]).join(onset(df, unit, time, treatment), unit)
    have = fetch(d, never=F.sum(F.when(F.col("__g").isNull(), 1).otherwise(0)), k=F.count_distinct("__g"))
    refuse(have["k"] == 0, "no unit is ever treated")
    refuse(have["k"] > 1 and have["never"] == 0, "staggered onsets need never-treated units")
    rel = F.when(F.col("__g").isNotNull(), F.least(F.greatest(F.col(time) - F.col("__g"), F.lit(-window)), F.lit(window))).cast("int")
    d = d.withColumn("__rel", rel)
    ks = sorted(r[0] for r in d.select("__rel").dropna().distinct().collect() if r[0] is not None)
    ref = -1 if -1 in ks else max(k for k in ks if k < 0)
    ks = [k for k in ks if k != ref]
    cols = [f"e{'m' if k < 0 else 'p'}{abs(k)}" for k in ks]
    z = d.select(unit, time, outcome, *[F.when(F.col("__rel") == k, 1.0).otherwise(0.0).alias(c) for k, c in zip(ks, cols)])
    f, v, _ = within_fit(z, outcome, cols, unit, time)
    return ks, f.beta[1:], v, int(f.n)


def event_study(df: DataFrame, unit: str, time: str, treatment: str, outcome: str, window: int = 5) -> DataFrame:
    """Dynamic effects by relative period with unit and period effects, errors clustered by unit."""
    ks, b, v, n = _event_fit(df, unit, time, treatment, outcome, window)
    rows = []
    for k, (t, c, s, z, p) in zip(ks, coef_rows([str(k) for k in ks], b, v)):
        rows.append((k, c, s, c - dist.Z95 * s, c + dist.Z95 * s, p, n))
    return rows_frame(df.sparkSession, "relative_time bigint, coef double, se double, ci_low double, ci_high double, p double, n bigint", rows)


def staggered_did(df: DataFrame, unit: str, time: str, treatment: str, outcome: str, window: int = 5) -> DataFrame:
    """Sun-Abraham: cohort by relative-time effects averaged with cohort shares."""
    d = complete(df, [outcome, treatment, time], [unit]).join(onset(df, unit, time, treatment), unit)
    refuse(d.where("__g is null").limit(1).count() == 0, "never-treated units are needed")
    rel = F.when(F.col("__g").isNotNull(), F.least(F.greatest(F.col(time) - F.col("__g"), F.lit(-window)), F.lit(window))).cast("int")
    d = d.withColumn("__rel", rel)
    cells = {(r["__g"], r["__rel"]): r["u"] for r in collect_bounded(d.dropna(subset=["__g"]).groupBy("__g", "__rel").agg(F.count_distinct(unit).alias("u")), "cohort cells") if r["__rel"] != -1}
    keys = sorted(cells)
    cols = [f"c{i}" for i in range(len(keys))]
    z = d.select(unit, time, outcome, *[F.coalesce(F.when((F.col("__g") == g) & (F.col("__rel") == e), 1.0).otherwise(0.0), F.lit(0.0)).alias(c) for (g, e), c in zip(keys, cols)])
    f, v, _ = within_fit(z, outcome, cols, unit, time)
    b = f.beta[1:]
    rows = []
    for e in sorted({k[1] for k in keys}):
        w = np.array([cells[k] if k[1] == e else 0.0 for k in keys])
        w = w / w.sum()
        c, s = float(w @ b), math.sqrt(max(float(w @ v @ w), 0))
        rows.append((int(e), c, s, c - dist.Z95 * s, c + dist.Z95 * s))
    return rows_frame(df.sparkSession, "relative_time bigint, coef double, se double, ci_low double, ci_high double", rows)


def callaway_santanna(df: DataFrame, unit: str, time: str, outcome: str, gname: str, control: str = "never") -> DataFrame:
    """Group-time effects against never (or not yet) treated units; base period g-1, or t-1 before treatment.

    Outcomes meet their base period by an equi-join on (unit, period); cohort-period means of the changes suffice.
    """
    d = complete(df, [time, outcome, gname], [unit]).select(F.col(unit).alias("u"), F.col(time).alias("t"), F.col(outcome).alias("y"), F.col(gname).alias("g"))
    cohorts = sorted(r[0] for r in collect_bounded(d.where("g > 0").select("g").distinct(), "cohorts"))
    first = fetch(d, m=F.min("t"))["m"]
    coh = F.explode(F.array(*[F.lit(float(c)) for c in cohorts]))
    e = d.withColumn("c", coh).where(F.col("t") > first)
    base = F.when(F.col("t") >= F.col("c"), F.col("c") - 1).otherwise(F.col("t") - 1)
    e = e.withColumn("b", base)
    clean = F.col("g") == 0
    if control != "never":
        clean = clean | ((F.col("g") > F.greatest("t", "b")) & (F.col("g") != F.col("c")))
    e = e.where((F.col("g") == F.col("c")) | clean).join(d.select("u", F.col("t").alias("b"), F.col("y").alias("yb")), ["u", "b"])
    own = F.col("g") == F.col("c")
    dy = F.col("y") - F.col("yb")
    a = e.groupBy("c", "t").agg(F.avg(F.when(own, dy)).alias("m1"), F.avg(F.when(~own, dy)).alias("m0"), F.sum(F.when(own, 1).otherwise(0)).alias("n_treated"), F.sum(F.when(~own, 1).otherwise(0)).alias("n_control"),
                                F.var_samp(F.when(own, dy)).alias("v1"), F.var_samp(F.when(~own, dy)).alias("v0"))
    return a.where("m1 is not null and m0 is not null").select(F.col("c").cast("bigint").alias("cohort"), F.col("t").cast("bigint").alias("period"), (F.col("m1") - F.col("m0")).alias("att"),
                                                               F.sqrt(F.col("v1") / F.col("n_treated") + F.col("v0") / F.col("n_control")).alias("se"), "n_treated", "n_control")


def callaway_aggregate(att: DataFrame) -> DataFrame:
    """Simple and dynamic averages of group-time effects, weighted by cohort size."""
    d = att.withColumn("e", F.col("period") - F.col("cohort"))
    w = F.sum(F.col("att") * F.col("n_treated")) / F.sum("n_treated")
    dyn = d.groupBy("e").agg(w.alias("att")).select(F.lit("dynamic").alias("kind"), F.col("e").cast("bigint").alias("relative_time"), "att")
    return dyn.unionByName(d.where("e >= 0").agg(w.alias("att")).select(F.lit("simple").alias("kind"), F.lit(None).cast("bigint").alias("relative_time"), "att"))


def goodman_bacon(df: DataFrame, unit: str, time: str, outcome: str, gname: str) -> DataFrame:
    """Two-by-two comparisons of cohorts with their weights, from cohort-period means of a balanced panel."""
    d = complete(df, [time, outcome, gname], [unit])
    refuse(not is_balanced(d, unit, time), "the panel must be balanced")
    rows = collect_bounded(d.groupBy(F.col(gname).alias("g"), F.col(time).alias("t")).agg(F.avg(outcome).alias("y"), F.count(F.lit(1)).alias("n")), "cohort periods")
    ts = sorted({r["t"] for r in rows})
    y = {(r["g"], r["t"]): r["y"] for r in rows}
    n = {r["g"]: r["n"] for r in rows}
    gs = sorted(g for g in n if g > 0)
    out = []

    def add(kind, k, l, nk, nl, pre, post):
        dbar = len(post) / (len(pre) + len(post))
        if not pre or not post:
            return
        share = nk / (nk + nl)
        span = (len(pre) + len(post)) / len(ts)
        w = ((nk + nl) * span) ** 2 * share * (1 - share) * dbar * (1 - dbar)
        m = lambda g, p: sum(y[(g, t)] for t in p) / len(p)
        out.append((kind, k, l, (m(k, post) - m(k, pre)) - (m(l, post) - m(l, pre)), w))

    for k in gs:
        if 0 in n:
            add("treated_vs_never", k, 0, n[k], n[0], [t for t in ts if t < k], [t for t in ts if t >= k])
    for k, l in combinations(gs, 2):
        add("earlier_vs_later", k, l, n[k], n[l], [t for t in ts if t < k], [t for t in ts if k <= t < l])
        add("later_vs_earlier", l, k, n[l], n[k], [t for t in ts if k <= t < l], [t for t in ts if t >= l])
    tot = sum(o[4] for o in out)
    return rows_frame(df.sparkSession, "kind string, treated bigint, control bigint, estimate double, weight double", [(a, int(b), int(c), e, w / tot) for a, b, c, e, w in out])


def honest_did(df: DataFrame, unit: str, time: str, treatment: str, outcome: str, window: int = 5, post_period: int = 0) -> DataFrame:
    """Event-study interval widened by multiples of the largest pre-trend change, and the breakdown multiple."""
    ks, b, v, n = _event_fit(df, unit, time, treatment, outcome, window)
    pre = [(k, float(c)) for k, c in zip(ks, b) if k < 0] + [(-1, 0.0)]
    pre.sort()
    step = max((abs(c1 - c0) for (_, c0), (_, c1) in zip(pre, pre[1:])), default=0.0)
    i = ks.index(post_period)
    est, se = float(b[i]), math.sqrt(v[i, i])
    slack = abs(est) - dist.Z95 * se
    br = slack / step if slack > 0 and step > 0 else 0.0
    return rows_frame(df.sparkSession, "m_bar double, estimate double, ci_low double, ci_high double, max_pre_change double, breakdown double",
                      [(m, est, est - dist.Z95 * se - m * step, est + dist.Z95 * se + m * step, step, br) for m in (0.0, 0.5, 1.0, 1.5, 2.0)])


def chaisemartin_did(df: DataFrame, unit: str, time: str, treatment: str, outcome: str) -> DataFrame:
    """DID_M over consecutive periods: switchers in and out against the stable, weighted by switchers."""
    d = complete(df, [time, treatment, outcome], [unit]).select(F.col(unit).alias("u"), F.col(time).alias("t"), F.col(treatment).alias("d"), F.col(outcome).alias("y"))
    j = d.join(d.select("u", (F.col("t") + 1).alias("t"), F.col("d").alias("d0"), F.col("y").alias("y0")), ["u", "t"])
    dy = F.col("y") - F.col("y0")
    c = lambda a, b: (F.col("d0") == a) & (F.col("d") == b)
    g = j.groupBy("t").agg(*[F.sum(F.when(c(a, b), 1).otherwise(0)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)], *[F.avg(F.when(c(a, b), dy)).alias(f"m{a}{b}") for a in (0, 1) for b in (0, 1)])
    up = F.when((F.col("n01") > 0) & (F.col("n00") > 0), F.col("n01"))
    dn = F.when((F.col("n10") > 0) & (F.col("n11") > 0), F.col("n10"))
    return g.agg(F.coalesce(F.sum(up), F.lit(0)).alias("switchers_in"), F.coalesce(F.sum(dn), F.lit(0)).alias("switchers_out"),
                 F.try_divide(F.coalesce(F.sum(up * (F.col("m01") - F.col("m00"))), F.lit(0.0)) + F.coalesce(F.sum(dn * (F.col("m11") - F.col("m10"))), F.lit(0.0)),
                              F.coalesce(F.sum(up), F.lit(0)) + F.coalesce(F.sum(dn), F.lit(0))).alias("did_m"))


def changes_in_changes(df: DataFrame, outcome: str, treated: str, post: str, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Counterfactual F01^-1(F00(y)) of treated pre values; average and quantile effects. `treated` and `post` are 0/1."""
    d = complete(df, [outcome, treated, post])
    cell = lambda g, t: d.where((F.col(treated) == g) & (F.col(post) == t)).select(F.col(outcome).alias("y"))
    n00, n01 = cell(0, 0).count(), cell(0, 1).count()
    refuse(min(n00, n01) < 2, "control rows in both periods are needed")
    # F00 at treated pre values by one cumulative count over the merged values
    m = cell(0, 0).select("y", F.lit(1).alias("c"), F.lit(0).alias("k")).unionByName(cell(1, 0).select("y", F.lit(0).alias("c"), F.lit(1).alias("k"))).groupBy("y").agg(F.sum("c").alias("c"), F.sum("k").alias("k"))
    r = cumulate(m, "y", ["c"]).where("k > 0").select("k", F.greatest(F.ceil((F.col("c_before") + F.col("c")) * F.lit(n01) / F.lit(n00) - 1e-9), F.lit(1)).cast("bigint").alias("rank"))
    q = cumulate(cell(0, 1).groupBy("y").agg(F.count(F.lit(1)).alias("n")), "y", ["n"])
    # the rank-th control post value: ranks and values meet in one more cumulative order
    ranks = r.groupBy("rank").agg(F.sum("k").alias("k"))
    ev = q.select((F.col("n_before") + 1).cast("double").alias("pos"), F.col("y").alias("v"), F.lit(0).cast("bigint").alias("k")).unionByName(
        ranks.select((F.col("rank") + 0.5).alias("pos"), F.lit(None).cast("double").alias("v"), "k"))
    cf = cumulate(ev, "pos", [], extremes=["v"]).where("k > 0").select("k", F.col("v_maxbefore").alias("v"))
    s = fetch(cf, m=F.sum(F.col("k") * F.col("v")) / F.sum("k"), n=F.sum("k"))
    obs = fetch(cell(1, 1), m=F.avg("y"))["m"]
    wide = cf.select("v", F.explode(F.sequence(F.lit(1), F.col("k"))))
    qo, qc = quantiles(cell(1, 1), "y", probs), quantiles(wide, "v", probs)
    rows = [("att", None, obs - s["m"], int(s["n"]))] + [("qte", float(p), a - b, int(s["n"])) for p, a, b in zip(probs, qo, qc)]
    return rows_frame(df.sparkSession, "effect string, prob double, estimate double, treated_pre bigint", rows)


def _local_line(d, y, x, cutoff, h):
    """Weighted intercepts at the cutoff on both sides (triangular kernel) and their variances."""
    c = F.col(x) - F.lit(cutoff)
    z = d.select(F.col(y).alias("y"), c.alias("c"), (F.col(x) >= cutoff).cast("int").alias("side"), (1 - F.abs(c) / F.lit(h)).alias("w")).where("w > 0")
    g = weighted_gram(z, ["y", "c"], F.col("w"), ["side"])
    refuse(len(g) < 2, "no rows on one side of the cutoff")
    out = {}
    for (s,), m in g.items():
        sl = m.cross[0, 1] / m.cross[1, 1]
        out[s] = (m.mean[0] - sl * m.mean[1], sl, m)
    v = {}
    for s in (0, 1):
        a, sl, m = out[s]
        lev = F.col("w") * (F.lit(1 / m.n) - F.lit(m.mean[1] / m.cross[1, 1]) * (F.col("c") - F.lit(m.mean[1])))
        v[s] = fetch(z.where(F.col("side") == s), v=F.sum((lev * (F.col("y") - F.lit(a) - F.lit(sl) * F.col("c"))) ** 2), n=F.count(F.lit(1)))
    return out[1][0] - out[0][0], v[0]["v"] + v[1]["v"], v[0]["n"], v[1]["n"]


def _bandwidth(d, x, h):
    if h is not None:
        return h
    s = fetch(d, s=F.stddev_samp(x), n=F.count(F.lit(1)))
    return 1.84 * s["s"] * s["n"] ** -0.2


def rdd(df: DataFrame, running: str, outcome: str, cutoff: float, bandwidth: float | None = None) -> DataFrame:
    """Sharp design: local-linear jump with a triangular kernel at a given or rule-of-thumb bandwidth."""
    d = complete(df, [running, outcome])
    h = _bandwidth(d, running, bandwidth)
    j, v, n0, n1 = _local_line(d, outcome, running, cutoff, h)
    se = math.sqrt(v)
    return one_row(df.sparkSession, jump=float(j), se=se, bandwidth=float(h), n_left=int(n0), n_right=int(n1), ci_low=j - dist.Z95 * se, ci_high=j + dist.Z95 * se, p=dist.p_two_sided(j / se))


def fuzzy_rdd(df: DataFrame, running: str, outcome: str, treatment: str, cutoff: float, bandwidth: float | None = None) -> DataFrame:
    d = complete(df, [running, outcome, treatment])
    h = _bandwidth(d, running, bandwidth)
    jy, vy, n0, n1 = _local_line(d, outcome, running, cutoff, h)
    jt, vt, _, _ = _local_line(d, treatment, running, cutoff, h)
    refuse(abs(jt) < 1e-12, "the treatment does not jump at the cutoff")
    est = jy / jt
    # the ratio's variance is that of the jump in y - est * treatment
    jr, vr, _, _ = _local_line(d.withColumn("__r", F.col(outcome) - F.lit(float(est)) * F.col(treatment)), "__r", running, cutoff, h)
    se = math.sqrt(vr) / abs(jt)
    return one_row(df.sparkSession, effect=float(est), se=se, jump_outcome=float(jy), jump_treatment=float(jt), bandwidth=float(h), n_left=int(n0), n_right=int(n1))


def mendelian_randomization(df: DataFrame, beta_exposure: str, beta_outcome: str, se_outcome: str) -> DataFrame:
    """IVW with multiplicative overdispersion, Egger after orientation, weighted median, Cochran's Q."""
    d = complete(df, [beta_exposure, beta_outcome, se_outcome]).select(F.abs(beta_exposure).alias("x"), (F.col(beta_outcome) * F.signum(F.col(beta_exposure))).alias("y"), (1 / F.col(se_outcome) ** 2).alias("w")).where("x > 0")
    s = fetch(d, k=F.count(F.lit(1)), wxx=F.sum(F.col("w") * F.col("x") ** 2), wxy=F.sum(F.col("w") * F.col("x") * F.col("y")), wyy=F.sum(F.col("w") * F.col("y") ** 2))
    refuse(s["k"] < 3, "three instruments are needed")
    b = s["wxy"] / s["wxx"]
    qv = s["wyy"] - b * s["wxy"]
    se = math.sqrt(1 / s["wxx"]) * max(1.0, math.sqrt(qv / (s["k"] - 1)))
    g = weighted_gram(d, ["y", "x"], F.col("w"))[()]
    sl = g.cross[0, 1] / g.cross[1, 1]
    ic = g.mean[0] - sl * g.mean[1]
    phi = max(1.0, (g.cross[0, 0] - sl * g.cross[0, 1]) / (s["k"] - 2))
    se_i = math.sqrt(phi * (1 / g.n + g.mean[1] ** 2 / g.cross[1, 1]))
    r = d.select((F.col("y") / F.col("x")).alias("r"), (F.col("w") * F.col("x") ** 2).alias("wt")).groupBy("r").agg(F.sum("wt").alias("wt"))
    c = cumulate(r, "r", ["wt"]).withColumn("p", (F.col("wt_before") + F.col("wt") / 2) / F.lit(s["wxx"]))
    m = fetch(c, lo=F.max_by("r", F.when(F.col("p") <= 0.5, F.col("p"))), pl=F.max(F.when(F.col("p") <= 0.5, F.col("p"))), hi=F.min_by("r", F.when(F.col("p") > 0.5, F.col("p"))), ph=F.min(F.when(F.col("p") > 0.5, F.col("p"))))
    med = m["hi"] if m["pl"] is None else m["lo"] + (m["hi"] - m["lo"]) * (0.5 - m["pl"]) / (m["ph"] - m["pl"])
    return one_row(df.sparkSession, instruments=int(s["k"]), ivw=b, ivw_se=se, q=qv, egger_slope=float(sl), egger_intercept=float(ic), weighted_median=med, ivw_p=dist.p_two_sided(b / se), q_p=dist.chi2_sf(qv, s["k"] - 1),
                   egger_intercept_p=dist.t_two_sided(float(ic) / se_i, s["k"] - 2))


# --- mediation ------------------------------------------------------------------------------------

def _boot(df, cols, id_col, effects, n_boot, seed):
    """Estimates and percentile intervals of functions of the moments."""
    d = complete(df, cols, [id_col])
    g, reps = replicate_grams(d, id_col, cols, n_boot, seed)
    est = effects(g)
    v = {k: np.array([e[k] for e in map(effects, reps)]) for k in est}
    return g, [(k, float(est[k]), float(v[k].std(ddof=1)), float(np.quantile(v[k], 0.025)), float(np.quantile(v[k], 0.975)), int(g.n)) for k in est]


_EFF = "effect string, estimate double, se double, ci_low double, ci_high double, n bigint"


def _b(g, y, xs):
    return dict(zip(xs, np.linalg.pinv(g.sub(xs, xs), hermitian=True) @ g.sub(xs, [y])[:, 0]))


def mediation(df: DataFrame, x: str, m: str, y: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Indirect, direct and total effect with Monte-Carlo intervals of the product."""
    g = gram(complete(df, [x, m, y]), [x, m, y])
    fa, fb, ft = ols(g, m, [x]), ols(g, y, [x, m]), ols(g, y, [x])
    a, b, c = fa.beta[1], fb.beta[2], fb.beta[1]
    rng = np.random.default_rng(seed)
    ab = rng.normal(a, fa.se[1], draws) * rng.normal(b, fb.se[2], draws)
    rows = [("indirect", a * b, float(ab.std(ddof=1)), float(np.quantile(ab, 0.025)), float(np.quantile(ab, 0.975)), int(g.n)), ("direct", c, fb.se[1], c - dist.Z95 * fb.se[1], c + dist.Z95 * fb.se[1], int(g.n)),
            ("total", ft.beta[1], ft.se[1], ft.beta[1] - dist.Z95 * ft.se[1], ft.beta[1] + dist.Z95 * ft.se[1], int(g.n)), ("proportion_mediated", a * b / ft.beta[1] if ft.beta[1] else None, None, None, None, int(g.n))]
    return rows_frame(df.sparkSession, _EFF, rows)


def serial_mediation(df: DataFrame, x: str, m1: str, m2: str, y: str, id_col: str, n_boot: int = 500, seed: int = 42) -> DataFrame:
    def effects(g):
        a1, r2, ry = _b(g, m1, [x])[x], _b(g, m2, [x, m1]), _b(g, y, [x, m1, m2])
        return {"m1": a1 * ry[m1], "m2": r2[x] * ry[m2], "serial": a1 * r2[m1] * ry[m2], "direct": ry[x], "total_indirect": a1 * ry[m1] + r2[x] * ry[m2] + a1 * r2[m1] * ry[m2]}
    return rows_frame(df.sparkSession, _EFF, _boot(df, [x, m1, m2, y], id_col, effects, n_boot, seed)[1])


def parallel_mediation(df: DataFrame, x: str, mediators: Sequence[str], y: str, id_col: str, n_boot: int = 500, seed: int = 42) -> DataFrame:
    ms = list(mediators)

    def effects(g):
        ry = _b(g, y, [x, *ms])
        e = {m: _b(g, m, [x])[x] * ry[m] for m in ms}
        return {**e, "total_indirect": sum(e.values()), "direct": ry[x], **{f"{a}-{b}": e[a] - e[b] for a, b in combinations(ms, 2)}}
    return rows_frame(df.sparkSession, _EFF, _boot(df, [x, *ms, y], id_col, effects, n_boot, seed)[1])


def moderated_mediation(df: DataFrame, x: str, m: str, y: str, w: str, id_col: str, n_boot: int = 500, seed: int = 42) -> DataFrame:
    """First-stage moderation: index of moderated mediation and conditional indirect effects at mean and one SD."""
    s = fetch(df, mean=F.avg(num(w)), sd=F.stddev_samp(num(w)))
    d = df.withColumn("__xw", num(x) * num(w))

    def effects(g):
        a, b = _b(g, m, [x, w, "__xw"]), _b(g, y, [x, m])
        return {"index": a["__xw"] * b[m], **{f"indirect_{t}": (a[x] + a["__xw"] * v) * b[m] for t, v in (("low", s["mean"] - s["sd"]), ("mean", s["mean"]), ("high", s["mean"] + s["sd"]))}, "direct": b[x]}
    return rows_frame(df.sparkSession, _EFF, _boot(d, [x, m, y, w, "__xw"], id_col, effects, n_boot, seed)[1])


def moderated_moderation(df: DataFrame, x: str, w: str, z: str, y: str) -> DataFrame:
    """Three-way interaction on centred variables with conditional slopes at one SD around the means."""
    vs = [x, w, z]
    d = complete(df, [*vs, y])
    g0 = gram(d, vs)
    sd = np.sqrt(np.diag(g0.cov()))
    c = d.select(y, *[(F.col(v) - F.lit(float(m))).alias(v) for v, m in zip(vs, g0.mean)])
    c = c.select("*", (F.col(x) * F.col(w)).alias("xw"), (F.col(x) * F.col(z)).alias("xz"), (F.col(w) * F.col(z)).alias("wz"), (F.col(x) * F.col(w) * F.col(z)).alias("xwz"))
    terms = [x, w, z, "xw", "xz", "wz", "xwz"]
    f = ols(gram(c, [y, *terms]), y, terms)
    rows = [("coef", t, b, s, p) for t, b, s, _, p in coef_rows(["intercept", "x", "w", "z", "xw", "xz", "wz", "xwz"], f.beta, f.vcov, f.df)]
    for a, wa in (("low", -sd[1]), ("high", sd[1])):
        for k, zk in (("low", -sd[2]), ("high", sd[2])):
            l = np.zeros(8)
            l[[1, 4, 5, 7]] = [1, wa, zk, wa * zk]
            s = math.sqrt(l @ f.vcov @ l)
            rows.append(("slope", f"w_{a}_z_{k}", float(l @ f.beta), s, dist.t_two_sided(float(l @ f.beta) / s, f.df)))
    return rows_frame(df.sparkSession, "kind string, term string, estimate double, se double, p double", rows)


def johnson_neyman(df: DataFrame, x: str, w: str, y: str, alpha: float = 0.05) -> DataFrame:
    """Moderator values where the conditional slope of x changes significance."""
    d = complete(df, [x, w, y])
    d = d.withColumn("xw", F.col(x) * F.col(w))
    f = ols(gram(d, [y, x, w, "xw"]), y, [x, w, "xw"])
    b1, b3 = f.beta[1], f.beta[3]
    v = f.vcov
    t2 = dist.t_ppf(1 - alpha / 2, f.df) ** 2
    qa, qb, qc = b3 * b3 - t2 * v[3, 3], 2 * (b1 * b3 - t2 * v[1, 3]), b1 * b1 - t2 * v[1, 1]
    disc = qb * qb - 4 * qa * qc
    roots = sorted([(-qb - math.sqrt(disc)) / (2 * qa), (-qb + math.sqrt(disc)) / (2 * qa)]) if disc >= 0 and qa else [None, None]
    r = fetch(d, lo=F.min(w), hi=F.max(w))
    return one_row(df.sparkSession, n=int(f.n), b_x=float(b1), b_xw=float(b3), root_low=float(roots[0]) if roots[0] is not None else float("nan"), root_high=float(roots[1]) if roots[1] is not None else float("nan"), w_min=r["lo"], w_max=r["hi"])


def dag_structure_learning(df: DataFrame, variables: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """PC algorithm on the Spark-aggregated correlation matrix: skeleton by Fisher-z tests, colliders, Meek's first rule."""
    vs = list(variables)
    g = gram(complete(df, vs), vs)
    r, n, p = g.corr(), g.n, len(vs)
    adj = {i: set(range(p)) - {i} for i in range(p)}
    sep = {}
    level = 0
    while any(len(adj[i]) - 1 >= level for i in adj):
        for i, j in [(i, j) for i in range(p) for j in sorted(adj[i]) if i < j]:
            for s in [c for k in (i, j) for c in combinations(sorted(adj[k] - {i, j}), level)]:
                idx = [i, j, *s]
                prec = np.linalg.pinv(r[np.ix_(idx, idx)], hermitian=True)
                rho = max(min(-prec[0, 1] / math.sqrt(prec[0, 0] * prec[1, 1]), 1 - 1e-12), -1 + 1e-12)
                if dist.p_two_sided(math.atanh(rho) * math.sqrt(max(n - level - 3, 1))) > alpha:
                    adj[i].discard(j)
                    adj[j].discard(i)
                    sep[(i, j)] = set(s)
                    break
        level += 1
    arrow = set()
    for k in range(p):
        for i, j in combinations(sorted(adj[k]), 2):
            if j not in adj[i] and k not in sep.get((i, j), set()):
                arrow |= {(i, k), (j, k)}
    moved = True
    while moved:
        moved = False
        for i, k in list(arrow):
            for j in adj[k]:
                if j != i and j not in adj[i] and (k, j) not in arrow and (j, k) not in arrow:
                    arrow.add((k, j))
                    moved = True
    rows = []
    for i, j in [(i, j) for i in range(p) for j in sorted(adj[i]) if i < j]:
        kind = "directed" if ((i, j) in arrow) != ((j, i) in arrow) else "undirected"
        a, b = (j, i) if kind == "directed" and (j, i) in arrow else (i, j)
        rows.append((vs[a], vs[b], kind, float(r[i, j])))
    return rows_frame(df.sparkSession, "source string, target string, kind string, r double", rows)
