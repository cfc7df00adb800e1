"""Multi-criteria ranking, marketing, process control, resource accounting, project economics, meta-analysis."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dist
from ..plans.design import Cells
from ..plans.frames import (collect_bounded, complete, cut_lineage, fetch, level_key, need, num, one_row, refuse, rows_frame)
from ..plans.gram import gram, weighted_gram
from ..plans.order import average_ranks, cumulate, range_bounds, range_id, sorted_position, value_counts
from ..plans.series import blocks


# --- multi-criteria ranking -----------------------------------------------------------------------

def min_rank(df: DataFrame, score: str, out: str = "rank", descending: bool = True) -> DataFrame:
    """1 + number of rows with a strictly better score; scores are compared at ten decimals."""
    d = df.withColumn("__s", F.round(F.col(score), 10))
    c = cumulate(value_counts(d.where(F.col("__s").isNotNull()), "__s"), "__s", ["n"], descending=descending)
    return d.join(c.select("__s", (F.col("n_before") + 1).cast("bigint").alias(out)), "__s", "left").drop("__s")


def _criteria(df: DataFrame, unit: str, criteria: Sequence[str]) -> DataFrame:
    refuse(len(criteria) < 2, "two criteria are needed")
    return complete(df, criteria, [unit])


def minmax(d: DataFrame, cols: Sequence[str], cost: Sequence[str] = (), flat: float = 0.5) -> dict[str, Column]:
    """Column expressions on [0, 1], cost criteria flipped, a constant criterion at `flat`."""
    r = fetch(d, **{f"lo{i}": F.min(c) for i, c in enumerate(cols)}, **{f"hi{i}": F.max(c) for i, c in enumerate(cols)})
    out = {}
    for i, c in enumerate(cols):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        if hi == lo:
            out[c] = F.lit(flat)
        elif c in cost:
            out[c] = (F.lit(hi) - F.col(c)) / F.lit(hi - lo)
        else:
            out[c] = (F.col(c) - F.lit(lo)) / F.lit(hi - lo)
    return out


def entropy_weights(z: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Entropy weights of non-negative columns: zero shares are skipped."""
    s = fetch(z, n=F.count(F.lit(1)), **{f"s{i}": F.sum(c) for i, c in enumerate(cols)},
              **{f"l{i}": F.sum(F.when(F.col(c) > 0, F.col(c) * F.log(c))) for i, c in enumerate(cols)})
    m = s["n"]
    refuse(m < 2, "two alternatives are needed")
    d = []
    for i in range(len(cols)):
        t = s[f"s{i}"]
        e = -(s[f"l{i}"] / t - math.log(t)) / math.log(m) if t > 0 else 1.0
        d.append(1 - e)
    tot = sum(d)
    return {c: (x / tot if tot > 0 else 1 / len(cols)) for c, x in zip(cols, d)}


def _normal(df, unit, criteria, cost):
    d = _criteria(df, unit, criteria)
    z = minmax(d, criteria, cost)
    return d.select(F.col(unit), *[e.alias(c) for c, e in z.items()])


def weighted_sum(cols: Sequence[str], w: Mapping[str, float]) -> Column:
    return sum([F.col(c) * F.lit(float(w[c])) for c in cols], F.lit(0.0))


def topsis(df: DataFrame, unit: str, criteria: Sequence[str], cost: Sequence[str] = ()) -> DataFrame:
    """Entropy-weighted TOPSIS closeness and min-rank."""
    z = _normal(df, unit, criteria, cost)
    w = entropy_weights(z, criteria)
    v = z.select(unit, *[(F.col(c) * F.lit(w[c])).alias(c) for c in criteria])
    r = fetch(v, **{f"lo{i}": F.min(c) for i, c in enumerate(criteria)}, **{f"hi{i}": F.max(c) for i, c in enumerate(criteria)})
    up = F.sqrt(sum([(F.col(c) - F.lit(r[f"hi{i}"])) ** 2 for i, c in enumerate(criteria)], F.lit(0.0)))
    dn = F.sqrt(sum([(F.col(c) - F.lit(r[f"lo{i}"])) ** 2 for i, c in enumerate(criteria)], F.lit(0.0)))
    t = v.select(unit, up.alias("d_plus"), dn.alias("d_minus"))
    t = t.withColumn("closeness", F.col("d_minus") / (F.col("d_plus") + F.col("d_minus") + 1e-12))
    return min_rank(t, "closeness")


def entropy_weight(df: DataFrame, unit: str, criteria: Sequence[str], cost: Sequence[str] = ()) -> DataFrame:
    z = _normal(df, unit, criteria, cost)
    w = entropy_weights(z, criteria)
    t = z.select(unit, weighted_sum(criteria, w).alias("score"), *[F.lit(w[c]).alias(f"w_{c}") for c in criteria])
    return min_rank(t, "score")


def critic(df: DataFrame, unit: str, criteria: Sequence[str], cost: Sequence[str] = ()) -> DataFrame:
    """Weights proportional to SD times the summed one-minus-correlation."""
    z = _normal(df, unit, criteria, cost)
    g = gram(z, list(criteria))
    sd = np.sqrt(np.diag(g.cov()))
    info = sd * (1 - g.corr()).sum(1)
    w = dict(zip(criteria, info / info.sum()))
    t = z.select(unit, weighted_sum(criteria, w).alias("score"), *[F.lit(float(w[c])).alias(f"w_{c}") for c in criteria])
    return min_rank(t, "score")


def grey_relational(df: DataFrame, unit: str, criteria: Sequence[str], cost: Sequence[str] = (), rho: float = 0.5) -> DataFrame:
    """Mean grey relational coefficient to the ideal row; global smallest and largest differences."""
    z = _normal(df, unit, criteria, cost)
    r = fetch(z, lo=F.min(F.least(*[1 - F.col(c) for c in criteria])), hi=F.max(F.greatest(*[1 - F.col(c) for c in criteria])))
    coef = [(F.lit(r["lo"] + rho * r["hi"])) / ((1 - F.col(c)) + F.lit(rho * r["hi"])) for c in criteria]
    return min_rank(z.select(unit, (sum(coef, F.lit(0.0)) / len(criteria)).alias("grade")), "grade")


def membership_function(df: DataFrame, unit: str, criteria: Sequence[str], cost: Sequence[str] = ()) -> DataFrame:
    z = _normal(df, unit, criteria, cost)
    return min_rank(z.select(unit, (sum([F.col(c) for c in criteria], F.lit(0.0)) / len(criteria)).alias("membership")), "membership")


def vikor(df: DataFrame, unit: str, criteria: Sequence[str], cost: Sequence[str] = (), weights: Mapping[str, float] | None = None,
          v: float = 0.5) -> DataFrame:
    """S, R, Q, ranks and the compromise set by the acceptable-advantage and stability conditions."""
    d = _criteria(df, unit, criteria)
    w = weights or {c: 1.0 for c in criteria}
    tot = sum(w[c] for c in criteria)
    z = minmax(d, criteria, cost, flat=1.0)
    gaps = [F.lit(w[c] / tot) * (1 - z[c]) for c in criteria]
    t = d.select(unit, sum(gaps, F.lit(0.0)).alias("s"), F.greatest(*gaps).alias("r"))
    b = fetch(t, s0=F.min("s"), s1=F.max("s"), r0=F.min("r"), r1=F.max("r"), m=F.count(F.lit(1)))
    part = lambda c, lo, hi: (F.col(c) - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.lit(0.0)
    t = t.withColumn("q", F.lit(v) * part("s", b["s0"], b["s1"]) + F.lit(1 - v) * part("r", b["r0"], b["r1"]))
    m = b["m"]
    refuse(m < 2, "two alternatives are needed")
    dq = 1 / (m - 1)
    top = t.orderBy(F.round("q", 10), unit).limit(2).collect()
    q1 = top[0]["q"]
    adv = top[1]["q"] - q1 >= dq
    stable = abs(top[0]["s"] - b["s0"]) < 1e-12 or abs(top[0]["r"] - b["r0"]) < 1e-12
    best = F.col(unit) == F.lit(top[0][unit])
    if adv and stable:
        inside = best
    elif adv:
        inside = best | (F.col(unit) == F.lit(top[1][unit]))
    else:
        inside = (F.col("q") - F.lit(q1)) < F.lit(dq)
    return min_rank(t.withColumn("in_compromise", inside), "q", "rank", descending=False)


def _flow_sums(d: DataFrame, c: str, q: float, p: float) -> DataFrame:
    """Per distinct value x: sums of clip((x - b - q)/(p - q), 0, 1) and clip((b - x - q)/(p - q), 0, 1) over all rows b.

    Both are piecewise linear in b, so four prefix counts and sums of the values give them.
    """
    vals = d.groupBy(F.col(c).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("c")).withColumn("s", F.col("c") * F.col("x"))
    probes = {"a": -p, "b": -q, "e": q, "f": p}
    ev = vals.select(F.col("x").alias("pos"), "c", "s")
    for sh in probes.values():
        ev = ev.unionByName(vals.select((F.col("x") + F.lit(float(sh))).alias("pos"), F.lit(0.0).alias("c"), F.lit(0.0).alias("s")))
    cum = cumulate(ev.groupBy("pos").agg(F.sum("c").alias("c"), F.sum("s").alias("s")), "pos", ["c", "s"])
    t = vals.select("x")
    for k, sh in probes.items():
        look = cum.select(F.col("pos").alias(f"p{k}"), F.col("c_before").alias(f"c{k}"), F.col("s_before").alias(f"s{k}"))
        t = t.withColumn(f"p{k}", F.col("x") + F.lit(float(sh))).join(look, f"p{k}")
    tot = fetch(vals, n=F.sum("c"))["n"]
    x, w = F.col("x"), F.lit(p - q)
    plus = F.col("ca") + ((x - q) * (F.col("cb") - F.col("ca")) - (F.col("sb") - F.col("sa"))) / w
    minus = (F.lit(tot) - F.col("cf")) + ((F.col("sf") - F.col("se")) - (x + q) * (F.col("cf") - F.col("ce"))) / w
    return t.select(F.col("x").alias(c), plus.alias(f"__plus_{c}"), minus.alias(f"__minus_{c}"))


def promethee(df: DataFrame, unit: str, criteria: Sequence[str], cost: Sequence[str] = (), weights: Mapping[str, float] | None = None,
              q: float = 0.0, p: float | None = None) -> DataFrame:
    """PROMETHEE II net flows without forming pairs of alternatives."""
    d = _criteria(df, unit, criteria).select(unit, *[(-F.col(c) if c in cost else F.col(c)).alias(c) for c in criteria])
    r = fetch(d, m=F.count(F.lit(1)), **{f"g{i}": F.max(c) - F.min(c) for i, c in enumerate(criteria)})
    m = r["m"]
    refuse(m < 2, "two alternatives are needed")
    w = weights or {c: 1.0 for c in criteria}
    tot = sum(w[c] for c in criteria)
    out = d
    plus, minus = F.lit(0.0), F.lit(0.0)
    for i, c in enumerate(criteria):
        pc = p if p is not None else r[f"g{i}"]
        if not pc or pc <= q:
            continue
        out = out.join(_flow_sums(d, c, q, pc), c)
        plus = plus + F.lit(w[c] / tot) * F.col(f"__plus_{c}")
        minus = minus + F.lit(w[c] / tot) * F.col(f"__minus_{c}")
    t = out.select(unit, (plus / (m - 1)).alias("phi_plus"), (minus / (m - 1)).alias("phi_minus"))
    return min_rank(t.withColumn("phi", F.col("phi_plus") - F.col("phi_minus")), "phi")


def composite_index(df: DataFrame, unit: str, indicators: Sequence[str], cost: Sequence[str] = (), normalization: str = "minmax",
                    weighting: str = "equal", aggregation: str = "linear") -> DataFrame:
    """Normalise, weight and aggregate; missing cells take the column mean; the rank is a total order."""
    cols = list(indicators)
    need(df, unit, *cols)
    mean = fetch(df, **{f"m{i}": F.avg(num(c)) for i, c in enumerate(cols)})
    d = df.select(unit, *[F.coalesce(num(c), F.lit(mean[f"m{i}"])).alias(c) for i, c in enumerate(cols)])
    if normalization == "minmax":
        z = minmax(d, cols, cost)
    else:
        refuse(normalization != "zscore", "normalization is minmax or zscore")
        s = fetch(d, **{f"m{i}": F.avg(c) for i, c in enumerate(cols)}, **{f"s{i}": F.stddev_pop(c) for i, c in enumerate(cols)})
        z = {c: (F.lit(0.0) if not s[f"s{i}"] else (F.col(c) - F.lit(s[f"m{i}"])) / F.lit(s[f"s{i}"]) * (-1 if c in cost else 1))
             for i, c in enumerate(cols)}
    t = d.select(unit, *[e.alias(c) for c, e in z.items()])
    if weighting == "entropy":
        lo = fetch(t, **{f"m{i}": F.min(c) for i, c in enumerate(cols)})
        pos = t.select(*[(F.col(c) - F.lit(min(lo[f"m{i}"], 0.0))).alias(c) for i, c in enumerate(cols)])
        sm = fetch(pos, n=F.count(F.lit(1)), **{f"s{i}": F.sum(c) for i, c in enumerate(cols)})
        n = sm["n"]
        share = {c: (F.col(c) / F.lit(sm[f"s{i}"]) if sm[f"s{i}"] > 0 else F.lit(1.0 / n)) for i, c in enumerate(cols)}
        e = fetch(pos, **{f"e{i}": -F.sum(share[c] * F.log(share[c] + 1e-12)) / math.log(n) for i, c in enumerate(cols)})
        dv = [max(1 - e[f"e{i}"], 0.0) for i in range(len(cols))]
        w = {c: (x / sum(dv) if sum(dv) > 0 else 1 / len(cols)) for c, x in zip(cols, dv)}
    else:
        w = {c: 1 / len(cols) for c in cols}
    if aggregation == "geometric":
        lo = fetch(t, **{f"m{i}": F.min(c) for i, c in enumerate(cols)})
        score = F.exp(sum([F.lit(w[c]) * F.log(F.col(c) - F.lit(min(lo[f"m{i}"], 0.0)) + 1e-6) for i, c in enumerate(cols)], F.lit(0.0)))
    else:
        score = weighted_sum(cols, w)
    t = t.select(unit, F.round(score, 12).alias("score"))
    return sorted_position(t, "score", [unit], "rank", descending=True)


# --- marketing ------------------------------------------------------------------------------------

def rfm_segmentation(df: DataFrame, customer: str, date: str, amount: str) -> DataFrame:
    """Recency, frequency, money, their quintile scores and the named segment per customer."""
    need(df, customer, date, amount)
    d = df.where(F.col(date).isNotNull())
    ref = d.agg(F.max(date).alias("__ref"))
    t = d.groupBy(customer).agg(F.max(date).alias("last"), F.count(F.lit(1)).alias("frequency"), F.sum(num(amount)).alias("monetary"))
    t = t.crossJoin(F.broadcast(ref)).select(customer, F.datediff("__ref", "last").cast("bigint").alias("recency_days"), "frequency",
                                             F.coalesce("monetary", F.lit(0.0)).alias("monetary"))
    t = cut_lineage(t)
    # All three rankings in one scan. A score follows the value, so each column's scores are told by four values.
    names = ("recency_days", "frequency", "monetary")
    long = t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in names])).alias("s")).select("s.*")
    n = t.count()
    ranked = average_ranks(long, "v", ["column"]).withColumn("score", F.least(F.greatest(F.ceil(F.col("avg_rank") * 5 / F.lit(n)), F.lit(1)), F.lit(5)).cast("bigint"))
    tops = {(r["column"], r["score"]): r["top"] for r in collect_bounded(ranked.groupBy("column", "score").agg(F.max("v").alias("top")), "scores")}

    def score(c):
        steps = sorted((k, v) for (column, k), v in tops.items() if column == c)
        out = F.lit(steps[-1][0] if steps else 1)
        for k, v in reversed(steps[:-1]):
            out = F.when(F.col(c) <= F.lit(float(v)), F.lit(k)).otherwise(out)
        return out.cast("bigint")

    t = t.select(customer, *names, (6 - score("recency_days")).alias("r_score"), score("frequency").alias("f_score"), score("monetary").alias("m_score"))
    r, fm = F.col("r_score"), (F.col("f_score") + F.col("m_score")) / 2
    # Segment names and their first-hit rules.
    seg = (F.when((r >= 4) & (fm >= 4), "Champions").when((r <= 1) & (fm >= 4), "Cant Lose Them")
           .when((r <= 2) & (fm >= 3), "At Risk").when((r >= 3) & (fm >= 3), "Loyal Customers")
           .when((r >= 4) & (fm >= 2), "Potential Loyalist").when((r >= 4) & (fm < 2), "New Customers")
           .when((r == 3) & (fm == 2), "Need Attention").when((r <= 1) & (fm <= 2), "Lost")
           .when((r <= 2) & (fm <= 2), "Hibernating").when((r >= 3) & (fm < 3), "Promising").otherwise("Others"))
    return t.withColumn("segment", seg)


def customer_lifetime_value(df: DataFrame, customer: str, amount: str, retention: float | None = None, discount: float = 0.10,
                            margin: float | None = None) -> DataFrame:
    """Historical value, order value, share of the top tenth of customers, and the projection m r/(1 + d - r)."""
    d = complete(df, [amount], [customer])
    t = d.groupBy(customer).agg(F.sum(amount).alias("v"), F.avg(amount).alias("aov"))
    s = fetch(t, n=F.count(F.lit(1)), total=F.sum("v"), mean=F.avg("v"), aov=F.avg("aov"))
    k = max(1, math.ceil(0.10 * s["n"]))
    top = sorted_position(t.select(customer, "v"), "v", [customer], "i", descending=True).where(F.col("i") <= k)
    share = fetch(top, s=F.sum("v"))["s"] / s["total"] if s["total"] > 0 else float("nan")
    m = s["aov"] if margin is None else margin
    ok = retention is not None and 0 < retention < 1 and 1 + discount - retention > 0
    return one_row(df.sparkSession, n_customers=int(s["n"]), mean_clv=s["mean"], mean_aov=s["aov"], top_decile_share=share,
                   projected_clv=m * retention / (1 + discount - retention) if ok else float("nan"))


def market_basket(df: DataFrame, transaction: str, item: str, min_support: float = 0.01, min_confidence: float = 0.3,
                  max_len: int = 3) -> DataFrame:
    """Association rules from frequent itemsets (MLlib FP-growth), itemsets of up to `max_len` items."""
    from pyspark.ml.fpm import FPGrowth
    b = df.select(transaction, F.col(item).cast("string").alias("i")).dropna().groupBy(transaction).agg(F.collect_set("i").alias("items"))
    n = b.count()
    sets = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0).fit(b).freqItemsets.where(F.size("items") <= max_len)
    sets = sets.select(F.array_sort("items").alias("items"), "freq")
    parts = sets.where(F.size("items") >= 2).select("items", "freq")
    # Every proper non-empty subset of a frequent set is a possible left side.
    masks = F.explode(F.sequence(F.lit(1), (F.lit(2) ** F.size("items") - 2).cast("int")))
    p = parts.withColumn("mask", masks)
    p = p.select("items", "freq", F.expr("filter(items, (x, j) -> shiftright(mask, j) % 2 = 1)").alias("lhs"),
                 F.expr("filter(items, (x, j) -> shiftright(mask, j) % 2 = 0)").alias("rhs"))
    left = sets.select(F.col("items").alias("lhs"), F.col("freq").alias("fl"))
    right = sets.select(F.col("items").alias("rhs"), F.col("freq").alias("fr"))
    r = p.join(left, "lhs").join(right, "rhs")
    conf = F.col("freq") / F.col("fl")
    return r.where(conf >= min_confidence).select(
        F.concat_ws(",", "lhs").alias("antecedent"), F.concat_ws(",", "rhs").alias("consequent"),
        (F.col("freq") / F.lit(n)).alias("support"), conf.alias("confidence"), (conf / (F.col("fr") / F.lit(n))).alias("lift"))


# --- process control ------------------------------------------------------------------------------

# Control-chart constants by subgroup size (A2, D3, D4, d2).
CHART = {2: (1.880, 0.0, 3.267, 1.128), 3: (1.023, 0.0, 2.574, 1.693), 4: (0.729, 0.0, 2.282, 2.059), 5: (0.577, 0.0, 2.114, 2.326),
         6: (0.483, 0.0, 2.004, 2.534), 7: (0.419, 0.076, 1.924, 2.704), 8: (0.373, 0.136, 1.864, 2.847), 9: (0.337, 0.184, 1.816, 2.970),
         10: (0.308, 0.223, 1.777, 3.078)}


def control_chart(df: DataFrame, measurement: str, order: str, subgroup: str | None = None) -> DataFrame:
    """Points with limits and the three run rules: X-bar/R for equal subgroups of 2-10, else individuals.

    Runs look back eight points at most, so long charts are cut into blocks with an eight-point halo.
    """
    if subgroup:
        d = complete(df, [measurement], [subgroup])
        g = d.groupBy(subgroup).agg(F.count(F.lit(1)).alias("n"), F.avg(measurement).alias("x"), (F.max(measurement) - F.min(measurement)).alias("range"))
        s = fetch(g, lo=F.min("n"), hi=F.max("n"), xbar=F.avg("x"), rbar=F.avg("range"))
        refuse(s["lo"] != s["hi"] or not 2 <= s["lo"] <= 10, "subgroups must be of one size from 2 to 10")
        a2, d3, d4, _ = CHART[s["lo"]]
        center, sigma = s["xbar"], a2 * s["rbar"] / 3
        b, part = blocks(g.select(F.col(subgroup).alias("point"), "x", "range"), "point", halo=8)
        lcl, ucl, r_ucl = center - 3 * sigma, center + 3 * sigma, d4 * s["rbar"]
    else:
        d = complete(df, [measurement], [order])
        b, part = blocks(d.select(F.col(order).alias("point"), F.col(measurement).alias("x")), "point", halo=9)
        w0 = Window.partitionBy(*part).orderBy("__i")
        b = b.withColumn("range", F.abs(F.col("x") - F.lag("x").over(w0)))
        s = fetch(b.where("__own"), xbar=F.avg("x"), rbar=F.avg("range"))
        center, sigma = s["xbar"], s["rbar"] / 1.128
        lcl, ucl, r_ucl = center - 3 * sigma, center + 3 * sigma, 3.267 * s["rbar"]
    w = Window.partitionBy(*part).orderBy("__i")
    z = F.round((F.col("x") - F.lit(center)) / F.lit(sigma), 9)
    b = b.withColumn("z", z)
    three, eight = w.rowsBetween(-2, 0), w.rowsBetween(-7, 0)
    up = F.sum(F.when(F.col("z") > 2, 1).otherwise(0)).over(three)
    dn = F.sum(F.when(F.col("z") < -2, 1).otherwise(0)).over(three)
    full = F.col("__i") >= 2
    r2 = full & (((up >= 2) & (F.col("z") > 2)) | ((dn >= 2) & (F.col("z") < -2)))
    r3 = (F.col("__i") >= 7) & ((F.min("z").over(eight) > 0) | (F.max("z").over(eight) < 0))
    t = b.withColumn("rule1", F.abs("z") > 3).withColumn("rule2", r2).withColumn("rule3", r3).where("__own")
    return t.select("point", "x", "range", F.lit(center).alias("center"), F.lit(lcl).alias("lcl"), F.lit(ucl).alias("ucl"),
                    F.lit(r_ucl).alias("range_ucl"), "rule1", "rule2", "rule3")


def process_capability(df: DataFrame, measurement: str, lsl: float | None, usl: float | None, order: str, subgroup: str | None = None) -> DataFrame:
    """Cp/Cpk on the within sigma, Pp/Ppk on the overall SD, expected and observed ppm outside."""
    refuse(lsl is None and usl is None, "a specification limit is needed")
    d = complete(df, [measurement], [c for c in (order, subgroup) if c])
    if subgroup:
        g = d.groupBy(subgroup).agg(F.count(F.lit(1)).alias("n"), (F.max(measurement) - F.min(measurement)).alias("r"))
        s = fetch(g, lo=F.min("n"), hi=F.max("n"), r=F.avg("r"))
        refuse(s["lo"] != s["hi"] or not 2 <= s["lo"] <= 10, "subgroups must be of one size from 2 to 10")
        within = s["r"] / CHART[s["lo"]][3]
    else:
        b, part = blocks(d, order, halo=1)
        mr = b.withColumn("r", F.abs(F.col(measurement) - F.lag(measurement).over(Window.partitionBy(*part).orderBy("__i")))).where("__own")
        within = fetch(mr, r=F.avg("r"))["r"] / 1.128
    out = F.lit(False)
    if lsl is not None:
        out = out | (F.col(measurement) < lsl)
    if usl is not None:
        out = out | (F.col(measurement) > usl)
    s = fetch(d, n=F.count(F.lit(1)), m=F.avg(measurement), sd=F.stddev_samp(measurement), o=F.avg(F.when(out, 1.0).otherwise(0.0)))
    m, sd = s["m"], s["sd"]

    def pair(sig):
        lo = (m - lsl) / (3 * sig) if lsl is not None else math.inf
        hi = (usl - m) / (3 * sig) if usl is not None else math.inf
        return (usl - lsl) / (6 * sig) if lsl is not None and usl is not None else float("nan"), min(lo, hi)

    cp, cpk = pair(within)
    pp, ppk = pair(sd)
    tail = (dist.norm_cdf((lsl - m) / sd) if lsl is not None else 0) + (dist.norm_sf((usl - m) / sd) if usl is not None else 0)
    return one_row(df.sparkSession, n=int(s["n"]), mean=m, sigma_within=within, sigma_overall=sd, cp=cp, cpk=cpk, pp=pp, ppk=ppk,
                   ppm_observed=s["o"] * 1e6, ppm_expected=tail * 1e6)


def gage_rr(df: DataFrame, measurement: str, part: str, operator: str) -> DataFrame:
    """Crossed gauge study by ANOVA: components floored at 0, interaction pooled when p > .25."""
    c = Cells(complete(df, [measurement], [part, operator]), measurement, [part, operator])
    npart, nop = len(c.levels[part]), len(c.levels[operator])
    refuse(len(c.key) != npart * nop or len(set(c.n)) != 1 or c.n[0] < 2, "every part x operator cell needs the same number (>= 2) of measurements")
    r = float(c.n[0])
    m = np.zeros((npart, nop))
    for k, v in zip(c.key, c.m):
        m[c.levels[part].index(k[0]), c.levels[operator].index(k[1])] = v
    g = m.mean()
    ss_p = r * nop * ((m.mean(1) - g) ** 2).sum()
    ss_o = r * npart * ((m.mean(0) - g) ** 2).sum()
    ss_po = r * ((m - m.mean(1)[:, None] - m.mean(0)[None, :] + g) ** 2).sum()
    d_po, d_e = (npart - 1) * (nop - 1), npart * nop * (r - 1)
    ms_p, ms_o, ms_po, ms_e = ss_p / (npart - 1), ss_o / (nop - 1), ss_po / d_po, c.within / d_e
    p_int = dist.f_sf(ms_po / ms_e, d_po, d_e)
    pooled = p_int > 0.25
    if pooled:
        ms_e = (c.within + ss_po) / (d_e + d_po)
        po, base = 0.0, ms_e
    else:
        po, base = (ms_po - ms_e) / r, ms_po
    rep, po = max(ms_e, 0.0), max(po, 0.0)
    op, pt = max((ms_o - base) / (npart * r), 0.0), max((ms_p - base) / (nop * r), 0.0)
    grr = rep + op + po
    total = grr + pt
    rows = [(k, v, 100 * v / total, 100 * math.sqrt(v / total)) for k, v in
            (("repeatability", rep), ("reproducibility", op + po), ("gage_rr", grr), ("part", pt), ("total", total))]
    ndc = int(1.41 * math.sqrt(pt / grr)) if grr > 0 else None
    return rows_frame(df.sparkSession, "source string, variance double, contribution_pct double, study_pct double, ndc bigint, pooled boolean, interaction_p double",
                      [(*x, ndc, pooled, p_int) for x in rows])


# --- resource and project economics ---------------------------------------------------------------

def lower_hull(pdf: pd.DataFrame) -> pd.DataFrame:
    """Lower convex hull of (effect, cost) points in effect order."""
    keep: list[int] = []
    p = pdf.sort_values(["effect", "cost"]).reset_index(drop=True)
    e, c = p["effect"].to_numpy(), p["cost"].to_numpy()
    for i in range(len(p)):
        while len(keep) >= 2:
            a, b = keep[-2], keep[-1]
            if (c[i] - c[b]) * (e[b] - e[a]) < (c[b] - c[a]) * (e[i] - e[b]) - 1e-12:
                keep.pop()
            else:
                break
        keep.append(i)
    return p.iloc[keep]


def cost_effectiveness_analysis(df: DataFrame, option: str, cost: str, effect: str, wtp: float | None = None) -> DataFrame:
    """Options with their status (frontier, extended or strong dominance), ACER, frontier ICER and net benefit.

    Strong dominance is a running maximum of effect along cost. Extended dominance is the lower hull of the
    survivors, found per effect range first, so that only hull points of the ranges meet.
    """
    d = complete(df, [cost, effect], [option])
    best = d.groupBy(F.col(cost).alias("cost")).agg(F.max(effect).alias("effect"))
    surv = cumulate(best, "cost", [], extremes=["effect"]).where(
        F.col("effect_maxbefore").isNull() | (F.col("effect") > F.col("effect_maxbefore"))).select("cost", "effect")
    b = surv.withColumn("b", range_id("effect", range_bounds(surv, "effect")))
    hull = b.groupBy("b").applyInPandas(lambda p: lower_hull(p)[["cost", "effect"]], "cost double, effect double")
    hull = hull.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(lambda p: lower_hull(p)[["cost", "effect"]], "cost double, effect double")
    pts = sorted([(r["effect"], r["cost"]) for r in collect_bounded(hull, "frontier options")])
    icer = [None] + [(c1 - c0) / (e1 - e0) for (e0, c0), (e1, c1) in zip(pts, pts[1:])]
    f = rows_frame(df.sparkSession, "__c double, __e double, icer double, __f boolean", [(c, e, i, True) for (e, c), i in zip(pts, icer)])
    s = surv.select(F.col("cost").alias("__sc"), F.col("effect").alias("__se"), F.lit(True).alias("__s"))
    t = d.join(F.broadcast(f), (F.col(cost) == F.col("__c")) & (F.col(effect) == F.col("__e")), "left")
    t = t.join(s, (F.col(cost) == F.col("__sc")) & (F.col(effect) == F.col("__se")), "left")
    status = F.when(F.col("__f"), "frontier").when(F.col("__s"), "extended_dominated").otherwise("dominated")
    nb = F.lit(wtp) * F.col(effect) - F.col(cost) if wtp is not None else F.lit(None).cast("double")
    return t.select(option, F.col(cost).alias("cost"), F.col(effect).alias("effect"), F.try_divide(F.col(cost), F.col(effect)).alias("acer"),
                    status.alias("status"), "icer", nb.alias("net_benefit"))


def marginal_abatement_cost(df: DataFrame, measure: str, cost: str, abatement: str, price: float | None = None) -> DataFrame:
    """Measures by cost per unit abated, cumulative abatement, no-regret and below-price flags."""
    d = complete(df, [cost, abatement], [measure]).where(F.col(abatement) > 0)
    t = d.withColumn("mac", F.col(cost) / F.col(abatement))
    pos = sorted_position(t, "mac", [measure], "rank")
    c = cumulate(pos.withColumn("__a", F.col(abatement)), "rank", ["__a"])
    return c.select(measure, "rank", "mac", F.col(abatement).alias("abatement"), (F.col("__a_before") + F.col(abatement)).alias("cumulative"),
                    (F.col("mac") < 0).alias("no_regret"), (F.col("mac") <= F.lit(price) if price is not None else F.lit(None).cast("boolean")).alias("below_price"))


def footprint_analysis(df: DataFrame, activity: str, quantity: str, factors: Mapping[str, float], functional_unit: float | None = None) -> DataFrame:
    """Quantity times factor per activity, its share, and the intensity per functional unit."""
    need(df, activity, quantity)
    fm = F.create_map(*[x for k, v in factors.items() for x in (F.lit(k), F.lit(float(v)))])
    t = df.groupBy(activity).agg(F.sum(num(quantity)).alias("quantity")).withColumn("factor", fm[F.col(activity)]).where(F.col("factor").isNotNull())
    t = t.withColumn("footprint", F.col("quantity") * F.col("factor"))
    tot = t.agg(F.sum("footprint").alias("total"))
    return t.crossJoin(F.broadcast(tot)).select(activity, "quantity", "factor", "footprint", (F.col("footprint") / F.col("total")).alias("share"),
                                                (F.col("total") / F.lit(functional_unit) if functional_unit else F.lit(None).cast("double")).alias("intensity"))


def emergy_analysis(df: DataFrame, transformities: Mapping[str, float], categories: Mapping[str, str], output: str | None = None) -> DataFrame:
    """Emergy by category (renewable, non-renewable, purchased) and the EYR, ELR and ESI ratios."""
    need(df, *transformities, output)
    refuse(not transformities, "no input flow has a transformity")
    cat = lambda c: k if (k := categories.get(c, "F").upper()) in ("R", "N", "F") else "F"
    s = {k: sum([F.coalesce(F.sum(num(c)), F.lit(0.0)) * F.lit(float(t)) for c, t in transformities.items() if cat(c) == k], F.lit(0.0)) for k in "RNF"}
    t = df.agg(s["R"].alias("r"), s["N"].alias("n"), s["F"].alias("f"), (F.sum(num(output)) if output else F.lit(None).cast("double")).alias("out"))
    t = t.withColumn("u", F.col("r") + F.col("n") + F.col("f"))
    eyr, elr = F.try_divide(F.col("u"), F.col("f")), F.try_divide(F.col("n") + F.col("f"), F.col("r"))
    return t.select(F.col("u").alias("total_emergy"), F.col("r").alias("renewable"), F.col("n").alias("nonrenewable"), F.col("f").alias("purchased"),
                    eyr.alias("eyr"), elr.alias("elr"), F.try_divide(eyr, elr).alias("esi"), F.try_divide(F.col("r"), F.col("u")).alias("pct_renewable"),
                    F.try_divide(F.col("u"), F.col("out")).alias("output_transformity"))


def material_flow_analysis(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], product: str | None = None, recycled: str | None = None) -> DataFrame:
    """Totals, net addition to stock, balance ratio, efficiency and recycling rate of named flow columns."""
    need(df, *inputs, *outputs)
    tot = lambda cs: sum([F.coalesce(F.sum(num(c)), F.lit(0.0)) for c in cs], F.lit(0.0))
    t = df.agg(tot(inputs).alias("i"), tot(outputs).alias("o"), tot([product] if product in outputs else outputs).alias("p"),
               (tot([recycled]) if recycled in inputs else F.lit(None).cast("double")).alias("r"))
    i, o = F.col("i"), F.col("o")
    return t.select(i.alias("total_input"), o.alias("total_output"), (i - o).alias("net_stock_addition"), F.try_divide(o, i).alias("balance_ratio"),
                    F.try_divide(F.col("p"), i).alias("resource_efficiency"), F.try_divide(F.col("r"), i).alias("recycling_rate"))


def material_flow_shares(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    st = [F.struct(F.lit(c).alias("flow"), F.lit(k).alias("type"), F.coalesce(F.sum(num(c)), F.lit(0.0)).alias("value"))
          for k, cs in (("input", inputs), ("output", outputs)) for c in cs]
    t = df.agg(F.array(*st).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return t.withColumn("share_pct", F.try_divide(F.col("value") * 100, F.sum("value").over(Window.partitionBy("type"))))


def input_output_analysis(df: DataFrame, source: str, target: str, flow: str, final_demand: DataFrame, tol: float = 1e-12, most: int = 5000) -> DataFrame:
    """Leontief output for a final demand, output multipliers and linkages of a sparse flow table.

    `final_demand` has (sector, demand). The inverse is the power series f + A f + A^2 f + ..., one sparse product per step
    for outputs and forward linkages together and one for multipliers, until what is still to come is below `tol` of the
    sum (told from the last ratio of terms). A table whose series does not settle has no such solution and is refused.
    """
    z = df.groupBy(F.col(source).alias("i"), F.col(target).alias("j")).agg(F.sum(num(flow)).alias("z"))
    f = final_demand.toDF("k", "f")
    x = z.groupBy("i").agg(F.sum("z").alias("z")).join(f, F.col("i") == F.col("k"), "full").select(
        F.coalesce("i", "k").alias("k"), (F.coalesce("z", F.lit(0.0)) + F.coalesce("f", F.lit(0.0))).alias("x"), F.coalesce("f", F.lit(0.0)).alias("f"))
    a = cut_lineage(z.join(x.select(F.col("k").alias("j"), "x"), "j").select("i", "j", (F.col("z") / F.col("x")).alias("a")))
    base = cut_lineage(x.select("k", "f", F.lit(1.0).alias("one")))

    def series(cols: Sequence[str], on: str, to: str) -> DataFrame:
        tot = term = base.select("k", *cols)
        size = None
        for step in range(1, most + 1):
            term = a.join(term, F.col(on) == F.col("k")).groupBy(F.col(to).alias("k")).agg(*[F.sum(F.col("a") * F.col(c)).alias(c) for c in cols])
            tot = tot.unionByName(term)
            if step % 8 == 0:
                term = cut_lineage(term)
                tot = cut_lineage(tot.groupBy("k").agg(*[F.sum(c).alias(c) for c in cols]))
                now = fetch(term, **{c: F.max(F.abs(c)) for c in cols})
                whole = fetch(tot, **{c: F.max(F.abs(c)) for c in cols})
                new = [now[c] or 0.0 for c in cols]
                ratio = max([(v / w) ** 0.125 for v, w in zip(new, size) if w] or [0.0]) if size else 0.0
                refuse(ratio > 1 + 1e-9 or any(not math.isfinite(v) for v in new), "the flows have no Leontief inverse: the series grows")
                rest = [v * ratio / (1 - ratio) if 0 < ratio < 1 else v for v in new]
                if all(r <= tol * max(whole[c] or 0.0, 1e-300) for r, c in zip(rest, cols)):
                    return tot
                size = new
        refuse(True, f"the series of the flows does not settle in {most} steps")

    forward = series(["f", "one"], "j", "i").select("k", F.col("f").alias("output"), F.col("one").alias("__fw"))
    multiplier = series(["one"], "i", "j").select("k", F.col("one").alias("multiplier"))
    avg = multiplier.agg(F.avg("multiplier").alias("m")).crossJoin(forward.agg(F.avg("__fw").alias("w")))        # one row
    return (base.join(forward, "k").join(multiplier, "k").crossJoin(F.broadcast(avg))
            .select(F.col("k").cast("string").alias("sector"), F.col("f").alias("demand"), "output", "multiplier", (F.col("multiplier") / F.col("m")).alias("backward"),
                    (F.col("__fw") / F.col("w")).alias("forward")))


def cash_table(df: DataFrame, project: str, period: str, **flows: Column) -> DataFrame:
    """Flows summed to one row per project and period."""
    return df.groupBy(project, F.col(period).cast("int").alias("t")).agg(*[F.sum(F.coalesce(c.cast("double"), F.lit(0.0))).alias(k) for k, c in flows.items()])


def _pv(c: str, rate: float) -> Column:
    return F.sum(F.col(c) / F.pow(F.lit(1 + rate), F.col("t")))


def irr_of(cf: np.ndarray) -> tuple[float, int]:
    """Internal rate of return: first sign change on a 600-point grid over [-.9999, 10], refined by bisection."""
    grid = np.linspace(-0.9999, 10, 600)
    t = np.arange(len(cf))
    with np.errstate(all="ignore"):
        v = (cf[None, :] / (1 + grid[:, None]) ** t).sum(1)
    cross = np.where(np.sign(v[:-1]) * np.sign(v[1:]) < 0)[0]
    if len(cross) == 0:
        return float("nan"), 0
    lo, hi = grid[cross[0]], grid[cross[0] + 1]
    f = lambda r: float((cf / (1 + r) ** t).sum())
    flo = f(lo)
    for _ in range(200):
        mid = (lo + hi) / 2
        fm = f(mid)
        if (fm > 0) == (flo > 0):
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2, len(cross)


def npv_irr(df: DataFrame, project: str, period: str, benefit: str, cost: str, rate: float = 0.10) -> DataFrame:
    """NPV, interpolated simple and discounted payback, and IRR (multiple roots flagged) per project."""
    t = cash_table(df, project, period, cf=F.col(benefit) - F.col(cost)).withColumn("dcf", F.col("cf") / F.pow(F.lit(1 + rate), F.col("t")))
    w = Window.partitionBy(project).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("cum", F.sum("cf").over(w)).withColumn("dcum", F.sum("dcf").over(w))

    def payback(c, cum):
        prev = F.col(cum) - F.col(c)
        return F.min(F.when((F.col(cum) >= 0) & (prev < 0), F.col("t") - 1 + F.try_divide(-prev, F.col(c))).when((F.col("t") == 0) & (F.col(cum) >= 0), F.lit(0.0)))

    g = t.groupBy(project).agg(F.sum("dcf").alias("npv"), payback("cf", "cum").alias("payback"), payback("dcf", "dcum").alias("discounted_payback"),
                               F.array_sort(F.collect_list(F.struct("t", "cf"))).alias("flow"))

    @F.pandas_udf("irr double, roots bigint")
    def irr(flow: pd.Series) -> pd.DataFrame:
        out = []
        for s in flow:
            cf = np.zeros(max(int(x["t"]) for x in s) + 1)
            for x in s:
                cf[int(x["t"])] += x["cf"]
            out.append(irr_of(cf))
        return pd.DataFrame(out, columns=["irr", "roots"])

    return g.withColumn("i", irr("flow")).select(project, "npv", "payback", "discounted_payback", "i.irr", (F.col("i.roots") > 1).alias("multiple_roots"))


def cost_benefit(df: DataFrame, project: str, period: str, benefit: str, cost: str, rate: float = 0.10) -> DataFrame:
    """Present values of benefits and costs, their ratio and difference; no present cost gives no ratio."""
    g = cash_table(df, project, period, b=F.col(benefit), c=F.col(cost)).groupBy(project).agg(_pv("b", rate).alias("pv_benefit"), _pv("c", rate).alias("pv_cost"))
    return g.select(project, "pv_benefit", "pv_cost", F.when(F.col("pv_cost") > 0, F.col("pv_benefit") / F.col("pv_cost")).alias("bcr"),
                    (F.col("pv_benefit") - F.col("pv_cost")).alias("npb"))


def lcoe(df: DataFrame, project: str, period: str, cost: str, output: str, rate: float = 0.10) -> DataFrame:
    g = cash_table(df, project, period, c=F.col(cost), o=F.col(output)).groupBy(project).agg(_pv("c", rate).alias("pv_cost"), _pv("o", rate).alias("pv_output"))
    return g.withColumn("lcoe", F.when(F.col("pv_output") > 0, F.col("pv_cost") / F.col("pv_output")))


def life_cycle_cost(df: DataFrame, project: str, period: str, cost: str, rate: float = 0.08, salvage: float = 0.0) -> DataFrame:
    """Period 0 is capital, later periods are operation; LCC, equivalent annual cost and phase shares."""
    t = cash_table(df, project, period, c=F.col(cost))
    g = t.groupBy(project).agg(F.sum(F.when(F.col("t") == 0, F.col("c")).otherwise(0.0)).alias("capex"),
                               F.sum(F.when(F.col("t") > 0, F.col("c") / F.pow(F.lit(1 + rate), F.col("t"))).otherwise(0.0)).alias("opex_pv"),
                               F.greatest(F.max("t"), F.lit(1)).alias("n"))
    n = F.col("n")
    sal = F.lit(salvage) / F.pow(F.lit(1 + rate), n)
    crf = F.lit(rate) * F.pow(F.lit(1 + rate), n) / (F.pow(F.lit(1 + rate), n) - 1) if rate else 1 / n
    lcc = F.col("capex") + F.col("opex_pv") - sal
    den = F.abs("capex") + F.abs("opex_pv") + F.abs(sal)
    return g.select(project, n.cast("bigint").alias("periods"), "capex", "opex_pv", lcc.alias("lcc"), (lcc * crf).alias("eac"),
                    F.try_divide(F.abs("capex") * 100, den).alias("capex_share"), F.try_divide(F.abs("opex_pv") * 100, den).alias("opex_share"))


def breakeven_analysis(df: DataFrame, product: str, fixed_cost: str, var_cost: str, price: str, units: str) -> DataFrame:
    """Contribution margin, break-even quantity and margin of safety per product row; CM <= 0 gives none."""
    need(df, product, fixed_cost, var_cost, price, units)
    cm = num(price) - num(var_cost)
    qv = F.when(cm > 0, num(fixed_cost) / cm)
    return df.select(product, cm.alias("contribution_margin"), F.try_divide(cm, num(price)).alias("cm_ratio"), qv.alias("breakeven_units"),
                     (qv * num(price)).alias("breakeven_revenue"), F.try_divide(num(units) - qv, num(units)).alias("margin_of_safety"))


def sensitivity_tornado(df: DataFrame, project: str, period: str, benefit: str, cost: str, rate: float = 0.10, pct: float = 20.0) -> DataFrame:
    """NPV swing of the rate and of every period's cash flow, one at a time, ranked per project."""
    t = cash_table(df, project, period, cf=F.col(benefit) - F.col(cost))
    s = pct / 100
    base = t.groupBy(project).agg(_pv("cf", rate).alias("npv"), _pv("cf", rate * (1 - s)).alias("lo"), _pv("cf", rate * (1 + s)).alias("hi"))
    r = base.select(project, F.lit("discount_rate").alias("parameter"), F.col("lo").alias("low_npv"), F.col("hi").alias("high_npv"))
    d = F.col("cf") / F.pow(F.lit(1 + rate), F.col("t"))
    f = t.where("cf <> 0").join(base.select(project, "npv"), project).select(
        project, F.concat(F.lit("cashflow_t"), F.col("t").cast("string")).alias("parameter"), (F.col("npv") - s * d).alias("low_npv"), (F.col("npv") + s * d).alias("high_npv"))
    u = r.unionByName(f).withColumn("swing", F.abs(F.col("high_npv") - F.col("low_npv")))
    return u.withColumn("rank", F.row_number().over(Window.partitionBy(project).orderBy(F.round("swing", 9).desc(), "parameter")).cast("bigint"))


# --- meta-analysis --------------------------------------------------------------------------------

def smd(df: DataFrame, study: str, m1: str, sd1: str, n1: str, m2: str, sd2: str, n2: str) -> DataFrame:
    """Standardised mean difference with small-sample correction, and its variance, per study."""
    d = complete(df, [m1, sd1, n1, m2, sd2, n2], [study])
    a, b = F.col(n1), F.col(n2)
    sp = F.sqrt(((a - 1) * F.col(sd1) ** 2 + (b - 1) * F.col(sd2) ** 2) / (a + b - 2))
    g = (F.col(m1) - F.col(m2)) / sp * (1 - 3 / (4 * (a + b - 2) - 1))
    return d.select(study, g.alias("yi"), (1 / a + 1 / b + g * g / (2 * (a + b))).alias("vi"))


def log_odds(df: DataFrame, study: str, a: str, b: str, c: str, d: str) -> DataFrame:
    """Log odds ratio and variance from 2x2 counts (one half added when a cell is empty)."""
    t = complete(df, [a, b, c, d], [study])
    k = F.when(F.least(a, b, c, d) == 0, F.lit(0.5)).otherwise(F.lit(0.0))
    w, x, y, z = (F.col(v) + k for v in (a, b, c, d))
    return t.select(study, F.log(w * z / (x * y)).alias("yi"), (1 / w + 1 / x + 1 / y + 1 / z).alias("vi"))


def meta_analysis(df: DataFrame, effect: str = "yi", variance: str = "vi", most: int = 100) -> DataFrame:
    """Fixed and random effects with Q, I-squared, DerSimonian-Laird and REML tau-squared, and Egger's test."""
    d = complete(df, [effect, variance]).where(F.col(variance) > 0)
    y, v = F.col(effect), F.col(variance)
    s = fetch(d, k=F.count(F.lit(1)), w=F.sum(1 / v), wy=F.sum(y / v), wyy=F.sum(y * y / v), w2=F.sum(1 / (v * v)))
    k = s["k"]
    refuse(k < 2, "two studies are needed")
    fixed = s["wy"] / s["w"]
    qv = s["wyy"] - s["wy"] ** 2 / s["w"]
    dl = max(0.0, (qv - (k - 1)) / (s["w"] - s["w2"] / s["w"]))
    tau = dl
    for _ in range(most):
        w = 1 / (v + F.lit(tau))
        t = fetch(d, w=F.sum(w), wy=F.sum(w * y), w2=F.sum(w * w), w2y=F.sum(w * w * y), w2yy=F.sum(w * w * y * y), w2v=F.sum(w * w * v))
        mu = t["wy"] / t["w"]
        new = max(0.0, (t["w2yy"] - 2 * mu * t["w2y"] + mu * mu * t["w2"] - t["w2v"]) / t["w2"] + 1 / t["w"])
        done = abs(new - tau) < 1e-10
        tau = new
        if done:
            break

    def pooled(t2):
        r = fetch(d, w=F.sum(1 / (v + F.lit(t2))), wy=F.sum(y / (v + F.lit(t2))))
        return r["wy"] / r["w"], math.sqrt(1 / r["w"])

    (rd, sd), (rr, sr) = pooled(dl), pooled(tau)
    e = d.select((y / F.sqrt(v)).alias("z"), (1 / F.sqrt(v)).alias("p"))
    g = gram(e, ["z", "p"])
    sl = g.cross[0, 1] / g.cross[1, 1]
    b0 = g.mean[0] - sl * g.mean[1]
    rss = g.cross[0, 0] - sl * g.cross[0, 1]
    se0 = math.sqrt(rss / (k - 2) * (1 / k + g.mean[1] ** 2 / g.cross[1, 1])) if k > 2 else float("nan")
    return one_row(df.sparkSession, k=int(k), fixed=fixed, fixed_se=math.sqrt(1 / s["w"]), q=qv, i2=max(0.0, (qv - (k - 1)) / qv * 100) if qv > 0 else 0.0,
                   tau2_dl=dl, random_dl=rd, random_dl_se=sd, egger_intercept=float(b0), tau2_reml=tau, random_reml=rr, random_reml_se=sr,
                   p_fixed=dist.p_two_sided(fixed * math.sqrt(s["w"])), p_random=dist.p_two_sided(rr / sr), q_p=dist.chi2_sf(qv, k - 1),
                   egger_p=dist.t_two_sided(float(b0) / se0, k - 2) if k > 2 and se0 > 0 else float("nan"))


def meta_regression(df: DataFrame, moderators: Sequence[str], effect: str = "yi", variance: str = "vi", most: int = 100) -> DataFrame:
    """Mixed-effects meta-regression: method-of-moments residual tau-squared, QM and R-squared."""
    ms = list(moderators)
    d = complete(df, [effect, variance, *ms]).where(F.col(variance) > 0)
    k, p = d.count(), len(ms) + 1
    refuse(k <= p, "more studies than moderators are needed")

    def fit(t2):
        g = weighted_gram(d, [effect, *ms], 1 / (F.col(variance) + F.lit(t2)))[()]
        sxx, sxy = g.sub(ms, ms), g.sub(ms, [effect])[:, 0]
        inv = np.linalg.pinv(sxx, hermitian=True)
        b = inv @ sxy
        mx = g.mean[1:]
        v = np.zeros((p, p))
        v[1:, 1:] = inv
        v[0, 1:] = v[1:, 0] = -inv @ mx
        v[0, 0] = 1 / g.n + mx @ inv @ mx
        return np.concatenate([[g.mean[0] - mx @ b], b]), v, float(g.cross[0, 0] - sxy @ b), float(b @ sxy)

    b, v, qe, _ = fit(0.0)
    g2 = weighted_gram(d, ms, 1 / F.col(variance) ** 2)[()]
    m2 = np.zeros((p, p))
    m2[1:, 1:] = g2.raw()
    m2[0, 0], m2[0, 1:], m2[1:, 0] = g2.n, g2.n * g2.mean, g2.n * g2.mean
    w = fetch(d, w=F.sum(1 / F.col(variance)))["w"]
    tau = max(0.0, (qe - (k - p)) / (w - np.trace(v @ m2)))
    b, v, _, qm = fit(tau)
    tau0 = fetch(meta_analysis(d, effect, variance, 0), t=F.first("tau2_dl"))["t"]
    r2 = max(0.0, 1 - tau / tau0) * 100 if tau0 > 0 else None
    rows = []
    for t, bb, s in zip(["intercept", *ms], b, np.sqrt(np.diag(v))):
        rows.append((t, float(bb), float(s), float(bb / s), dist.p_two_sided(bb / s), k, tau, r2, qm, dist.chi2_sf(qm, p - 1)))
    return rows_frame(df.sparkSession, "term string, coef double, se double, z double, p double, k bigint, tau2 double, r2_pct double, qm double, qm_p double", rows)
