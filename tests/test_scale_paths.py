"""The distributed form of every ordered kernel gives what the plain window gives."""

import math

from pyspark.sql import Window, functions as F

from helpers import rows
from statloom.operators import groups, ranking
from statloom.plans import order, series


def test_cumulate_and_extremes(tab):
    d = tab("lineitem").groupBy("l_returnflag", "l_extendedprice").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("m"))
    for desc in (False, True):
        w = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice") if desc else F.asc("l_extendedprice")).rowsBetween(Window.unboundedPreceding, -1)
        a = d.select("*", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n_before"), F.max("m").over(w).alias("m_maxbefore"))
        b = order.cumulate(d, "l_extendedprice", ["n"], ["l_returnflag"], extremes=["m"], descending=desc)
        assert rows(a) == rows(b.select(*a.columns))


def test_running_over_many_tasks_and_batches(spark):
    """Keys that span tasks and batches, keys of one row, null keys and values; a second pass over what the first gave."""
    data = [(None if k == 7 else "hot" if k < 3 else f"k{k}", i, None if i % 11 == 0 else i % 5, None if i % 13 == 0 else (i * 37 % 101) / 4) for i in range(900) for k in (i % 9,)] + [("once", 1, 2, 3.0)]
    d = spark.createDataFrame(data, "k string, t int, n int, x double")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.shuffle.partitions": "9"}
    old = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        for keys in ([], ["k"]):
            for desc in (False, True):
                w = Window.partitionBy(*keys).orderBy(F.desc("t") if desc else F.asc("t"), "k").rowsBetween(Window.unboundedPreceding, -1)
                got = order.cumulate(d if keys else d.where("k = 'hot'"), "t", ["n", "x"], keys, ["x", "n"], desc)
                want = (d if keys else d.where("k = 'hot'")).select("*", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n_before"), F.coalesce(F.sum("x").over(w), F.lit(0.0)).alias("x_before"),
                                                                   F.max("x").over(w).alias("x_maxbefore"), F.max("n").over(w).alias("n_maxbefore"))
                assert rows(got.select(*want.columns)) == rows(want)
        one = order.running(order.in_order(d, "t", ["k"]), ["n"], ["k"])
        two = order.running(one.withColumn("m", F.col("n_before") * 2), ["m"], ["k"]).drop("__id")
        w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
        a = d.withColumn("n_before", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("m", F.col("n_before") * 2).withColumn("m_before", F.coalesce(F.sum("m").over(w), F.lit(0)))
        assert rows(two.select(*a.columns)) == rows(a)
        assert order.cumulate(d.limit(0), "t", ["n"], ["k"]).collect() == []
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_ranks_positions_quantiles(tab):
    d = tab("orders").select(F.floor(F.col("o_totalprice") / 10000).cast("double").alias("l_quantity"), F.col("o_orderstatus").alias("l_returnflag"), F.col("o_orderkey").alias("id"))
    same = Window.partitionBy("l_quantity")
    a = d.withColumn("r", F.rank().over(Window.orderBy("l_quantity")) + (F.count(F.lit(1)).over(same) - 1) / 2)
    assert rows(a) == rows(order.with_average_rank(d, "l_quantity", "r").select(*a.columns))
    for desc in (False, True):
        a = d.withColumn("p", F.row_number().over(Window.orderBy(F.desc("l_quantity") if desc else F.asc("l_quantity"), "id")))
        assert rows(a) == rows(order.sorted_position(d, "l_quantity", ["id"], "p", descending=desc).select(*a.columns))
    p = [0.0, 0.1, 0.33, 0.5, 0.999, 1.0]
    for keys in ((), ("l_returnflag",)):
        got = order.group_quantiles(d, "l_quantity", p, keys)
        want = d.groupBy(*keys).agg(F.expr(f"percentile(l_quantity, array({','.join(map(str, p))}))").alias("q")).collect()
        want = {tuple(r[k] for k in keys): r["q"] for r in want}
        assert got.keys() == want.keys() and all(math.isclose(u, v) for k in got for u, v in zip(got[k], want[k]))


def test_nulls_and_text_ids(spark):
    """Null keys, null values and text ids: no row is lost, nulls have no rank and come first in the order."""
    data = [(None if i % 10 == 0 else float(i % 7), None if i % 4 == 0 else "ab"[i % 2], f"c{i}") for i in range(100)]
    d = spark.createDataFrame(data, "v double, k string, id string")
    r = order.with_average_rank(d, "v", "r", ["k"])
    w, same = Window.partitionBy("k").orderBy("v"), Window.partitionBy("k", "v")
    want = d.where("v is not null").withColumn("r", F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2)
    assert r.count() == 100 and r.where("v is null and r is null").count() == 10
    assert rows(r.where("v is not null").select("id", "r")) == rows(want.select("id", "r"))
    for desc in (False, True):
        got = order.sorted_position(d, "v", ["id"], "p", descending=desc)
        want = d.withColumn("p", F.row_number().over(Window.orderBy(F.desc("v") if desc else F.asc("v"), "id")))
        assert rows(got.select("id", "p")) == rows(want.select("id", "p"))
    q = order.group_quantiles(d, "v", [0.5], ["k"])
    assert set(q) == {("a",), ("b",), (None,)}
    assert ranking.min_rank(d, "v").count() == 100
    mac = ranking.marginal_abatement_cost(d.where("v > 0").withColumn("a", F.lit(2.0)), "id", "v", "a")
    assert mac.count() == d.where("v > 0").count()


def test_hot_value_positions(spark):
    """A third of all rows share one value; positions stay a permutation of 1..n."""
    d = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"), F.col("id"))
    got = sorted(r["p"] for r in order.sorted_position(d, "v", ["id"], "p").collect())
    assert got == list(range(1, 3001))


def test_concordance_brute_force(spark):
    pts = [(float((i * 7) % 13), float((i * 5) % 11)) for i in range(60)]
    d = spark.createDataFrame(pts, "x double, y double").groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    c = sum(1 for i in range(60) for j in range(i) if (pts[i][0] - pts[j][0]) * (pts[i][1] - pts[j][1]) > 0)
    k = sum(1 for i in range(60) for j in range(i) if (pts[i][0] - pts[j][0]) * (pts[i][1] - pts[j][1]) < 0)
    r = order.concordance(d, "x", "y", "w").collect()[0]
    assert (r["concordant"], r["discordant"]) == (c, k)


def test_theil_sen_brute_force(spark):
    pts = [(float(i), float((i * i * 7) % 23) + 0.5 * i) for i in range(40)]
    d = spark.createDataFrame(pts, "x double, y double")
    sl = sorted((b[1] - a[1]) / (b[0] - a[0]) for i, a in enumerate(pts) for b in pts[i + 1:])
    m = len(sl)
    want = (sl[(m - 1) // 2] + sl[m // 2]) / 2
    assert abs(groups.theil_sen(d, "x", "y")[0] - want) < 1e-8


def test_blocks_with_halo(spark):
    d = spark.range(500).select(F.col("id").alias("t"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    b, part = series.blocks(d, "t", halo=3, size=50)
    w = Window.partitionBy(*part).orderBy("__i")
    got = b.withColumn("l", F.lag("v", 3).over(w)).where("__own").select("t", "l")
    want = d.select("t", F.lag("v", 3).over(Window.orderBy("t")).alias("l"))
    assert rows(got) == rows(want)


def test_repartition_invariance(tab):
    d = tab("orders")
    a = groups.bootstrap_ci(d.repartition(1), "o_totalprice", "o_orderkey", n_boot=100).collect()[0]
    b = groups.bootstrap_ci(d.repartition(17), "o_totalprice", "o_orderkey", n_boot=100).collect()[0]
    assert all(x == y or math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a, b))
    a = groups.permutation_test(d.repartition(1), "o_totalprice", "o_orderpriority", "o_orderkey", 50).collect()[0]
    b = groups.permutation_test(d.repartition(17), "o_totalprice", "o_orderpriority", "o_orderkey", 50).collect()[0]
    assert a["hits"] == b["hits"]
