"""Planted parameters come back; missing or degenerate input is refused."""

import pytest
from pyspark.sql import functions as F

from statloom import profile, recommend
from statloom.operators import causal, describe, groups, linear, networks, ranking, spatial, tables, timeseries
from statloom.sources import tables as src


def test_idf_and_rdd(tab):
    r = timeseries.idf_curve(tab("fx_idf"), "duration", "intensity").collect()[0]
    assert r["a"] == pytest.approx(30, rel=0.02) and r["b"] == pytest.approx(10, rel=0.02) and r["c"] == pytest.approx(0.8, rel=0.02)
    assert causal.rdd(tab("fx_running"), "running", "y", 4.5, 2.0).collect()[0]["jump"] == pytest.approx(3, abs=0.6)


def test_mendelian_slope(tab):
    assert causal.mendelian_randomization(tab("fx_snp"), "bx", "beta_y", "sey").collect()[0]["ivw"] == pytest.approx(0.5, abs=0.05)


def test_ordered_and_tobit_recover(spark):
    d = spark.range(4000).select(((F.col("id") * 7919 % 1000) / 1000).alias("x"), ((F.col("id") * 104729 % 997 + 0.5) / 997).alias("u"))
    lat = 2 * F.col("x") + F.log(F.col("u") / (1 - F.col("u")))
    o = d.select("x", F.when(lat < 0.5, 0).when(lat < 1.8, 1).otherwise(2).alias("y"))
    b = {r["term"]: r["coef"] for r in linear.ordered_logit(o, "y", ["x"]).collect()}
    assert b["x"] == pytest.approx(2, abs=0.35) and b["cut_0|1"] == pytest.approx(0.5, abs=0.25)
    n = d.select("x", F.greatest(F.lit(0.0), 3 * F.col("x") - 1 + 0.6 * F.log(F.col("u") / (1 - F.col("u")))).alias("y"))
    t = {r["term"]: r["coef"] for r in linear.tobit_regression(n, "y", ["x"]).collect()}
    assert t["mu:x"] == pytest.approx(3, abs=0.4)


def test_quantile_fit_median(tab):
    r = groups.quantile_regression(tab("lineitem"), "l_extendedprice", ["l_quantity"], [0.25]).collect()
    assert r[0]["share_below"] == pytest.approx(0.25, abs=0.01)


def test_matching_balances(tab):
    r = causal.psm(tab("fx_treat"), "t", "y", ["x1", "x2"], "id").collect()
    assert all(abs(x["smd_after"]) <= abs(x["smd_before"]) + 0.05 for x in r) and r[0]["pairs"] > 0


def test_components_and_knn_brute_force(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (20, 21)], "a bigint, b bigint").withColumn("w", F.lit(1.0))
    c = {r["u"]: r["component"] for r in networks.components(e).collect()}
    assert c == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20}
    pts = [(i, float(i * 37 % 17), float(i * 11 % 23)) for i in range(60)] + [(100 + i, 500.0, 500.0) for i in range(8)]
    from statloom.plans.knn import knn
    got = {(r["i"], r["rank"]): r["j"] for r in knn(spark.createDataFrame(pts, "id bigint, x double, y double"), 4).collect()}
    for i, x, y in pts:
        want = [j for _, j in sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in pts if j != i)[:4]]
        assert [got[(i, k)] for k in range(1, 5)] == want


def test_hull_frontier(spark):
    d = spark.createDataFrame([("a", 10.0, 1.0), ("b", 20.0, 3.0), ("c", 35.0, 3.5), ("d", 40.0, 5.0), ("e", 50.0, 4.0)], "o string, c double, e double")
    s = {r["o"]: r["status"] for r in ranking.cost_effectiveness_analysis(d, "o", "c", "e").collect()}
    assert s == {"a": "frontier", "b": "frontier", "c": "extended_dominated", "d": "frontier", "e": "dominated"}


def test_irr():
    import numpy as np
    r, k = ranking.irr_of(np.array([-100.0, 60.0, 60.0]))
    assert r == pytest.approx(0.1306623863, abs=1e-8) and k == 1


def test_profile_clean_recommend(spark, tmp_path):
    lines = ["id;city;price;pct;note"] + [f"{i};{'A' if i % 3 else 'B'};{i},5;{i % 50}%;x" for i in range(1, 101)]
    p = tmp_path / "t.csv"
    p.write_bytes(("\n".join(lines) + "\n").encode("gb18030"))
    d = src.read_delimited(spark, str(p))
    assert d.columns == ["id", "city", "price", "pct", "note"]
    t, log = src.coerce_numeric(d)
    assert {r["column"] for r in log.collect()} >= {"id", "pct"} and dict(t.dtypes)["pct"] == "double"
    kinds = {r["column"]: r["kind"] for r in profile.profile(t).collect()}
    assert kinds["city"] == "binary"
    c, steps = profile.clean(t)
    assert "note" not in c.columns
    assert recommend.select_top(t).count() >= 5


def test_panel_detected(tab):
    r = profile.detect_structure(tab("fx_panel")).collect()[0]
    assert (r["structure"], r["unit_col"], r["time_col"]) == ("panel", "unit", "period")


@pytest.mark.parametrize("call", [
    lambda t: describe.correlation(t("orders"), ["o_totalprice"]), lambda t: tables.fisher_exact(t("orders"), "o_orderpriority", "o_orderstatus"),
    lambda t: groups.cohens_d(t("orders"), "o_totalprice", "o_orderstatus"), lambda t: linear.iv_regression(t("fx_treat"), "y", ["t"], []),
    lambda t: ranking.rfm_segmentation(t("orders"), "no_such_column", "o_orderdate", "o_totalprice"), lambda t: spatial.moran_i(t("fx_geo").limit(5), "id", "x", "y", "val")])
def test_refusals(tab, call):
    with pytest.raises(ValueError):
        call(tab).collect()
