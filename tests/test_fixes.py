"""Defects that were found once and must not come back."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom import profile as P
from statloom.operators import causal, learning, linear, ranking
from statloom.plans import frames
from statloom.plans.gram import weighted_gram
from statloom.sources import tables as S


def test_decimal_comma_is_left_alone(spark):
    d = spark.createDataFrame([("1,5",), ("1,234",), ("1,234,567.5",), ("12,34",), ("tbd",), ("–",), ("$1,000",), ("5%",)], "t string")
    got = [r[0] for r in d.select(S.as_number(F.col("t"))).collect()]
    assert got == [None, 1234.0, 1234567.5, None, None, None, 1000.0, 5.0]
    out, log = S.coerce_numeric(spark.createDataFrame([("1,5",), ("2,5",)], "price string"))
    assert log.collect() == [] and [r[0] for r in out.collect()] == ["1,5", "2,5"]


def test_repeated_and_missing_cells_are_not_balanced(spark):
    rng = np.random.default_rng(0)
    cells = [(u, t) for u in range(4) for t in ([0, 1, 2, 3] if u < 2 else [0, 0, 1, 2] if u == 2 else [1, 2, 3, 3])]
    rows = [(u, t, float(rng.normal() + u + 10 * t)) for u, t in cells]
    d = spark.createDataFrame(rows, "u long, t long, y double")
    assert not linear.is_balanced(d, "u", "t")
    w = linear.demean(d, ["y"], "u", "t")
    for k in ("u", "t"):
        assert max(abs(r[1]) for r in w.groupBy(k).agg(F.avg("y")).collect()) < 1e-8
    with pytest.raises(ValueError):
        causal.goodman_bacon(d.withColumn("g", F.lit(2)), "u", "t", "y", "g")


def test_cleaning_reads_the_table_as_cleaned(spark):
    d = spark.createDataFrame([(1, 1.0)] * 6 + [(2, 5.0), (3, 9.0), (4, None)], "k int, v double")
    out, _ = P.apply_plan(d, [("drop_duplicates", None), ("impute_median", "v")])
    assert {r["k"]: r["v"] for r in out.collect()}[4] == 5.0
    one_rare = spark.createDataFrame([("a",)] * 200 + [("b",)], "s string")
    out, _ = P.apply_plan(one_rare, [("collapse_rare", "s")])
    assert {r["s"] for r in out.collect()} == {"a", "b"}
    two_rare = one_rare.union(spark.createDataFrame([("c",)], "s string"))
    out, _ = P.apply_plan(two_rare, [("collapse_rare", "s")])
    assert {r["s"] for r in out.collect()} == {"a", "Other"}


def test_grades_are_no_class_labels(spark):
    d = spark.range(300).select((F.col("id") % 5 + 1).alias("grade"), (F.col("id") % 5 + 1).alias("cluster"))
    got = {r["column"]: r["kind"] for r in P.profile(d).collect()}
    assert got["grade"] != got["cluster"]


@pytest.mark.parametrize("model", [learning.gradient_boosting, learning.svm_model])
def test_three_classes(spark, model):
    d = spark.range(300).select("id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("y"), (F.col("id") % 3 + F.rand(1) / 10).alias("x1"), F.rand(2).alias("x2"))
    r = model(d, "y", ["x1", "x2"], "id").collect()
    assert r[0]["task"] == "classification" and r[0]["score"] > 0.6


def test_emergy_category_is_matched_whole(spark):
    d = spark.createDataFrame([(1.0, 2.0, 4.0)], "a double, b double, c double")
    r = ranking.emergy_analysis(d, {"a": 1.0, "b": 1.0, "c": 1.0}, {"a": "R", "b": "", "c": "NF"}).collect()[0]
    assert (r["renewable"], r["nonrenewable"], r["purchased"]) == (1.0, 0.0, 6.0)


def test_weighted_moments_with_large_means(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200) + 1e9
    y = rng.normal(size=200)
    w = rng.uniform(1, 2, size=200)
    g = weighted_gram(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), w.tolist())), "x double, y double, w double"), ["x", "y"], F.col("w"))[()]
    mx, my = np.average(x, weights=w), np.average(y, weights=w)
    assert np.allclose(g.cross, [[(w * (x - mx) ** 2).sum(), (w * (x - mx) * (y - my)).sum()], [(w * (x - mx) * (y - my)).sum(), (w * (y - my) ** 2).sum()]], rtol=1e-6)


def test_reading_delimited(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    for name, text, enc in (("a.csv", "\ufeffname;größe\nx;1\n", "utf-8"), ("b.csv", "名;值\n中;2\n", "gb18030"), ("c.csv", "n\tv\ny\t3\n", "utf-8")):
        with open(f"{path}/{name}", "w", encoding=enc) as f:
            f.write(text)
    assert S.sniff(spark, f"{path}/a.csv") == ("utf-8", ";")
    assert S.read_delimited(spark, f"{path}/a.csv").collect()[0].asDict() == {"name": "x", "größe": "1"}
    assert S.read_delimited(spark, f"{path}/b.csv").collect()[0].asDict() == {"名": "中", "值": "2"}
    assert S.read_delimited(spark, f"{path}/c.csv").columns == ["n", "v"]
    assert {r["kind"] for r in S.scan_folder(spark, path).collect()} == {"csv"}


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        frames.shared_folder(Session())
