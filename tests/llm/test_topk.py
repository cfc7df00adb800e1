"""Exact top-k against brute force."""

import math
import random

from pyspark.sql import functions as F

from statloom.llm import topk
from statloom.llm.topk import top_k


def brute(rows, k):
    good = [(i, [math.floor(256.0 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        s = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(q[1], v)))), i) for i, v in good if i != q[0] and len(v) == len(q[1]))
        out |= {(q[0], r + 1, i, -v) for r, (v, i) in enumerate(s[:k])}
    return out


def run(spark, rows, k=5, kind="float"):
    d = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("rank", F.lit("x")).withColumn("score", F.lit(1)).repartition(4)
    return {tuple(r) for r in top_k(d, F.col("vec_id") % 50 == 0, k).collect()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    f = lambda: rng.choice([-3, -1, 0, 1, 2]) / 4     # floats that hold exactly, many ties
    rows = [(i, [f() for _ in range(6)]) for i in range(300)] + [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1050, [float("nan")] * 6), (1051, [float("inf")] * 6), (None, [1.0] * 6), (1100, []), (1101, []), (1150, [1.0, 2.0])]
    old = topk.BLOCK, topk.SHARD, topk.FAN
    topk.BLOCK, topk.SHARD, topk.FAN = 4, 16, 3
    try:
        assert run(spark, rows) == brute(rows, 5)
    finally:
        topk.BLOCK, topk.SHARD, topk.FAN = old
    assert run(spark, rows) == brute(rows, 5)


def test_large_values_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 2.0 ** rng.choice([20, 30, 40]) for _ in range(3)]) for i in range(60)]
    assert run(spark, rows, 3, "double") == brute(rows, 3)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == {(0, 1, 1, 256 * 512)}
    assert run(spark, [(0, [1.0])]) == set() and run(spark, []) == set() and run(spark, [(1, [1.0])]) == set()
