"""Connected components of an undirected edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.frames import cut_lineage


def _signature(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).collect()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b), label being the smallest node it is connected to.

    A large star ties every larger neighbour of a node to the smallest one, a small star every smaller one; both keep
    the components. The rounds end when the edges no longer change, which then are stars around the labels. Edges of a
    hub are met by its minimum in a join, whose skewed partitions Spark can split. Loops and nulls are ignored.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(e)
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        e = cut_lineage(small)
        after = _signature(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select("b", "b").distinct())
