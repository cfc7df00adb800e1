"""Ordered series of any length: positions, and blocks with a halo so that windows stay short."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .order import cumulate

BLOCK = 100_000


def numeric_time(df: DataFrame, order: str) -> Column:
    """The order column as a number (microseconds for times)."""
    t = df.schema[order].dataType
    if isinstance(t, T.TimestampNTZType):
        return F.unix_micros(F.col(order).cast("timestamp"))
    if isinstance(t, T.TimestampType):
        return F.unix_micros(F.col(order))
    if isinstance(t, T.DateType):
        return F.unix_date(F.col(order))
    return F.col(order)


def positions(df: DataFrame, order: str, keys: Sequence[str] = (), out: str = "__i") -> DataFrame:
    """0-based position inside the key; `order` must be unique within a key."""
    d = df.withColumn("__ord", numeric_time(df, order)).withColumn("__one", F.lit(1).cast("bigint"))
    c = cumulate(d, "__ord", ["__one"], keys)
    return c.withColumnRenamed("__one_before", out).drop("__one", "__ord")


def blocks(df: DataFrame, order: str, keys: Sequence[str] = (), halo: int = 1,
           size: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """Rows with position `__i` cut into blocks `__blk`; the last `halo` rows of a block are repeated in
    the next one with `__own` false, so look-back windows of up to `halo` rows are right inside a block.

    Returns the table and the window partition columns.
    """
    p = positions(df, order, keys)
    b = F.floor(F.col("__i") / size)
    spill = F.col("__i") % size >= size - halo
    p = p.withColumn("__s", F.explode(F.when(spill, F.array(F.struct(b.alias("b"), F.lit(True).alias("own")),
                                                            F.struct((b + 1).alias("b"), F.lit(False).alias("own"))))
                                      .otherwise(F.array(F.struct(b.alias("b"), F.lit(True).alias("own"))))))
    return p.withColumn("__blk", F.col("__s.b")).withColumn("__own", F.col("__s.own")).drop("__s"), [*keys, "__blk"]
