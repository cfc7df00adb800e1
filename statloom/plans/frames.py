"""Small helpers shared by the operators: validation, listwise deletion, bounded collects."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

# Most rows an operator may bring to the driver: a table of levels, cells or cohorts.
LEVEL_LIMIT = 20_000


def need(df: DataFrame, *names: str | None) -> None:
    """Raise when a required column is absent."""
    gone = [n for n in names if n is not None and n not in df.columns]
    if gone:
        raise ValueError(f"columns not in the table: {gone}; it has {df.columns}")


def refuse(condition: bool, reason: str) -> None:
    if condition:
        raise ValueError(reason)


def num(name: str | Column) -> Column:
    """A column as double with NaN read as missing."""
    c = F.col(name) if isinstance(name, str) else name
    c = c.cast("double")
    return F.when(F.isnan(c), None).otherwise(c)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) or isinstance(f.dataType, T.BooleanType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def complete(df: DataFrame, numeric: Sequence[str] = (), other: Sequence[str] = ()) -> DataFrame:
    """The listed columns, numerics as double, rows with any missing value removed."""
    need(df, *numeric, *other)
    seen: dict[str, Column] = {}
    for c in other:
        seen[c] = F.col(c)
    for c in numeric:
        seen[c] = num(c).alias(c)
    return df.select(*seen.values()).dropna()


def collect_bounded(df: DataFrame, what: str, limit: int = LEVEL_LIMIT) -> list[Row]:
    """Collect a table that must stay small; refuse (never truncate) when it does not."""
    rows = df.limit(limit + 1).collect()
    refuse(len(rows) > limit, f"more than {limit} {what}: this operator needs a small set of them")
    return rows


def levels_of(df: DataFrame, name: str, limit: int = LEVEL_LIMIT) -> list:
    """Distinct values of a factor, numeric ones ascending, otherwise in text order."""
    vals = [r[0] for r in collect_bounded(df.select(name).dropna().distinct(), f"levels of {name}", limit)]
    return sorted(vals, key=level_key)


def level_key(v) -> tuple:
    try:
        return (0, float(v), "")
    except (TypeError, ValueError):
        return (1, 0.0, str(v))


def binary01(df: DataFrame, name: str) -> tuple[Column, object, object]:
    """0/1 column of a two-level column: the higher sorted level is 1."""
    vals = levels_of(df, name, 2)
    refuse(len(vals) != 2, f"{name} must have exactly two levels, found {vals}")
    return (F.when(F.col(name).isNull(), None)
            .when(F.col(name) == F.lit(vals[1]), 1.0).otherwise(0.0)), vals[0], vals[1]


def r4(c: Column, digits: int = 4) -> Column:
    return F.round(c, digits)


def clean(v):
    """A driver value as a plain Python value Spark can store (NaN and inf become null)."""
    if v is None:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        f = float(v)
        return None if math.isnan(f) or math.isinf(f) else f + 0.0
    return v


def rows_frame(spark: SparkSession, schema: str, rows: Iterable[Sequence]) -> DataFrame:
    """A small result table from driver values, with an explicit schema."""
    kinds = [f.dataType for f in T._parse_datatype_string(schema).fields]
    return spark.createDataFrame([tuple(_as(clean(v), t) for v, t in zip(r, kinds, strict=True)) for r in rows], schema)


def _as(v, t):
    if v is None:
        return None
    return float(v) if isinstance(t, T.DoubleType) else int(v) if isinstance(t, (T.LongType, T.IntegerType)) else v


def one_row(spark: SparkSession, **values) -> DataFrame:
    """A one-row result; column types follow the Python values (None is a double)."""
    kinds, row = [], []
    for k, v in values.items():
        v2 = clean(v)
        t = ("boolean" if isinstance(v2, bool) else "bigint" if isinstance(v2, int)
             else "string" if isinstance(v2, str) else "double")
        if isinstance(v, (float, np.floating)):
            t = "double"
        kinds.append(f"`{k}` {t}")
        row.append(v2)
    return spark.createDataFrame([tuple(row)], ", ".join(kinds))


def sum_exprs(pairs: Iterable[tuple[str, Column]]) -> list[Column]:
    return [F.sum(c).alias(a) for a, c in pairs]


def fetch(df: DataFrame, **exprs: Column) -> Row:
    """One aggregate row as a driver Row."""
    return df.agg(*[e.alias(k) for k, e in exprs.items()]).collect()[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints; one of our own only where none is set and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        refuse(not re.fullmatch(r"local(\[[^]]*\])?", master), "set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it back.

    The written copy survives the loss of executors, and, unlike a checkpoint of the plan, it drops the inferred
    constraints of the old plan, which would otherwise double with every round of a loop.
    """
    import uuid
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
