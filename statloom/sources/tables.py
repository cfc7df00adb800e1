"""Reading delimited text with encoding and delimiter detection, numeric coercion, folder scan, run manifest."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.frames import rows_frame, text_columns

# Encodings tried in order, delimiters, and the tokens that mean missing inside numeric columns.
ENCODINGS = ("utf-8", "gb18030", "latin-1")
DELIMITERS = (",", ";", "\t", "|")
MISSING = ("", "-", "--", "---", "–", "—", "?", "??", ".", "na", "n/a", "n/d", "nan", "null", "none", "missing", "unknown", "tbd", "无", "缺失")


def _head(spark: SparkSession, path: str, size: int = 65_536) -> bytes:
    """First bytes of one file below a path; Spark reads the file listing, the driver sees only the head."""
    # As Latin-1 every byte is one character, so the lines give back the bytes whatever their encoding is.
    rows = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").option("encoding", "ISO-8859-1").option("header", False).option("sep", "\u0001").option("quote", "").schema("value string").csv(path).limit(200).collect()
    return "\n".join(r["value"] or "" for r in rows).encode("latin-1", "replace")[:size]


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """(encoding, delimiter) from the head of the first file."""
    raw = _head(spark, path)
    for enc in ENCODINGS:
        try:
            # a multi-byte character may be cut at the end of the head
            text = raw[:len(raw) - len(raw) % 1].decode(enc) if len(raw) < 65_536 else raw[:raw.rfind(b"\n") + 1 or None].decode(enc)
            break
        except UnicodeDecodeError:
            continue
    line = text.lstrip("﻿").splitlines()[0] if text else ""
    best = max(DELIMITERS, key=line.count)
    return enc, best if line.count(best) else ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Header file as strings, byte-order mark removed from the first name; cells may hold quoted line breaks.

    Spark's reader knows UTF-8 and Latin-1; a file in another encoding is read byte by byte and decoded cell by cell.
    """
    enc, sep = sniff(spark, path)
    native = {"utf-8": "utf-8", "latin-1": "iso-8859-1"}.get(enc)
    # A quoted line break leaves a line with an odd number of quotes. Only then is a file read as a whole, else in splits.
    lines = spark.read.option("encoding", native or "iso-8859-1").text(path)
    broken = not lines.where("length(value) % 2 <> length(replace(value, '\"', '')) % 2").isEmpty()
    df = spark.read.option("header", True).option("sep", sep).option("encoding", native or "iso-8859-1").option("escape", '"').option("multiLine", broken).csv(path)
    if native is None:
        def again(cells: pd.Series) -> pd.Series:
            return cells.map(lambda v: None if v is None else v.encode("latin-1").decode(enc, "replace"))

        decode = F.pandas_udf(again, "string")
        df = df.select(*[decode(F.col(f"`{c}`")).alias(c.encode("latin-1").decode(enc, "replace")) for c in df.columns])
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


def as_number(c: Column) -> Column:
    """Number behind a text cell: missing tokens, thousands separators, currency signs and percent removed.

    A comma goes only before a group of three digits; a decimal comma is left, so such a cell is no number.
    """
    t = F.trim(c)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r",(?=\d{3}(?!\d))|[\s_]", ""), r"^[¥$€£￥]|[元¥$€£]$", ""), r"%$", "")
    return F.when(F.lower(t).isin(*MISSING), None).otherwise(bare.try_cast("double"))


def coerce_numeric(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text columns of which 90% of the stated values are numbers become doubles; every coercion is listed.

    One aggregate decides all columns. A column of whole percents is divided by 100.
    """
    texts = text_columns(df)
    if not texts:
        return df, rows_frame(df.sparkSession, "column string, share double, percent boolean, lost bigint", [])
    stated = {c: F.col(c).isNotNull() & ~F.lower(F.trim(F.col(c))).isin(*MISSING) for c in texts}
    r = df.agg(*[F.sum(F.when(stated[c], 1).otherwise(0)).alias(f"s{i}") for i, c in enumerate(texts)],
               *[F.sum(F.when(stated[c] & as_number(F.col(c)).isNotNull(), 1).otherwise(0)).alias(f"k{i}") for i, c in enumerate(texts)],
               *[F.sum(F.when(stated[c] & F.trim(F.col(c)).endswith("%"), 1).otherwise(0)).alias(f"p{i}") for i, c in enumerate(texts)]).collect()[0]
    new, rows = {}, []
    for i, c in enumerate(texts):
        s, k, p = r[f"s{i}"] or 0, r[f"k{i}"] or 0, r[f"p{i}"] or 0
        if s and k / s >= 0.9:
            pct = p == s
            new[c] = as_number(F.col(c)) / F.lit(100.0) if pct else as_number(F.col(c))
            rows.append((c, k / s, pct, s - k))
    out = df.select(*[(new[c] if c in new else F.col(c)).alias(c) for c in df.columns])
    return out, rows_frame(df.sparkSession, "column string, share double, percent boolean, lost bigint", rows)


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """Data files below a folder with size and kind; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return f.withColumn("kind", ext).where(F.col("kind").isin("csv", "tsv", "txt", "parquet", "json"))


def manifest(df: DataFrame, op: str, params: dict) -> DataFrame:
    """One row: operator, parameters, row count and an order-free content hash."""
    cols = [c for c in df.columns]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).cast("string").alias("content_hash")).select(
        F.lit(op).alias("op"), F.lit(json.dumps(params, sort_keys=True, default=str)).alias("params"), "rows", "content_hash")
