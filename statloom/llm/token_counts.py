"""Token totals by source, language and tokenizer version, maintained by signed changes.

A store is a folder with three tables, each in one subfolder per batch: `rows` (signed document rows), `totals` (their
sums) and `commits` (one row, written last). A batch counts once it is in `commits`; applying a committed batch again
does nothing, and one that broke off is written anew from the start. Totals only add up, so a batch costs its own
rows and the state of the documents it names, not the history's tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.frames import need
from .text import bounded, word_counts
from .tokenise import encoder

ROW = "doc_id bigint, source string, lang string, version string, sign int, tokens bigint"
TOTAL = "source string, lang string, version string, docs bigint, tokens bigint"
GROUP = ["source", "lang", "version"]
WORDS = "words"         # the version that counts words instead of a vocabulary's tokens


def _table(spark: SparkSession, store: str, name: str, schema: str) -> DataFrame:
    """All batches of a table with their names; empty where none was written."""
    try:
        return spark.read.schema(f"{schema}, batch string").parquet(f"{store}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, batch string")


def committed(spark: SparkSession, store: str) -> DataFrame:
    return _table(spark, store, "commits", "n bigint").select("batch").distinct()


def state(spark: SparkSession, store: str) -> DataFrame:
    """Live documents: the rows of committed batches, added up."""
    rows = _table(spark, store, "rows", ROW).join(committed(spark, store), "batch", "left_semi")
    return rows.groupBy("doc_id", *GROUP).agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens")).where("n > 0").select("doc_id", *GROUP, F.col("tokens").alias("tokens"))


def totals(spark: SparkSession, store: str) -> DataFrame:
    """source, lang, version, docs, tokens over all committed batches; groups that went back to nothing are left out."""
    parts = _table(spark, store, "totals", TOTAL).join(committed(spark, store), "batch", "left_semi")
    return parts.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def apply_batch(changes: DataFrame, store: str, batch: str) -> bool:
    """Commits a batch of changes (op, doc_id, source, lang, version, tokens); False if it was committed before.

    `insert` and `revise` both make the given row the document's one under that version: an earlier row is taken back
    with its own source, language and count. `delete` takes it back and reads no other column. Deleting what is not
    there does nothing. Of several changes of one (doc_id, version) in a batch, a delete wins, then the largest count,
    then source and lang in order. Rows with a null doc_id, version or op are ignored; null source and lang are groups of
    their own; null tokens count 0. An empty batch commits and changes nothing. The batch name must suit a folder.
    """
    need(changes, "op", "doc_id", "source", "lang", "version", "tokens")
    spark = changes.sparkSession
    if not committed(spark, store).where(F.col("batch") == batch).isEmpty():
        return False
    last = (changes.where("doc_id is not null and version is not null and op is not null")
            .groupBy("doc_id", "version").agg(F.max(F.struct((F.col("op") == "delete").alias("gone"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), "source", "lang")).alias("c"))
            .select("doc_id", "version", "c.*"))
    old = state(spark, store).join(last.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
    out = old.select("doc_id", *GROUP, F.lit(-1).alias("sign"), "tokens").unionByName(last.where("not gone").select("doc_id", *GROUP, F.lit(1).alias("sign"), "tokens"))
    out.write.mode("overwrite").parquet(f"{store}/rows/batch={batch}")
    rows = spark.read.schema(ROW).parquet(f"{store}/rows/batch={batch}")
    sums = rows.groupBy(*GROUP).agg(F.sum("sign").cast("bigint").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).cast("bigint").alias("tokens"))
    sums.write.mode("overwrite").parquet(f"{store}/totals/batch={batch}")
    spark.range(1).select(F.lit(1).cast("bigint").alias("n")).write.mode("overwrite").parquet(f"{store}/commits/batch={batch}")
    return True


def token_counts(docs: DataFrame, tokenizers: dict[str, str | None], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(doc_id, *keep, version, tokens), a row for each document and version; a version is a tokenizer file or, if None, words.

    A null text has no tokens.
    """
    need(docs, id_col, text_col, *keep)
    names = ["doc_id", *keep, "version", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            texts = b.column(0).to_pylist()
            for version, path in tokenizers.items():
                n = word_counts(b.column(0)) if path is None else np.array([len(encoder(path).encode(t or "")) // 4 for t in texts], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(1 + i) for i in range(1 + len(keep))), pa.array([version] * len(b)), pa.array(n)], names)

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), *keep).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {kinds}version string, tokens bigint")
