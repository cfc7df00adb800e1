"""From raw documents to packed training sequences, one operator after another.

All stages but the last return the columns of documents: rejected and duplicate documents go, secrets are masked, and
the mix repeats documents. No row goes for its doc_id, be it null or repeated. Columns other than those of documents are
ignored. The last stage returns the pieces of all documents with their places in the sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from statloom.llm.minhash import near_duplicates
from statloom.llm.mixing import mixture
from statloom.llm.packing import pack
from statloom.llm.quality import accepted
from statloom.llm.secrets import base_spans, find_secrets, redacted
from statloom.plans.frames import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null texts are scored as empty ones, and ids do not matter here."""
    return accepted(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one with the smallest doc_id.

    Rows without an id or with a repeated one are told apart by the place they are read from; ids come before nulls, and
    of rows that share an id the first read stays. Null, empty and blank texts are near-duplicates of nothing and stay.
    Texts may be of any length; an empty table gives no rows.
    """
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")).crossJoin(docs.agg(F.countDistinct("doc_id").alias("apart"))).collect()[0]
    if ids["n"] == ids["apart"]:
        kept = cut_lineage(near_duplicates(docs).where("kept").select("doc_id"))
        return docs.hint("merge").join(kept.hint("merge"), "doc_id", "left_semi").select(*COLUMNS)
    rows = cut_lineage(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row").alias("id"), "text")
    kept = cut_lineage(near_duplicates(named, "id").where("kept").select("doc_id.row"))
    return rows.hint("merge").join(kept.hint("merge"), "row", "left_semi").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes a mark; no row goes.

    Pattern matches are found where the text is; random tokens, which few texts have, come by a join on the text's
    digest, so null and repeated ids and repeated rows do not matter. A null text becomes an empty one.
    """
    texts = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")
    random = find_secrets(texts, id_col="digest").where("n_random > 0").select(F.col("doc_id").alias("digest"), F.expr("filter(spans, x -> x.k = 3)").alias("random"))
    random = cut_lineage(random.dropDuplicates(["digest"]))
    spans = F.expr("array_sort(concat(base, coalesce(random, filter(base, x -> false))), (x, y) -> if(x.s <> y.s, x.s - y.s, x.k - y.k))")
    found = docs.select(*COLUMNS).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", F.sha2("text", 256)).join(random, "digest", "left")
    found = found.withColumn("base", base_spans()).withColumn("spans", spans)
    clean = found.withColumn("text", F.when(F.size("spans") > 0, redacted("text", "spans")).otherwise(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, each one whole; nulls, ties and repeated rows as `mixture` says."""
    return mixture(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row with its sequence and its place there; a null text is an empty one."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
