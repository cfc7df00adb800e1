"""Quality voting: held-out accuracy and oddities."""

import random
import zlib

from pyspark.sql import functions as F

from statloom.llm.quality import accepted, learnable, quality_scores, train


def corpus(spark, n=600):
    rng = random.Random(11)
    vocab = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        ws = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        bad = i % 4 == 0
        kind = i % 12 // 4
        text = " ".join(ws) if not bad else " | ".join(ws) if kind == 0 else " ".join(w.upper() + "!!" for w in ws) if kind == 1 else " ".join(w for w in ws for _ in range(3))
        docs.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, q) for i, q, _ in labels)


def test_held_out(spark):
    docs, labels, truth = corpus(spark)
    got = quality_scores(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r["doc_id"], r["score"]) for r in quality_scores(docs, flipped).collect()} == {(r["doc_id"], r["score"]) for r in got}     # held-out labels are not read


def test_oddities(spark, odd, none):
    _, labels, _ = corpus(spark, 40)
    odd_labels = labels.union(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 0, 0), (2, 1, 0), (3, 7, 0)], labels.schema))
    got = quality_scores(odd, odd_labels).collect()
    assert len(got) == odd.count()
    blank = {r["doc_id"] for r in odd.where("text is null or trim(text) = ''").collect()}
    assert all(r["score"] == 0.0 for r in got if r["doc_id"] in {4, 5} & blank)
    assert quality_scores(none, odd_labels).collect() == []
    assert all(r["score"] == 0 for r in quality_scores(odd, labels.limit(0)).collect())
    assert accepted(odd, odd_labels).columns == odd.columns
    assert accepted(odd, labels.limit(0)).count() == odd.count()


def test_repeated_id_counts_once(spark):
    docs, labels, _ = corpus(spark, 40)
    known = learnable(labels).count()
    one = learnable(labels).first()["doc_id"]
    more = docs.union(spark.range(300).select(F.lit(one).alias("doc_id"), F.concat(F.lit("copy "), F.col("id").cast("string")).alias("text")))
    assert len(train(more, labels).label) == known
    twice = docs.union(docs)
    assert {tuple(r) for r in quality_scores(twice, labels).collect()} == {tuple(r) for r in quality_scores(docs, labels).collect()}
