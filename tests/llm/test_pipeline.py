"""The pipeline stage by stage against plain Python, and its run as a whole."""

import random
import re
import tempfile
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from statloom.llm.quality import quality_scores
from test_near_duplicates import brute
from test_secrets import base

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(21)
    vocab = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(240):
        ws = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        bad = i % 6 == 0
        text = " | ".join(ws) if bad else " ".join(ws)
        if i % 10 == 1:
            text += " password=hunter2hunter2 end"
        docs.append((i, text, "en", rng.choice(["a", "b", "c", None]), len(text)))
        labels.append((i, 0 if bad else 1, 0))
        if i % 8 == 1:
            docs.append((1000 + i, text + " tail", "en", "a", len(text) + 5))
    docs += [(2000, None, None, None, None), (2001, "", "en", "a", 0), (None, docs[1][1], "en", "a", 1), docs[3], docs[3]]
    path = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = {}
    for name, stage in C.STAGES:
        found[name] = out = stage(spark, docs, folder)
        rows_in, rows = [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]
        if name != "packing":
            assert out.columns == C.COLUMNS
        if name == "quality":
            want = Counter((r["doc_id"], r["predicted"]) for r in quality_scores(docs, labels).where("predicted = 1").collect())
            assert Counter((r["doc_id"], 1) for r in rows) == want
            assert {i for i in range(240) if i % 6} <= {r["doc_id"] for r in rows} and not {i for i in range(240) if i % 6 == 0} & {r["doc_id"] for r in rows}
        if name == "near_duplicates":
            kept = {d for d, _, _, k in brute([(r["doc_id"], r["text"]) for r in rows_in]) if k}
            assert sorted(r["doc_id"] for r in rows) == sorted(kept)
        if name == "secrets":
            before = {r["doc_id"]: r["text"] for r in rows_in}
            for r in rows:
                text, at, new = before[r["doc_id"]], 0, ""
                for s in filter(None, base(text).split(",")):
                    _, a, b = s.split(":")
                    if int(a) >= at:
                        new, at = new + text[at:int(a)] + "[SECRET]", int(b)
                assert r["text"] == new + text[at:] and r["n_chars"] == len(r["text"])
            assert len(rows) == len(rows_in) and any("[SECRET]" in r["text"] for r in rows)
        if name == "mixing":
            total = sum(len(r["text"].split()) for r in rows_in)
            longest = max(len(r["text"].split()) for r in rows_in)
            assert abs(sum(len(r["text"].split()) for r in rows) - total) <= 2 * longest        # half a document for each of four sources
            own = {r["doc_id"]: r["text"] for r in rows_in}
            assert all(r["text"] == own[r["doc_id"]] for r in rows)
            assert max(Counter(r["doc_id"] for r in rows).values()) <= 3
        if name == "packing":
            tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert sum(r["length"] for r in rows) == sum(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows_in)
        docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA) if name != "packing" else out


def test_run(spark, folder):
    got = C.run(spark, folder).collect()
    again = C.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in again)
    assert np.bincount([r["length"] for r in got]).sum() == len(got)


def test_rows_without_an_id_and_rows_that_share_one(spark, folder):
    """Nothing is lost or multiplied for its id: only copies of a kept text go, and clashing columns do not matter."""
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(99)) for _ in range(40))
    key = "api_key=" + "A1b2C3d4E5f6G7h8"
    docs = [(None, text(), "en", "a", 1) for _ in range(30)] + [(7, text() + " " + key, "en", None, None) for _ in range(30)] + [(i, text(), None, "b", 1) for i in range(10, 20)]
    docs += [docs[0], docs[35], (None, docs[60][1], "en", "a", 1), (None, "", "en", "a", 0), (None, None, None, None, None)]
    df = spark.createDataFrame([(*d, "x", 0.5) for d in docs], SCHEMA + ", row string, kept double").repartition(5)
    stages = dict(C.STAGES)
    kept = stages["near_duplicates"](spark, df, folder).collect()
    assert Counter(r["text"] for r in kept) == Counter([d[1] for d in docs[:70]] + ["", None])
    assert [r["doc_id"] for r in kept if r["text"] == docs[60][1]] == [10]
    masked = stages["secrets"](spark, df, folder).collect()
    assert len(masked) == len(docs) and sum("[SECRET]" in (r["text"] or "") for r in masked) == 31 and not any(key in (r["text"] or "") for r in masked)
    mix = stages["mixing"](spark, df, folder).collect()
    assert all(r["text"] in {d[1] or "" for d in docs} | {None} for r in mix) and max(Counter(r["text"] for r in mix if r["text"]).values()) <= 6


def test_empty_tables(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in C.STAGES:
        assert stage(spark, none, folder).collect() == [], name
