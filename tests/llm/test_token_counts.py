"""Rollups against a plain replay of the changes."""

import random
import re
import tempfile
from collections import Counter

from statloom.llm import token_counts as T

SCHEMA = "op string, doc_id long, source string, lang string, version string, tokens long"


def replay(batches):
    live = {}
    for batch in batches:
        last = {}
        for op, i, s, g, v, n in batch:
            if None in (op, i, v):
                continue
            key = (op == "delete", n or 0, (s is not None, s or ""), (g is not None, g or ""))
            if (i, v) not in last or key > last[i, v][0]:
                last[i, v] = (key, op, s, g, n or 0)
        for (i, v), (_, op, s, g, n) in last.items():
            live.pop((i, v), None)
            if op != "delete":
                live[i, v] = (s, g, n)
    docs, tokens = Counter(), Counter()
    for (_, v), (s, g, n) in live.items():
        docs[s, g, v] += 1
        tokens[s, g, v] += n
    return {k: (docs[k], tokens[k]) for k in docs}


def test_replay(spark):
    rng = random.Random(4)
    store = tempfile.mkdtemp(prefix="spark-") + "/store"
    batches = []
    for b in range(4):
        rows = [(rng.choice(["insert", "insert", "revise", "delete"]), rng.randint(1, 30), rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice(["v1", "v2"]), rng.choice([0, 3, 17, None])) for _ in range(40)]
        rows += [(None, 1, "a", "en", "v1", 1), ("insert", None, "a", "en", "v1", 1), ("insert", 2, "a", "en", None, 1), rows[0]]
        batches.append(rows)
        d = spark.createDataFrame(rows, SCHEMA)
        assert T.apply_batch(d, store, f"b{b}")
        assert not T.apply_batch(d, store, f"b{b}")
        assert {tuple(r)[:3]: tuple(r)[3:] for r in T.totals(spark, store).collect()} == replay(batches)
    # A batch that broke off before its commit leaves rows behind, counts nothing, and is written anew.
    more = [("insert", 99, "z", "en", "v1", 5)]
    spark.createDataFrame([(99, "z", "en", "v1", 1, 777)], T.ROW).write.parquet(f"{store}/rows/batch=late")
    spark.createDataFrame([("z", "en", "v1", 1, 777)], T.TOTAL).write.parquet(f"{store}/totals/batch=late")
    assert {tuple(r)[:3]: tuple(r)[3:] for r in T.totals(spark, store).collect()} == replay(batches)
    assert T.apply_batch(spark.createDataFrame(more, SCHEMA), store, "late")
    assert {tuple(r)[:3]: tuple(r)[3:] for r in T.totals(spark, store).collect()} == replay([*batches, more])
    assert T.apply_batch(spark.createDataFrame([], SCHEMA), store, "empty")
    assert {tuple(r)[:3]: tuple(r)[3:] for r in T.totals(spark, store).collect()} == replay([*batches, more])


def test_empty_store(spark):
    assert T.totals(spark, tempfile.mkdtemp(prefix="spark-") + "/none").collect() == []


def test_counts(odd, none):
    got = T.token_counts(odd, {"words": None}).collect()
    assert Counter((r["doc_id"], r["tokens"]) for r in got) == Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in odd.collect())
    assert T.token_counts(none, {"words": None}).collect() == []
