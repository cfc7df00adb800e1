"""Near-duplicates against brute force, with families that need the group keys."""

import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from statloom.llm import minhash
from statloom.llm.components import components
from statloom.llm.minhash import near_duplicates


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted(((d, len(s), low.get(root(i)), d is not None and d == low.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_oddities(odd):
    check(odd)


def test_empty(none):
    assert near_duplicates(none).collect() == []


def test_family_beyond_long_list(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([1, 3, 6, 8, 12])):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((1000 + i, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(5000 + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(rng.choice([4, 20, 60])))) for i in range(80)]
    old = minhash.TILE_ROWS
    minhash.TILE_ROWS = 24      # several tiles for a group
    try:
        check(spark.createDataFrame(rows, "doc_id long, text string"))
    finally:
        minhash.TILE_ROWS = old


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(e).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert components(e.limit(0)).collect() == []
