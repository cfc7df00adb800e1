"""Targets, flows and selection."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from statloom.llm.mixing import mix, mixed, mixture, routes, targets


def test_targets():
    t = targets({"b": 10, "a": 1000, None: 0, "c": 400})
    assert abs(sum(t.values()) - 1410) < 1e-6 and t[None] == 0 and t["b"] == 30
    assert abs(t["a"] / 1 - t["c"] / 3) < 1e-6
    assert targets({"a": 5}) == {"a": 5.0}


def test_routes_prefer_unrepeated():
    r = routes({'["x"]': 100, '["x", "y"]': 100, '["y"]': 10}, {"x": 150, "y": 120})
    assert sum(v for (p, s), v in r.items() if s == "x") == 150 and sum(v for (p, s), v in r.items() if s == "y") == 120
    used = defaultdict(int)
    for (p, s), v in r.items():
        used[p] += v
        assert s in p
    assert used['["x"]'] >= 100 and used['["x", "y"]'] >= 100 and used['["y"]'] >= 10     # all once before any twice
    assert routes({'["x"]': 10}, {"x": 1000}) == {('["x"]', "x"): 30}
    assert routes({}, {}) == {}


def test_oddities(odd):
    size = lambda t: len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    rows = odd.select("doc_id", "text", "source").collect()
    by = Counter()
    for r in rows:
        by[r["source"]] += size(r["text"])
    want = targets(dict(by))
    got = mix(odd).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == sorted(((r["doc_id"], size(r["text"])) for r in rows), key=str)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["pattern"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken['[null]' if s is None else f'["{s}"]'] - t) <= 1
    again = mix(odd.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_overlap(spark):
    d = spark.createDataFrame([(i, " ".join(["w"] * 10), [["x"], ["x", "y"], ["y", None]][i % 3]) for i in range(90)], "doc_id long, text string, member array<string>")
    got = mix(d, F.col("member")).collect()
    assert len(got) == 90 and all(r["taken"] <= 30 for r in got)


def test_empty(none):
    assert mix(none).collect() == []


def test_mixed(spark):
    d = spark.createDataFrame([(i, " a  b\nc d ", "s" if i % 4 else "t") for i in range(40)], "doc_id long, text string, source string")
    m = mix(d)
    total = sum(len(r["text"].split()) for r in mixed(d, m).collect())
    assert total == m.agg(F.sum("taken")).collect()[0][0]


def test_mixture_of_whole_documents(odd, none):
    size = lambda t: len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    docs = odd.where("doc_id not in (9, 10) or doc_id is null")
    rows = docs.collect()
    by, own = Counter(), Counter(map(tuple, rows))
    for r in rows:
        by[r["source"]] += size(r["text"])
    got = mixture(docs).collect()
    taken, times = Counter(), Counter(map(tuple, got))
    for r in got:
        taken[r["source"]] += size(r["text"])
    assert mixture(docs).columns == docs.columns and set(times) <= set(own)
    assert all(times[k] <= 3 * own[k] for k in times)
    for s, t in targets(dict(by)).items():
        assert abs(taken[s] - t) <= max(size(r["text"]) for r in rows if r["source"] == s)
    assert Counter(map(tuple, mixture(docs.repartition(7)).collect())) == times
    assert mixture(none).collect() == []


def test_mixture_ends_at_a_document(spark):
    """Null ids all over: the remainder is still met to half a document, which the text's digest makes possible."""
    d = spark.createDataFrame([(None, f"{i} b c", "s" if i % 4 else "t") for i in range(400)], "doc_id long, text string, source string")
    got = Counter(r["source"] for r in mixture(d).collect())
    want = targets({"s": 900, "t": 300})
    assert all(abs(3 * got[s] - t) <= 1.5 for s, t in want.items())
