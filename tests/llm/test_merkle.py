"""The Merkle manifest against a tree built in plain Python, and proofs checked by themselves."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from statloom.llm import merkle
from statloom.llm.merkle import copied_path, leaf_digest, prove

FIELDS = ("doc_id", "source", "lang", "n_chars")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, fan=3):
    """Root and, for each node, its siblings with its place, level by level."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fan] for i in range(0, len(nodes), fan)]
        for k, i in enumerate(at):
            run = runs[i // fan]
            ways[k].append((run[:i % fan], run[i % fan + 1:]))
            at[k] = i // fan
        nodes = [h(*r) for r in runs]
    return nodes[0], ways


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars); a multiset of the query's rows."""
    groups = {}
    for d, t, lang, s, n in rows:
        changed = None
        if d is not None and zlib.crc32(str(d).encode()) % 2 == 0:
            changed = leaf((d, s, lang, n, t and t.replace("\n", "")))
        groups.setdefault(s, []).append((d, leaf((d, s, lang, n, t)), changed))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        subs[s] = tree([r[1] for r in groups[s]])
    root, tops = tree([subs[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        sub, ways = subs[s]
        for (d, lf, changed), way in zip(groups[s], ways):
            node = changed or lf
            for left, right in way + top:
                node = h(*left, node, *right)
            out.append((str(d), lf, sub, root, h(*[x for left, right in way + top for x in left + right]), node, node == root))
    return sorted(out)


def query(df, **how):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf_digest(*FIELDS, F.translate("text", "\n", "")))
    return prove(df, leaf_digest(*FIELDS, "text"), tampered, **how)


def run(df, **how):
    out = query(df, **how).select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified")
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.mark.parametrize("height", [1, 6])
def test_oddities(odd, height):
    got = run(odd, height=height)
    assert got == brute(plain(odd)) and len(got) == odd.count()
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_many_rounds_and_lone_leaves(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PACK", 2)
    rows = [(i, f"line {i}\nnext" if i % 3 else "one line", "en", "hot", i) for i in range(500)]
    rows += [(1000 + i, f"x\n{i}", None, f"s{i:03}", None) for i in range(40)] + [(5, "a\nb", "en", "", 1), (5, "a\nb", "en", "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert run(df, height=2) == brute(rows)


def test_one_row_and_none(spark, none):
    assert run(none) == []
    rows = [(4, "a\nb", "en", "s", 3)]
    df = spark.createDataFrame(rows, none.select("doc_id", "text", "lang", "source", "n_chars").schema)
    (got,) = run(df)
    assert got == brute(rows)[0] and got[1] == got[2] == got[3] and got[4] == h()


def test_versions_share_all_but_their_ancestors(odd):
    for r in query(odd).collect():
        assert copied_path(r.leaf, r.proof, r.places)[-1:] == ([r.root.encode()] if r.places else [])
        assert r.copied in (0, len(r.places) // 2 + 1)
        assert len(r.proof) == merkle.HEX * sum(int(n) - 1 for n in r.places[1::2])


def test_text_ids_and_bad_fan(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "y")], "doc_id string, source string")
    out = prove(df, leaf_digest("doc_id", "source"), F.lit(None).cast("string"))
    assert sorted(str(r.doc_id) for r in out.collect()) == ["None", "a", "b"] and out.where("not verified").isEmpty()
    with pytest.raises(ValueError):
        prove(df, leaf_digest("doc_id"), F.lit(None).cast("string"), fan=12)


def test_every_proof_is_folded(spark, monkeypatch):
    """Rows that are left as they are get their root from their leaf and siblings, too, not from the tree."""
    monkeypatch.setattr(merkle, "copied_path", lambda node, proof, places: [b"folded"])
    df = spark.createDataFrame([(i, "s", "a", i, str(i)) for i in range(5)], "doc_id long, source string, lang string, n_chars long, text string")
    got = prove(df, leaf_digest("doc_id", "text"), F.lit(None).cast("string")).collect()
    assert len(got) == 5 and all(r["folded_root"] == "folded" and not r["verified"] and r["copied"] == 0 for r in got)
