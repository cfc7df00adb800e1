"""Fingerprints: edited texts, entropy levels and likeness against plain computation."""

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa

from statloom.llm import fingerprint as P
from statloom.llm.text import text_bytes


def test_oddities(odd):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for (i, t), (_, n) in zip(rows, [*rows[1:], rows[0]]):
        q = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[:len(t) - q] + n[:q]).encode()).hexdigest()))
    got = P.neighbour_likeness(odd).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by_text = {}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t)
    for r in got:
        if len(texts[r["doc_id"]]) == 1:
            by_text.setdefault(next(iter(texts[r["doc_id"]])), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[""] == {""}


def test_single_and_empty(spark, none):
    assert P.neighbour_likeness(none).collect() == []
    r = P.neighbour_likeness(spark.createDataFrame([(5, "abcdefgh" * 40)], "doc_id long, text string")).collect()[0]
    assert r["near_next"] == 1.0


def test_levels_are_entropies():
    rng = np.random.default_rng(1)
    raw = np.concatenate([rng.integers(97, 110, 3000), np.full(200, 65), rng.integers(0, 256, 500)]).astype(np.uint8)
    got = P.levels(raw)
    for i in range(0, len(got), 13):
        c = Counter(raw[i:i + P.WINDOW].tolist())
        h = -sum(v / P.WINDOW * np.log2(v / P.WINDOW) for v in c.values()) / np.log2(P.WINDOW)
        assert abs(h * P.LEVELS - got[i]) <= 1.01


def test_features_by_definition():
    rng = np.random.default_rng(2)
    text = "".join(chr(x) for x in rng.integers(97, 120, 900))
    raw, off = text_bytes(pa.array(["\0" * P.SPAN, text, "\0" * P.SPAN]))
    ranks = P.ranks_of(P.level_counts(raw, off))
    row, h = P.features(raw, off, ranks)
    e = ranks[P.levels(raw[off[1]:off[2]])]
    votes = Counter()
    for s in range(-P.SPAN + 1, len(e)):
        inside = [(e[i], i) for i in range(max(0, s), min(len(e), s + P.SPAN)) if e[i] >= 0]
        if inside:
            votes[min(inside)[1]] += 1
    assert set(row) == {1} and len(h) == sum(v >= P.POPULAR for v in votes.values())


def test_batches_do_not_matter(odd):
    texts = [r["text"] or "" for r in odd.collect()]
    ranks = P.corpus_ranks(odd)
    assert P.fingerprints(texts, ranks) == [P.fingerprints([t], ranks)[0] for t in texts]
    got = {base64.b64decode(r["fingerprint"]) for r in P.fingerprint(odd, ranks=ranks).collect()}
    assert got == set(P.fingerprints(texts, ranks))


def test_likeness_follows_the_share(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join("".join(chr(c) for c in rng.integers(97, 123, rng.integers(2, 9))) for _ in range(n))
    a, b = text(800), text(800)
    raw, off = text_bytes(pa.array([a, b]))
    ranks = P.ranks_of(P.level_counts(raw, off))
    x, half, y = P.fingerprints([a, a[:len(a) // 2] + b[len(b) // 2:], b], ranks)
    assert P.likeness(x, x) == 1.0 and P.likeness(x, y) < 0.1 < 0.3 < P.likeness(x, half) < 0.8
    assert P.likeness(b"", b"") == 1.0 and P.likeness(x, b"") == 0.0 and P.likeness(x, y) == P.likeness(y, x)
