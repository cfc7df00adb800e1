"""Packing: pieces against the tokenizer itself, places gapless and few sequences."""

import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from statloom.llm.packing import pack, plan, sequences
from statloom.llm.tokenise import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "  a", "a  b", "a \nb\n\n c", "x　 y  z", "don't  'll we've", "tab\t x", "á 한글 12 3", "a ", "\n", " \n x", "<|endoftext|> a <|endoftext|>", "one two three", "😀 😀"]


def test_ids_are_the_tokenizers():
    tok, enc = Tokenizer.from_file(PATH), Encoder(PATH)
    assert enc.cut
    for t in TEXTS:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
    other = public_tokenizers.path("word_bpe_49k.json")
    assert np.frombuffer(Encoder(other).encode("Some words"), "<u4").tolist() == Tokenizer.from_file(other).encode("Some words", add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [16, 2048])
def test_oddities(odd, capacity):
    tok = Tokenizer.from_file(PATH)
    got = pack(odd, PATH, capacity).collect()
    want = []
    for r in odd.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    bound = -(-sum(w[3] for w in want) // capacity)
    assert len(seqs) <= 1.03 * bound + 1


def test_empty(none):
    assert pack(none, PATH).collect() == []


def test_sequences(spark):
    d = spark.createDataFrame([(1, "one two"), (2, "three"), (2, "three")], "doc_id long, text string")
    rows = sequences(pack(d, PATH, 8, ids=True)).collect()
    tok = Tokenizer.from_file(PATH)
    assert sum(len(r["ids"]) for r in rows) == sum(len(tok.encode(t).ids) + 1 for t in ("one two", "three", "three"))


@pytest.mark.parametrize("seed", range(6))
def test_plan_near_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([64, 300, 2048])
    lengths = [min(capacity, max(1, int(rng.lognormvariate(rng.uniform(2, 6), 1)))) for _ in range(3000)]
    counts = np.bincount(lengths, minlength=capacity + 1)
    runs, n = plan(counts, capacity)
    seqs, seen = {}, [0] * (capacity + 1)
    for length, at, times, first, offset in sorted(runs):
        assert at == seen[length]
        seen[length] += times
        for k in range(times):
            seqs.setdefault(first + k, []).append((offset, length))
    assert seen == counts.tolist() and len(seqs) == n
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    rooms, best = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        room = rooms.pop(i) if i < len(rooms) else capacity
        best += room == capacity
        if room > x:
            bisect.insort(rooms, room - x)
    assert n <= 1.02 * best + 2
