"""Document fingerprints of improbable features.

Every window of `WINDOW` bytes has an entropy; the rarer its entropy (in tenths of a per cent) among all windows of the
corpus, the lower its rank. A window that is the leftmost of the lowest rank in at least `POPULAR` of the `SPAN`
neighbourhoods (runs of `SPAN` windows) that hold it is a feature. Features, in text order and each once, set `HASHES` bits in Bloom filters of
`BITS` bits, `PER_FILTER` features to a filter, as many filters as needed. Two fingerprints are compared filter by
filter: the overlap of the bits, less what chance gives, over its possible range.

Windows' entropies come from running sums: when the window moves, only the counts of the byte that leaves and of the one
that enters change, and these counts are sums of WINDOW - 1 shifted comparisons of the whole run of bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.frames import need
from .text import bounded, mix, text_bytes

WINDOW = 32             # bytes of a window
SPAN, POPULAR = 64, 16  # neighbouring windows, and how often a feature must be the lowest
LEVELS = 1000
TRIVIAL = 100           # windows below this level (long runs of a byte) are no features
BITS, HASHES, PER_FILTER = 2048, 5, 160
ABOVE_CHANCE = 0.05     # of the range between chance and all; unrelated filters stay below it
BLOCK = 1 << 18

_G = np.round(np.array([0.0, *(c * np.log2(c) for c in range(1, WINDOW + 1))]) * (1 << 20)).astype(np.int64)
_STEP = np.diff(_G)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def levels(raw: np.ndarray) -> np.ndarray:
    """Entropy level (0 to LEVELS) of the window that starts at each byte; len(raw) - WINDOW + 1 of them."""
    n = len(raw)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        for d in range(1, WINDOW):
            a = max(lo, d)
            if a >= hi:
                break
            same = (raw[a:hi] == raw[a - d:hi - d]).view(np.uint8)
            before[a:hi] += same
            after[a - d:hi - d] += same
    first = np.bincount(raw[:WINDOW], minlength=256)
    move = _STEP[before[WINDOW:]] - _STEP[after[:n - WINDOW]]
    s = np.concatenate([[0], np.cumsum(move)]) + _G[first].sum()
    top = int(_G[WINDOW])
    return ((top - s) * LEVELS // top).astype(np.int64)


def _inside(off: np.ndarray, lo: int, n: int) -> np.ndarray:
    """Which of the windows that start at lo..lo+n lie within one row."""
    edge = np.zeros(n + 1, np.int64)
    inner = off[1:-1]
    np.add.at(edge, np.clip(inner - WINDOW + 1 - lo, 0, n), 1)
    np.add.at(edge, np.clip(inner - lo, 0, n), -1)
    return np.cumsum(edge)[:n] == 0


def level_counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many windows of the rows have each level."""
    out = np.zeros(LEVELS + 1, np.int64)
    for lo in range(0, max(0, len(raw) - WINDOW + 1), BLOCK):
        seg = raw[lo:lo + BLOCK + WINDOW - 1]
        if len(seg) >= WINDOW:
            e = levels(seg)
            out += np.bincount(e[_inside(off, lo, len(e))], minlength=LEVELS + 1)
    return out


def ranks_of(count: np.ndarray) -> np.ndarray:
    """Rank of each level, the rarest first; trivial ones have none (-1)."""
    order = np.lexsort((np.arange(len(count)), count))
    out = np.empty(len(count), np.int64)
    out[order] = np.arange(len(count))
    out[:TRIVIAL] = -1
    return out


def features(raw: np.ndarray, off: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit feature) of all features of the rows, in order. Rows must be SPAN bytes apart to be independent."""
    halo, none = SPAN - 1, 1 << 20
    at_all = []
    for lo in range(0, max(0, len(raw) - WINDOW + 1), BLOCK):
        a, b = max(0, lo - halo), min(len(raw), lo + BLOCK + halo + WINDOW - 1)
        e = levels(raw[a:b])
        r = ranks[e]
        r = np.where((r >= 0) & _inside(off, a, len(e)), r, none)
        key = (r << 32) | np.arange(len(r))
        low = np.concatenate([np.full(halo, none << 32), key, np.full(halo, none << 32)])
        for d in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[:-d], low[d:])
        chosen = low[low < none << 32] & 0xFFFFFFFF
        popular = np.flatnonzero(np.bincount(chosen, minlength=len(r)) >= POPULAR) + a
        at_all.append(popular[(popular >= lo) & (popular < lo + BLOCK)])
    at = np.concatenate([*at_all, np.zeros(0, np.int64)]).astype(np.int64)
    h = np.zeros(len(at), np.uint64)
    for k in range(0, len(at), 1 << 16):
        w = raw[at[k:k + (1 << 16), None] + np.arange(WINDOW)].view("<u8")
        part = h[k:k + (1 << 16)]
        for j in range(w.shape[1]):
            part[:] = mix(part * _BASE ^ w[:, j])
    return np.searchsorted(off, at, side="right") - 1, h


def _eights(raw: np.ndarray) -> np.ndarray:
    """Hashes of the distinct windows of eight bytes (of all bytes, if fewer)."""
    n = max(1, len(raw) - 7)
    code = np.full(n, len(raw) if len(raw) < 8 else 8, np.uint64)
    for k in range(min(8, len(raw))):
        code = mix(code * _BASE ^ raw[k:k + n].astype(np.uint64))
    return np.unique(code)


def fingerprints(texts: list[str], ranks: np.ndarray) -> list[bytes]:
    """The chained filters of each text. A text without features has its windows of eight bytes instead, an empty one no filter."""
    apart = "\0" * SPAN      # its windows are trivial
    raw, off = text_bytes(pa.array([x for t in texts for x in (t, apart)], pa.large_string()))
    row, h = features(raw, off, ranks)
    row, off = row // 2, np.stack([off[:-1:2], off[1::2]])
    size = off[1] - off[0]
    bare = np.flatnonzero((size > 0) & (np.bincount(row, minlength=len(size)) == 0))
    short = [_eights(raw[off[0, i]:off[1, i]]) for i in bare]
    row, h = np.concatenate([row, np.repeat(bare, [len(x) for x in short])]), np.concatenate([h, *short])
    _, first = np.unique(np.stack([row.astype(np.uint64), h], axis=1), axis=0, return_index=True) if len(row) else (None, np.zeros(0, int))
    first = first[np.lexsort((first, row[first]))]
    row, h = row[first], h[first]
    n = np.bincount(row, minlength=len(size))
    filters = -(-n // PER_FILTER)
    base = np.concatenate([[0], np.cumsum(filters)])
    nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n)])[row]
    bits = np.zeros((base[-1], BITS), np.uint8)
    for j in range(HASHES):
        bits[base[row] + nth // PER_FILTER, ((h >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1)
    return [packed[base[i]:base[i + 1]].tobytes() for i in range(len(size))]


def likeness(x: bytes, y: bytes) -> float:
    """0 to 1: how well each filter of the shorter chain finds its like in the other; 1 for equal ones."""
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    a, b = (np.frombuffer(z, "<u8").reshape(-1, BITS // 64) for z in sorted((x, y), key=lambda z: (len(z), z)))
    na, nb = (np.bitwise_count(z).sum(axis=1).astype(np.float64) for z in (a, b))
    best = np.zeros(len(a))
    step = max(1, (1 << 20) // max(1, b.size))
    for lo in range(0, len(a), step):
        both = np.bitwise_count(a[lo:lo + step, None, :] & b[None]).sum(axis=2).astype(np.float64)
        chance, most = na[lo:lo + step, None] * nb[None] / BITS, np.minimum(na[lo:lo + step, None], nb[None])
        floor = chance + ABOVE_CHANCE * (most - chance)
        best[lo:lo + step] = np.clip((both - floor) / np.maximum(most - floor, 1e-9), 0, 1).max(axis=1)
    return round(float((best * na).sum() / na.sum()), 6)


def edited(text: str, nxt: str) -> str:
    """The text with its last quarter (rounded down) replaced by the beginning of the next text."""
    q = len(text) // 4
    return text[:len(text) - q] + nxt[:q]


def corpus_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks of the entropy levels over all windows of all texts (LEVELS + 1 numbers on the driver)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for b in bounded(batches, most=1 << 20):
            total += level_counts(*text_bytes(b.column(0)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["level", "n"])

    count = np.zeros(LEVELS + 1, np.int64)
    for r in docs.select(F.col(text_col).alias("text")).mapInArrow(run, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect():
        count[r["level"]] = r["n"]
    return ranks_of(count)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """(doc_id, fingerprint): base64 of the chained filters, '' for null and empty texts. Equal texts have equal ones.

    `ranks` from `corpus_ranks` of another table make fingerprints comparable with that table's.
    """
    need(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs, text_col) if ranks is None else ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, most=1 << 20):
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([base64.b64encode(x).decode() for x in fingerprints(texts, shared.value)])], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def _in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (bucket, guest, k, doc_id, text): id ranges as buckets, each followed by the first document after it.

    Range ends are quantiles of the ids, so the driver has some numbers for each of 2 * parts buckets.
    """
    low = -(1 << 63)
    d = docs.withColumn("k", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(low)))
    cuts = 2 * parts
    got = d.select("k").agg(F.percentile_approx("k", [i / cuts for i in range(1, cuts)], 10000)).collect()[0][0] if cuts > 1 else None
    bounds = sorted(set(got or []))
    longs = lambda v: "array(" + ", ".join("cast(null as bigint)" if x is None else f"cast('{x}' as bigint)" for x in v) + ")"
    # The number of bounds up to k, by bisection.
    half = f"if(a.lo >= a.hi, a, if({longs(bounds)}[(a.lo + a.hi) div 2] <= k, named_struct('lo', (a.lo + a.hi) div 2 + 1L, 'hi', a.hi), named_struct('lo', a.lo, 'hi', (a.lo + a.hi) div 2)))"
    bucket = F.expr(f"cast(aggregate(sequence(1, {len(bounds).bit_length()}), named_struct('lo', 0L, 'hi', {len(bounds)}L), (a, s) -> {half}, a -> a.lo) as int)") if bounds else F.lit(0)
    d = d.withColumn("own", bucket)
    heads = sorted((r["own"], r["k"]) for r in d.groupBy("own").agg(F.min("k").alias("k")).collect())
    if not heads:
        return d.select(F.col("own").alias("bucket"), F.lit(0).alias("guest"), "k", "doc_id", "text")
    first, before = [None] * (len(bounds) + 1), [None] * (len(bounds) + 1)
    for (b, k), (prior, _) in zip(heads, [heads[-1], *heads[:-1]]):
        first[b], before[b] = k, prior
    guest = F.expr(f"if({longs(first)}[own] = k, named_struct('bucket', cast({longs(before)}[own] as int), 'guest', 1), null)")
    places = F.array_compact(F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("guest")), guest))
    return d.select(F.explode(places).alias("p"), "k", "doc_id", "text").select("p.bucket", "p.guest", "k", "doc_id", "text")


def neighbour_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    The edited form has the last quarter replaced by the beginning of the next document in ascending id, after the last
    by that of the first. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next, one row per input row. Ids are whole numbers; null ones come first. Rows that repeat an id follow each
    other by text. A null text is empty; an empty one has the fingerprint '' and is like empty ones only. A single
    document is its own next one. Other columns are ignored. An empty table gives no rows.
    """
    need(docs, id_col, text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(corpus_ranks(d))
    parts = min(5000, int(spark.conf.get("spark.sql.shuffle.partitions")))     # texts stream through a task, however many it has
    ordered = _in_order(d, parts).repartition(F.col("bucket")).sortWithinPartitions("bucket", "guest", "k", "text").select("guest", "doc_id", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in bounded(batches, most=1 << 19):
            texts = b.column(2).to_pylist()
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, fingerprints(texts, shared.value)))
            if held is not None:
                rows.insert(0, held)
            held = rows[-1]
            pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[0]]
            new = [edited(x[2], y[2]) for x, y in pairs]
            if pairs:
                made = fingerprints(new, shared.value)
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[1] for x, _ in pairs]).cast(b.column(1).type), pa.array([len(x[2]) for x, _ in pairs], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                    pa.array([base64.b64encode(x[3]).decode() for x, _ in pairs]), pa.array([base64.b64encode(m).decode() for m in made]),
                    pa.array([likeness(x[3], m) for (x, _), m in zip(pairs, made)]), pa.array([likeness(x[3], y[3]) for x, y in pairs])], names)

    return ordered.mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
