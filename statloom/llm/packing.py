"""Packing documents into sequences of a fixed length by linear grouping and best fit.

Only the histogram of piece lengths (at most `capacity` numbers, whatever the table) reaches the driver. There

1. the long lengths, in descending order, are cut into groups of equal cardinality and rounded up to the largest of
   their group;
2. the configurations (multisets of rounded sizes that fit a sequence) that need the fewest sequences are found by a
   linear program with columns generated by a knapsack;
3. actual lengths take the places of the rounded ones, the last place of a sequence the longest one that fits;
4. short lengths go by best fit, longest first, into what is left, and into new sequences when nothing is.

The result is a plan in runs: pieces lo..lo+n of one length go to sequences s..s+n at one offset. Every piece knows its
rank among those of its length, and looks its place up in the plan.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.frames import cut_lineage, need
from .text import bounded
from .tokenise import encoder

GROUPS = 48         # groups of equal cardinality
LONG = 3            # lengths above capacity / LONG are long

Run = tuple[int, int, int, int, int]    # length, first rank, count, first sequence, offset


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size stands in the configuration of the highest worth."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    s, w = sizes[order], worth[order]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = int(np.searchsorted(s, c, side="right"))
        if n:
            got = best[c - s[:n]] + w[:n]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], pick[c] = got[i], i
    out, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[order[pick[c]]] += 1
            c -= int(s[pick[c]])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(configuration, times) that cover the demand exactly; the linear optimum rounded down, the rest first fit."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    while True:
        x = np.linalg.solve(basis, demand.astype(float))
        y = np.linalg.solve(basis.T, np.ones(k))
        new = best_configuration(sizes, np.maximum(y, 0), capacity)
        if float(np.maximum(y, 0) @ new) <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, new.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    left, out = demand.copy(), []
    for j in np.argsort(-x, kind="stable"):
        c = np.rint(basis[:, j]).astype(np.int64)
        used = c > 0
        n = min(int(np.floor(max(x[j], 0) + 1e-6)), int((left[used] // c[used]).min()))
        if n > 0:
            out.append((c, n))
            left -= n * c
    bins: list[list] = []
    for g in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[g])):
            fit = [b for b in bins if b[0] >= sizes[g]]
            b = min(fit, key=lambda b: b[0]) if fit else None
            if b is None:
                bins.append(b := [capacity, np.zeros(k, dtype=np.int64)])
            b[0] -= int(sizes[g])
            b[1][g] += 1
    return out + [(c, 1) for _, c in bins]


def plan(counts: np.ndarray, capacity: int, groups: int = GROUPS) -> tuple[list[Run], int]:
    """Runs for counts[length] pieces of each length, and the number of sequences."""
    runs: list[Run] = []
    left, rank = counts.copy(), np.zeros(capacity + 1, dtype=np.int64)
    open_: dict[int, list[list[int]]] = defaultdict(list)      # room -> runs of sequences [first, count]
    floor = capacity // LONG
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, int(rank[length]), n, first, offset))
        rank[length] += n
        left[length] -= n

    if left[capacity]:
        sequences = int(left[capacity])
        put(capacity, sequences, 0, 0)
    sizes, demand = rounded(left, floor, capacity, groups)
    for config, times in configurations(sizes, demand, capacity) if len(sizes) else []:
        slots = [int(sizes[g]) for g in np.flatnonzero(config) for _ in range(int(config[g]))]
        slots.sort(reverse=True)
        bins = [[sequences, times, 0]]
        sequences += times
        for k, slot in enumerate(slots):
            nxt = []
            for first, n, used in bins:
                # The last place also has what rounding left over; an actual length may come from a larger group then.
                most = capacity - used if k == len(slots) - 1 else slot
                while n:
                    there = np.flatnonzero(left[floor + 1:most + 1])
                    if not len(there):
                        nxt.append([first, n, used])
                        break
                    length = floor + 1 + int(there[-1])
                    take = min(n, int(left[length]))
                    put(length, take, first, used)
                    nxt.append([first, take, used + length])
                    first, n = first + take, n - take
            bins = nxt
        for first, n, used in bins:
            if used < capacity:
                open_[capacity - used].append([first, n])
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            fit = min((r for r, v in open_.items() if v and r >= length), default=0)
            if not fit:
                new = -(-int(left[length]) // (capacity // length))
                open_[capacity].append([sequences, new])
                sequences += new
                continue
            first, n = open_[fit].pop()
            per = min(fit // length, int(left[length]))
            take = min(n, int(left[length]) // per)
            if take < n:
                open_[fit].append([first + take, n - take])
            for j in range(per):
                put(length, take, first, capacity - fit + j * length)
            if fit - per * length:
                open_[fit - per * length].append([first, take])
    return runs, sequences


def rounded(left: np.ndarray, floor: int, capacity: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and cardinalities of the long lengths, cut into groups of equal cardinality and rounded up."""
    length = np.arange(capacity - 1, floor, -1)
    n = left[length]
    before = np.cumsum(n) - n
    each = max(1, -(-int(n.sum()) // groups))
    length, n, before = length[n > 0], n[n > 0], before[n > 0]
    found: dict[int, int] = defaultdict(int)
    size = 0
    for at in range(len(length)):
        lo, hi = int(before[at]), int(before[at] + n[at])
        while lo < hi:
            if lo % each == 0:
                size = int(length[at])
            take = min(hi, (lo // each + 1) * each) - lo
            found[size] += take
            lo += take
    return np.array(sorted(found), dtype=np.int64), np.array([found[k] for k in sorted(found)], dtype=np.int64)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is the tokens of its text and `end_id`; one longer than `capacity` is cut into pieces of that length,
    the first of which may be shorter. `part` and `rank` number the pieces of each length inside a task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in bounded(batches):
            rows: list[tuple] = []
            for i, text in enumerate(b.column(1).to_pylist()):
                packed = enc.encode(text or "") + end
                n = len(packed) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    own = packed[4 * lo:4 * hi]
                    rows.append((i, k, lo, hi - lo, zlib.crc32(own), int(seen[hi - lo]), own))
                    seen[hi - lo] += 1
            at, k, lo, n, crc, rank, own = zip(*rows)
            cols = [b.column(0).take(pa.array(at, pa.int32())), pa.array(k, pa.int32()), *[pa.array(x, pa.int64()) for x in (lo, n, crc)], pa.array([part] * len(k), pa.int32()), pa.array(rank, pa.int64())]
            if ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in own], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *(["ids"] if ids else [])]
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint" + ", ids array<bigint>" * ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, groups: int = GROUPS) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there, gapless from 0.

    A null text is an empty one and has the end token alone. Rows that repeat a doc_id are packed each by itself. A null
    doc_id is packed like any other. Other columns are ignored. An empty table gives no rows. With `ids` the token ids
    come along; `sequences` then puts the sequences together.
    """
    need(docs, id_col, text_col)
    cut = cut_lineage(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, ids))
    sizes = cut_lineage(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():     # at most `capacity` rows
        counts[r["length"]] = r["n"]
    runs, _ = plan(counts, capacity, groups)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(table)                   # its size depends on `capacity` alone

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("part", "length", before.alias("base"))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    ranked = ranked.select(*keep, "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        key = t[:, 0].astype(np.float64) * 2.0 ** 40 + t[:, 1] if len(t) and t[:, 1].max() < 1 << 40 else None
        first = {int(v): (int(i), int(j)) for v, i, j in zip(*np.unique(t[:, 0], return_index=True), np.append(np.unique(t[:, 0], return_index=True)[1][1:], len(t)))}
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(len(keep)).to_numpy()
            if key is not None:
                at = np.searchsorted(key, length * 2.0 ** 40 + rank, side="right") - 1
            else:
                at = np.array([first[n][0] + np.searchsorted(t[first[n][0]:first[n][1], 1], r, side="right") - 1 for n, r in zip(length.tolist(), rank.tolist())], dtype=np.int64)
            cols = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(t[at, 3] + rank - t[at, 1]), pa.array(t[at, 4])], [*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, doc_ids, ids) of a packing with ids; a sequence is at most `capacity` tokens."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("r")).select("sequence_id", F.col("r.doc_id").alias("doc_ids"), F.flatten("r.ids").alias("ids"))
