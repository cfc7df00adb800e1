"""MinHash near-duplicates by bottom-k sketches of one hash function.

A document's set is its distinct word shingles. Its sketch is the `k` smallest hashes of the set. The steps:

1. Documents with the same set are one *class*; all that follows works on classes, so copies cost nothing more.
2. Inverted lists of the retained values give each pair of classes its shared values. A value is *frequent* when more
   than `long_list` classes retain it. Frequent values are left out of the lists, and the next smallest others step in,
   so every list is short and pairs are few, however often a passage or a line repeats.
3. The ranks of the shared values in both lists tell which of them lie in the bottom of the union; their share is the
   union-sketch estimate of the likeness. Pairs far below the threshold go.
4. The texts of the remaining pairs meet, one side at a time, and the exact likeness of the full sets decides.
5. Classes whose sketches consist of frequent values in the main (large families of near copies) take `keys` minima of
   re-hashed sketches as group keys, and are compared inside the groups by tiles of a bounded number of texts: first
   tiles along the diagonal of some keys, then, under every key, all classes that the first tiles and step 4 left
   outside the group's largest component against the whole group. A pair inside one component is never looked at, and a
   tile returns no more than a spanning forest of its links, so families make no quadratic number of rows.
6. Components of the links, smallest doc_id first.

No pair is capped. The retained values decide which pairs meet: a pair at the threshold is missed with a probability
below 1e-8 (32 draws that each hit with 1/2 at least, of which 2 must, or 20 keys).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.frames import cut_lineage, need
from .components import components
from .text import bounded, list_array, mix, shingle_hashes

K = 64              # retained values of a class
LISTED = 32         # of these, values in inverted lists
LONG_LIST = 32      # classes in a list beyond which its value is frequent
KEYS = 20           # group keys of classes with frequent values in the main
FIRST_KEYS = 4      # of these, keys compared along the diagonal first
TILE_ROWS, TILE_SHINGLES = 1024, 400_000


def sets_of(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, at = shingle_hashes(column, words)
    return [np.unique(h[at[i]:at[i + 1]]) for i in range(len(at) - 1)]


def _digest(s: np.ndarray) -> bytes:
    one = mix(s ^ np.uint64(0x5851F42D4C957F2D))
    return np.array([len(s), s.sum(dtype=np.uint64), one.sum(dtype=np.uint64)], dtype=np.uint64)[1:].tobytes() + np.uint32(len(s)).tobytes()


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, digest of the set or null if empty, sketch ascending)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            sets = sets_of(b.column(1), words)
            low = [s[:k].view(np.int64) for s in sets]
            at = np.concatenate([[0], np.cumsum([len(x) for x in low])])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                 list_array(np.concatenate([*low, np.zeros(0, np.int64)]), at)], ["doc_id", "n_shingles", "digest", "sketch"])

    # mapInArrow hands each batch's sets over at once; the sketch holds unsigned hashes, so order is kept by position.
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_shingles bigint, digest binary, sketch array<bigint>")


def _pairs(listed: DataFrame, share: int) -> DataFrame:
    """Pairs of classes that the lists bring together, filtered by size and by the union-sketch estimate."""
    post = listed.select("nid", "n", F.size("vals").alias("m"), F.posexplode("vals").alias("r", "v"))
    lists = (post.groupBy("v").agg(F.collect_list(F.struct("nid", "n", "m", (F.col("r") + 1).alias("r"))).alias("l"))
             .where("size(l) > 1").select("v", F.array_sort("l").alias("l")))
    fits = f"100 * least(x.n, y.n) >= {share} * greatest(x.n, y.n)"
    met = lists.select("v", F.expr(f"explode(flatten(transform(l, (x, i) -> transform(filter(slice(l, i + 2, size(l)), y -> {fits}), y -> struct(x.nid as a, y.nid as b, x.m as ma, y.m as mb, x.r + y.r as rr)))))").alias("p")).select("v", "p.*")
    # Values are unsigned: the order along the union follows the summed ranks as well, which only grow.
    got = met.groupBy("a", "b").agg(F.first("ma").alias("ma"), F.first("mb").alias("mb"), F.sort_array(F.collect_list("rr")).alias("rr"))
    hits = F.expr(f"size(filter(transform(rr, (r, i) -> r - i - 1), u -> u <= {LISTED}))")
    union = F.least(F.lit(LISTED), F.col("ma") + F.col("mb") - F.size("rr"))
    return got.where(hits >= F.greatest(F.lit(1), F.floor(union / 16))).select("a", "b")


def _verify(pairs: DataFrame, texts: DataFrame, words: int, share: int) -> DataFrame:
    """The pairs whose full sets are alike: left's text comes once, then those of its partners, in a stream."""
    left = pairs.select(F.col("a").alias("nid")).distinct().join(texts, "nid").select(F.col("nid").alias("a"), F.lit(-1).cast("bigint").alias("b"), "text")
    right = pairs.join(texts, pairs["b"] == texts["nid"]).select("a", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for b in bounded(batches):
            sets = sets_of(b.column(2), words)
            hit = []
            for x, y, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), sets):
                if y < 0:
                    at, own = x, s
                elif x == at:
                    both = _common(own, s)
                    if 100 * both >= share * (len(own) + len(s) - both):
                        hit.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hit], pa.int64()) for i in (0, 1)], ["a", "b"])

    return left.union(right).repartition(F.col("a")).sortWithinPartitions("a", "b").mapInArrow(run, "a bigint, b bigint")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def tile_links(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, share: int) -> list[tuple[int, int]]:
    """Index pairs (row, col) of sets that are alike, all of them, by blocked products of incidence matrices."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), size)
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    new = np.cumsum(times > 1) - 1
    col, owner = new[col[shared]], owner[shared]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    both = np.zeros((len(rows), len(cols)), dtype=np.float32)
    row_at, col_at = np.full(len(sets), -1), np.full(len(sets), -1)
    row_at[rows], col_at[cols] = np.arange(len(rows)), np.arange(len(cols))
    step = 4096
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        i, j = np.searchsorted(col, [lo, lo + step])
        c, o = col[i:j] - lo, owner[i:j]
        left, right = np.zeros((len(rows), step), np.float32), np.zeros((len(cols), step), np.float32)
        r = row_at[o] >= 0
        left[row_at[o[r]], c[r]] = 1
        r = col_at[o] >= 0
        right[col_at[o[r]], c[r]] = 1
        both += left @ right.T
    union = size[rows][:, None] + size[cols][None, :] - both
    ok = (100 * both >= share * union) & (size[rows] > 0)[:, None]
    return [(int(rows[i]), int(cols[j])) for i, j in zip(*np.nonzero(ok)) if rows[i] != cols[j]]


def forest(links: list[tuple[int, int]], label: list[int]) -> list[tuple[int, int]]:
    """The links that join what the labels and the links before them have not joined."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    out = []
    for i, j in links:
        a, b = root(label[i]), root(label[j])
        if a != b:
            up[a] = b
            out.append((i, j))
    return out


def _tiles(rows: DataFrame, texts: DataFrame, words: int, share: int) -> DataFrame:
    """Links in tiles: rows (tile, nid, comp, side); side 0 is compared with side 1, or with itself if 1 is missing."""
    full = rows.join(texts, "nid").select("tile", "nid", "comp", "side", "text")

    def run(_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nid, comp, side = (table.column(c).to_numpy() for c in ("nid", "comp", "side"))
        sets = sets_of(table.column("text"), words)
        rows = np.flatnonzero(side == 0)
        cols = np.flatnonzero(side == 1) if (side == 1).any() else rows
        links = [(i, j) for i, j in tile_links(sets, rows, cols, share) if comp[i] != comp[j]]
        hit = forest(links, comp.tolist())
        return pa.table({"a": pa.array([int(nid[i]) for i, _ in hit], pa.int64()), "b": pa.array([int(nid[j]) for _, j in hit], pa.int64())})

    return full.groupBy("tile").applyInArrow(run, "a bigint, b bigint")


def _chunks(keyed: DataFrame) -> DataFrame:
    """(r, key, chunks): parts of about TILE_ROWS rows and TILE_SHINGLES shingles that each group is cut into."""
    many = F.greatest(F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum("n") / TILE_SHINGLES))
    return keyed.groupBy("r", "key").agg(many.alias("chunks"), F.count(F.lit(1)).alias("c"))


def _numbered(keyed: DataFrame, chunks: DataFrame) -> DataFrame:
    return keyed.join(chunks.drop("c"), ["r", "key"]).withColumn("chunk", F.pmod(F.xxhash64("nid", F.lit(17)), F.col("chunks")))


def _families(crowded: DataFrame, links: DataFrame, texts: DataFrame, words: int, share: int) -> DataFrame:
    """Edges that tie the same classes together as the links given and those among classes of frequent values do."""
    key = "array_min(transform(sketch, v -> xxhash64(v, {r})))"
    keyed = crowded.select("nid", "n", F.posexplode(F.array(*[F.expr(key.format(r=r)) for r in range(KEYS)])).alias("r", "key"))
    keyed = cut_lineage(_numbered(keyed, _chunks(keyed).where("c > 1")))
    diagonal = keyed.where(F.col("r") < FIRST_KEYS).select(F.xxhash64("r", "key", "chunk").alias("tile"), "nid", F.col("nid").alias("comp"), F.lit(0).alias("side"))
    links = cut_lineage(links.union(_tiles(diagonal, texts, words, share)))
    label = cut_lineage(components(links))
    keyed = cut_lineage(keyed.join(label.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("label", "nid")).drop("label"))
    parts = keyed.groupBy("r", "key", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = parts.groupBy("r", "key").agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select(F.col("r").alias("mr"), F.col("key").alias("mk"), F.col("top.comp").alias("main"))
    apart = keyed.join(main, (F.col("r") == F.col("mr")) & (F.col("key") == F.col("mk")) & (F.col("comp") != F.col("main")))
    apart = cut_lineage(apart.select("r", "key", "nid", "n", "comp", F.col("chunks").alias("against")))
    sizes = _chunks(apart)
    # Tile (i, j) of a group holds the i-th part of those outside its largest component and the j-th part of all.
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    rows = _numbered(apart, sizes).select("r", "key", "nid", "comp", F.lit(0).alias("side"), F.col("chunk").alias("i"), upto("against").alias("j"))
    cols = keyed.drop("chunks").join(sizes, ["r", "key"]).select("r", "key", "nid", "comp", F.lit(1).alias("side"), upto("chunks").alias("i"), F.col("chunk").alias("j"))
    tiles = rows.union(cols).select(F.xxhash64("r", "key", "i", "j").alias("tile"), "nid", "comp", "side")
    # The labels tie together what the links so far have tied.
    return label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(_tiles(tiles, texts, words, share))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: int = 75) -> DataFrame:
    """Every document with its set size and its near-duplicate component.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable over links of likeness >= share / 100, itself
    included) and kept (doc_id = component_id), one row per input row. A null or wordless text has an empty set, is
    linked with nothing and stays its own component. Texts may be of any length. Ties do not matter: a link or none.
    Rows that repeat a doc_id are documents of their own, which have the same text's row values if their texts agree;
    a null doc_id is a member like any other but never names a component nor is kept, unless all of it is null (then
    component_id is null). Other columns are ignored, so their names cannot clash. An empty table gives no rows.
    """
    need(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    members = cut_lineage(sketches(docs, id_col, text_col, words))
    classes = members.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut_lineage(classes.withColumn("nid", F.monotonically_increasing_id()))
    frequent = cut_lineage(classes.select(F.explode("sketch").alias("v")).groupBy("v").count().where(F.col("count") > LONG_LIST).select("v"))
    # Every retained value stays a row of its own, frequent or not, so the rows follow the classes alone.
    kept = classes.select("nid", "n", F.size("sketch").alias("k"), F.posexplode("sketch").alias("r", "v")).join(frequent.withColumn("hot", F.lit(True)), "v", "left")
    split = kept.groupBy("nid").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.sort_array(F.collect_list(F.when(F.col("hot").isNull(), F.struct("r", "v")))).alias("left"))
    split = cut_lineage(split.select("nid", "n", "k", F.col("left.v").alias("vals")))
    pairs = cut_lineage(_pairs(split.select("nid", "n", F.slice("vals", 1, LISTED).alias("vals")), share))
    crowded = cut_lineage(classes.join(split.where("2 * size(vals) < k").select("nid"), "nid", "left_semi").select("nid", "n", "sketch"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("nid")).union(crowded.select("nid")).distinct()
    reps = wanted.join(classes.select("nid", "rep", "digest"), "nid")
    repeated = cut_lineage(members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"))
    texts = cut_lineage(_class_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), reps, repeated, words))
    links = _verify(pairs, texts, words, share)
    if not crowded.isEmpty():
        links = _families(crowded, cut_lineage(links), texts, words, share)
    label = cut_lineage(components(links))
    of = classes.select("nid", "digest", "rep").join(label.withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    first = of.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = of.join(first, "label").select("digest", "component_id")
    out = members.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).cast(kind))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _class_texts(docs: DataFrame, reps: DataFrame, repeated: DataFrame, words: int) -> DataFrame:
    """(nid, text) of the classes in reps (nid, rep, digest), from docs (id, text).

    A class's first document is looked up by its id, one row for one class. Rows whose id is null or repeats are not told
    apart by it: among these, which may be many, the digest of the text is the key. Texts are dealt by id at every size.
    """
    once = reps.join(repeated, F.col("rep").eqNullSafe(F.col("doc_id")), "left_anti")
    found = docs.hint("merge").join(once.hint("merge"), F.col("id") == F.col("rep")).select("nid", "text")
    if repeated.isEmpty():
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) if len(s) else None for s in sets_of(b.column(0), words)], pa.binary()), b.column(0)], ["d", "text"])

    others = docs.join(repeated, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").select("text").mapInArrow(run, "d binary, text string")
    again = reps.join(repeated, F.col("rep").eqNullSafe(F.col("doc_id")), "left_semi")
    return found.union(again.join(others, F.col("digest") == F.col("d")).select("nid", "text").dropDuplicates(["nid"]))
