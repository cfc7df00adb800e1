"""Exact top-k by inner product: tiles of queries times shards, partial selection, merging by a tree.

Queries are packed into blocks of at most `BLOCK` rows, candidates into shards of at most `SHARD` rows, each one row of a
table that holds a matrix. Shards are dealt evenly to salts, every block goes to every salt, and the join by salt lines
up each block with each shard once; so the queries move once per salt and the candidates once in all, and no side is
broadcast. A tile's product is taken by float64 where it is exact (all partial sums below 2**53) and by whole numbers
otherwise, and keeps k rows a query. Groups of `FAN` lists are merged at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.frames import cut_lineage, need

BLOCK, SHARD, FAN = 1024, 4096, 32
SALT_SHARDS = 8         # shards of a salt, about
LONGEST = 2 ** 63 - 1


def packed(vectors: DataFrame, most: int) -> DataFrame:
    """Rows (id, vec array<double>) as (piece, n, dim, ids, data): runs of at most `most` vectors of one length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        part, made = TaskContext.get().partitionId(), 0

        def out(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, vecs = zip(*held.pop(dim))
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([len(ids)]), pa.array([dim]), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([np.concatenate([*vecs, np.zeros(0)]).astype("<f8").tobytes()])], names)

        for b in batches:
            vec = b.column(1)
            flat, at = vec.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(vec.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            for i, key in enumerate(b.column(0).to_pylist()):
                dim = int(at[i + 1] - at[i])
                rows = held.setdefault(dim, [])
                rows.append((key, flat[at[i]:at[i + 1]]))
                if len(rows) == most:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    names = ["piece", "n", "dim", "ids", "data"]
    return vectors.mapInArrow(run, "piece bigint, n bigint, dim bigint, ids binary, data binary")


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole-number inner products, exact; those beyond a long are held at its ends."""
    big = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if big < 2.0 ** 53:
        return (q @ c.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in c.tolist()]
    return np.array([[max(-LONGEST - 1, min(LONGEST, sum(int(a) * b for a, b in zip(row, v)))) for v in whole] for row in q.tolist()], dtype=np.int64)


def top_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of one query, ties to the smaller id."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= edge)
        score, ids = score[near], ids[near]
    order = np.lexsort((ids, -score.astype(object) if score.size and score.min() == -LONGEST - 1 else -score))[:k]
    return score[order], ids[order]


def _tiles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            qi, ci = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
            s = scores(np.frombuffer(r["q_data"], "<f8").reshape(len(qi), r["dim"]), np.frombuffer(r["data"], "<f8").reshape(len(ci), r["dim"]))
            rows: list[tuple] = []
            for i, own in enumerate(qi.tolist()):
                other = ci != own
                best, ids = top_of(s[i][other], ci[other], k) if not other.all() else top_of(s[i], ci, k)
                rows += [(own, r["piece"], int(v), int(x)) for x, v in zip(best, ids)]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "piece", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The k highest inner products of each query with all other rows: query_id, rank, vec_id, score.

    Components become floor(scale * x), x as double. Rows take no part if the id or the vector is null or a component
    is null or not finite. Vectors are compared with those of their own length (an empty one scores 0). A query is
    never met by rows that carry its id; other repeated rows are candidates each, and repeated query rows count once.
    Fewer than k rows come back where there are fewer candidates. Ties go to the smaller id, then to either row.
    """
    need(vectors, id_col, vec_col)
    good = (vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("x"))
            .where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(2)
            flat = np.floor(scale * vec.flatten().to_numpy(zero_copy_only=False))
            at = np.concatenate([[0], np.cumsum(vec.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["id", "is_query", "vec"])

    good = good.mapInArrow(whole, "id bigint, is_query boolean, vec array<double>")
    asked = good.where("is_query").select("id", "vec").dropDuplicates(["id", "vec"])
    asked = cut_lineage(asked)
    blocks = cut_lineage(packed(asked.repartition(max(1, -(-asked.count() // BLOCK))), BLOCK))
    shards = cut_lineage(packed(good.select("id", "vec"), SHARD))
    n = shards.count()
    salts = max(1, -(-n // SALT_SHARDS), min(n, vectors.sparkSession.sparkContext.defaultParallelism))
    left = blocks.select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("dim").alias("q_dim"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    right = shards.withColumn("salt", F.pmod(F.xxhash64("piece"), F.lit(salts)).cast("int"))
    met = right.join(left, (right["salt"] == left["salt"]) & (F.col("dim") == F.col("q_dim"))).select("piece", "dim", "ids", "data", "q_ids", "q_data")
    lists = met.mapInArrow(lambda it: _tiles(it, k), "query_id bigint, piece bigint, vec_id bigint, score bigint")
    order = [F.col("score").desc(), F.col("vec_id")]
    while n > FAN:
        n = -(-n // FAN)
        w = Window.partitionBy("query_id", "piece").orderBy(*order)
        lists = lists.withColumn("piece", F.pmod(F.xxhash64("piece", F.lit(n)), F.lit(n))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    w = Window.partitionBy("query_id").orderBy(*order)
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
