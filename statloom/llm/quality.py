"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text is counted into hashed terms: its words, the trigrams of its character classes, and repetitions of words nearby.
Square roots of relative frequencies, weighted by rarity among the labelled texts, are projected on the leading
directions of the labelled texts. The labelled vectors are a bounded sample (`PER_LABEL` rows of each label, seeded by
a digest of the id) and are broadcast; every document meets all of them in blocked cosine products, and the labels of
the `NEIGHBOURS` nearest vote, weighted by a power of the cosine and by what their label's sample stands for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.frames import need, rows_frame
from .text import LOWER, bounded, mix, span_hashes, text_bytes, word_spans

PER_LABEL = 3000        # labelled rows of each label in the model, at most
LATENT = 64             # directions
NEIGHBOURS, POWER = 25, 8
WORDS, SHAPES, REPEATS = 1024, 1000, 8
TERMS = WORDS + SHAPES + REPEATS
NEAR = (1, 2, 3, 4)     # a word that occurred so many words before
BLOCK = 512

#: Character classes: 0 other bytes, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 beyond ASCII; the rest by itself.
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[ord("a"):ord("z") + 1], CLASS[ord("A"):ord("Z") + 1], CLASS[ord("0"):ord("9") + 1] = 1, 2, 3
CLASS[32], CLASS[9:14], CLASS[128:] = 4, 5, 6
for _i, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    CLASS[_c] = 7 + _i


def counts(column: pa.Array) -> np.ndarray:
    """Term counts of each text."""
    raw, off = text_bytes(column)
    n = len(off) - 1
    out = np.zeros(n * TERMS)
    if len(raw) == 0:
        return out.reshape(n, TERMS).astype(np.float32)
    starts, ends, bounds = word_spans(raw, off)
    h = span_hashes(LOWER[raw], starts, ends)
    row = np.repeat(np.arange(n), np.diff(bounds))
    out += np.bincount(row * TERMS + (h % np.uint64(WORDS)).astype(np.int64), minlength=len(out))
    for i, d in enumerate(NEAR):
        same = np.flatnonzero((h[d:] == h[:-d]) & (row[d:] == row[:-d]))
        out += np.bincount(row[same] * TERMS + WORDS + SHAPES + i, minlength=len(out))
    if len(raw) > 2:
        c = CLASS[raw].astype(np.uint64)
        code = (c[:-2] << np.uint64(16)) | (c[1:-1] << np.uint64(8)) | c[2:]
        at = np.repeat(np.arange(n), np.diff(off))
        inside = at[:-2] == at[2:]
        shape = (mix(code) % np.uint64(SHAPES)).astype(np.int64)
        out += np.bincount(at[:-2][inside] * TERMS + WORDS + shape[inside], minlength=len(out))
    return out.reshape(n, TERMS).astype(np.float32)


def weighted(x: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Square roots of frequencies relative to the words or characters of the text, times the terms' weights."""
    words, shapes = x[:, :WORDS].sum(axis=1), x[:, WORDS:WORDS + SHAPES].sum(axis=1)
    y = np.empty_like(x)
    y[:, :WORDS] = np.sqrt(x[:, :WORDS] / np.maximum(words, 1)[:, None])
    y[:, WORDS:WORDS + SHAPES] = np.sqrt(x[:, WORDS:WORDS + SHAPES] / np.maximum(shapes, 1)[:, None])
    y[:, WORDS + SHAPES:] = np.sqrt(x[:, WORDS + SHAPES:] / np.maximum(words, 1)[:, None])
    return y * rarity


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(size > 1e-9, v / np.maximum(size, 1e-9), 0).astype(np.float32)


@dataclass
class Model:
    rarity: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    stands_for: np.ndarray

    def vectors_of(self, x: np.ndarray) -> np.ndarray:
        return _unit(weighted(x, self.rarity) @ self.directions)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest; 0 for a text without any term that the model knows."""
        out = np.zeros(len(x))
        k = min(NEIGHBOURS, len(self.vectors))
        for lo in range(0, len(x), BLOCK) if k else []:
            near = self.vectors_of(x[lo:lo + BLOCK]) @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** POWER * self.stands_for[top]
            out[lo:lo + BLOCK] = (w * self.label[top]).sum(axis=1) / np.maximum(w.sum(axis=1), 1e-300)
        return np.clip(np.round(out, 6), 0, 1)


def leading(gram: np.ndarray, k: int, rounds: int = 200, tolerance: float = 1e-7) -> np.ndarray:
    """The k leading eigenvectors of a symmetric matrix, by iterating on a few more directions than k.

    That takes one thin block beside the matrix, where a full decomposition takes several copies of it; where the
    iteration has not settled after `rounds`, the full one is made after all.
    """
    width = min(len(gram), 2 * k)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((len(gram), width)))[0]
    for _ in range(rounds):
        y = gram @ q
        value, turn = np.linalg.eigh(q.T @ y)
        at, v = q @ turn[:, ::-1][:, :k], value[::-1][:k]
        if np.abs(y @ turn[:, ::-1][:, :k] - at * v).max(initial=0) <= tolerance * max(float(v[0]) if k else 0, 1e-300):
            return at
        q = np.linalg.qr(y)[0]
    return np.linalg.eigh(gram)[1][:, ::-1][:, :k]


def fit(blocks: Callable[[], Iterator[np.ndarray]], label: np.ndarray, share: dict[int, int]) -> Model:
    """The model of labelled counts, which `blocks` gives in blocks of rows, so that no table of all terms stands in memory.

    share: rows of each label that the sample stands for.
    """
    rarity = (np.log((1 + len(label)) / (1 + sum((x > 0).sum(axis=0) for x in blocks()))) + 1).astype(np.float32)
    gram = np.zeros((TERMS, TERMS))
    for x in blocks():
        y = weighted(x, rarity).astype(np.float64)
        for lo in range(0, TERMS, 256):         # in strips, so that no second matrix of all terms stands beside the sum
            gram[lo:lo + 256] += y[:, lo:lo + 256].T @ y
    directions = leading(gram, LATENT).astype(np.float32)
    del gram
    here = {v: max(1, int((label == v).sum())) for v in (0, 1)}
    vectors = np.concatenate([_unit(weighted(x, rarity) @ directions) for x in blocks()])
    return Model(rarity, directions, vectors, label.astype(np.float64), np.array([share[int(v)] / here[int(v)] for v in label]))


def learnable(labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of the rows a model may learn from: one clear label, crc32 of the id modulo 5 not 0."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("most"))
    return one.where((F.col("label") == F.col("most")) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).select("doc_id", F.col("label").cast("int").alias("label"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> Model | None:
    """A model of at most `per_label` labelled documents of each label, or None if none is labelled."""
    known = learnable(labels, label_col, id_col)
    share = {0: 0, 1: 0} | {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = []
    for v in (0, 1):
        chosen += known.where(F.col("label") == v).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(per_label).collect()
    if not chosen:
        return None
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    sample = spark.createDataFrame([(r["doc_id"], r["label"]) for r in chosen], f"id {kind}, label int")     # 2 * per_label rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    # An id that repeats counts once, with the text of the smallest digest, whatever the number of its rows.
    text = F.coalesce("text", F.lit(""))
    texts = texts.groupBy("id").agg(F.first("label").alias("label"), F.min(F.struct(F.sha2(text, 256).alias("digest"), text.alias("text"))).alias("one")).select("label", "id", F.col("one.text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            x = counts(b.column(2))
            at = np.concatenate([[0], np.cumsum((x > 0).sum(axis=1))]).astype(np.int32)
            i, j = np.nonzero(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(j.astype(np.int16))), pa.ListArray.from_arrays(pa.array(at), pa.array(x[i, j]))], ["label", "id", "term", "n"])

    rows = texts.mapInArrow(run, f"label int, id {kind}, term array<smallint>, n array<float>").toArrow().sort_by([("id", "ascending")])

    def blocks() -> Iterator[np.ndarray]:
        for lo in range(0, len(rows), BLOCK):
            part = rows.slice(lo, BLOCK)
            x = np.zeros((len(part), TERMS), dtype=np.float32)
            for i, (t, n) in enumerate(zip(part["term"], part["n"])):
                x[i, t.values.to_numpy()] = n.values.to_numpy()
            yield x

    return fit(blocks, rows["label"].to_numpy(), share) if len(rows) else None


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> DataFrame:
    """Every document with held_out (crc32 of the id modulo 5 is 0), score in 0..1 and predicted (score >= threshold).

    Only the text enters the score. A null or empty text has no terms and scores 0, as does every text when no label is
    known; a blank one is scored by its white space. Where cosines tie at the last of the nearest, the lower places in
    numpy's partition count, the same in every run. Texts may be of any length. Rows
    that repeat a doc_id are scored each by its text. A null doc_id is not held out. Labels that contradict each other
    or are null are left out of the model. Other columns are ignored. An empty table gives no rows.
    """
    need(docs, id_col, text_col)
    need(labels, id_col, label_col)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label_col, id_col, text_col, per_label))      # a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, most=1 << 20):
            score = model.value.score(counts(b.column(1))) if model.value is not None else np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold; all rows if no label is known."""
    need(docs, id_col, text_col)
    need(labels, id_col, label_col)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label_col, id_col, text_col, per_label))      # a bounded sample
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, text_col, 1 << 20):
            yield b if model.value is None else b.filter(pa.array(model.value.score(counts(b.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
