"""Resampling whose work stays with the rows: Poisson bootstrap sums and exact block permutations.

Weights come from a hash of (row id, replicate), so results do not depend on partitioning or retries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

_P1 = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def poisson_weights(ids: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """reps x ids matrix of Poisson(1) counts."""
    with np.errstate(over="ignore"):
        a = mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1))
        b = mix64(reps.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1))
        u = mix64(a[None, :] ^ b[:, None]).astype(np.float64) / 2.0 ** 64
    return np.searchsorted(_P1, u.ravel(), side="right").reshape(u.shape).astype(np.float64)


def replicate_sums(df: DataFrame, row_id: str, columns: Sequence[str], reps: int, seed: int = 42) -> np.ndarray:
    """Weighted sums of the columns (and of 1, first) for every bootstrap replicate: reps x (1 + columns).

    Each task multiplies its weight matrix with its column matrix and emits one row per replicate.
    """
    cols = list(columns)
    t = df.select(F.xxhash64(row_id).alias("__id"), *[F.col(c).cast("double").alias(c) for c in cols])

    def run(batches):
        total = np.zeros((reps, len(cols) + 1))
        r = np.arange(reps)
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf[cols].to_numpy(float)]) if cols else np.ones((len(pdf), 1))
            ids = pdf["__id"].to_numpy()
            for lo in range(0, len(pdf), 4096):
                total += poisson_weights(ids[lo:lo + 4096], r, seed) @ x[lo:lo + 4096]
        yield pd.DataFrame({"rep": r, "s": list(total)})

    parts = t.mapInPandas(run, "rep bigint, s array<double>")
    m = len(cols) + 1
    rows = parts.groupBy("rep").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(m)]).orderBy("rep").collect()
    return np.array([[r[f"s{i}"] for i in range(m)] for r in rows])


def product_names(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]


def replicate_grams(df: DataFrame, row_id: str, cols: Sequence[str], reps: int, seed: int = 42):
    """Bootstrap moments of several columns: list of Gram objects (columns are shifted by their means first)."""
    from .gram import Gram, gram
    cols = list(cols)
    g = gram(df, cols)
    shifted = df.select(row_id, *[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(cols, g.mean)])
    pairs = product_names(cols)
    prod = shifted.select("*", *[(F.col(a) * F.col(b)).alias(f"__p{i}") for i, (a, b) in enumerate(pairs)])
    s = replicate_sums(prod, row_id, [*cols, *[f"__p{i}" for i in range(len(pairs))]], reps, seed)
    out = []
    k = len(cols)
    for r in s:
        n, mean = r[0], r[1:k + 1] / r[0]
        cross = np.zeros((k, k))
        for v, (a, b) in zip(r[k + 1:], pairs):
            i, j = cols.index(a), cols.index(b)
            cross[i, j] = cross[j, i] = v - n * mean[i] * mean[j]
        out.append(Gram(cols, n, mean + g.mean, cross))
    return g, out


def permuted_sums(df: DataFrame, row_id: str, value: str, sizes: Sequence[int], reps: int, seed: int = 42,
                  block_rows: int = 20_000) -> np.ndarray:
    """Group sums under `reps` uniform relabelings that keep the group sizes: reps x groups.

    Rows are cut into blocks by the leading bits of their hash. How many rows of each group fall in a block is drawn down
    the binary tree of those bits: at each node the counts of its left half are multivariate hypergeometric, from a
    generator that the replicate and the node name. Every task draws the nodes on its own block's path where its rows
    are (two blocks draw the same for a node they share), then shuffles inside the block. So no plan of replicates by
    blocks exists anywhere, and only the sums reach the driver.
    """
    n = int(sum(sizes))
    bits = max(0, math.ceil(math.log2(max(n, 1) / block_rows)))
    h = F.xxhash64(row_id)
    t = df.select(h.alias("__id"), F.col(value).cast("double").alias("v"), (F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0)).cast("bigint").alias("b"))
    counts = t.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    steps = counts.select("b", "c", F.explode(F.sequence(F.lit(1), F.lit(bits))).alias("l")) if bits else counts.select("b", "c", F.lit(0).alias("l")).where("false")
    steps = steps.withColumn("p", F.expr(f"shiftright(b, {bits} - l)"))
    nodes = steps.groupBy("l", "p").agg(F.sum("c").alias("own"))
    other = nodes.select("l", F.col("p").bitwiseXOR(F.lit(1).cast("bigint")).alias("p"), F.col("own").alias("other"))
    path = steps.join(nodes.join(other, ["l", "p"], "left"), ["l", "p"]).select(F.col("b").alias("at"), "l", "p", "own", F.coalesce("other", F.lit(0)).alias("other"))
    k = len(sizes)

    def shuffle(rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((reps, k))
        if len(rows):
            v = rows.sort_values("__id")["v"].to_numpy()
            way = sorted(path[["l", "p", "own", "other"]].itertuples(index=False, name=None))
            g = np.random.default_rng([seed, int(rows["b"].iloc[0]) + 1])
            for r in range(reps):
                left = np.array(sizes, dtype=np.int64)
                for level, p, own, rest in way:
                    half = _hyper(np.random.default_rng([seed, r, int(level), int(p) >> 1]), left, int(rest if p & 1 else own))
                    left = left - half if p & 1 else half
                cuts = np.concatenate([[0], np.cumsum(left)])
                c = np.concatenate([[0.0], np.cumsum(v[g.permutation(len(v))])])
                out[r] = c[cuts[1:]] - c[cuts[:-1]]
        return pd.DataFrame({"rep": np.arange(reps), "s": list(out)})

    rows = (t.groupBy("b").cogroup(path.groupBy("at")).applyInPandas(shuffle, "rep bigint, s array<double>")
            .groupBy("rep").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k)]).orderBy("rep").collect())
    return np.array([[r[f"s{i}"] for i in range(k)] for r in rows])


def _hyper(rng, left: np.ndarray, draw: int) -> np.ndarray:
    """One multivariate hypergeometric draw, group by group."""
    out = np.zeros(len(left), dtype=np.int64)
    pool = int(left.sum())
    for i, c in enumerate(left):
        pool -= int(c)
        out[i] = rng.hypergeometric(int(c), pool, draw) if draw > 0 and c > 0 and pool >= 0 else 0
        draw -= int(out[i])
    return out


def bca(theta: float, reps: np.ndarray, accel: float, level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected accelerated interval from replicates."""
    from ..functions.dist import norm_cdf, norm_ppf
    reps = np.sort(reps[np.isfinite(reps)])
    share = min(max((reps < theta).mean(), 1 / (2 * len(reps))), 1 - 1 / (2 * len(reps)))
    z0 = norm_ppf(share)
    ends = []
    for p in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + norm_ppf(p)
        ends.append(float(np.quantile(reps, norm_cdf(z0 + z / (1 - accel * z)))))
    return ends[0], ends[1]
