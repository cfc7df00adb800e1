"""Least squares from one aggregate pass: n, means and centred cross products.

`covar_pop` merges centred moments, so columns with a large mean keep their precision; everything
after the aggregate works on p x p numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import collect_bounded, refuse


@dataclass
class Gram:
    names: list[str]
    n: float
    mean: np.ndarray
    cross: np.ndarray        # sum of (a - mean a)(b - mean b)

    def at(self, names: Sequence[str]) -> list[int]:
        return [self.names.index(c) for c in names]

    def sub(self, a: Sequence[str], b: Sequence[str]) -> np.ndarray:
        return self.cross[np.ix_(self.at(a), self.at(b))]

    def corr(self, names: Sequence[str] | None = None) -> np.ndarray:
        i = self.at(names or self.names)
        c = self.cross[np.ix_(i, i)]
        d = np.sqrt(np.diag(c))
        refuse(bool((d <= 0).any()), "a column is constant")
        return c / np.outer(d, d)

    def cov(self, names: Sequence[str] | None = None) -> np.ndarray:
        i = self.at(names or self.names)
        return self.cross[np.ix_(i, i)] / (self.n - 1)

    def raw(self) -> np.ndarray:
        """Uncentred cross products."""
        return self.cross + self.n * np.outer(self.mean, self.mean)


def _aggs(names: Sequence[str]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("__n")]
    out += [F.avg(c).alias(f"__m{i}") for i, c in enumerate(names)]
    out += [F.covar_pop(names[i], names[j]).alias(f"__c{i}_{j}")
            for i in range(len(names)) for j in range(i, len(names))]
    return out


def _unpack(names: Sequence[str], r) -> Gram:
    p = len(names)
    n = float(r["__n"])
    mean = np.array([r[f"__m{i}"] if r[f"__m{i}"] is not None else 0.0 for i in range(p)], float)
    cross = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            v = r[f"__c{i}_{j}"]
            cross[i, j] = cross[j, i] = (0.0 if v is None else v) * n
    return Gram(list(names), n, mean, cross)


WIDE = 16                  # columns beyond which cross products are added in batches: the plan would hold one aggregate for each pair


def gram(df: DataFrame, names: Sequence[str]) -> Gram:
    """Moments of complete rows (the caller has removed missing values)."""
    if len(names) > WIDE:
        return _gram_wide(df, names)
    return _unpack(names, df.agg(*_aggs(names)).collect()[0])


def _gram_wide(df: DataFrame, names: Sequence[str]) -> Gram:
    """The same for many columns: a task adds up the cross products of its batches, around the overall means."""
    p = len(names)
    x = df.select(*[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(names)])
    at = x.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"__{i}").alias(f"m{i}") for i in range(p)]).collect()[0]
    mean = np.array([float(at[f"m{i}"] or 0.0) for i in range(p)])

    def run(batches):
        cross = np.zeros((p, p))
        for b in batches:
            d = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - mean
            cross += d.T @ d
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p * p, dtype=np.int32)), pa.array(cross.ravel())], names=["i", "v"])

    cross = np.zeros(p * p)
    for r in x.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        cross[r["i"]] = r["v"]
    return Gram(list(names), float(at["n"]), mean, cross.reshape(p, p))


def gram_by(df: DataFrame, names: Sequence[str], by: str) -> dict:
    """The same per level of a small factor, in one pass."""
    rows = collect_bounded(df.groupBy(by).agg(*_aggs(names)), f"levels of {by}")
    return {r[by]: _unpack(names, r) for r in rows}


def merge(parts: Sequence[Gram]) -> Gram:
    n = sum(g.n for g in parts)
    mean = sum(g.n * g.mean for g in parts) / n
    cross = sum(g.cross + g.n * np.outer(g.mean - mean, g.mean - mean) for g in parts)
    return Gram(parts[0].names, n, mean, cross)


def weighted_gram(df: DataFrame, names: Sequence[str], weight: Column, by: Sequence[str] = ()) -> dict:
    """Weighted moments per group (key tuple -> Gram with n = sum of weights)."""
    w = weight.cast("double")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    aggs = [F.sum(w).alias("__n"), F.count(F.lit(1)).alias("__rows")]
    # Sums are taken around the overall means, so that large means leave the digits of the cross products alone.
    at = df.agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(names)]).collect()[0]
    at = [float(at[f"__m{i}"] or 0.0) for i in range(len(names))]
    off = [F.col(c) - F.lit(m) for c, m in zip(names, at)]
    aggs += [F.sum(w * x).alias(f"__s{i}") for i, x in enumerate(off)]
    aggs += [F.sum(w * off[i] * off[j]).alias(f"__q{i}_{j}") for i, j in pairs]
    out = {}
    got = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    for r in collect_bounded(got, "weight groups"):
        n = float(r["__n"] or 0.0)
        p = len(names)
        if n <= 0:
            continue
        mean = np.array([r[f"__s{i}"] / n for i in range(p)], float)
        cross = np.zeros((p, p))
        for i, j in pairs:
            cross[i, j] = cross[j, i] = r[f"__q{i}_{j}"] - n * mean[i] * mean[j]
        g = Gram(list(names), n, mean + np.array(at), cross)
        g.rows = r["__rows"]
        out[tuple(r[b] for b in by)] = g
    return out


@dataclass
class Fit:
    terms: list[str]          # intercept first
    beta: np.ndarray
    unscaled: np.ndarray      # (X'X)^-1 with the intercept
    n: float
    df: float
    rss: float
    tss: float

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss if self.tss > 0 else float("nan")

    @property
    def sigma2(self) -> float:
        return self.rss / self.df

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.unscaled) * self.sigma2, 0))

    @property
    def vcov(self) -> np.ndarray:
        return self.unscaled * self.sigma2

    def predict(self) -> Column:
        e = F.lit(float(self.beta[0]))
        for t, b in zip(self.terms[1:], self.beta[1:]):
            e = e + F.col(t) * F.lit(float(b))
        return e


def ols(g: Gram, y: str, xs: Sequence[str]) -> Fit:
    """Ordinary least squares with intercept from the moments."""
    xs = list(xs)
    p = len(xs)
    refuse(g.n <= p + 1, f"{int(g.n)} complete rows are too few for {p} predictors")
    sxx = g.sub(xs, xs)
    sxy = g.sub(xs, [y])[:, 0]
    syy = float(g.sub([y], [y])[0, 0])
    mx = g.mean[g.at(xs)]
    my = g.mean[g.at([y])[0]]
    inv = np.linalg.pinv(sxx, hermitian=True) if p else np.zeros((0, 0))
    b = inv @ sxy
    unscaled = np.zeros((p + 1, p + 1))
    unscaled[1:, 1:] = inv
    unscaled[0, 1:] = unscaled[1:, 0] = -inv @ mx
    unscaled[0, 0] = 1 / g.n + mx @ inv @ mx
    rss = max(float(syy - sxy @ b), 0.0)
    return Fit(["intercept", *xs], np.concatenate([[my - mx @ b], b]), unscaled, g.n,
               g.n - p - 1, rss, syy)


def r2_of(g: Gram, y: str, xs: Sequence[str]) -> float:
    return ols(g, y, xs).r2 if xs else 0.0


def score_meat(df: DataFrame, xs: Sequence[str], resid: Column, weight: Column | None = None,
               cluster: str | None = None) -> tuple[np.ndarray, int]:
    """Sum of score outer products (rows, or sums within a cluster); first score is the intercept."""
    w = F.lit(1.0) if weight is None else weight
    scores = [(w * resid).alias("__s0"), *[(w * resid * F.col(c)).alias(f"__s{i + 1}") for i, c in enumerate(xs)]]
    k = len(scores)
    t = df.select(*scores, *([F.col(cluster).alias("__g")] if cluster else []))
    if cluster:
        t = t.groupBy("__g").agg(*[F.sum(f"__s{i}").alias(f"__s{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = t.agg(F.count(F.lit(1)).alias("g"),
              *[F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")).alias(f"m{i}_{j}") for i, j in pairs]).collect()[0]
    m = np.zeros((k, k))
    for i, j in pairs:
        m[i, j] = m[j, i] = r[f"m{i}_{j}"] or 0.0
    return m, int(r["g"])


def robust_vcov(df: DataFrame, fit: Fit, y: str, cluster: str | None = None) -> np.ndarray:
    """HC1, or cluster-robust with the usual small-sample factor."""
    xs = fit.terms[1:]
    m, groups = score_meat(df, xs, F.col(y) - fit.predict(), cluster=cluster)
    k = len(fit.terms)
    factor = fit.n / (fit.n - k)
    if cluster:
        factor = groups / (groups - 1) * (fit.n - 1) / (fit.n - k)
    return factor * fit.unscaled @ m @ fit.unscaled
