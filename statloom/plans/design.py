"""Analysis of variance from cell sums: the table is collapsed to its factor cells in one grouped pass."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .frames import collect_bounded, level_key, refuse


class Cells:
    """Cell counts, means and within-cell sums of squares of one outcome."""

    def __init__(self, df: DataFrame, y: str, factors: Sequence[str]):
        rows = collect_bounded(df.groupBy(*factors).agg(
            F.count(F.lit(1)).alias("__n"), F.avg(y).alias("__m"), F.var_pop(y).alias("__v")), "factor cells")
        refuse(not rows, "no complete rows")
        self.factors = list(factors)
        self.key = [tuple(r[f] for f in factors) for r in rows]
        self.n = np.array([r["__n"] for r in rows], float)
        self.m = np.array([r["__m"] for r in rows], float)
        self.within = float(sum(r["__n"] * (r["__v"] or 0.0) for r in rows))
        self.levels = {f: sorted({k[i] for k in self.key}, key=level_key) for i, f in enumerate(self.factors)}
        self.total_n = float(self.n.sum())
        self.grand = float((self.n * self.m).sum() / self.total_n)
        self.tss = self.within + float((self.n * (self.m - self.grand) ** 2).sum())

    def dummies(self, terms: Sequence[tuple[str, ...]]) -> np.ndarray:
        cols = [np.ones(len(self.key))]
        for t in terms:
            idx = [self.factors.index(f) for f in t]
            for combo in product(*[self.levels[f][1:] for f in t]):
                cols.append(np.array([1.0 if all(k[i] == c for i, c in zip(idx, combo)) else 0.0 for k in self.key]))
        return np.column_stack(cols)

    def rss(self, terms: Sequence[tuple[str, ...]]) -> tuple[float, int]:
        """Residual sum of squares over all rows, and the rank of the design."""
        x = self.dummies(terms)
        w = np.sqrt(self.n)
        b, _, rank, _ = np.linalg.lstsq(x * w[:, None], self.m * w, rcond=None)
        e = self.m - x @ b
        return self.within + float((self.n * e * e).sum()), int(rank)

    def type2(self, terms: Sequence[tuple[str, ...]]) -> tuple[list[tuple], float, float]:
        """(term, SS, df) by Type II, with the residual SS and df of the full model."""
        full_rss, full_rank = self.rss(terms)
        out = []
        for t in terms:
            rest = [u for u in terms if not set(t) <= set(u)]
            r0, k0 = self.rss(rest)
            r1, k1 = self.rss([*rest, t])
            out.append((t, r0 - r1, k1 - k0))
        return out, full_rss, self.total_n - full_rank

    def marginal(self, factor: str) -> dict:
        i = self.factors.index(factor)
        out = {}
        for lv in self.levels[factor]:
            s = np.array([k[i] == lv for k in self.key])
            out[lv] = (float(self.n[s].sum()), float((self.n[s] * self.m[s]).sum() / self.n[s].sum()))
        return out
