"""Maximum likelihood for models whose rows depend on a few linear predictors.

Tasks evaluate the log-likelihood of Arrow batches and its derivatives in the predictors (central differences of
a vectorised function), chain them to the coefficients and emit one row of sums; Spark adds the rows, the driver
takes a Newton step with halving. Nothing but coefficient-sized arrays leaves the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import dist
from .frames import fetch, refuse


@dataclass
class Mle:
    terms: list[str]
    beta: np.ndarray
    vcov: np.ndarray
    ll: float
    n: float
    steps: int
    converged: bool

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.vcov), 0))

    @property
    def aic(self) -> float:
        return 2 * len(self.beta) - 2 * self.ll

    def rows(self):
        for t, b, s in zip(self.terms, self.beta, self.se):
            z = float(b / s) if s > 0 else float("nan")
            yield t, float(b), float(s), z, dist.p_two_sided(z) if s > 0 else float("nan")


def fit_mle(d: DataFrame, data: Sequence[str], blocks: Sequence[tuple[str, Sequence[str], bool]],
            loglik: Callable[[list[np.ndarray], dict[str, np.ndarray]], np.ndarray], start: Sequence[Sequence[float]] | None = None,
            most: int = 60, tol: float = 1e-9) -> Mle:
    """Blocks are (name, columns, has intercept): each is one linear predictor passed to `loglik` in order."""
    xs = sorted({c for _, cols, _ in blocks for c in cols})
    stat = fetch(d, n=F.count(F.lit(1)), **{f"m{i}": F.avg(c) for i, c in enumerate(xs)}, **{f"s{i}": F.stddev_pop(c) for i, c in enumerate(xs)})
    n = float(stat["n"])
    refuse(n == 0, "no complete rows")
    mean = {c: float(stat[f"m{i}"]) for i, c in enumerate(xs)}
    sd = {c: float(stat[f"s{i}"]) or 1.0 for i, c in enumerate(xs)}
    centred = {b: has for b, _, has in blocks}
    sizes = [len(cols) + int(has) for _, cols, has in blocks]
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    p, k = int(cuts[-1]), len(blocks)
    t = d.select(*dict.fromkeys([*data, *xs]))

    def at(theta: np.ndarray, deriv: bool = True):
        def run(batches):
            acc = np.zeros(1 + p + p * p)
            for pdf in batches:
                if not len(pdf):
                    continue
                y = {c: pdf[c].to_numpy(float) for c in data}
                design, eta = [], []
                for (name, cols, has), lo, hi in zip(blocks, cuts[:-1], cuts[1:]):
                    parts = [np.ones((len(pdf), 1))] if has else []
                    if cols:
                        z = np.column_stack([(pdf[c].to_numpy(float) - (mean[c] if has else 0.0)) / sd[c] for c in cols])
                        parts.append(z)
                    x = np.hstack(parts)
                    design.append(x)
                    eta.append(x @ theta[lo:hi])
                with np.errstate(all="ignore"):
                    base = loglik(eta, y)
                    acc[0] += base.sum()
                    if not deriv:
                        continue
                    h = [1e-4 * (1 + np.abs(e)) for e in eta]
                    up, dn = [], []
                    for i in range(k):
                        up.append(loglik([e + h[i] if j == i else e for j, e in enumerate(eta)], y))
                        dn.append(loglik([e - h[i] if j == i else e for j, e in enumerate(eta)], y))
                    for i in range(k):
                        g = (up[i] - dn[i]) / (2 * h[i])
                        acc[1 + cuts[i]:1 + cuts[i + 1]] += design[i].T @ g
                        for j in range(i, k):
                            if i == j:
                                w = (up[i] - 2 * base + dn[i]) / h[i] ** 2
                            else:
                                s = lambda a, b: loglik([e + (a * h[i] if q == i else b * h[j] if q == j else 0.0) for q, e in enumerate(eta)], y)
                                w = (s(1, 1) - s(1, -1) - s(-1, 1) + s(-1, -1)) / (4 * h[i] * h[j])
                            hb = design[i].T @ (design[j] * w[:, None])
                            full = acc[1 + p:].reshape(p, p)
                            full[cuts[i]:cuts[i + 1], cuts[j]:cuts[j + 1]] += hb
                            if i != j:
                                full[cuts[j]:cuts[j + 1], cuts[i]:cuts[i + 1]] += hb.T
            yield pd.DataFrame({"i": np.arange(len(acc)), "v": acc})

        got = t.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        acc = np.zeros(1 + p + p * p)
        for r in got:
            acc[r["i"]] = r["v"]
        return float(acc[0]), acc[1:1 + p], acc[1 + p:].reshape(p, p)

    theta = np.zeros(p)
    if start is not None:
        # start values come on the raw scale: intercept first
        for (name, cols, has), lo, vals in zip(blocks, cuts[:-1], start):
            v = np.array(vals, float)
            if has:
                theta[lo] = v[0] + sum(v[1 + i] * mean[c] for i, c in enumerate(cols))
                for i, c in enumerate(cols):
                    theta[lo + 1 + i] = v[1 + i] * sd[c]
            else:
                for i, c in enumerate(cols):
                    theta[lo + i] = v[i] * sd[c]
    ll, grad, hess = at(theta)
    ok, steps = False, 0
    for steps in range(1, most + 1):
        info = -hess
        ev, vec = np.linalg.eigh((info + info.T) / 2)
        ev = np.where(np.abs(ev) < 1e-10 * max(np.abs(ev).max(), 1e-300), np.inf, np.abs(ev))
        step = vec @ ((vec.T @ grad) / ev)
        if float(grad @ step) < tol * (1 + abs(ll)):
            ok = True
            break
        f = 1.0
        while True:
            new = at(theta + f * step, False)[0]
            if math.isfinite(new) and new >= ll - 1e-10 * abs(ll):
                break
            f /= 2
            if f < 1e-6:
                break
        if f < 1e-6:
            ok = float(grad @ step) < 1e-5 * (1 + abs(ll))
            break
        theta = theta + f * step
        ll, grad, hess = at(theta)
    vc = np.linalg.pinv(-(hess + hess.T) / 2, hermitian=True)
    back = np.eye(p)
    names = []
    for (name, cols, has), lo in zip(blocks, cuts[:-1]):
        off = lo + int(has)
        if has:
            names.append(f"{name}:intercept" if cols or name else "intercept")
        for i, c in enumerate(cols):
            back[off + i, off + i] = 1 / sd[c]
            if has:
                back[lo, off + i] = -mean[c] / sd[c]
            names.append(f"{name}:{c}")
    return Mle(names, back @ theta, back @ vc @ back.T, ll, n, steps, ok)
