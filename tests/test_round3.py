"""Betweenness, permutations of whole rows, the Leontief series, quoted line breaks, scales near a guess, graph loops."""

import random
import tempfile
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import ecology, groups, networks, ranking
from statloom.plans.order import near_quantile
from statloom.plans.resample import permuted_sums
from statloom.sources.tables import read_delimited


def brandes(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = dict.fromkeys(near, 0.0)
    for s in near:
        dist, sigma, order, todo = {s: 0}, {s: 1.0}, [], deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    sigma[w] = 0.0
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                out[w] += delta[w]
    n = len(near)
    return {v: d / ((n - 1) * (n - 2)) for v, d in out.items()}


@pytest.mark.parametrize("messages", [20_000_000, 400])
def test_betweenness(spark, messages):
    rng = random.Random(4)
    edges = {(f"n{a}", f"n{b}") for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(45)) if a != b} | {(f"z{i}", f"z{i + 1}") for i in range(5)}
    e = networks.undirected(spark.createDataFrame([*edges, ("n1", "n1"), ("n1", None)], "a string, b string"), "a", "b")
    got = {r["u"]: r["betweenness"] for r in networks.betweenness(e, messages).collect()}
    want = brandes({tuple(sorted(p)) for p in edges})
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_suite_and_rank_correlations(spark):
    d = spark.createDataFrame([(i, (i * 7 + 3) % 23) for i in range(23)] + [(0, i) for i in range(1, 12)], "a long, b long")
    t = networks.centrality_suite(d, "a", "b")
    assert {"betweenness", "closeness", "eigenvector"} <= set(t.columns) and t.count() == 23
    c = {(r["measure_a"], r["measure_b"]): r["rho"] for r in networks.rank_correlations(t, ["degree_centrality", "pagerank", "betweenness"]).collect()}
    pdf = t.toPandas()
    assert all(abs(v - pdf[[a, b]].corr("spearman").iloc[0, 1]) < 1e-9 for (a, b), v in c.items())


def test_rda_permutation(spark):
    rng = np.random.default_rng(1)
    rows, grad = [], []
    for s in range(60):
        g = float(rng.uniform())
        grad.append((f"s{s}", g, float(rng.uniform())))
        rows += [(f"s{s}", f"sp{k}", float(rng.poisson(1 + 8 * (g if k < 2 else 0.5)))) for k in range(5)]
    d = spark.createDataFrame(rows, "site string, species string, n double").join(spark.createDataFrame(grad, "site string, env double, other double"), "site")
    strong = ecology.rda(d, "site", "species", "n", ["env"], 99).collect()[0]
    none = ecology.rda(d, "site", "species", "n", ["other"], 99).collect()[0]
    assert strong["p"] == 0.01 and none["p"] > 0.05
    again = ecology.rda(d.repartition(7), "site", "species", "n", ["other"], 99).collect()[0]
    assert again["p"] == none["p"]


def test_re_pairing_is_uniform(spark):
    """Each of 5 rows meets each of 5 partners about equally often over 2000 draws, and every draw uses each once."""
    t = spark.createDataFrame([(i, *[1.0 * (i == k) for k in range(5)]) for i in range(5)], "k long, " + ", ".join(f"e{k} double" for k in range(5)))
    es = [f"e{k}" for k in range(5)]
    m = ecology.re_paired(t, t, "k", es, es, 2000)
    assert (m.sum(axis=1) == 1).all() and (m.sum(axis=2) == 1).all()
    assert np.abs(m.mean(axis=0) - 0.2).max() < 0.04


def test_leontief_series(spark):
    rng = np.random.default_rng(2)
    z = rng.uniform(0, 10, (6, 6)) * (rng.uniform(size=(6, 6)) < 0.7)
    f = rng.uniform(1, 20, 6)
    flows = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(6) for j in range(6) if z[i, j]], "i long, j long, z double")
    got = {int(r["sector"]): r for r in ranking.input_output_analysis(flows, "i", "j", "z", spark.createDataFrame([(i, float(f[i])) for i in range(6)], "k long, f double")).collect()}
    x = z.sum(1) + f
    inv = np.linalg.inv(np.eye(6) - z / x)
    for i in range(6):
        assert abs(got[i]["output"] - (inv @ f)[i]) < 1e-8 * x[i] and abs(got[i]["multiplier"] - inv.sum(0)[i]) < 1e-8 and abs(got[i]["forward"] - inv.sum(1)[i] / inv.sum(1).mean()) < 1e-8
    bad = spark.createDataFrame([(0, 1, 5.0), (1, 0, 5.0)], "i long, j long, z double")
    with pytest.raises(ValueError, match="inverse|settle"):
        ranking.input_output_analysis(bad, "i", "j", "z", spark.createDataFrame([(0, -4.0), (1, -4.0)], "k long, f double"))


def test_quoted_line_breaks(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/a.csv"
    with open(path, "w", encoding="utf-8") as out:
        out.write('id,note\n1,"two\nlines, and a ""quote"""\n2,plain\n')
    assert [tuple(r) for r in read_delimited(spark, path).orderBy("id").collect()] == [("1", 'two\nlines, and a "quote"'), ("2", "plain")]


@pytest.mark.parametrize("guess", [None, 0.3, 1e6])
def test_near_quantile(spark, guess):
    rng = random.Random(8)
    vals = [rng.choice([0.0, 0.5, rng.random(), rng.random() ** 9]) for _ in range(999)]
    d = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v double").repartition(3)
    for p in (0.0, 0.25, 0.5, 0.913, 1.0):
        assert abs(near_quantile(d, F.col("v"), p, guess, cells=16, few=20) - float(np.quantile(vals, p))) < 1e-12


@pytest.mark.parametrize("tau", [0.1, 0.5, 0.9])
def test_quantile_fit_is_exact(spark, tau):
    """The loss equals the least over all vertices (pairs of rows), with ties, and the middle may be small."""
    rng = random.Random(int(tau * 10))
    rows = [(float(rng.randrange(12)), float(rng.randrange(20)) / 2) for _ in range(60)]
    d = spark.createDataFrame([(2 * x + e, x) for x, e in rows], "y double, x double")
    pts = [(2 * x + e, x) for x, e in rows]

    def loss(b):
        return sum((tau if y - b[0] - b[1] * x > 0 else tau - 1) * (y - b[0] - b[1] * x) for y, x in pts)

    best = min(loss((y1 - (y2 - y1) / (x2 - x1) * x1, (y2 - y1) / (x2 - x1))) for i, (y1, x1) in enumerate(pts) for y2, x2 in pts[:i] if x1 != x2)
    for middle in (4000, 12):
        assert abs(loss(groups.quantile_fit(d, "y", ["x"], tau, middle)) - best) < 1e-9 * max(1, best)


def test_permuted_sums_by_a_drawn_tree(spark):
    """Every relabeling gives all values away; group means follow the exact mean and variance of sampling without replacement."""
    vals = [float(i % 17) for i in range(600)]
    d = spark.createDataFrame(list(enumerate(vals)), "id long, v double")
    s = permuted_sums(d.repartition(5), "id", "v", [100, 200, 300], 400, block_rows=50)
    assert np.allclose(s.sum(axis=1), sum(vals)) and np.allclose(s, permuted_sums(d.repartition(2), "id", "v", [100, 200, 300], 400, block_rows=50))
    v = np.array(vals)
    for k, size in enumerate((100, 200, 300)):
        sd = np.sqrt(size * v.var() * (600 - size) / 599)
        assert abs(s[:, k].mean() - size * v.mean()) < 4 * sd / 20 and 0.8 < s[:, k].std() / sd < 1.2
