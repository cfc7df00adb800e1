"""Findings of round 4: fits that settle, whole methods."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SF
from statloom.bindings import load
from statloom.operators import groups, learning, networks, spatial
from statloom.plans import parts
from test_graph_blocks import distances
from test_round3 import brandes

QUERIES = load()[0]


def test_no_row_that_stands_still_comes_into_a_vertex():
    """The loss falls without end; the third row has the x of the second, so it must not stand beside it in a vertex."""
    x, y, w = np.array([[1.0, 5.0], [1.0, 49.0], [1.0, 49.0]]), np.array([52420.96, 53248.05, 53285.77]), np.full(3, 6.0)
    b, whole = groups.check_loss_vertex(x, y, w, np.array([-3249.0, -1701.0]), 0.5, np.array([52322.686136363634, 19.654772727272583]))
    assert not whole and np.isfinite(b).all()


@pytest.mark.parametrize("tau", [0.05])
def test_quantile_fit_from_a_far_start(spark, tau):
    """Every round has a smaller loss than the one before, so the fit is reached from anywhere with few rows at a time."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.integers(1, 51, 700).astype(float), 6)
    y = np.repeat(np.round(rng.uniform(0.09, 10.5, 700) * (1 + np.arange(700) % 9), 2), 6)
    d = spark.createDataFrame(list(zip(y.tolist(), x.tolist())), "y double, x double").cache()
    loss = lambda b: (lambda e: np.where(e > 0, tau * e, (tau - 1) * e).sum())(y - b[0] - b[1] * x)
    best = groups.quantile_fit(d, "y", ["x"], tau, 6000)
    for start in ([400.0, -9.0], [-30.0, 4.0]):
        got, why = groups._settled(d, len(y), "y", ["x"], tau, np.array(start), 24, 40)
        assert why is None and abs(loss(got) - loss(best)) < 1e-9 * loss(best)


@pytest.mark.parametrize("edges", [0, 8, 1 << 22])
@pytest.mark.parametrize("text", [False, True])
def test_searches_by_component_and_by_blocks(spark, monkeypatch, edges, text):
    """Whole components in tasks, the larger ones in blocks, or all in blocks; several parts of sources and shared tasks."""
    for name, v in (("EDGES", edges), ("SMALL", 6), ("WORK", 200), ("ROOM", 5000)):
        monkeypatch.setattr(parts, name, v)
    rng = np.random.default_rng(3)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 60, (80, 2)).tolist()} | {(i, i + 1) for i in range(200, 206)} | {(300, 301), (310, 311), (311, 312)}
    pairs = {(a, b) for a, b in pairs if a != b}
    d = spark.createDataFrame(sorted(pairs), "a long, b long")
    e = networks.undirected(d.selectExpr("concat('n', a) a", "concat('n', b) b") if text else d, "a", "b")
    name = (lambda u: int(u[1:])) if text else int
    want = brandes(pairs)
    got = {name(r["u"]): r["betweenness"] for r in networks.betweenness(e).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    far = distances(pairs)
    totals, t = networks.reach(e)
    every = [k for ds in far.values() for k in ds]
    assert totals == [(k, every.count(k)) for k in sorted(set(every))]
    assert {name(r["u"]): (r["r"], r["d"]) for r in t.collect()} == {u: (len(ds), sum(ds)) for u, ds in far.items()}


def test_disjoint_copies_cost_their_sum(spark, monkeypatch):
    """Sources meet only the nodes of their component: rows of one matrix, not of the whole graph."""
    monkeypatch.setattr(parts, "SMALL", 1)
    d = spark.createDataFrame([(10 * k + i, 10 * k + (i + 1) % 5) for k in range(40) for i in range(5)], "a long, b long")
    e = networks.undirected(d, "a", "b")
    assert parts.split(e, networks.components)[0].groupBy("own", "bin", "part").count().count() == 40


def test_centrality_suite_query_has_betweenness(spark):
    assert "betweenness" in QUERIES["centrality_suite"](spark, SF).columns


@pytest.mark.parametrize("edges", [0, 1 << 22])
def test_communities_by_component_and_in_rounds(spark, monkeypatch, edges):
    """Cliques joined by single edges, and one apart; what a task can hold takes no rounds over all nodes."""
    monkeypatch.setattr(parts, "EDGES", edges)
    pairs = [(10 * k + i, 10 * k + j) for k in range(4) for i in range(7) for j in range(i)] + [(0, 10), (11, 20)]
    e = networks.undirected(spark.createDataFrame(pairs, "a long, b long"), "a", "b")
    if edges:
        monkeypatch.setattr(networks, "_local_moves", None)
    labels, q = networks.communities(e)
    found = {}
    for r in labels.collect():
        found.setdefault(r["label"], set()).add(r["u"])
    assert sorted(map(sorted, found.values())) == [[10 * k + i for i in range(7)] for k in range(4)]
    m = len(pairs)
    share = [2 * 21 + n for n in (1, 2, 1, 0)]
    assert abs(q - (84 / m - sum(s * s for s in share) / (4 * m * m))) < 1e-12


def test_profiles_settle_for_every_number_of_classes(spark):
    """Four groups apart: found among two to five classes, and the fit is where another round changes nothing."""
    rng = np.random.default_rng(1)
    at = np.array([[0, 0, 0], [6, 0, 3], [0, 6, -3], [6, 6, 9]], float)
    x = at[np.arange(1200) % 4] + rng.normal(size=(1200, 3))
    d = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    rows = [r for s in range(3) for r in learning.latent_profile_analysis(d, ["a", "b", "c"], seed=s).collect()]
    assert {r["classes"] for r in rows} == {2, 3, 4, 5}
    best = max((r for r in rows if r["classes"] == 4), key=lambda r: r["loglik"])["loglik"]
    k = np.array([[1 / 4] * 4])
    lik = np.log((k * np.exp(-0.5 * ((x[:, None] - at) ** 2).sum(2)) / (2 * np.pi) ** 1.5).sum(1)).sum()
    assert lik - 1 < best < lik + 30


def test_queries_try_every_number_of_clusters(spark, monkeypatch):
    tried = {}
    monkeypatch.setattr(learning, "kmeans_clustering", lambda d, f, k_max=6, seed=0: tried.update(kmeans=k_max) or d.select(F.lit(1.0).alias("x")))
    monkeypatch.setattr(learning, "latent_profile_analysis", lambda d, f, k_min=2, k_max=5, **_: tried.update(profiles=(k_min, k_max)) or d.select(F.lit(1.0).alias("x")))
    for name in ("kmeans_clustering", "latent_profile_analysis"):
        QUERIES[name](spark, SF)
    assert tried == {"kmeans": 6, "profiles": (2, 5)}


def test_gwr_chooses_its_bandwidth(spark):
    """Equal to the plain method: weighted fits at every point for each number of neighbours, the least AICc."""
    rng = np.random.default_rng(2)
    n = 60
    p, z = rng.uniform(0, 10, (n, 2)), rng.normal(size=n)
    y = 5 + (p[:, 0] - 5) * z + rng.normal(size=n) / 5
    x, best = np.column_stack([np.ones(n), z]), None
    d = np.hypot(*(p[:, None] - p).transpose(2, 0, 1))
    for k in spatial.bandwidths(n, 2):
        b, hat = np.empty((n, 2)), 0.0
        for i in range(n):
            r = d[i] / np.sort(d[i])[k]
            w = np.where(r < 1, (1 - r * r) ** 2, 0)
            inv = np.linalg.inv((x.T * w) @ x)
            b[i], hat = inv @ (x.T * w) @ y, hat + x[i] @ inv @ x[i]
        rss = ((y - (x * b).sum(1)) ** 2).sum()
        aicc = n * np.log(rss / n) + n * np.log(2 * np.pi) + n * (n + hat) / (n - 2 - hat)
        if best is None or aicc < best[0]:
            best = aicc, k, b
    df = spark.createDataFrame([(i, *map(float, (*p[i], y[i], z[i]))) for i in range(n)], "id long, x double, y double, v double, z double")
    got = sorted(spatial.gwr(df, "id", "x", "y", "v", ["z"]).collect())
    assert {r["neighbours"] for r in got} == {best[1]}
    assert np.allclose([(r["intercept"], r["b_z"]) for r in got], best[2], atol=1e-8)


def test_ripleys_k_has_the_band_of_random_patterns(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SIM_FOCAL", 9)
    rng = np.random.default_rng(1)
    rows = [(i, *(float(v) for v in p)) for i, p in enumerate(np.r_[rng.uniform(0, 10, (30, 2)), rng.normal(5, 0.05, (15, 2))])]
    got = sorted(spatial.ripleys_k(spark.createDataFrame(rows, "id long, x double, y double"), "x", "y", "id", radii=5, sims=39).collect())
    p = np.array([r[1:] for r in rows])
    (x0, y0), (x1, y1), n = p.min(axis=0), p.max(axis=0), len(p)
    grid = np.array([r["r"] for r in got])
    sims = []
    for s in range(39):
        rg = np.random.default_rng([42, s])
        q = np.column_stack([rg.uniform(x0, x1, n), rg.uniform(y0, y1, n)])
        d = np.hypot(*(q[:, None] - q).transpose(2, 0, 1))
        a = np.arange(36) * 2 * np.pi / 36
        px, py = q[:, 0, None, None] + d[:, :, None] * np.cos(a), q[:, 1, None, None] + d[:, :, None] * np.sin(a)
        w = 1 / np.maximum(((px >= x0) & (px <= x1) & (py >= y0) & (py <= y1)).mean(2), 1 / 36)
        np.fill_diagonal(d, np.inf)
        sims.append([np.sqrt((x1 - x0) * (y1 - y0) / (n * (n - 1)) * w[d <= r].sum() / np.pi) - r for r in grid])
    low, high = np.percentile(sims, [2.5, 97.5], axis=0)
    assert np.allclose([r["env_low"] for r in got], low) and np.allclose([r["env_high"] for r in got], high)
    assert got[0]["l_minus_r"] > got[0]["env_high"]


def test_moran_query_returns_its_permutation_p(spark):
    assert "p" in QUERIES["moran_i"](spark, SF).columns
    for n in (2, 3, 4, 5, 12, 97, 1000):
        for a, b in spatial.relabelings(n, 20):
            assert sorted((a * q + b) % n for q in range(n)) == list(range(n))


def test_local_geary_tells_significance_by_conditional_permutation(spark):
    """Values of other points are drawn in the place of the neighbours', never the point's own."""
    import hashlib
    rng = np.random.default_rng(7)
    n, k, count = 40, 4, 199
    p, v = rng.uniform(0, 1, (n, 2)), rng.normal(size=n)
    v[np.argsort(p[:, 0])[:8]] = 5.0
    d = spark.createDataFrame([(i, *map(float, (*p[i], v[i]))) for i in range(n)], "id long, x double, y double, v double")
    got = {r["id"]: r for r in spatial.local_geary(d, "id", "x", "y", "v", k, count).collect()}
    z = (v - v.mean()) / v.std()
    far = np.hypot(*(p[:, None] - p).transpose(2, 0, 1))
    np.fill_diagonal(far, np.inf)
    w = np.zeros((n, n), bool)
    w[np.repeat(np.arange(n), k), np.argsort(far, axis=1)[:, :k].ravel()] = True
    w |= w.T
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"{i}-42".encode()).hexdigest()[:12], i))
    for i in range(n):
        m, c = w[i].sum(), ((z[i] - z[w[i]]) ** 2).mean()
        draws = [[order[(a * u + b) % n] for u in range(n)] for a, b in spatial.relabelings(n, count)]
        sims = np.array([((z[i] - z[[j for j in t if j != i][:m]]) ** 2).mean() for t in draws])
        at = min((sims.round(9) <= round(c, 9)).sum(), (sims.round(9) >= round(c, 9)).sum())
        assert abs(got[i]["p"] - (at + 1) / (count + 1)) < 1e-12 and abs(got[i]["expected"] - sims.mean()) < 1e-9
        assert got[i]["kind"] == ("ns" if got[i]["p"] >= 0.05 else "similar" if c < sims.mean() else "dissimilar")
    assert {r["kind"] for r in got.values()} >= {"ns", "similar"}
