"""Cases of the fourth round: steps that were fine on small tables only."""

import numpy as np

from statloom.operators import ecology, groups, spatial
from statloom.plans.knn import knn


def brute(pts, k):
    out = set()
    for i, x, y in pts:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in pts if j != i)[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(near)}
    return out


def test_knn_crowded_and_lone_points(spark):
    rng = np.random.default_rng(5)
    spread = rng.uniform(0, 100, (200, 2)).tolist()
    crowd = (50 + rng.normal(0, 1e-3, (900, 2))).tolist()
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate([*spread, *crowd, *[[7.0, 7.0]] * 60, [4000.0, -3000.0]])]
    got = knn(spark.createDataFrame(pts, "id long, x double, y double").repartition(5), 6)
    assert {(r["i"], r["j"], r["rank"]) for r in got.collect()} == brute(pts, 6)


def test_tables_of_points_are_not_broadcast(spark):
    pts = spark.range(400).selectExpr("id", "cast(id * 7919 % 1000 as double) x", "cast(id * 104729 % 997 as double) y", "cast(id % 13 as double) v", "cast(id % 7 as double) u")
    for got in (spatial.getis_ord_gi(pts, "id", "x", "y", "v"), spatial.gwr(pts, "id", "x", "y", "v", ["u"], 20)):
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_quantile_fit_widens_the_middle(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(1, 51, 6000).astype(float)
    y = np.round(1000 * x * rng.uniform(0.9, 2.1, 6000), 2)
    d = spark.createDataFrame(list(zip(y.tolist(), x.tolist())), "y double, x double")
    loss = lambda b, tau: (lambda e: np.where(e > 0, tau * e, (tau - 1) * e).sum())(y - b[0] - b[1] * x)
    for tau in (0.05, 0.95):
        few, all_rows = (groups.quantile_fit(d, "y", ["x"], tau, m) for m in (12, 6000))
        assert abs(loss(few, tau) - loss(all_rows, tau)) < 1e-9 * loss(all_rows, tau)


def test_differences_are_counted_without_rows_per_candidate(spark, monkeypatch):
    """Ranks come from cells laid side by side; the pooled order of a and b + t, a row for each value and t, is not written."""
    rng = np.random.default_rng(1)
    for a, b in ((rng.normal(3, 1, 300), rng.normal(0, 2, 400)), (rng.integers(0, 5, 300).astype(float), rng.integers(0, 7, 200).astype(float)),
                 (np.r_[np.zeros(900), rng.normal(0, 1, 100)], np.exp(rng.normal(0, 6, 200)))):
        d = spark.createDataFrame([(float(v), "a") for v in a] + [(float(v), "b") for v in b], "v double, g string")
        want = np.quantile(np.subtract.outer(a, b).ravel(), (0.1, 0.5, 0.9))
        with monkeypatch.context() as m:
            m.setattr(groups, "cumulate", None)
            for cells in (4, 2048):
                got = groups.pair_difference_quantile(d, "v", "g", "a", (0.1, 0.5, 0.9), cells=cells)
                assert np.allclose(got, want, rtol=1e-11, atol=1e-11)


def communities_of(spark, sites=60):
    rng = np.random.default_rng(4)
    rows = [(s, f"sp{k}", int(v), "ab"[s % 2], float(s * 37 % 11)) for s in range(sites) for k, v in enumerate(rng.poisson(2, 7)) if v]
    return rows, spark.createDataFrame(rows, "site long, species string, n long, grp string, env double")


def test_permutations_by_place():
    for n in (1, 2, 5, 16, 17, 1000):
        assert all(sorted(r) == list(range(n)) for r in ecology.redrawn(np.arange(n), n, 20, 3).tolist())
    whole = ecology.redrawn(np.arange(1000), 1000, 20, 3)
    assert (ecology.redrawn(np.array([7, 500]), 1000, 20, 3) == whole[:, [7, 500]]).all() and abs(np.corrcoef(whole[0], whole[1])[0, 1]) < 0.15


def test_sites_and_their_relabelings_stay_in_the_tasks(spark, monkeypatch):
    rows, df = communities_of(spark)
    wide = {}
    for s, k, v, _, _ in rows:
        wide.setdefault(s, np.zeros(7))[int(k[2])] = v
    ids = sorted(wide)
    m = np.array([wide[s] for s in ids])
    d = np.abs(m[:, None] - m).sum(2) / (m.sum(1)[:, None] + m.sum(1))
    up = np.triu_indices(len(ids), 1)
    env = np.array([s * 37 % 11 for s in ids], float)
    from statloom.plans import frames
    monkeypatch.setattr(ecology, "collect_bounded", lambda df, what, limit=20: frames.collect_bounded(df, what, 20))       # fewer than the sites
    for rows_of_block, sites_of_block in ((250_000, 256), (60, 8)):
        monkeypatch.setattr(ecology, "BLOCK_ROWS", rows_of_block)
        monkeypatch.setattr(ecology, "BLOCK_SITES", sites_of_block)
        monkeypatch.setattr(ecology, "LABEL_SITES", sites_of_block)
        got = ecology.mantel_test(df, "site", "species", "n", ["env"], 19).first()
        assert (got["sites"], got["pairs"]) == (len(ids), len(up[0])) and abs(got["r"] - np.corrcoef(d[up], np.abs(env[:, None] - env)[up])[0, 1]) < 1e-9
        mean = ecology.mean_beta(df, "site", "species", "n").first()
        assert mean["pairs"] == len(up[0]) and abs(mean["mean_bray_curtis"] - d[up].mean()) < 1e-12 and abs(mean["max"] - d[up].max()) < 1e-12
        lab = np.array([s % 2 for s in ids])
        same = lab[up[0]] == lab[up[1]]
        sst, ssw = (d[up] ** 2).sum() / len(ids), sum((d[up] ** 2)[same & (lab[up[0]] == g)].sum() / (lab == g).sum() for g in (0, 1))
        assert abs(ecology.permanova(df, "site", "species", "n", "grp", 19).first()["pseudo_f"] - (sst - ssw) / (ssw / (len(ids) - 2))) < 1e-9
        ind = {r["species"]: r for r in ecology.indicator_species(df, "site", "species", "n", "grp", 19).collect()}
        for k in range(7):
            mu, fr = (np.array([f(m[lab == g, k]) for g in (0, 1)]) for f in (np.mean, lambda v: (v > 0).mean()))
            assert abs(ind[f"sp{k}"]["indval"] - (100 * mu / mu.sum() * fr).max()) < 1e-9
