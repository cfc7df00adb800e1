"""Machine learning on MLlib, mixtures and item-response models by EM over Spark sums, interpretation, imputation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dist
from ..functions.special import softplus
from ..plans.frames import binary01, collect_bounded, complete, cut_lineage, fetch, level_key, levels_of, need, num, one_row, refuse, rows_frame
from ..plans.gram import Fit, Gram, gram, gram_by, ols
from ..plans.order import quantiles, sorted_position


def assembled(df: DataFrame, features: Sequence[str], *keep: str, scale: bool = False) -> DataFrame:
    d = complete(df, features, keep)
    if scale:
        g = gram(d, list(features))
        sd = np.sqrt(np.diag(g.cross) / g.n)
        d = d.select(*keep, *[((F.col(c) - F.lit(float(m))) / F.lit(float(s or 1.0))).alias(c) for c, m, s in zip(features, g.mean, sd)])
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(d)


def kmeans_clustering(df: DataFrame, features: Sequence[str], k_max: int = 6, seed: int = 0) -> DataFrame:
    """K-means on standardised columns, k by silhouette; sizes and profile means per cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    v = assembled(df, features, scale=True).persist()
    try:
        n = v.count()
        refuse(n < 20, "twenty rows are needed")
        best = None
        for k in range(2, max(2, min(k_max, n // 10)) + 1):
            m = KMeans(k=k, seed=seed, maxIter=50).fit(v)
            t = m.transform(v)
            s = ClusteringEvaluator().evaluate(t)
            if best is None or s > best[0]:
                best = (s, k, t)
        rows = best[2].groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in features]).collect()
    finally:
        v.unpersist()
    return rows_frame(df.sparkSession, "cluster bigint, n bigint, k bigint, silhouette double, " + ", ".join(f"`{c}` double" for c in features),
                      [(r["prediction"], r["n"], best[1], best[0], *[r[c] for c in features]) for r in sorted(rows, key=lambda r: r["prediction"])])


def gaussian_mixture(df: DataFrame, features: Sequence[str], k_max: int = 4, seed: int = 0) -> DataFrame:
    """Full-covariance mixtures by BIC with the mean membership certainty."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import vector_to_array
    v = assembled(df, features, scale=True).select("features").persist()
    p = len(features)
    rows = []
    try:
        n = v.count()
        for k in range(2, k_max + 1):
            m = GaussianMixture(k=k, seed=seed, maxIter=50).fit(v)
            ll = m.summary.logLikelihood
            q = k - 1 + k * p + k * p * (p + 1) / 2
            c = fetch(m.transform(v), c=F.avg(F.array_max(vector_to_array("probability"))))["c"]
            rows.append((k, ll, q * math.log(n) - 2 * ll, c))
    finally:
        v.unpersist()
    best = min(r[2] for r in rows)
    return rows_frame(df.sparkSession, "k bigint, loglik double, bic double, certainty double, is_best boolean", [(*r, r[2] == best) for r in rows])


def _em(table: DataFrame, step, theta, most: int, tol: float):
    """EM driver: `step(pdf, theta) -> (loglik, sums)` in the tasks; Spark adds the sums."""
    last = -math.inf
    for it in range(most):
        def run(batches, th=theta[0]):
            acc = None
            for pdf in batches:
                if len(pdf):
                    s = step(pdf, th)
                    acc = s if acc is None else acc + s
            if acc is not None:
                yield pd.DataFrame({"i": np.arange(len(acc)), "v": acc})
        got = table.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        s = np.zeros(len(got))
        for r in got:
            s[r["i"]] = r["v"]
        ll = s[0]
        theta[0] = theta[1](theta[0], s[1:])
        if abs(ll - last) < tol * (1 + abs(ll)):
            break
        last = ll
    return ll, theta[0], it + 1


def latent_class_analysis(df: DataFrame, indicators: Sequence[str], k_min: int = 2, k_max: int = 3, seed: int = 0, most: int = 60) -> DataFrame:
    """Bernoulli latent classes on collapsed response patterns, class count by BIC."""
    its = list(indicators)
    d = complete(df, its)
    pat = cut_lineage(d.groupBy(*its).agg(F.count(F.lit(1)).cast("double").alias("w")))
    n = fetch(pat, n=F.sum("w"))["n"]
    j = len(its)
    out = []
    for k in range(k_min, k_max + 1):
        rng = np.random.default_rng(seed)
        start = (np.full(k, 1 / k), rng.uniform(0.25, 0.75, (k, j)))

        def step(pdf, th, k=k):
            pi, p = th
            x, w = pdf[its].to_numpy(float), pdf["w"].to_numpy(float)
            lg = np.log(pi) + x @ np.log(p).T + (1 - x) @ np.log1p(-p).T
            m = lg.max(1, keepdims=True)
            lse = m[:, 0] + np.log(np.exp(lg - m).sum(1))
            r = np.exp(lg - lse[:, None]) * w[:, None]
            ent = -(np.where(r > 0, r * (lg - lse[:, None]), 0)).sum()
            return np.concatenate([[(w * lse).sum()], r.sum(0), (r.T @ x).ravel(), [ent]])

        def update(th, s, k=k):
            nk = s[:k]
            return nk / nk.sum(), np.clip(s[k:k + k * j].reshape(k, j) / nk[:, None], 1e-6, 1 - 1e-6)

        ll, (pi, p), it = _em(pat, step, [start, update], most, 1e-8)
        out.append((k, ll, -2 * ll + (k - 1 + k * j) * math.log(n), pi, p))
    best = min(o[2] for o in out)
    rows = [(k, c + 1, it, float(pi[c]), float(p[c, i]), ll, bic, bic == best) for k, ll, bic, pi, p in out for c in np.argsort(-pi) for i, it in enumerate(its)]
    return rows_frame(df.sparkSession, "classes bigint, class bigint, item string, class_share double, probability double, loglik double, bic double, is_best boolean", rows)


def latent_profile_analysis(df: DataFrame, indicators: Sequence[str], k_min: int = 2, k_max: int = 5, seed: int = 0, most: int = 1000) -> DataFrame:
    """Diagonal Gaussian mixture, class count by BIC; the class counts share their passes, each until it has settled."""
    its = list(indicators)
    d = cut_lineage(complete(df, its))
    g = gram(d, its)
    sd = np.sqrt(np.diag(g.cross) / g.n)
    j = len(its)
    fits, done = {}, {}
    for k in range(k_min, k_max + 1):
        rng = np.random.default_rng(seed)
        fits[k] = (np.full(k, 1 / k), rng.normal(size=(k, j)) * sd, np.tile(sd ** 2, (k, 1)))      # means around the overall ones
    last = dict.fromkeys(fits, -math.inf)
    for _ in range(most):
        open_ = {k: t for k, t in fits.items() if k not in done}

        def run(batches, th=open_, mean=g.mean):
            acc = {k: np.zeros(1 + k + 2 * k * j) for k in th}
            for pdf in batches:
                c = pdf[its].to_numpy(float) - mean
                c2 = c * c
                for k, (pi, mu, v) in th.items():
                    lg = np.log(pi) - 0.5 * (c2 @ (1 / v).T - 2 * c @ (mu / v).T + (mu * mu / v + np.log(2 * math.pi * v)).sum(1))
                    m = lg.max(1, keepdims=True)
                    lse = m[:, 0] + np.log(np.exp(lg - m).sum(1))
                    r = np.exp(lg - lse[:, None])
                    acc[k] += np.concatenate([[lse.sum()], r.sum(0), (r.T @ c).ravel(), (r.T @ c2).ravel()])
            yield pd.DataFrame({"v": [np.concatenate(list(acc.values())).tobytes()]})

        # One packed array of sums from each task, whose length does not depend on the rows.
        total = sum(np.frombuffer(r["v"]) for r in d.mapInPandas(run, "v binary").collect())
        sizes = [1 + k + 2 * k * j for k in open_]
        for k, s in zip(open_, np.split(total, np.cumsum(sizes)[:-1])):
            nk = np.maximum(s[1:1 + k], 1e-9)
            m1, m2 = (x.reshape(k, j) / nk[:, None] for x in np.split(s[1 + k:], 2))
            fits[k] = (nk / nk.sum(), m1, np.maximum(m2 - m1 ** 2, 1e-6 * sd ** 2))
            if abs(s[0] - last[k]) < 1e-7 * (1 + abs(s[0])):
                done[k] = s[0]
            last[k] = s[0]
        if len(done) == len(fits):
            break
    refuse(len(done) < len(fits), f"the classes do not settle in {most} rounds")
    out = [(k, done[k], -2 * done[k] + (k - 1 + 2 * k * j) * math.log(g.n), fits[k][0], fits[k][1] + g.mean) for k in fits]
    best = min(o[2] for o in out)
    rows = [(k, c + 1, it, float(pi[c]), float(mu[c, i]), ll, bic, bic == best) for k, ll, bic, pi, mu in out for c in np.argsort(-pi) for i, it in enumerate(its)]
    return rows_frame(df.sparkSession, "classes bigint, class bigint, indicator string, class_share double, mean double, loglik double, bic double, is_best boolean", rows)


def mahalanobis_outliers(df: DataFrame, features: Sequence[str], id_col: str, alpha: float = 0.975, steps: int = 10) -> DataFrame:
    """Robust distances by concentration steps: refit on the closest half until the determinant settles."""
    fs = list(features)
    d = complete(df, fs, [id_col])
    g = gram(d, fs)
    p = len(fs)
    cut = dist.chi2_ppf(alpha, p)

    def dist2(mean, cov):
        inv = np.linalg.pinv(cov, hermitian=True)
        e = F.lit(0.0)
        for i, a in enumerate(fs):
            for j, b in enumerate(fs):
                e = e + F.lit(float(inv[i, j])) * (F.col(a) - F.lit(float(mean[i]))) * (F.col(b) - F.lit(float(mean[j])))
        return e

    classic = dist2(g.mean, g.cov())
    med = np.array([quantiles(d, c, [0.5])[0] for c in fs])
    mean, cov = med, np.diag(np.diag(g.cov()))
    det = math.inf
    for _ in range(steps):
        t = d.withColumn("__d", dist2(mean, cov))
        h = quantiles(t, "__d", [(g.n + p + 1) / 2 / g.n])[0]
        gh = gram(t.where(F.col("__d") <= F.lit(h)), fs)
        mean, cov = gh.mean, gh.cov()
        new = np.linalg.det(cov)
        if new >= det * (1 - 1e-9):
            break
        det = new
    # consistency factor of the half-sample covariance
    q = dist.chi2_ppf(0.5, p)
    cov = cov * 0.5 / dist.gamma_p(p / 2 + 1, q / 2)
    t = d.select(id_col, F.sqrt(dist2(mean, cov)).alias("robust_distance"), F.sqrt(classic).alias("classical_distance"))
    return t.withColumn("robust_outlier", F.col("robust_distance") > math.sqrt(cut)).withColumn("classical_outlier", F.col("classical_distance") > math.sqrt(cut))


def pca(df: DataFrame, features: Sequence[str], components: int = 10) -> DataFrame:
    """Components of the correlation matrix: variance share and loadings (largest loading positive)."""
    fs = list(features)
    g = gram(complete(df, fs), fs)
    ev, vec = np.linalg.eigh(g.corr())
    o = np.argsort(-ev)[:min(components, len(fs))]
    rows = []
    for k, i in enumerate(o):
        v = vec[:, i] * (1 if vec[np.argmax(np.abs(vec[:, i])), i] > 0 else -1)
        rows += [(k + 1, c, float(v[j] * math.sqrt(max(ev[i], 0))), float(ev[i]), float(ev[i] / len(fs))) for j, c in enumerate(fs)]
    return rows_frame(df.sparkSession, "component bigint, feature string, loading double, eigenvalue double, share double", rows)


def correspondence_analysis(df: DataFrame, column_a: str, column_b: str) -> DataFrame:
    """Row and column coordinates of a two-way table on the first two axes."""
    from .tables import crosstab
    m, la, lb = crosstab(df, column_a, column_b)
    p = m / m.sum()
    r, c = p.sum(1), p.sum(0)
    s = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    u, sv, vt = np.linalg.svd(s, full_matrices=False)
    for k in range(len(sv)):
        if vt[k, np.argmax(np.abs(vt[k]))] < 0:
            vt[k] *= -1
            u[:, k] *= -1
    tot = (sv ** 2).sum()
    rows = []
    for kind, names, xy in (("row", la, u * sv / np.sqrt(r)[:, None]), ("column", lb, vt.T * sv / np.sqrt(c)[:, None])):
        rows += [(kind, str(nm), xy[i, 0], xy[i, 1] if len(sv) > 1 else 0.0, float(tot), float(sv[0] ** 2 / tot)) for i, nm in enumerate(names)]
    return rows_frame(df.sparkSession, "kind string, level string, dim1 double, dim2 double, inertia double, dim1_share double", rows)


# --- supervised -----------------------------------------------------------------------------------

def _split(df, outcome, xs, id_col, pct=25, seed=0):
    """Label, features and a hash-based holdout flag, and the number of classes (0 for a number).

    Text and two-level outcomes become class indices."""
    lv = df.select(outcome).dropna().distinct().limit(21).count()
    text = df.schema[outcome].dataType.simpleString() == "string"
    cls = 2 if text or lv <= 2 else 0
    if cls:
        levels = levels_of(df, outcome)
        cls = max(2, len(levels))
        y = F.create_map(*[x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(float(i)))])[F.col(outcome)]
    else:
        y = num(outcome)
    d = complete(df.select(y.alias("label"), *xs, F.col(id_col).alias("__id")), ["label", *xs], ["__id"])
    d = VectorAssembler(inputCols=list(xs), outputCol="features").transform(d)
    return d.withColumn("holdout", F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(100)) < pct), cls


def _score(pred: DataFrame, cls: bool) -> dict:
    if cls:
        c = collect_bounded(pred.groupBy("label", "prediction").count(), "confusion cells")
        n = sum(r["count"] for r in c)
        acc = sum(r["count"] for r in c if r["label"] == r["prediction"]) / n
        f1 = []
        tot = {}
        for r in c:
            tot[r["label"]] = tot.get(r["label"], 0) + r["count"]
        for k in tot:
            tp = sum(r["count"] for r in c if r["label"] == k == r["prediction"])
            pp = sum(r["count"] for r in c if r["prediction"] == k)
            f1.append(2 * tp / (tot[k] + pp) if tot[k] + pp else 0.0)
        return {"accuracy": acc, "macro_f1": sum(f1) / len(f1), "baseline": max(tot.values()) / n}
    e = F.col("label") - F.col("prediction")
    r = fetch(pred, sse=F.avg(e * e), v=F.var_pop("label"))
    return {"r2": 1 - r["sse"] / r["v"] if r["v"] else float("nan"), "rmse": math.sqrt(r["sse"])}


def _estimator(kind, cls, seed=0, trees=50, depth=5):
    from pyspark.ml import classification as C, regression as R
    if kind == "forest":
        return (C.RandomForestClassifier if cls else R.RandomForestRegressor)(numTrees=trees, maxDepth=depth, seed=seed)
    if kind == "gbt":
        one = (C.GBTClassifier if cls else R.GBTRegressor)(maxIter=20, maxDepth=3, stepSize=0.1, seed=seed)
        return C.OneVsRest(classifier=one) if cls > 2 else one
    if kind == "svm":
        one = C.LinearSVC(maxIter=50, regParam=0.01, standardization=True)
        return C.OneVsRest(classifier=one) if cls > 2 else one
    return C.NaiveBayes(modelType="gaussian")


def _supervised(df, outcome, predictors, id_col, kind, permute=False, seed=0):
    xs = list(predictors)
    d, cls = _split(df, outcome, xs, id_col, seed=seed)
    refuse(kind in ("svm", "nb") and not cls, "this classifier needs a categorical outcome")
    d = d.persist()
    try:
        m = _estimator(kind, cls, seed).fit(d.where(~F.col("holdout")))
        te = d.where(F.col("holdout"))
        s = _score(m.transform(te), cls)
        each = [x.featureImportances.toArray() for x in getattr(m, "models", [m]) if hasattr(x, "featureImportances")]
        imp = [float(v) for v in np.mean(each, axis=0)] if each else [None] * len(xs)
        per = [None] * len(xs)
        if permute:
            main = "accuracy" if cls else "r2"
            n = te.count()
            # A column is shuffled by reading it from the row at another hash position: two positions, one join.
            pos = cut_lineage(sorted_position(te.select("__id", "label", *xs).withColumn("h", F.xxhash64("__id", F.lit(seed + 7)).cast("double")), "h", ["__id"], "p"))
            for i, x in enumerate(xs):
                sh = pos.drop(x).withColumn("q", F.col("p") % n + 1).join(pos.select(F.col("p").alias("q"), F.col(x)), "q")
                per[i] = s[main] - _score(m.transform(VectorAssembler(inputCols=xs, outputCol="features").transform(sh)), cls)[main]
    finally:
        d.unpersist()
    a, b = (s["accuracy"], s["macro_f1"]) if cls else (s["r2"], s["rmse"])
    leak = bool(cls and a > 0.97 and a - s["baseline"] > 0.05) or any(v is not None and v >= 0.9 for v in imp)
    return rows_frame(df.sparkSession, "feature string, importance double, permutation_importance double, task string, score double, second_score double, leak_warning boolean",
                      [(x, v, pv, "classification" if cls else "regression", a, b, leak) for x, v, pv in zip(xs, imp, per)])


def random_forest(df: DataFrame, outcome: str, predictors: Sequence[str], id_col: str) -> DataFrame:
    """Forest with a 25% hash holdout: importances, accuracy + macro F1 or R-squared + RMSE, leak warning."""
    return _supervised(df, outcome, predictors, id_col, "forest")


def xgboost(df: DataFrame, outcome: str, predictors: Sequence[str], id_col: str) -> DataFrame:
    """Boosted trees (MLlib GBT)."""
    return _supervised(df, outcome, predictors, id_col, "gbt")


def gradient_boosting(df: DataFrame, outcome: str, predictors: Sequence[str], id_col: str) -> DataFrame:
    return _supervised(df, outcome, predictors, id_col, "gbt", True)


def svm_model(df: DataFrame, outcome: str, predictors: Sequence[str], id_col: str) -> DataFrame:
    """Linear support vector classifier (kernels and regression are not part of it)."""
    return _supervised(df, outcome, predictors, id_col, "svm")


def naive_bayes(df: DataFrame, outcome: str, predictors: Sequence[str], id_col: str) -> DataFrame:
    return _supervised(df, outcome, predictors, id_col, "nb")


def conformal_prediction(df: DataFrame, outcome: str, predictors: Sequence[str], id_col: str, alpha: float = 0.1, seed: int = 0) -> DataFrame:
    """Split conformal intervals: forest on a half, residual rank on a quarter, coverage on the rest."""
    xs = list(predictors)
    d = complete(df, [outcome, *xs], [id_col]).select(F.col(outcome).alias("label"), *xs, F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(4)).alias("part"))
    d = VectorAssembler(inputCols=xs, outputCol="features").transform(d)
    m = _estimator("forest", False, seed, 30).fit(d.where("part < 2"))
    r = m.transform(d.where("part >= 2")).select("part", F.abs(F.col("label") - F.col("prediction")).alias("r"))
    r = cut_lineage(r)
    cal = r.where("part = 2")
    n = cal.count()
    rank = math.ceil((n + 1) * (1 - alpha))
    capped = rank > n
    q = quantiles(cal, "r", [(min(rank, n) - 1) / max(n - 1, 1)])[0]
    c = fetch(r.where("part = 3"), c=F.avg(F.when(F.col("r") <= F.lit(q), 1.0).otherwise(0.0)), n=F.count(F.lit(1)))
    return one_row(df.sparkSession, n_calibration=int(n), n_test=int(c["n"]), quantile=q, coverage=c["c"], target=1 - alpha, width=2 * q, capped=capped)


def quantile_intervals(df: DataFrame, outcome: str, predictors: Sequence[str], id_col: str, lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """Linear quantile fits on three quarters, coverage and width on the holdout quarter."""
    from .groups import predictor, quantile_fit
    xs = list(predictors)
    d = complete(df, [outcome, *xs], [id_col]).withColumn("__h", F.pmod(F.xxhash64(id_col), F.lit(4)) == 0)
    tr = cut_lineage(d.where(~F.col("__h")))
    b = {t: quantile_fit(tr, outcome, xs, t) for t in (lower, 0.5, upper)}
    lo, hi = predictor(xs, b[lower]), predictor(xs, b[upper])
    s = fetch(d.where("__h"), n=F.count(F.lit(1)), c=F.avg(F.when(F.col(outcome).between(lo, hi), 1.0).otherwise(0.0)), w=F.avg(hi - lo))
    return one_row(df.sparkSession, n_test=int(s["n"]), coverage=s["c"], target=upper - lower, mean_width=s["w"])


# --- interpretation -------------------------------------------------------------------------------

def _black_box(df, outcome, xs, id_col):
    d = complete(df, [outcome, *xs], [id_col]).select(F.col(outcome).alias("label"), *xs, F.col(id_col).alias("__id"))
    return d, _estimator("forest", False, 0, 20).fit(VectorAssembler(inputCols=xs, outputCol="features").transform(d))


def _apply(m, d, xs):
    return m.transform(VectorAssembler(inputCols=list(xs), outputCol="features").transform(d))


def partial_dependence(df: DataFrame, outcome: str, predictors: Sequence[str], id_col: str, features: Sequence[str] | None = None, grid: int = 30) -> DataFrame:
    """Mean prediction with one column set to each point of a fixed grid; rows grow by the grid size only."""
    xs = list(predictors)
    d, m = _black_box(df, outcome, xs, id_col)
    out = None
    for x in features or xs:
        s = fetch(d, lo=F.min(x), hi=F.max(x))
        g = np.linspace(s["lo"], s["hi"], grid)
        e = d.drop(x).withColumn(x, F.explode(F.array(*[F.lit(float(v)) for v in g])))
        t = _apply(m, e, xs).groupBy(F.col(x).alias("value")).agg(F.avg("prediction").alias("mean_prediction")).select(F.lit(x).alias("feature"), "value", "mean_prediction")
        out = t if out is None else out.unionByName(t)
    return out


def accumulated_local_effects(df: DataFrame, outcome: str, predictors: Sequence[str], id_col: str, features: Sequence[str] | None = None, bins: int = 20) -> DataFrame:
    """Mean local prediction differences per quantile bin, accumulated and centred by counts."""
    xs = list(predictors)
    d, m = _black_box(df, outcome, xs, id_col)
    rows = []
    for x in features or xs:
        z = sorted(set(quantiles(d, x, [i / bins for i in range(bins + 1)])))
        lo = F.array(*[F.lit(float(v)) for v in z])
        e = d.withColumn("__k", F.least(F.size(F.filter(lo, lambda q: q < F.col(x))), F.lit(len(z) - 1)))
        e = e.withColumn("__k", F.greatest(F.col("__k"), F.lit(1)))
        both = e.withColumn("__s", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(x, F.element_at(lo, (F.col("__k") + F.col("__s")).cast("int")))
        t = _apply(m, both, xs).groupBy("__k").agg(F.count(F.lit(1)).alias("c"), (F.sum(F.when(F.col("__s") == 1, F.col("prediction"))) - F.sum(F.when(F.col("__s") == 0, F.col("prediction")))).alias("d")).collect()
        acc, cum, tot = [], 0.0, 0.0
        for r in sorted(t, key=lambda r: r["__k"]):
            prev = cum
            cum += r["d"] / (r["c"] / 2)
            acc.append((r["__k"], cum, r["c"] // 2))
            tot += (prev + cum) / 2 * (r["c"] / 2)
        mean = tot / sum(a[2] for a in acc)
        rows += [(x, int(b), z[b], c - mean, n) for b, c, n in acc]
    return rows_frame(df.sparkSession, "feature string, bin bigint, upper_edge double, ale double, n bigint", rows)


def feature_interaction(df: DataFrame, outcome: str, predictors: Sequence[str], id_col: str, grid: int = 5) -> DataFrame:
    """Friedman's H over a small quantile grid of every pair; rows grow by the squared grid size only."""
    xs = list(predictors)
    d, m = _black_box(df, outcome, xs, id_col)
    zs = {x: sorted(set(quantiles(d, x, [(i + 0.5) / grid for i in range(grid)]))) for x in xs}
    arr = lambda v: F.array(*[F.lit(float(q)) for q in v])
    rows = []
    for i, a in enumerate(xs):
        for b in xs[i + 1:]:
            e = d.drop(a, b).withColumn(a, F.explode(arr(zs[a]))).withColumn(b, F.explode(arr(zs[b])))
            t = {(r[a], r[b]): r["p"] for r in _apply(m, e, xs).groupBy(a, b).agg(F.avg("prediction").alias("p")).collect()}
            ea = {r[a]: r["p"] for r in _apply(m, d.drop(a).withColumn(a, F.explode(arr(zs[a]))), xs).groupBy(a).agg(F.avg("prediction").alias("p")).collect()}
            eb = {r[b]: r["p"] for r in _apply(m, d.drop(b).withColumn(b, F.explode(arr(zs[b]))), xs).groupBy(b).agg(F.avg("prediction").alias("p")).collect()}
            mu = np.mean(list(t.values()))
            ma, mb = np.mean(list(ea.values())), np.mean(list(eb.values()))
            top = sum((v - mu - (ea[p] - ma) - (eb[q] - mb)) ** 2 for (p, q), v in t.items())
            low = sum((v - mu) ** 2 for v in t.values())
            rows.append((a, b, math.sqrt(top / low) if low > 0 else 0.0))
    return rows_frame(df.sparkSession, "feature_a string, feature_b string, h double", rows)


def surrogate_model(df: DataFrame, outcome: str, predictors: Sequence[str], id_col: str, max_depth: int = 3) -> DataFrame:
    """Shallow tree fitted to the predictions of a forest: fidelity and the rules."""
    from pyspark.ml.regression import DecisionTreeRegressor
    xs = list(predictors)
    d, m = _black_box(df, outcome, xs, id_col)
    p = _apply(m, d, xs).select("features", F.col("prediction").alias("target"))
    t = DecisionTreeRegressor(labelCol="target", maxDepth=max_depth).fit(p)
    r = fetch(t.transform(p), sse=F.avg((F.col("target") - F.col("prediction")) ** 2), v=F.var_pop("target"))
    return rows_frame(df.sparkSession, "feature string, importance double, fidelity_r2 double, leaves bigint", [(x, float(v), 1 - r["sse"] / r["v"] if r["v"] else None, (t.numNodes + 1) // 2) for x, v in zip(xs, t.featureImportances.toArray())])


# --- imputation -----------------------------------------------------------------------------------

def _normal(*parts: Column) -> Column:
    """Standard normal from a hash of its arguments (Box-Muller)."""
    u = lambda s: (F.pmod(F.xxhash64(*parts, F.lit(s)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(F.lit(2 * math.pi) * u(2))


def mice_imputation(df: DataFrame, id_col: str, outcome: str, predictors: Sequence[str], m: int = 10, cycles: int = 5, seed: int = 42) -> DataFrame:
    """Chained-equation imputations of numeric columns and Rubin's pooled regression, complete cases beside it.

    All imputations run together, tagged by a number; moments of every imputation come from one grouped pass.
    """
    xs = list(predictors)
    cols = [outcome, *xs]
    need(df, id_col, *cols)
    base = df.select(F.col(id_col).alias("__id"), *[num(c).alias(c) for c in cols])
    miss = {c: k for c, k in zip(cols, fetch(base, **{f"m{i}": F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)) for i, c in enumerate(cols)})) if k}
    mean = fetch(base, **{c: F.avg(c) for c in cols})
    cc = ols(gram(base.dropna(), cols), outcome, xs)
    t = base.withColumn("__m", F.explode(F.sequence(F.lit(1), F.lit(m)))).select("__id", "__m", *[F.coalesce(F.col(c), F.lit(mean[c])).alias(c) for c in cols], *[F.col(c).isNull().alias(f"__n_{c}") for c in miss])
    t = cut_lineage(t)
    rng = np.random.default_rng(seed)
    for cyc in range(cycles):
        for c in miss:
            rest = [x for x in cols if x != c]
            gs = gram_by(t.where(~F.col(f"__n_{c}")), [c, *rest], "__m")
            par = {}
            for k, g in gs.items():
                f = ols(g, c, rest)
                s2 = f.rss / rng.chisquare(f.df)
                par[k] = (rng.multivariate_normal(f.beta, f.unscaled * s2), math.sqrt(s2))
            pick = lambda fn: F.create_map(*[z for k, v in par.items() for z in (F.lit(k), F.lit(float(fn(v))))])[F.col("__m")]
            e = pick(lambda v: v[0][0]) + pick(lambda v: v[1]) * _normal(F.col("__id"), F.col("__m"), F.lit(cyc), F.lit(c))
            for i, x in enumerate(rest):
                e = e + pick(lambda v, i=i: v[0][i + 1]) * F.col(x)
            t = t.withColumn(c, F.when(F.col(f"__n_{c}"), e).otherwise(F.col(c)))
        t = cut_lineage(t)
    fits = [ols(g, outcome, xs) for g in gram_by(t, cols, "__m").values()]
    rows = []
    for i, term in enumerate(["intercept", *xs]):
        b = np.array([f.beta[i] for f in fits])
        w, bt = float(np.mean([f.se[i] ** 2 for f in fits])), float(b.var(ddof=1))
        tot = w + (1 + 1 / m) * bt
        fmi = (1 + 1 / m) * bt / tot if tot > 0 else 0.0
        rows.append((term, float(b.mean()), math.sqrt(tot), fmi, (m - 1) / fmi ** 2 if fmi > 0 else None, float(cc.beta[i]), float(cc.se[i]), m))
    return rows_frame(df.sparkSession, "term string, pooled double, se double, fmi double, df double, complete_case double, complete_case_se double, imputations bigint", rows)


# --- item response --------------------------------------------------------------------------------

def _cat_probs(kind: str, th: np.ndarray, par: np.ndarray) -> np.ndarray:
    """nodes x categories probabilities of one item: par = (log slope, locations...)."""
    a, b = math.exp(par[0]), par[1:]
    if kind == "grm":
        cuts = np.concatenate([[b[0]], b[0] + np.cumsum(np.exp(b[1:]))]) if len(b) > 1 else b
        c = np.hstack([np.ones((len(th), 1)), 1 / (1 + np.exp(-a * (th[:, None] - cuts))), np.zeros((len(th), 1))])
        return np.maximum(c[:, :-1] - c[:, 1:], 1e-12)
    z = np.hstack([np.zeros((len(th), 1)), np.cumsum(a * (th[:, None] - b), 1)])
    e = np.exp(z - z.max(1, keepdims=True))
    return np.maximum(e / e.sum(1, keepdims=True), 1e-12)


def irt_fit(df: DataFrame, items: Sequence[str], kind: str, nodes: int = 21, most: int = 40) -> tuple[list[np.ndarray], float, float, list[int], float]:
    """Marginal maximum likelihood: patterns are collapsed once, tasks add expected counts per node, the driver
    updates each item's few parameters."""
    its = list(items)
    d = complete(df, its)
    lo = fetch(d, **{c: F.min(c) for c in its})
    hi = fetch(d, **{c: F.max(c) for c in its})
    k = [int(hi[c] - lo[c]) + 1 for c in its]
    refuse(min(k) < 2, "an item is constant")
    pat = cut_lineage(d.select(*[(F.col(c) - F.lit(lo[c])).cast("int").alias(c) for c in its]).groupBy(*its).agg(F.count(F.lit(1)).cast("double").alias("w")))
    th = np.linspace(-4.5, 4.5, nodes)
    wt = np.exp(-th ** 2 / 2)
    wt /= wt.sum()
    par = [np.concatenate([[0.0], [0.0 if kind == "grm" and kk > 2 else 0.0], np.zeros(max(kk - 2, 0)) + (-0.5 if kind == "grm" else 0.0)]) for kk in k]
    off = np.concatenate([[0], np.cumsum([kk * nodes for kk in k])]).astype(int)

    def step(pdf, p):
        x, w = pdf[its].to_numpy(int), pdf["w"].to_numpy(float)
        lp = [np.log(_cat_probs(kind, th, q)) for q in p]
        l = np.log(wt) + sum(lp[j][:, x[:, j]].T for j in range(len(its)))
        m = l.max(1, keepdims=True)
        lse = m[:, 0] + np.log(np.exp(l - m).sum(1))
        post = np.exp(l - lse[:, None]) * w[:, None]
        eap = (post / w[:, None]) @ th
        v = (post / w[:, None]) @ (th ** 2) - eap ** 2
        out = np.zeros(1 + off[-1] + 3)
        out[0] = (w * lse).sum()
        for j, kk in enumerate(k):
            for c in range(kk):
                out[1 + off[j] + c * nodes:1 + off[j] + (c + 1) * nodes] = post[x[:, j] == c].sum(0)
        out[-3:] = [(w * eap).sum(), (w * eap * eap).sum(), (w * v).sum()]
        return out

    def update(p, s):
        new = []
        common = []
        for j, kk in enumerate(k):
            r = s[off[j]:off[j + 1]].reshape(kk, nodes).T
            f = lambda q: float((r * np.log(_cat_probs(kind, th, q))).sum())
            q = p[j].copy()
            free = [i for i in range(len(q)) if not (kind == "rasch" and i == 0)]
            for _ in range(4):
                h = 1e-4
                g = np.array([(f(q + h * np.eye(len(q))[i]) - f(q - h * np.eye(len(q))[i])) / (2 * h) for i in free])
                hs = np.array([[(f(q + h * (np.eye(len(q))[a] + np.eye(len(q))[b])) - f(q + h * (np.eye(len(q))[a] - np.eye(len(q))[b])) - f(q - h * (np.eye(len(q))[a] - np.eye(len(q))[b])) + f(q - h * (np.eye(len(q))[a] + np.eye(len(q))[b]))) / (4 * h * h) for b in free] for a in free])
                ev, vec = np.linalg.eigh(-hs)
                st = vec @ ((vec.T @ g) / np.maximum(np.abs(ev), 1e-3))
                st = np.clip(st, -1, 1)
                base, sc = f(q), 1.0
                while sc > 1e-3:
                    c = q.copy()
                    c[free] += sc * st
                    if f(c) >= base:
                        q = c
                        break
                    sc /= 2
                if np.abs(st).max() < 1e-5:
                    break
            q[0] = min(max(q[0], -4.0), 3.0)
            new.append(q)
        update.tail = s[-3:]
        return new

    ll, par, it = _em(pat, step, [par, update], most, 1e-6)
    n = fetch(pat, n=F.sum("w"))["n"]
    me, m2, pv = update.tail / n
    ve = m2 - me * me
    return par, ll, float(ve / (ve + pv)) if ve + pv > 0 else 0.0, k, n


def _irt_frame(df, items, kind):
    par, ll, rel, k, n = irt_fit(df, items, kind)
    rows = []
    for it, q, kk in zip(items, par, k):
        b = q[1:]
        if kind == "grm" and len(b) > 1:
            b = np.concatenate([[b[0]], b[0] + np.cumsum(np.exp(b[1:]))])
        rows += [(it, i + 1, math.exp(q[0]), float(v), ll, rel, int(n)) for i, v in enumerate(b)]
    return rows_frame(df.sparkSession, "item string, threshold bigint, discrimination double, difficulty double, loglik double, reliability double, n bigint", rows)


def irt_rasch(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """Equal-slope model with N(0,1) abilities: difficulties and separation reliability."""
    return _irt_frame(df, list(items), "rasch")


def irt_2pl(df: DataFrame, items: Sequence[str]) -> DataFrame:
    return _irt_frame(df, list(items), "2pl")


def irt_grm(df: DataFrame, items: Sequence[str]) -> DataFrame:
    return _irt_frame(df, list(items), "grm")


def irt_pcm(df: DataFrame, items: Sequence[str]) -> DataFrame:
    return _irt_frame(df, list(items), "pcm")


def lime_explanation(df: DataFrame, outcome: str, predictors: Sequence[str], id_col: str, samples: int = 500, ridge: float = 1.0) -> DataFrame:
    """Local linear explanations of a forest at rows with a low, middle and high prediction.

    Neighbours are drawn around each row with the columns' standard deviations, weighted by an exponential kernel of
    their standardised distance, and fitted by weighted ridge from one grouped moment pass.
    """
    from ..plans.gram import weighted_gram
    xs = list(predictors)
    d, m = _black_box(df, outcome, xs, id_col)
    g = gram(d, xs)
    sd = np.sqrt(np.diag(g.cov()))
    p = _apply(m, d, xs).select("__id", "prediction", *xs)
    rows = []
    for tag, q in zip(("low", "middle", "high"), quantiles(p, "prediction", [0.05, 0.5, 0.95])):
        r = p.orderBy(F.abs(F.col("prediction") - F.lit(q)), "__id").limit(1).collect()[0]
        rows.append((tag, str(r["__id"]), float(r["prediction"]), *[float(r[x]) for x in xs]))
    inst = rows_frame(df.sparkSession, "tag string, row string, target double, " + ", ".join(f"`c_{x}` double" for x in xs), rows)
    e = inst.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    e = e.select("tag", *[_normal(F.col("row"), F.col("k"), F.lit(x)).alias(f"z_{x}") for x in xs], *[f"c_{x}" for x in xs])
    e = e.select("tag", *[f"z_{x}" for x in xs], *[(F.col(f"c_{x}") + F.col(f"z_{x}") * F.lit(float(s))).alias(x) for x, s in zip(xs, sd)])
    width = 0.75 * math.sqrt(len(xs))
    w = F.exp(-sum([F.col(f"z_{x}") ** 2 for x in xs], F.lit(0.0)) / F.lit(width ** 2))
    t = _apply(m, e, xs).select("tag", F.col("prediction").alias("__p"), w.alias("__w"), *[f"z_{x}" for x in xs])
    out = []
    zs = [f"z_{x}" for x in xs]
    for (tag,), gm in weighted_gram(t, ["__p", *zs], F.col("__w"), ["tag"]).items():
        b = np.linalg.solve(gm.sub(zs, zs) + ridge * np.eye(len(zs)), gm.sub(zs, ["__p"])[:, 0])
        r2 = 1 - float(gm.cross[0, 0] - 2 * b @ gm.sub(zs, ["__p"])[:, 0] + b @ gm.sub(zs, zs) @ b) / gm.cross[0, 0] if gm.cross[0, 0] > 0 else None
        base = next(r for r in rows if r[0] == tag)
        out += [(tag, base[1], base[2], x, float(v), r2) for x, v in zip(xs, b)]
    return rows_frame(df.sparkSession, "instance string, row_id string, prediction double, feature string, local_effect double, local_r2 double", out)
