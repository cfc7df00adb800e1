"""Checked queries: machine learning, mixtures, item response, interpretation, imputation."""

from __future__ import annotations

from ..operators import density, learning as J
from .tables import ORACLE, q, qs, query, rounded

_e = [f"e{i}" for i in range(64)]
_em = "select vec_id, " + ", ".join(f"cast(element_at(embedding, {i + 1}) as double) as {c}" for i, c in enumerate(_e)) + ", label from embeddings"
query("kmeans_clustering", _em, lambda d: rounded(J.kmeans_clustering(d, _e)))
query("gaussian_mixture", _em, lambda d: rounded(J.gaussian_mixture(d, _e, 3)))
query("latent_profile_analysis", _em, lambda d: rounded(J.latent_profile_analysis(d, _e)))
_it = ["i1", "i2", "i3", "i4", "i5", "i6"]
query("latent_class_analysis", "fx_items", lambda d: rounded(J.latent_class_analysis(d, _it)))
_li = "select *, l_orderkey * 10 + l_linenumber as id, l_extendedprice / 10000 as p from lineitem"
_x = ["l_quantity", "l_discount", "l_tax"]
query("mahalanobis_outliers", _li, lambda d: rounded(J.mahalanobis_outliers(d, ["p", "l_quantity"], "id").select("id", "classical_distance", "classical_outlier"), 5),
      f"""with c as (select avg(p) m1, avg(l_quantity) m2, var_samp(p) a, var_samp(l_quantity) b, covar_samp(p, l_quantity) c from src), d as (select id, sqrt((b * power(p - m1, 2) - 2 * c * (p - m1) * (l_quantity - m2) + a * power(l_quantity - m2, 2)) / (a * b - c * c)) d from src, c)
      select id, {q('d', 'classical_distance', 5)}, d > sqrt(7.377758908227871) as classical_outlier from d""")
query("pca", _li, lambda d: rounded(J.pca(d, ["p", "l_quantity"]).select("component", "feature", "eigenvalue", "share"), 6),
      f"""with c as (select abs(corr(p, l_quantity)) r from src) select cast(k as bigint) as component, f as feature, {qs(6, eigenvalue='case when k = 1 then 1 + r else 1 - r end', share='case when k = 1 then (1 + r) / 2 else (1 - r) / 2 end')} from c, (values (1), (2)) a(k), (values ('p'), ('l_quantity')) b(f)""")
query("correspondence_analysis", "orders", lambda d: rounded(J.correspondence_analysis(d, "o_orderpriority", "o_orderstatus").select("kind", "level", "inertia"), 8),
      f"""with c as (select o_orderpriority a, o_orderstatus b, count(*)::double o from src group by 1, 2), e as (select *, sum(o) over (partition by a) * sum(o) over (partition by b) / sum(o) over () e, sum(o) over () n from c), i as (select sum(power(o - e, 2) / e) / max(n) i from e)
      select kind, level, {q('i', 'inertia', 8)} from i, (select distinct 'row' kind, a level from c union all select distinct 'column', b from c)""")
for _n, _f in (("random_forest", J.random_forest), ("xgboost", J.xgboost)):
    query(_n, _li, lambda d, f=_f: rounded(f(d, "p", _x, "id")))
query("gradient_boosting", _li, lambda d: rounded(J.gradient_boosting(d, "p", _x, "id")))
query("svm_model", _li, lambda d: rounded(J.svm_model(d, "l_linestatus", _x, "id")))
query("naive_bayes", _li, lambda d: rounded(J.naive_bayes(d, "l_returnflag", _x, "id")))
query("conformal_prediction", _li, lambda d: rounded(J.conformal_prediction(d, "p", _x, "id")))
query("quantile_intervals", _li, lambda d: rounded(J.quantile_intervals(d, "p", ["l_quantity"], "id"), 2))
_pt = "select p_partkey, p_retailprice, cast(p_size as double) as s, cast(p_partkey % 97 as double) as m from part"
query("partial_dependence", _pt, lambda d: rounded(J.partial_dependence(d, "p_retailprice", ["s", "m"], "p_partkey"), 3))
query("accumulated_local_effects", _pt, lambda d: rounded(J.accumulated_local_effects(d, "p_retailprice", ["s", "m"], "p_partkey"), 3))
query("feature_interaction", _pt, lambda d: rounded(J.feature_interaction(d, "p_retailprice", ["s", "m"], "p_partkey"), 3))
query("surrogate_model", _pt, lambda d: rounded(J.surrogate_model(d, "p_retailprice", ["s", "m"], "p_partkey"), 3))
query("mice_imputation", "select *, cast(id % 13 as double) as c from (select c_custkey as id, case when c_custkey % 10 = 0 then null else c_acctbal end as a, case when c_custkey % 7 = 0 then null else cast(c_nationkey as double) end as b from customer) s0",
      lambda d: rounded(J.mice_imputation(d, "id", "a", ["b", "c"], 5, 3)))
query("irt_rasch", "fx_items", lambda d: rounded(J.irt_rasch(d, _it), 3))
query("irt_2pl", "fx_items", lambda d: rounded(J.irt_2pl(d, _it), 3))
_lk = ["q1", "q2", "q3", "q4", "q5"]
query("irt_grm", "fx_likert", lambda d: rounded(J.irt_grm(d.select(*[d[c].cast("double").alias(c) for c in _lk]), _lk), 2))
query("irt_pcm", "fx_likert", lambda d: rounded(J.irt_pcm(d.select(*[d[c].cast("double").alias(c) for c in _lk]), _lk), 2))
query("lime_explanation", _pt, lambda d: rounded(J.lime_explanation(d, "p_retailprice", ["s", "m"], "p_partkey"), 3))
query("dbscan_clustering", _em, lambda d: density.dbscan_clustering(d, _e, "vec_id", 9.45, 5))
ORACLE["dbscan_clustering"] = """with recursive u as (select vec_id, unnest(embedding)::double as v, unnest(range(len(embedding))) as k from embeddings),
m as (select k, avg(v) as m, stddev_pop(v) as s from u group by k), z as materialized (select vec_id, list((v - m) / s order by k) as z from u join m using (k) group by vec_id),
near as materialized (select a.vec_id as a, b.vec_id as b from z a join z b on list_distance(a.z, b.z) <= 9.45), c as (select a, count(*) as n from near group by a),
core as materialized (select a from c where n >= 5), e as materialized (select near.a, b from near semi join core on core.a = near.a semi join (select a as b from core) using (b)),
r as (select a, a as b from core union select r.a, e.b from r join e on e.a = r.b), root as (select a, min(b) as root from r group by a),
k as (select a, dense_rank() over (order by root) - 1 as k from root), border as (select near.a, min(b) as b from near semi join (select a as b from core) using (b) anti join core on core.a = near.a group by near.a)
select c.a as vec_id, coalesce(k.k, g.k, -1) as cluster, k.k is not null as core, n as neighbours from c left join k on k.a = c.a left join border on border.a = c.a left join k g on g.a = border.b"""
