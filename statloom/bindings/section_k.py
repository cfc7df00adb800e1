"""Checked queries: graphs and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ENGLISH_STOP
from ..operators import networks as N, textual as T
from .tables import q, qs, query, rounded

_stop = "(" + ", ".join(f"'{w}'" for w in ENGLISH_STOP) + ")"
_tok = f"tk as (select doc_id, w from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) w from src) where w not in {_stop})"
_tokw = f"tk as (select doc_id, w from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) w from src) where regexp_full_match(w, '[a-z]{{2,}}') and w not in {_stop})"
query("word_frequency", "documents", lambda d: rounded(T.word_frequency(d, "text"), 8),
      f"with {_tok} select w as word, count(*) as tf, count(distinct doc_id) as df, {q('count(*)::double / sum(count(*)) over ()', 'share', 8)} from tk group by w")
_tfi = f"""with {_tokw}, t as (select doc_id, w, count(*)::double tf from tk group by 1, 2), n as (select count(*)::double n from src),
 v as (select w, count(*)::double df, ln((1 + max(n)) / (1 + count(*))) + 1 idf from t, n group by 1), r as (select doc_id, t.w, df, tf * idf raw from t join v on t.w = v.w),
 u as (select doc_id, w, df, raw / sqrt(sum(raw * raw) over (partition by doc_id)) x from r)"""
query("tfidf_keywords", "documents", lambda d: rounded(T.tfidf_keywords(d, "doc_id", "text", top_n=None), 7),
      _tfi + f" select w as word, {q('sum(x) / max(n)', 'mean_tfidf', 7)}, cast(max(df) as bigint) as df from u, n group by w")
query("tfidf_keywords_by_group", "documents", lambda d: rounded(T.tfidf_keywords(d, "doc_id", "text", "lang", top_n=20), 7),
      _tfi + f""", g as (select lang, count(*)::double k from src group by 1), m as (select s.lang, w, sum(x) / max(k) z from u join src s on u.doc_id = s.doc_id join g on s.lang = g.lang group by 1, 2),
      o as (select *, row_number() over (partition by lang order by round(z, 10) desc, w) i from m) select lang, w as word, {q('z', 'mean_tfidf', 7)}, i as rank from o where i <= 20""")
query("lda_topic_model", "documents", lambda d: rounded(T.lda_topic_model(d, "text")))
_lx = "select word, cast(case when length(word) % 3 = 0 then 0.5 when length(word) % 3 = 1 then -0.5 else 0.1 end as double) as score from (select distinct lower(o_orderpriority) as word from orders) z"


def _lex(b):
    w = b.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word")).distinct()
    n = F.length("word") % 3
    return w.withColumn("score", F.when(n == 0, 0.5).when(n == 1, -0.5).otherwise(0.1))


query("sentiment_analysis", "documents", lambda d, lx: rounded(T.sentiment_analysis(d, "doc_id", "text", _lex(lx), "lang")),
      f"""with l as (select distinct w, case when length(w) % 3 = 0 then 0.5 when length(w) % 3 = 1 then -0.5 else 0.1 end::double s from (select unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) w from lx)),
      t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) w from src), h as (select doc_id, sum(s) p from t join l on t.w = l.w group by 1),
      p as (select lang, coalesce(p, 0) p from src left join h on src.doc_id = h.doc_id)
      select lang, count(*) as n, {qs(mean_polarity='avg(p)', positive='avg((p > 0.05)::int)', neutral='avg((p <= 0.05 and p >= -0.05)::int)', negative='avg((p < -0.05)::int)')} from p group by lang""",
      {"lx": "select item_id, text from benchmark"})
_dict = {"articles": ["the", "an", "la", "le"], "links": ["and", "or", "und", "et"], "places": ["in", "on", "at"]}
_hits = "with h as (select doc_id, " + ", ".join(
    f"len(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda x: x in ({', '.join(chr(39) + w + chr(39) for w in ws)}))) as {k}" for k, ws in _dict.items()) + " from src)"
query("content_analysis", "documents", lambda d: rounded(T.content_analysis(d, "doc_id", "text", _dict)),
      _hits + " " + " union all ".join(f"select '{k}' as category, cast(sum({k}) as bigint) as total_hits, cast(sum(({k} > 0)::int) as bigint) as docs, {q(f'avg(({k} > 0)::int)', 'share')} from h" for k in _dict))
query("coded_documents", "documents", lambda d: rounded(T.coded_documents(d, "doc_id", "text", _dict)),
      _hits + f""" select doc_id, articles as hits_articles, links as hits_links, places as hits_places, case when greatest(articles, links, places) = 0 then '(none)'
      when articles = greatest(articles, links, places) then 'articles' when links = greatest(articles, links, places) then 'links' else 'places' end as dominant from h""")
query("category_cooccurrence", "documents", lambda d: rounded(T.category_cooccurrence(d, "doc_id", "text", _dict)),
      _hits + " select * from (" + " union all ".join(f"select '{a}' as category1, '{b}' as category2, cast(sum(({a} > 0 and {b} > 0)::int) as bigint) as docs_both from h"
                                                   for a, b in (("articles", "links"), ("articles", "places"), ("links", "places"))) + ") where docs_both > 0")
query("semantic_network", "documents", lambda d: rounded(T.semantic_network(d, "text")),
      f"""with {_tok}, top as (select w from tk group by w having count(*) >= 2 order by count(*) desc, w limit 30), dw as (select distinct doc_id, tk.w from tk join top on tk.w = top.w)
      select a.w as word1, b.w as word2, count(*) as docs from dw a join dw b on a.doc_id = b.doc_id and a.w < b.w group by 1, 2 having count(*) >= 2""")

_und = "with e as (select distinct src as a, dst as b from src), b as (select a u, b v from e union all select b, a from e), dg as (select u, count(*)::double k from b group by 1)"
query("network_analysis", "fx_edges", lambda d: rounded(N.network_analysis(d, "src", "dst"), 6, ["nodes", "edges", "density", "mean_degree", "max_degree", "average_clustering", "triangles", "assortativity"]),
      _und + f""", w as (select x.u, count(*)::double t from b x join b y on x.u = y.u and x.v < y.v join e on e.a = x.v and e.b = y.v group by 1),
      c as (select dg.u, k, coalesce(t, 0) t, case when k > 1 then 2 * coalesce(t, 0) / (k * (k - 1)) else 0 end c from dg left join w on dg.u = w.u),
      z as (select corr(p.k, r.k) r from b join dg p on b.u = p.u join dg r on b.v = r.u)
      select count(*) as nodes, cast(sum(k) / 2 as bigint) as edges, {qs(6, density='sum(k) / (count(*) * (count(*) - 1))', mean_degree='avg(k)')}, cast(max(k) as bigint) as max_degree,
      {q('avg(c)', 'average_clustering', 6)}, cast(sum(t) / 3 as bigint) as triangles, {q('max(r)', 'assortativity', 6)} from c, z""")
# Sparse graph: suppliers linked to customers of the same nation with an order between them.
_bip = "select l_suppkey as src, 1000000 + o_custkey as dst, count(*) as wt from lineitem join orders on l_orderkey = o_orderkey group by l_suppkey, o_custkey"
query("path_lengths", _bip, lambda d: rounded(N.path_lengths(d, "src", "dst")))
query("centrality_suite", "fx_edges", lambda d: rounded(N.centrality_suite(d, "src", "dst", "wt"), 6))
query("community_detection", "fx_edges", lambda d: rounded(N.community_detection(d, "src", "dst", "wt")))
_lab = "select p_partkey as u, p_size % 5 as label from part"
query("stochastic_block_model", "fx_edges", lambda d, lab: rounded(N.stochastic_block_model(d, "src", "dst", lab), 4),
      _und + f""", s as (select label l, count(*)::double n from lab group by 1), x as (select least(i.label, j.label) p, greatest(i.label, j.label) r, count(*)::double m from e join lab i on e.a = i.u join lab j on e.b = j.u group by 1, 2),
      y as (select p, r, m, i.n ni, j.n nj, case when p = r then i.n * (i.n - 1) / 2 else i.n * j.n end t from x join s i on p = i.l join s j on r = j.l)
      select cast(p as bigint) as block_i, cast(r as bigint) as block_j, cast(ni as bigint) as n_i, cast(nj as bigint) as n_j, cast(m as bigint) as edges, {qs(density='m / t', loglik='m * ln(m / t) + (t - m) * ln(1 - m / t)')} from y""",
      {"lab": _lab})
_lp = """with e as (select distinct src a, dst b from src), h as (select a x, b y from e where (a * 31 + b * 17) % 100 < 15), tr as (select a, b from e where (a * 31 + b * 17) % 100 >= 15), mx as (select max(b) m from e),
 nd as (select a z from e union select b from e), c0 as (select x, y, k, (y * 7919 + x * 104729 + k * 15485863) % (m + 1) z from h, mx, range(1, 9) r(k)),
 c1 as (select x, y, k, least(x, z) lo, greatest(x, z) hi from c0 where z <> x and z in (select z from nd)), c2 as (select c1.* from c1 left join e on lo = a and hi = b where a is null),
 ng as (select distinct lo x, hi y from (select *, row_number() over (partition by x, y order by k) i from c2) where i = 1),
 p as (select x, y, 1 l from h union all select x, y, 0 from ng), b as (select a u, b v from tr union all select b, a from tr), dg as (select u, count(*)::double k from b group by 1),
 cm as (select p.x, p.y, p.l, count(*)::double c, sum(1 / ln(k)) aa, sum(1 / k) ra from p join b i on p.x = i.u join b j on p.y = j.u and i.v = j.v join dg on i.v = dg.u group by 1, 2, 3),
 s as (select p.l, coalesce(c, 0) c, coalesce(aa, 0) aa, coalesce(ra, 0) ra, coalesce(d1.k, 0) k1, coalesce(d2.k, 0) k2 from p left join cm on p.x = cm.x and p.y = cm.y and p.l = cm.l left join dg d1 on p.x = d1.u left join dg d2 on p.y = d2.u),
 v as (select 'common_neighbours' n, l, c v from s union all select 'jaccard', l, coalesce(c / nullif(k1 + k2 - c, 0), 0) from s union all select 'adamic_adar', l, aa from s union all select 'resource_allocation', l, ra from s
  union all select 'preferential_attachment', l, k1 * k2 from s),
 r as (select n, l, rank() over (partition by n order by round(v, 10)) + (count(*) over (partition by n, round(v, 10)) - 1) / 2.0 r from v)"""
query("link_prediction", "fx_edges", lambda d: rounded(N.link_prediction(d, "src", "dst"), 6),
      _lp + f" select n as score, cast(sum(l) as bigint) as held_out, count(*) - cast(sum(l) as bigint) as non_edges, {q('(sum(case when l = 1 then r else 0 end) - sum(l) * (sum(l) + 1) / 2.0) / (sum(l) * (count(*) - sum(l)))', 'auc', 6)} from r group by n")
_supply = "select l_suppkey as src, 1000000 + l_partkey as dst, count(*) as wt from lineitem group by l_suppkey, l_partkey"
query("betweenness", _supply, lambda d: rounded(N.betweenness(N.undirected(d, "src", "dst")).withColumnRenamed("u", "node"), 8))
query("centrality_correlations", _supply, lambda d: rounded(N.rank_correlations(N.centrality_suite(d, "src", "dst", "wt"), ["degree_centrality", "pagerank", "eigenvector", "closeness", "betweenness"])))
