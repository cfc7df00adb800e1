"""Checked queries: profile, quality, cleaning, recommendation, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import profile as P, recommend as R
from ..sources import tables as S
from .tables import FX, q, qs, query, rounded

query("profile", "orders", lambda d: rounded(P.profile(d)),
      "with n as (select count(*) n from src) " + " union all ".join(
          f"""select '{c}' as "column", '{k}' as kind, '{t}' as dtype, n - count({c}) as n_missing, count(distinct {c}) as n_unique, false as ordinal_like, n as n_rows from src, n group by n""" for c, k, t in
          (("o_orderkey", "id", "bigint"), ("o_custkey", "continuous", "bigint"), ("o_orderstatus", "categorical", "string"), ("o_totalprice", "continuous", "double"), ("o_orderdate", "datetime", "timestamp_ntz"), ("o_orderpriority", "categorical", "string")))
      .replace("'o_custkey' as \"column\", 'continuous'", "'o_custkey' as \"column\", case when max(o_custkey) < 1000 then 'count' else 'continuous' end"))
query("quality_issues", "fx_nulls", lambda d: rounded(P.quality_issues(d).where("kind = 'missing'"), 4, ["kind", "column", "count"]),
      """select 'missing' as kind, 'a' as "column", count(*) - count(a) as count from src union all select 'missing', 'b', count(*) - count(b) from src""")
query("clean", "fx_nulls", lambda d: rounded(P.clean(d)[0], 6),
      f"select id, {qs(6, a='coalesce(a, (select quantile_cont(a, 0.5) from src))', b='coalesce(b, (select quantile_cont(b, 0.5) from src))')}, s from src")
query("detect_structure", "fx_panel", lambda d: rounded(P.detect_structure(d)))
query("detect_roles", "fx_treat", lambda d: rounded(P.detect_roles(d)))
query("diagnostics", "lineitem", lambda d: rounded(P.diagnostics(d, "l_extendedprice", ["l_quantity", "l_discount"])))
query("coerce_numeric", "orders", lambda d: rounded(S.coerce_numeric(d.select("o_orderkey", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price"),
                                                                              F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit("%")).alias("pct"), "o_orderpriority"))[0], 4),
      f"select o_orderkey, {qs(price='o_totalprice', pct='(o_orderkey % 90) / 100.0')}, o_orderpriority from src")
query("manifest", "orders", lambda d: S.manifest(d, "profile", {"k": 1}).select("op", "params", "rows"), """select 'profile' as op, '{"k": 1}' as params, count(*) as rows from src""")
query("check_preconditions", "fx_panel", lambda d: R.check_preconditions(d).select("id", F.array_join("unmet", ", ").alias("unmet")))
query("recommend", "fx_panel", lambda d: R.recommend(d))
query("select_top", "fx_panel", lambda d: R.select_top(d))
_ever = f"select *, case when g > 0 then 1 else 0 end as ever, case when period >= 1998 then 1 else 0 end as late from ({FX['fx_panel']})"
query("pick_did_treatment", _ever, lambda d: rounded(P.pick_did_treatment(d, "unit", ["ever", "treated", "late"]), 6),
      f"""with v as (select unit, (min(ever) <> max(ever))::int a, (min(treated) <> max(treated))::int b, (min(late) <> max(late))::int c from src group by unit), s as (select avg(a) a, avg(b) b, avg(c) c from v)
      select column_name as "column", {q('x', 'share_varying', 6)}, x > 0 and k = first_value(k) over (order by x desc, k) as picked from (select 'ever' as column_name, a as x, 1 as k from s union all select 'treated', b, 2 from s union all select 'late', c, 3 from s)""")
query("resolve_outcome", "fx_treat", lambda d: d.sparkSession.createDataFrame([(P.resolve_outcome(d, ["x1", "x2", "y"]), ",".join(P.resolve_predictors(d, "y")))], "outcome string, predictors string"))
