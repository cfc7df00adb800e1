"""Checked queries: linear, panel, generalised linear and limited-outcome models."""

from __future__ import annotations

from ..operators import linear as D, panel_gmm as G
from .tables import FX, q, qs, query, rounded

_x = ["l_quantity"]
query("ols_regression", "lineitem", lambda d: rounded(D.ols_regression(d, "l_extendedprice", _x), 6, ["term", "coef", "se", "n", "r2"]),
      f"""with f as (select count(*)::double n, regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a, avg(l_quantity) mx, regr_sxx(l_extendedprice, l_quantity) sxx, regr_r2(l_extendedprice, l_quantity) r2 from src),
      m as (select sum(power((l_quantity - mx) * (l_extendedprice - a - b * l_quantity), 2)) m, sum(power((1 / n - mx * (l_quantity - mx) / sxx) * (l_extendedprice - a - b * l_quantity), 2)) m0 from src, f)
      select 'l_quantity' as term, {qs(6, coef='b', se='sqrt(n / (n - 2) * m) / sxx')}, cast(n as bigint) as n, {q('r2', 'r2', 6)} from f, m
      union all select 'intercept', {qs(6, coef='a', se='sqrt(n / (n - 2) * m0)')}, cast(n as bigint), {q('r2', 'r2', 6)} from f, m""")
_pw = """with w as (select unit, period, y - avg(y) over (partition by unit) - avg(y) over (partition by period) + avg(y) over () y, {x} - avg({x}) over (partition by unit) - avg({x}) over (partition by period) + avg({x}) over () x from src),
 b as (select sum(x * y) / sum(x * x) b, sum(x * x) sxx, count(*)::double n from w), s as (select unit, sum(x * (y - b * x)) s from w, b group by 1), g as (select sum(s * s) m, count(*)::double g from s)
 select '{x}' as term, """ + qs(6, coef="b", se="sqrt(g / (g - 1) * (n - 1) / (n - 1) * m) / sxx") + ", cast(n as bigint) as n from b, g"
query("panel_fixed_effects", "fx_panel", lambda d: rounded(D.panel_fixed_effects(d, "y", ["x"], "unit", "period"), 6, ["term", "coef", "se", "n"]), _pw.format(x="x"))
query("did", "fx_panel", lambda d: rounded(D.did(d, "y", "treated", "unit", "period"), 6, ["term", "coef", "se", "n"]), _pw.format(x="treated"))
_lg = "select l_extendedprice / 10000 as p, l_quantity, l_discount, case when l_returnflag = 'R' then 1 else 0 end as r, l_linenumber as o, l_orderkey * 10 + l_linenumber as id from lineitem"
query("logistic_regression", _lg, lambda d: rounded(D.logistic_regression(d, "r", ["p", "l_discount"])))
_pr = "select *, o_totalprice / 100000 as tp, cast(o_custkey % 7 as double) as c7 from orders"
query("multinomial_logit", _pr, lambda d: rounded(D.multinomial_logit(d, "o_orderstatus", ["tp", "c7"])))
query("mnl_choice", _pr, lambda d: rounded(D.mnl_choice(d, "o_orderpriority", ["tp"])))
query("conditional_logit", "fx_choice", lambda d: rounded(D.conditional_logit(d, "choice_id", "chosen", ["price", "qty"], "price")))
_od = "select cast(floor(p_size / 13) as bigint) as sz, p_retailprice / 1000 as rp, cast(p_partkey % 11 as double) as k from part"
query("ordered_logit", _od, lambda d: rounded(D.ordered_logit(d, "sz", ["rp", "k"])))
query("proportional_odds_logit", _od, lambda d: rounded(D.proportional_odds_logit(d, "sz", ["rp"])))
query("ordered_probit", _od, lambda d: rounded(D.ordered_probit(d, "sz", ["rp", "k"])))
query("brant_test", _od, lambda d: rounded(D.brant_test(d, "sz", ["rp", "k"])))
_ct = "select cast(floor(value / 20) as double) as n, case when event_type = 'error' then 1.0 else 0.0 end as err, cast(user_id % 10 as double) as u from events"
query("poisson_regression", _ct, lambda d: rounded(D.poisson_regression(d, "n", ["err", "u"])))
query("negative_binomial_regression", _ct, lambda d: rounded(D.negative_binomial_regression(d, "n", ["err", "u"])))
query("zero_inflated_poisson", _ct, lambda d: rounded(D.zero_inflated_poisson(d, "n", ["u"])))
query("zero_inflated_negbin", _ct, lambda d: rounded(D.zero_inflated_negbin(d, "n", ["u"])))
query("tweedie_glm", _lg, lambda d: rounded(D.tweedie_glm(d, "p", ["l_quantity", "l_discount"])))
_cu = "select case when c_acctbal > 0 then c_acctbal / 1000 else 0 end as bal, cast(c_nationkey as double) as nk, c_acctbal / 1000 as raw, cast(c_custkey % 5 as double) as k, case when c_acctbal > 1000 then c_acctbal / 1000 end as seen from customer"
query("tobit_regression", _cu, lambda d: rounded(D.tobit_regression(d, "bal", ["nk", "k"])))
query("truncated_regression", _cu, lambda d: rounded(D.truncated_regression(d, "raw", ["nk", "k"])))
query("heckman_selection", _cu, lambda d: rounded(D.heckman_selection(d, "seen", ["nk"], ["nk", "k"])))
query("regularized_regression", "lineitem", lambda d: rounded(D.regularized_regression(d, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], folds=3), 2))
query("pls_regression", _lg, lambda d: rounded(D.pls_regression(d, "p", ["l_quantity", "l_discount", "o"], "id")))
query("mixed_effects", _pr, lambda d: rounded(D.mixed_effects(d, "tp", ["c7"], "o_custkey")))
query("gam", _lg, lambda d: rounded(D.gam(d, "p", ["l_quantity", "l_discount"])))
_r3 = """with c as (select corr(p, l_quantity) r1, corr(p, l_discount) r2, corr(l_quantity, l_discount) r3 from src), s as (select r1 * r1 a, r2 * r2 b, (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r3) / (1 - r3 * r3) f from c) """
query("dominance_analysis", _lg, lambda d: rounded(D.dominance_analysis(d, "p", ["l_quantity", "l_discount"]), 10, ["predictor", "general_dominance", "r2_alone", "r2_unique", "r2_total"]),
      _r3 + f"select 'l_quantity' as predictor, {qs(10, general_dominance='(a + f - b) / 2', r2_alone='a', r2_unique='f - b', r2_total='f')} from s union all select 'l_discount', {qs(10, general_dominance='(b + f - a) / 2', r2_alone='b', r2_unique='f - a', r2_total='f')} from s")
query("relative_weights", _lg, lambda d: rounded(D.relative_weights(d, "p", ["l_quantity", "l_discount"]), 10, ["predictor", "weight", "r2_total"]),
      """with c as (select corr(p, l_quantity) r1, corr(p, l_discount) r2, corr(l_quantity, l_discount) r from src), l as (select r1, r2, r, (sqrt(1 + r) + sqrt(1 - r)) / 2 u, (sqrt(1 + r) - sqrt(1 - r)) / 2 v from c),
      b as (select u, v, (u * r1 - v * r2) / (u * u - v * v) b1, (u * r2 - v * r1) / (u * u - v * v) b2 from l), w as (select u * u * b1 * b1 + v * v * b2 * b2 w1, v * v * b1 * b1 + u * u * b2 * b2 w2 from b)
      """ + f"select 'l_quantity' as predictor, {qs(10, weight='w1', r2_total='w1 + w2')} from w union all select 'l_discount', {qs(10, weight='w2', r2_total='w1 + w2')} from w")
query("commonality_analysis", _lg, lambda d: rounded(D.commonality_analysis(d, "p", ["l_quantity", "l_discount"]), 10, ["component", "order", "commonality"]),
      _r3 + f"""select 'l_quantity' as component, cast(1 as bigint) as "order", {q('f - b', 'commonality', 10)} from s union all select 'l_discount', 1, {q('f - a', 'commonality', 10)} from s union all select 'l_quantity+l_discount', 2, {q('a + b - f', 'commonality', 10)} from s""")
query("bayesian_model_averaging", _lg, lambda d: rounded(D.bayesian_model_averaging(d, "p", ["l_quantity", "l_discount", "o"])))
_iv = "select y, cast(t as double) as t, x1, cast(id * 7919 % 1000 as double) / 1000 as z from (select o_orderkey as id, case when cast(o_orderkey * 7919 % 1000 as double) / 1000 < 0.5 then 1 else 0 end as t, c_acctbal / 1000 as x1, o_totalprice / 1000 + 5 * case when cast(o_orderkey * 7919 % 1000 as double) / 1000 < 0.5 then 1 else 0 end as y from orders join customer on o_custkey = c_custkey) s0"
query("iv_regression", _iv, lambda d: rounded(D.iv_regression(d, "y", ["t"], ["z"]), 6, ["term", "coef", "n"]),
      f"select 't' as term, {q('covar_pop(z, y) / covar_pop(z, t)', 'coef', 6)}, count(*) as n from src")
query("mundlak", "fx_panel", lambda d: rounded(D.mundlak(d, "y", ["x"], "unit")))
query("random_effects", "fx_panel", lambda d: rounded(D.random_effects(d, "y", ["x"], "unit")))
query("hausman_test", "fx_panel", lambda d: rounded(D.hausman_test(d, "y", ["x"], "unit")))
query("first_difference", "fx_panel", lambda d: rounded(D.first_difference(d, "y", ["x"], "unit", "period"), 6, ["term", "coef", "fixed_effects", "n"]),
      f"""with d as (select a.unit, a.y - b.y y, a.x - b.x x from src a join src b on a.unit = b.unit and a.period = b.period + 1), w as (select x - avg(x) over (partition by unit) x, y - avg(y) over (partition by unit) y from src)
      select 'x' as term, {q('sum(x * y) / sum(x * x)', 'coef', 6)}, {q('(select sum(x * y) / sum(x * x) from w)', 'fixed_effects', 6)}, count(*) as n from d""")
query("sfa", _lg, lambda d: rounded(D.sfa(d, "p", ["l_quantity"])))
query("oster_delta", _lg, lambda d: rounded(D.oster_delta(d, "p", "l_quantity", ["l_discount"]), 10, ["n", "beta_short", "r2_short", "beta_long", "r2_long"]),
      f"""with c as (select count(*) n, covar_pop(p, l_quantity) c1, covar_pop(p, l_discount) c2, covar_pop(l_quantity, l_discount) c3, var_pop(l_quantity) v1, var_pop(l_discount) v2, var_pop(p) v from src),
      b as (select *, (c1 * v2 - c2 * c3) / (v1 * v2 - c3 * c3) b1, (c2 * v1 - c1 * c3) / (v1 * v2 - c3 * c3) b2 from c)
      select n, {qs(10, beta_short='c1 / v1', r2_short='c1 * c1 / (v1 * v)', beta_long='b1', r2_long='(b1 * c1 + b2 * c2) / v')} from b""")
query("evalue", _lg, lambda d: rounded(D.evalue(d, "p", "r")),
      f"""with s as (select count(*) n, avg(case when r = 1 then p end) m1, avg(case when r = 0 then p end) m0, var_samp(case when r = 1 then p end) v1, var_samp(case when r = 0 then p end) v0, sum(r)::double n1 from src),
      d as (select n, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n - n1 - 1) * v0) / (n - 2)) d from s), e as (select *, exp(0.91 * d) rr, greatest(exp(0.91 * d), exp(-0.91 * d)) e from d)
      select n, 'smd' as kind, {qs(estimate='d', rr='rr', e_value='e + sqrt(e * (e - 1))')} from e""")
query("dynamic_panel_gmm", "fx_panel", lambda d: rounded(G.dynamic_panel_gmm(d, "y", ["x"], "unit", "period", collapse=True)))
query("system_gmm", "fx_panel", lambda d: rounded(G.system_gmm(d, "y", ["x"], "unit", "period", collapse=True)))
query("hausman_taylor", f"select *, case when g > 0 then 1.0 else 0.0 end as ever from ({FX['fx_panel']})", lambda d: rounded(G.hausman_taylor(d, "y", ["x", "treated", "ever"], "unit", ["treated"])))
