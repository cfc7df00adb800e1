"""Checked queries: ranking, marketing, process control, resources, project economics, meta-analysis."""

from __future__ import annotations

from ..operators import ranking as L
from .tables import FX, q, qs, query, rounded

_pt = "select p_partkey, p_retailprice, cast(p_size as double) as p_size, cast(p_partkey * 31 % 101 as double) as age from part"
_cr = ["p_retailprice", "p_size", "age"]
# Normalised criteria: price is a cost.
_z = """with b as (select min(p_retailprice) a0, max(p_retailprice) a1, min(p_size) b0, max(p_size) b1, min(age) c0, max(age) c1, count(*)::double m from src),
 z as (select p_partkey, (a1 - p_retailprice) / (a1 - a0) z1, (p_size - b0) / (b1 - b0) z2, (age - c0) / (c1 - c0) z3, m from src, b)"""
_ew = """, t as (select sum(z1) s1, sum(z2) s2, sum(z3) s3 from z), h as (select """ + ", ".join(
    f"1 + sum(case when z{i} > 0 then z{i} / s{i} * ln(z{i} / s{i}) else 0 end) / ln(max(m)) d{i}" for i in (1, 2, 3)) + """ from z, t),
 w as (select d1 / (d1 + d2 + d3) w1, d2 / (d1 + d2 + d3) w2, d3 / (d1 + d2 + d3) w3 from h)"""
_args = dict(unit="p_partkey", criteria=_cr, cost=["p_retailprice"])
_rank = lambda s, d="desc": f"rank() over (order by round({s}, 10) {d}) as rank"
query("topsis", _pt, lambda d: rounded(L.topsis(d, **_args), 6, ["p_partkey", "closeness", "rank"]),
      _z + _ew + f""", v as (select p_partkey, z1 * w1 v1, z2 * w2 v2, z3 * w3 v3 from z, w), e as (select max(v1) a1, max(v2) a2, max(v3) a3, min(v1) b1, min(v2) b2, min(v3) b3 from v),
      c as (select p_partkey, sqrt(power(v1 - a1, 2) + power(v2 - a2, 2) + power(v3 - a3, 2)) dp, sqrt(power(v1 - b1, 2) + power(v2 - b2, 2) + power(v3 - b3, 2)) dm from v, e)
      select p_partkey, {q('dm / (dp + dm + 1e-12)', 'closeness', 6)}, {_rank('dm / (dp + dm + 1e-12)')} from c""")
query("entropy_weight", _pt, lambda d: rounded(L.entropy_weight(d, **_args), 6),
      _z + _ew + f" select p_partkey, {qs(6, score='z1 * w1 + z2 * w2 + z3 * w3', w_p_retailprice='w1', w_p_size='w2', w_age='w3')}, {_rank('z1 * w1 + z2 * w2 + z3 * w3')} from z, w")
query("critic", _pt, lambda d: rounded(L.critic(d, **_args), 6),
      _z + f""", c as (select stddev_samp(z1) * (2 - corr(z1, z2) - corr(z1, z3)) c1, stddev_samp(z2) * (2 - corr(z1, z2) - corr(z2, z3)) c2, stddev_samp(z3) * (2 - corr(z1, z3) - corr(z2, z3)) c3 from z),
      w as (select c1 / (c1 + c2 + c3) w1, c2 / (c1 + c2 + c3) w2, c3 / (c1 + c2 + c3) w3 from c)
      select p_partkey, {qs(6, score='z1 * w1 + z2 * w2 + z3 * w3', w_p_retailprice='w1', w_p_size='w2', w_age='w3')}, {_rank('z1 * w1 + z2 * w2 + z3 * w3')} from z, w""")
query("grey_relational", _pt, lambda d: rounded(L.grey_relational(d, **_args), 6),
      _z + f""", g as (select min(least(1 - z1, 1 - z2, 1 - z3)) lo, max(greatest(1 - z1, 1 - z2, 1 - z3)) hi from z),
      s as (select p_partkey, ((lo + 0.5 * hi) / (1 - z1 + 0.5 * hi) + (lo + 0.5 * hi) / (1 - z2 + 0.5 * hi) + (lo + 0.5 * hi) / (1 - z3 + 0.5 * hi)) / 3 g from z, g)
      select p_partkey, {q('g', 'grade', 6)}, {_rank('g')} from s""")
query("membership_function", _pt, lambda d: rounded(L.membership_function(d, **_args), 6),
      _z + f" select p_partkey, {q('(z1 + z2 + z3) / 3', 'membership', 6)}, {_rank('(z1 + z2 + z3) / 3')} from z")
query("vikor", _pt, lambda d: rounded(L.vikor(d, **_args), 6),
      _z + f""", t as (select p_partkey, ((1 - z1) + (1 - z2) + (1 - z3)) / 3 s, greatest(1 - z1, 1 - z2, 1 - z3) / 3 r, m from z), bb as (select min(s) s0, max(s) s1, min(r) r0, max(r) r1 from t),
      v as (select p_partkey, s, r, 0.5 * (s - s0) / (s1 - s0) + 0.5 * (r - r0) / (r1 - r0) q, m, s0, r0 from t, bb),
      o as (select *, row_number() over (order by round(q, 10), p_partkey) i from v), f as (select max(case when i = 1 then q end) q1, max(case when i = 2 then q end) q2,
       bool_or(i = 1 and (abs(s - s0) < 1e-12 or abs(r - r0) < 1e-12)) st, max(1 / (m - 1)) dq from o)
      select p_partkey, {qs(6, s='s', r='r', q='q')}, case when q2 - q1 >= dq and st then i = 1 when q2 - q1 >= dq then i <= 2 else q - q1 < dq end as in_compromise, {_rank('q', 'asc')} from o, f""")
_su = "select s_suppkey, s_acctbal, cast(s_suppkey * 31 % 101 as double) as age from supplier"
query("promethee", _su, lambda d: rounded(L.promethee(d, "s_suppkey", ["s_acctbal", "age"], ["age"]), 6),
      f"""with b as (select max(s_acctbal) - min(s_acctbal) g1, max(age) - min(age) g2, count(*)::double m from src),
      p as (select a.s_suppkey k, sum(greatest(a.s_acctbal - c.s_acctbal, 0) / g1 + greatest(c.age - a.age, 0) / g2) / 2 / (max(m) - 1) up,
        sum(greatest(c.s_acctbal - a.s_acctbal, 0) / g1 + greatest(a.age - c.age, 0) / g2) / 2 / (max(m) - 1) dn from src a, src c, b group by 1)
      select k as s_suppkey, {qs(6, phi_plus='up', phi_minus='dn', phi='up - dn')}, {_rank('up - dn')} from p""")
query("composite_index", _pt, lambda d: rounded(L.composite_index(d, "p_partkey", _cr, ["p_retailprice"]), 6),
      _z + f" select p_partkey, {q('(z1 + z2 + z3) / 3', 'score', 6)}, row_number() over (order by round((z1 + z2 + z3) / 3, 12) desc, p_partkey) as rank from z")

query("rfm_segmentation", "orders", lambda d: rounded(L.rfm_segmentation(d, "o_custkey", "o_orderdate", "o_totalprice"), 2),
      f"""with c as (select o_custkey, date_diff('day', max(o_orderdate), (select max(o_orderdate) from src)) rd, count(*) f, sum(o_totalprice) m from src group by 1),
      r as (select *, count(*) over () n, rank() over (order by rd) + (count(*) over (partition by rd) - 1) / 2.0 r1, rank() over (order by f) + (count(*) over (partition by f) - 1) / 2.0 r2,
        rank() over (order by m) + (count(*) over (partition by m) - 1) / 2.0 r3 from c),
      s as (select o_custkey, rd, f, m, cast(6 - least(greatest(ceil(r1 * 5 / n), 1), 5) as bigint) r, cast(least(greatest(ceil(r2 * 5 / n), 1), 5) as bigint) fs, cast(least(greatest(ceil(r3 * 5 / n), 1), 5) as bigint) ms from r),
      g as (select *, (fs + ms) / 2.0 fm from s)
      select o_custkey, rd as recency_days, f as frequency, {q('m', 'monetary', 2)}, r as r_score, fs as f_score, ms as m_score,
      case when r >= 4 and fm >= 4 then 'Champions' when r <= 1 and fm >= 4 then 'Cant Lose Them' when r <= 2 and fm >= 3 then 'At Risk' when r >= 3 and fm >= 3 then 'Loyal Customers'
      when r >= 4 and fm >= 2 then 'Potential Loyalist' when r >= 4 and fm < 2 then 'New Customers' when r = 3 and fm = 2 then 'Need Attention' when r <= 1 and fm <= 2 then 'Lost'
      when r <= 2 and fm <= 2 then 'Hibernating' when r >= 3 and fm < 3 then 'Promising' else 'Others' end as segment from g""")
query("customer_lifetime_value", "orders", lambda d: rounded(L.customer_lifetime_value(d, "o_custkey", "o_totalprice", 0.8)),
      f"""with c as (select o_custkey, sum(o_totalprice) v, avg(o_totalprice) a from src group by 1), r as (select *, row_number() over (order by v desc, o_custkey) i, count(*) over () n from c)
      select count(*) as n_customers, {qs(mean_clv='avg(v)', mean_aov='avg(a)', top_decile_share='sum(case when i <= greatest(1, ceil(0.1 * n)) then v end) / sum(v)', projected_clv='avg(a) * 0.8 / (1 + 0.1 - 0.8)')} from r""")
_bk = "select l_orderkey, p_type from lineitem join part on l_partkey = p_partkey"
query("market_basket", _bk, lambda d: rounded(L.market_basket(d, "l_orderkey", "p_type"), 6),
      f"""with b as (select distinct l_orderkey k, p_type i from src), n as (select count(distinct k)::double n from b), f1 as (select i s, count(*)::double f from b group by 1),
      f2 as (select a.i || ',' || c.i s, a.i x, c.i y, count(*)::double f from b a join b c on a.k = c.k and a.i < c.i group by a.i, c.i),
      f3 as (select a.i x, c.i y, d.i z, count(*)::double f from b a join b c on a.k = c.k and a.i < c.i join b d on a.k = d.k and c.i < d.i group by 1, 2, 3),
      r as (select x a, y c, f from f2 union all select y, x, f from f2 union all select x, y || ',' || z, f from f3 union all select y, x || ',' || z, f from f3 union all select z, x || ',' || y, f from f3
       union all select x || ',' || y, z, f from f3 union all select x || ',' || z, y, f from f3 union all select y || ',' || z, x, f from f3),
      u as (select s, f from f1 union all select s, f from f2)
      select a as antecedent, c as consequent, {qs(6, support='r.f / n', confidence='r.f / l.f', lift='r.f / l.f / (h.f / n)')} from r join u l on r.a = l.s join u h on r.c = h.s, n where r.f / n >= 0.01 and r.f / l.f >= 0.3""")


_ccs = "select o_orderkey, cast(floor(o_orderkey / 5) as bigint) as sub, o_totalprice from orders"
_run = """, z as (select *, row_number() over (order by point) - 1 i, round((x - ce) / sg, 9) z from p, c),
 r as (select *, sum((z > 2)::int) over w3 up, sum((z < -2)::int) over w3 dn, min(z) over w8 mn, max(z) over w8 mx from z
  window w3 as (order by i rows between 2 preceding and current row), w8 as (order by i rows between 7 preceding and current row))
 select point, {xs}, abs(z) > 3 as rule1, i >= 2 and ((up >= 2 and z > 2) or (dn >= 2 and z < -2)) as rule2, i >= 7 and (mn > 0 or mx < 0) as rule3 from r"""
_runq = _run.format(xs=qs(x="x", range="range", center="ce", lcl="ce - 3 * sg", ucl="ce + 3 * sg", range_ucl="d4 * rb"))
query("control_chart", _ccs, lambda d: rounded(L.control_chart(d, "o_totalprice", "o_orderkey", "sub")),
      "with p as (select sub as point, avg(o_totalprice) x, max(o_totalprice) - min(o_totalprice) range from src group by 1), c as (select avg(x) ce, 0.577 * avg(range) / 3 sg, 2.114 d4, avg(range) rb from p)" + _runq)
query("control_chart_individuals", "events", lambda d: rounded(L.control_chart(d, "value", "event_id")),
      "with p as (select event_id as point, value x, abs(value - lag(value) over (order by event_id)) range from src), c as (select avg(x) ce, avg(range) / 1.128 sg, 3.267 d4, avg(range) rb from p)" + _runq)
query("process_capability", _ccs, lambda d: rounded(L.process_capability(d, "o_totalprice", 10000.0, 490000.0, "o_orderkey", "sub"), 4).drop("ppm_expected"),
      f"""with g as (select avg(r) / 2.326 w from (select max(o_totalprice) - min(o_totalprice) r from src group by sub)), s as (select count(*) n, avg(o_totalprice) m, stddev_samp(o_totalprice) sd, avg((o_totalprice < 10000 or o_totalprice > 490000)::int) o from src)
      select n, {qs(mean='m', sigma_within='w', sigma_overall='sd', cp='480000 / (6 * w)', cpk='least(m - 10000, 490000 - m) / (3 * w)', pp='480000 / (6 * sd)', ppk='least(m - 10000, 490000 - m) / (3 * sd)', ppm_observed='o * 1e6')} from g, s""")
# Balanced gauge table: three mean readings per part type and priority-like operator.
_gr = "select l_linenumber as part, l_returnflag as operator, l_orderkey % 3 as rep, avg(l_extendedprice) / 1000 as y from lineitem group by l_linenumber, l_returnflag, l_orderkey % 3"
query("gage_rr", _gr, lambda d: rounded(L.gage_rr(d, "y", "part", "operator"), 4, ["source", "variance", "contribution_pct"]),
      """with s as (select y, avg(y) over (partition by part) mp, avg(y) over (partition by operator) mo, avg(y) over (partition by part, operator) mc, avg(y) over () g from src),
      k as (select count(distinct part)::double p, count(distinct operator)::double o, 3.0 r from src),
      t as (select sum(power(mp - g, 2)) / (max(p) - 1) msp, sum(power(mo - g, 2)) / (max(o) - 1) mso, sum(power(mc - mp - mo + g, 2)) sspo, sum(power(y - mc, 2)) sse, max(p) p, max(o) o, max(r) r from s, k),
      f as (select *, (sspo / ((p - 1) * (o - 1))) / (sse / (p * o * (r - 1))) f from t),
      -- the interaction is pooled when its F is below the 75th percentile of F(12, 42)
      m as (select case when f < 1.3139 then (sse + sspo) / (p * o * (r - 1) + (p - 1) * (o - 1)) else sse / (p * o * (r - 1)) end rep, case when f < 1.3139 then 0 else (sspo / ((p - 1) * (o - 1)) - sse / (p * o * (r - 1))) / r end po,
       case when f < 1.3139 then (sse + sspo) / (p * o * (r - 1) + (p - 1) * (o - 1)) else sspo / ((p - 1) * (o - 1)) end base, * from f),
      v as (select rep, greatest(po, 0) po, greatest((mso - base) / (p * r), 0) op, greatest((msp - base) / (o * r), 0) pt from m), w as (select *, rep + po + op grr, rep + po + op + pt tot from v)
      """ + " union all ".join(f"select '{n}' as source, {qs(variance=e, contribution_pct=f'100 * ({e}) / tot')} from w" for n, e in
                               (("repeatability", "rep"), ("reproducibility", "op + po"), ("gage_rr", "grr"), ("part", "pt"), ("total", "tot"))))
query("cost_effectiveness_analysis", _pt, lambda d: rounded(L.cost_effectiveness_analysis(d, "p_partkey", "p_retailprice", "p_size", 50.0)),
      f"""with s as (select * from (select distinct p_retailprice c, p_size e from src) a where not exists (select 1 from src b where b.p_retailprice <= c and b.p_size >= e and (b.p_retailprice < c or b.p_size > e))),
      x as (select c, e from s p where not exists (select 1 from s a join s b on a.e < p.e and b.e > p.e and p.c > a.c + (b.c - a.c) * (p.e - a.e) / (b.e - a.e) + 1e-9)),
      i as (select c, e, (c - lag(c) over (order by e)) / (e - lag(e) over (order by e)) icer from x)
      select p_partkey, {qs(cost='p_retailprice', effect='p_size', acer='p_retailprice / p_size')}, case when i.c is not null then 'frontier' when s.c is not null then 'extended_dominated' else 'dominated' end as status,
      {qs(icer='icer', net_benefit='50 * p_size - p_retailprice')} from src left join s on p_retailprice = s.c and p_size = s.e left join i on p_retailprice = i.c and p_size = i.e""")
_ma = "select p_partkey, p_retailprice - 950 as cost, cast(p_size as double) as abated from part"
query("marginal_abatement_cost", _ma, lambda d: rounded(L.marginal_abatement_cost(d, "p_partkey", "cost", "abated", 10.0)),
      f"""with m as (select p_partkey, cost / abated mac, abated, row_number() over (order by cost / abated, p_partkey) i from src where abated > 0)
      select p_partkey, i as rank, {qs(mac='mac', abatement='abated', cumulative='sum(abated) over (order by i)')}, mac < 0 as no_regret, mac <= 10 as below_price from m""")
query("footprint_analysis", "lineitem", lambda d: rounded(L.footprint_analysis(d, "l_returnflag", "l_quantity", {"A": 1.5, "N": 2.0, "R": 0.5}, 1000.0)),
      f"""with a as (select l_returnflag, sum(l_quantity) v, case l_returnflag when 'A' then 1.5 when 'N' then 2.0 when 'R' then 0.5 end::double f from src group by 1)
      select l_returnflag, {qs(quantity='v', factor='f', footprint='v * f', share='v * f / sum(v * f) over ()', intensity='sum(v * f) over () / 1000')} from a""")
query("emergy_analysis", "lineitem", lambda d: rounded(L.emergy_analysis(d, {"l_quantity": 2.0, "l_discount": 300.0, "l_tax": 500.0}, {"l_quantity": "R", "l_discount": "N", "l_tax": "F"}, "l_extendedprice"), 5),
      f"""with s as (select 2 * sum(l_quantity) r, 300 * sum(l_discount) n, 500 * sum(l_tax) f, sum(l_extendedprice) o from src)
      select {qs(5, total_emergy='r + n + f', renewable='r', nonrenewable='n', purchased='f', eyr='(r + n + f) / f', elr='(n + f) / r', esi='(r + n + f) / f / ((n + f) / r)', pct_renewable='r / (r + n + f)', output_transformity='(r + n + f) / o')} from s""")
query("material_flow_analysis", "lineitem", lambda d: rounded(L.material_flow_analysis(d, ["l_quantity", "l_discount"], ["l_tax"], None, "l_discount"), 5),
      f"""with s as (select sum(l_quantity) + sum(l_discount) i, sum(l_tax) o, sum(l_discount) r from src)
      select {qs(5, total_input='i', total_output='o', net_stock_addition='i - o', balance_ratio='o / i', resource_efficiency='o / i', recycling_rate='r / i')} from s""")
query("material_flow_shares", "lineitem", lambda d: rounded(L.material_flow_shares(d, ["l_quantity", "l_discount"], ["l_tax"]), 5),
      f"""with s as (select sum(l_quantity) a, sum(l_discount) b, sum(l_tax) c from src) select 'l_quantity' as flow, 'input' as type, {qs(5, value='a', share_pct='100 * a / (a + b)')} from s
      union all select 'l_discount', 'input', {qs(5, value='b', share_pct='100 * b / (a + b)')} from s union all select 'l_tax', 'output', {qs(5, value='c', share_pct='cast(100 as double)')} from s""")
query("input_output_analysis", "fx_trade", lambda d, fd: rounded(L.input_output_analysis(d, "i", "j", "z", fd)), None,
      {"fd": "select c_nationkey as sector, sum(o_totalprice) / 1000000 as demand from orders join customer on o_custkey = c_custkey group by c_nationkey"})
_cf = "with t as (select project, period t, benefit - cost cf, benefit b, cost c, output o from src)"
query("npv_irr", "fx_cash", lambda d: rounded(L.npv_irr(d, "project", "period", "benefit", "cost"), 4, ["project", "npv", "payback", "discounted_payback", "multiple_roots"]),
      _cf + f""", u as (select *, cf / power(1.1, t) d, sum(cf) over (partition by project order by t) s, sum(cf / power(1.1, t)) over (partition by project order by t) ds from t)
      select cast(project as bigint) as project, {qs(npv='sum(d)', payback='min(case when s >= 0 and s - cf < 0 then t - 1 + (cf - s) / cf when t = 0 and s >= 0 then 0 end)',
      discounted_payback='min(case when ds >= 0 and ds - d < 0 then t - 1 + (d - ds) / d when t = 0 and ds >= 0 then 0 end)')}, false as multiple_roots from u group by project""")
query("cost_benefit", "fx_cash", lambda d: rounded(L.cost_benefit(d, "project", "period", "benefit", "cost")),
      _cf + f" select cast(project as bigint) as project, {qs(pv_benefit='sum(b / power(1.1, t))', pv_cost='sum(c / power(1.1, t))', bcr='sum(b / power(1.1, t)) / sum(c / power(1.1, t))', npb='sum((b - c) / power(1.1, t))')} from t group by project")
query("lcoe", "fx_cash", lambda d: rounded(L.lcoe(d, "project", "period", "cost", "output")),
      _cf + f" select cast(project as bigint) as project, {qs(pv_cost='sum(c / power(1.1, t))', pv_output='sum(o / power(1.1, t))', lcoe='sum(c / power(1.1, t)) / sum(o / power(1.1, t))')} from t group by project")
query("life_cycle_cost", "fx_cash", lambda d: rounded(L.life_cycle_cost(d, "project", "period", "cost", salvage=5.0)),
      _cf + f""", g as (select project, sum(case when t = 0 then c else 0 end) k, sum(case when t > 0 then c / power(1.08, t) else 0 end) o, greatest(max(t), 1) n from t group by 1),
      h as (select *, 5 / power(1.08, n) s from g)
      select cast(project as bigint) as project, cast(n as bigint) as periods, {qs(capex='k', opex_pv='o', lcc='k + o - s', eac='(k + o - s) * 0.08 * power(1.08, n) / (power(1.08, n) - 1)', capex_share='100 * k / (k + o + s)', opex_share='100 * o / (k + o + s)')} from h""")
_be = "select p_partkey, 10000.0 as fc, p_retailprice * 0.6 as vc, p_retailprice as pr, cast(p_size * 10 as double) as un from part"
query("breakeven_analysis", _be, lambda d: rounded(L.breakeven_analysis(d, "p_partkey", "fc", "vc", "pr", "un")),
      f"select p_partkey, {qs(contribution_margin='pr - vc', cm_ratio='(pr - vc) / pr', breakeven_units='10000 / (pr - vc)', breakeven_revenue='10000 / (pr - vc) * pr', margin_of_safety='(un - 10000 / (pr - vc)) / un')} from src")
query("sensitivity_tornado", "fx_cash", lambda d: rounded(L.sensitivity_tornado(d, "project", "period", "benefit", "cost")),
      _cf + f""", n as (select project, sum(cf / power(1.1, t)) v, sum(cf / power(1.08, t)) lo, sum(cf / power(1.12, t)) hi from t group by 1),
      u as (select project, 'discount_rate' p, lo, hi from n union all select t.project, 'cashflow_t' || t::varchar, v - 0.2 * cf / power(1.1, t), v + 0.2 * cf / power(1.1, t) from t join n on t.project = n.project where cf <> 0)
      select cast(project as bigint) as project, p as parameter, {qs(low_npv='lo', high_npv='hi', swing='abs(hi - lo)')}, row_number() over (partition by project order by round(abs(hi - lo), 9) desc, p) as rank from u""")
_sm = f"""select study, g as yi, 1 / n1 + 1 / n2 + g * g / (2 * (n1 + n2)) as vi from (select study, n1, n2, (m1 - m2) / sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / (n1 + n2 - 2)) * (1 - 3 / (4 * (n1 + n2 - 2) - 1)) as g from (
 select study, m1, sd1, cast(n1 as double) as n1, m2, sd2, cast(n2 as double) as n2 from ({FX['fx_studies']}) s0) s1) s2"""
query("effect_sizes_smd", "fx_studies", lambda d: rounded(L.smd(d, "study", "m1", "sd1", "n1", "m2", "sd2", "n2"), 6), f"select cast(study as bigint) as study, {qs(6, yi='yi', vi='vi')} from ({_sm})")
query("meta_analysis", _sm, lambda d: rounded(L.meta_analysis(d), 6, ["k", "fixed", "fixed_se", "q", "i2", "tau2_dl", "random_dl", "random_dl_se", "egger_intercept"]),
      f"""with s as (select count(*)::double k, sum(1 / vi) w, sum(yi / vi) wy, sum(yi * yi / vi) wyy, sum(1 / (vi * vi)) w2, regr_intercept(yi / sqrt(vi), 1 / sqrt(vi)) eg from src),
      t as (select *, wyy - wy * wy / w qq, greatest(0, (wyy - wy * wy / w - (k - 1)) / (w - w2 / w)) t2 from s), r as (select sum(1 / (vi + t2)) rw, sum(yi / (vi + t2)) ry from src, t)
      select cast(k as bigint) as k, {qs(6, fixed='wy / w', fixed_se='sqrt(1 / w)', q='qq', i2='greatest(0, (qq - (k - 1)) / qq * 100)', tau2_dl='t2', random_dl='ry / rw', random_dl_se='sqrt(1 / rw)', egger_intercept='eg')} from t, r""")
query("meta_regression", f"select *, cast(study % 5 as double) as m from ({_sm}) z", lambda d: rounded(L.meta_regression(d, ["m"]), 6))
