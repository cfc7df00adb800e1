"""Checked queries: causal inference and mediation."""

from __future__ import annotations

from ..operators import causal as E
from .tables import q, qs, query, rounded

_T = ("t", "y", ["x1", "x2"])
query("ipw", "fx_treat", lambda d: rounded(E.ipw(d, *_T)))
query("aipw", "fx_treat", lambda d: rounded(E.aipw(d, *_T)))
query("psm", "fx_treat", lambda d: rounded(E.psm(d, *_T, "id")))
query("rosenbaum_bounds", "fx_treat", lambda d: rounded(E.rosenbaum_bounds(d, *_T, "id")))
query("g_computation", "fx_treat", lambda d: rounded(E.g_computation(d, *_T, "id", 200)))
query("double_ml", "fx_treat", lambda d: rounded(E.double_ml(d, *_T, "id", 2, 10)))
_its = "select cast(year(o_orderdate) * 12 + month(o_orderdate) - 23940 as double) as t, sum(o_totalprice) / 1000 as y from orders group by year(o_orderdate) * 12 + month(o_orderdate)"
query("interrupted_time_series", _its, lambda d: rounded(E.interrupted_time_series(d, "y", "t", 36.0)))
_P = dict(unit="unit", time="period", treatment="treated", outcome="y")
query("event_study", "fx_panel", lambda d: rounded(E.event_study(d, **_P)))
query("staggered_did", "fx_panel", lambda d: rounded(E.staggered_did(d, **_P)))
query("callaway_santanna", "fx_panel", lambda d: rounded(E.callaway_santanna(d, "unit", "period", "y", "g"), 4, ["cohort", "period", "att", "n_treated", "n_control"]),
      f"""with p as (select unit, period t, g, y from src), c as (select distinct g c from p where g > 0), e as (select p.*, c, case when t >= c then c - 1 else t - 1 end b from p, c where t > (select min(t) from p) and (g = c or g = 0)),
      j as (select e.*, e.y - z.y dy from e join p z on e.unit = z.unit and e.b = z.t)
      select cast(c as bigint) as cohort, t as period, {q('avg(case when g = c then dy end) - avg(case when g <> c then dy end)', 'att')}, cast(sum((g = c)::int) as bigint) as n_treated, cast(sum((g <> c)::int) as bigint) as n_control from j group by c, t""")
query("callaway_aggregate", "fx_panel", lambda d: rounded(E.callaway_aggregate(E.callaway_santanna(d, "unit", "period", "y", "g"))))
query("goodman_bacon", "fx_panel", lambda d: rounded(E.goodman_bacon(d, "unit", "period", "y", "g"), 6),
      f"""with m as (select g, period t, avg(y) y, count(*)::double n from src group by 1, 2), s as (select g, max(n) n from m group by 1), tt as (select count(distinct t)::double tt from m),
      c as (select 'treated_vs_never' kind, a.g k, b.g l, a.n nk, b.n nl, 0 lo, 9999 hi, a.g cut from s a, s b where a.g > 0 and b.g = 0
        union all select 'earlier_vs_later', a.g, b.g, a.n, b.n, 0, b.g, a.g from s a, s b where a.g > 0 and b.g > a.g union all select 'later_vs_earlier', b.g, a.g, b.n, a.n, a.g, 9999, b.g from s a, s b where a.g > 0 and b.g > a.g),
      e as (select kind, k, l, nk, nl, avg(case when m.g = k and t >= cut then y end) - avg(case when m.g = k and t < cut then y end) - avg(case when m.g = l and t >= cut then y end) + avg(case when m.g = l and t < cut then y end) est,
        count(distinct case when t < cut then t end)::double pre, count(distinct case when t >= cut then t end)::double post from c join m on m.g in (k, l) and t >= lo and t < hi group by 1, 2, 3, 4, 5),
      w as (select *, power((nk + nl) * (pre + post) / tt, 2) * nk / (nk + nl) * nl / (nk + nl) * post / (pre + post) * pre / (pre + post) w from e, tt)
      select kind, cast(k as bigint) as treated, cast(l as bigint) as control, {qs(6, estimate='est', weight='w / sum(w) over ()')} from w""")
query("honest_did", "fx_panel", lambda d: rounded(E.honest_did(d, **_P)))
query("chaisemartin_did", "fx_panel", lambda d: rounded(E.chaisemartin_did(d, **_P), 6),
      f"""with j as (select a.period t, b.treated d0, a.treated d1, a.y - b.y dy from src a join src b on a.unit = b.unit and a.period = b.period + 1),
      g as (select t, sum((d0 = 0 and d1 = 1)::int) n01, sum((d0 = 1 and d1 = 0)::int) n10, sum((d0 = 0 and d1 = 0)::int) n00, avg(case when d0 = 0 and d1 = 1 then dy end) - avg(case when d0 = 0 and d1 = 0 then dy end) e from j group by t)
      select cast(coalesce(sum(case when n00 > 0 and n01 > 0 then n01 end), 0) as bigint) as switchers_in, cast(0 as bigint) as switchers_out, {q('sum(case when n00 > 0 and n01 > 0 then n01 * e end) / sum(case when n00 > 0 and n01 > 0 then n01 end)', 'did_m', 6)} from g""")
query("changes_in_changes", "select y, case when g > 0 then 1 else 0 end as tr, case when period >= 1998 then 1 else 0 end as post from (select c_nationkey % 3 as g, year(o_orderdate) as period, o_totalprice / 1000 as y from orders join customer on o_custkey = c_custkey) s0",
      lambda d: rounded(E.changes_in_changes(d, "y", "tr", "post")))
query("rdd", "fx_running", lambda d: rounded(E.rdd(d, "running", "y", 4.5, 1.0), 5, ["jump", "bandwidth", "n_left", "n_right"]),
      f"""with z as (select y, running - 4.5 c, (running >= 4.5)::int s, 1 - abs(running - 4.5) w from src where abs(running - 4.5) < 1), m as (select s, sum(w) sw, sum(w * c) / sum(w) mc, sum(w * y) / sum(w) my, count(*) n from z group by s),
      b as (select z.s, max(my) - sum(w * (c - mc) * (y - my)) / sum(w * power(c - mc, 2)) * max(mc) a, max(n) n from z join m on z.s = m.s group by z.s)
      select {qs(5, jump='max(case when s = 1 then a end) - max(case when s = 0 then a end)', bandwidth='1.0')}, max(case when s = 0 then n end) as n_left, max(case when s = 1 then n end) as n_right from b""")
query("fuzzy_rdd", "select running, y, case when running >= 4.5 and id % 5 <> 0 then 1.0 else 0.0 end as tr from (select c_custkey as id, c_acctbal / 1000 as running, 2 * c_acctbal / 1000 + case when c_acctbal >= 4500 then 3 else 0 end as y from customer) s0",
      lambda d: rounded(E.fuzzy_rdd(d, "running", "y", "tr", 4.5, 1.0)))
query("mendelian_randomization", "fx_snp", lambda d: rounded(E.mendelian_randomization(d, "bx", "beta_y", "sey"), 6, ["instruments", "ivw", "ivw_se", "q", "egger_slope", "egger_intercept"]),
      f"""with w as (select abs(bx) x, beta_y * sign(bx) y, 1 / (sey * sey) w from src), s as (select count(*)::double k, sum(w * x * x) xx, sum(w * x * y) xy, sum(w * y * y) yy, sum(w) sw, sum(w * x) sx, sum(w * y) sy from w),
      b as (select *, xy / xx b, yy - xy * xy / xx qq, (xy - sx * sy / sw) / (xx - sx * sx / sw) e from s)
      select cast(k as bigint) as instruments, {qs(6, ivw='b', ivw_se='sqrt(1 / xx) * greatest(1, sqrt(qq / (k - 1)))', q='qq', egger_slope='e', egger_intercept='sy / sw - e * sx / sw')} from b""")
_m = "select l_quantity as x, l_extendedprice / 10000 as m, l_discount * 100 as m2, l_tax * 100 + l_quantity / 10 as y, l_linenumber as w, l_orderkey * 10 + l_linenumber as id from lineitem"
query("mediation", _m, lambda d: rounded(E.mediation(d, "x", "m", "y"), 6))
query("serial_mediation", _m, lambda d: rounded(E.serial_mediation(d, "x", "m", "m2", "y", "id", 100), 6))
query("parallel_mediation", _m, lambda d: rounded(E.parallel_mediation(d, "x", ["m", "m2"], "y", "id", 100), 6))
query("moderated_mediation", _m, lambda d: rounded(E.moderated_mediation(d, "x", "m", "y", "w", "id", 100), 6))
query("moderated_moderation", _m, lambda d: rounded(E.moderated_moderation(d, "x", "m", "w", "y"), 6))
query("johnson_neyman", _m, lambda d: rounded(E.johnson_neyman(d, "x", "w", "y"), 6))
query("dag_structure_learning", _m, lambda d: rounded(E.dag_structure_learning(d, ["x", "m", "m2", "y"]), 6))
