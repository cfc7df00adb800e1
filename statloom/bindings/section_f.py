"""Checked queries: survival and reliability."""

from __future__ import annotations

from pyspark.sql import functions as Fn

from ..operators import survival as S
from .tables import FX, q, qs, query, rounded

_sv = f"select id, duration, case when status > 0 then 1 else 0 end as ev, status, grp, x from ({FX['fx_surv']}) s0"
_km = """t as (select grp, duration t, sum(ev)::double d, count(*)::double m from src group by 1, 2), r as (select *, sum(m) over (partition by grp order by t desc) n from t),
 k as (select *, case when sum(case when d >= n then 1 else 0 end) over (partition by grp order by t) > 0 then 0 else exp(sum(case when d >= n then 0 else ln(1 - d / n) end) over (partition by grp order by t)) end s,
  case when coalesce(sum(case when d >= n then 1 else 0 end) over (partition by grp order by t rows between unbounded preceding and 1 preceding), 0) > 0 then 0 else exp(coalesce(sum(case when d >= n then 0 else ln(1 - d / n) end) over (partition by grp order by t rows between unbounded preceding and 1 preceding), 0)) end sb from r)"""
query("kaplan_meier", _sv, lambda d: rounded(S.kaplan_meier(d, "duration", "ev", "grp"), 6),
      f"with {_km} select grp, t, cast(d as bigint) as d, cast(m - d as bigint) as c, cast(n as bigint) as at_risk, {q('s', 'survival', 6)} from k")
query("survival_analysis", _sv, lambda d: rounded(S.survival_analysis(d, "duration", "ev", "grp"), 4, ["level", "n", "events", "median", "logrank_chi2"]),
      f"""with {_km}, m as (select grp, sum(m) n, sum(d) e, coalesce(min(case when s <= 0.5 then t end), -1) med from k group by 1),
      a as (select duration t, sum(ev)::double d, count(*)::double m, sum(case when grp = 'a' then ev else 0 end)::double d1, sum((grp = 'a')::int)::double m1 from src group by 1),
      b as (select *, sum(m) over (order by t desc) n, sum(m1) over (order by t desc) n1 from a), lr as (select power(sum(d1 - d * n1 / n), 2) / sum(case when n > 1 then d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) else 0 end) x from b)
      select grp as level, cast(n as bigint) as n, cast(e as bigint) as events, {qs(median='med', logrank_chi2='x')} from m, lr""")
query("competing_risks", _sv, lambda d: rounded(S.competing_risks(d, "duration", "status", "grp"), 6),
      f"""with {_km}, i as (select grp, duration t, sum((status = 1)::int)::double dk from src group by 1, 2), c as (select k.grp, k.t, sum(sb * dk / n) over (partition by k.grp order by k.t) cif from k join i on k.grp = i.grp and k.t = i.t),
      p as (select unnest([0.2, 0.4, 0.6, 0.8, 1.0]) q, unnest((select quantile_cont(duration, [0.2, 0.4, 0.6, 0.8, 1.0]) from src)) v)
      select grp as level, {qs(6, q='q', time='max(v)', cif='coalesce(max(case when t <= v then cif end), 0)')} from c, p group by grp, q""")
query("rmst", _sv, lambda d: rounded(S.rmst(d, "duration", "ev", "grp"), 4, ["level", "tau", "rmst", "se", "difference"]),
      f"""with {_km}, tm as (select min(m) tau from (select grp, max(t) m from k where d > 0 group by 1)), e as (select k.*, tau, (sb - s) * (tau - t) dr from k, tm where d > 0 and t <= tau),
      g as (select *, s * (tau - t) - coalesce(sum(dr) over (partition by grp order by t desc rows between unbounded preceding and 1 preceding), 0) ar from e),
      v as (select grp, max(tau) tau, max(tau) - sum(dr) r, sqrt(sum(case when n > d then ar * ar * d / (n * (n - d)) else 0 end)) se from g group by 1)
      select grp as level, {qs(tau='tau', rmst='r', se='se', difference="(select r from v where grp = 'a') - (select r from v where grp = 'b')")} from v""")
query("cox_regression", _sv, lambda d: rounded(S.cox_regression(d.withColumn("g", (Fn.col("grp") == "a").cast("double")), "duration", "ev", ["x", "g"])))
query("stratified_cox", _sv, lambda d: rounded(S.stratified_cox(d, "duration", "ev", ["x"], "grp")))
query("time_varying_cox", _sv, lambda d: rounded(S.time_varying_cox(d.withColumn("t0", Fn.floor(Fn.col("duration") / 3)), "t0", "duration", "ev", ["x"])))
query("cox_ph_diagnostics", _sv, lambda d: rounded(S.cox_ph_diagnostics(d, "duration", "ev", ["x"])))
query("parametric_survival", _sv, lambda d: rounded(S.parametric_survival(d, "duration", "ev", ["x"])))
query("life_table", "fx_mortality", lambda d: rounded(S.life_table(d, "age", "deaths", "exposure")),
      f"""with d as (select age::double age, deaths::double / exposure m from src), n as (select *, lead(age) over (order by age) - age n from d),
      q as (select *, case when n is null then 1 else least(greatest(n * m / (1 + n / 2 * m), 0), 1) end q from n), l as (select *, 100000 * exp(coalesce(sum(case when q < 1 then ln(1 - q) else -800 end) over (order by age rows between unbounded preceding and 1 preceding), 0)) l from q),
      b as (select *, l * q d, case when n is null then l / nullif(m, 0) else n * (l - l * q) + n / 2 * l * q end bl from l), t as (select *, sum(bl) over (order by age desc) bt from b)
      select {qs(age='age', m='m', q='q', l='l', d='d', big_l='bl', big_t='bt', e='bt / nullif(l, 0)')} from t""")
query("chain_ladder", "fx_triangle", lambda d: rounded(S.chain_ladder(d, "origin", "dev", "claim")),
      f"""with c as (select origin, dev, sum(claim) over (partition by origin order by dev) c from src), p as (select a.dev j, sum(b.c) / sum(a.c) f from c a join c b on a.origin = b.origin and b.dev = a.dev + 1 group by 1),
      l as (select origin, max(dev) j, arg_max(c, dev) c from c group by 1), u as (select l.origin, l.j, l.c, coalesce(exp(sum(ln(p.f))), 1) f from l left join p on p.j >= l.j group by 1, 2, 3)
      select origin, cast(u.j as bigint) as last_dev, {qs(latest='u.c', next_factor='coalesce(p.f, 1)', ultimate='u.c * u.f', ibnr='u.c * u.f - u.c')} from u left join p on p.j = u.j""")
query("weibull_life_analysis", _sv, lambda d: rounded(S.weibull_life_analysis(d, "duration", "ev")))
_rg = "select event_type, cast(event_id + 1 as double) as t from events"
query("reliability_growth", _rg, lambda d: rounded(S.reliability_growth(d, "t", "event_type"), 5),
      f"""with g as (select event_type s, count(*)::double n, max(t) l, sum(ln(t)) sl from src group by 1), b as (select *, (n - 1) / (n * ln(l) - sl) b from g), c as (select *, n / power(l, b) lam from b)
      select s as system, cast(n as bigint) as n, {qs(5, beta='b', log_lambda='ln(lam)', cumulative_mtbf='l / n', instantaneous_mtbf='1 / (lam * b * power(l, b - 1))', projected_mtbf='1 / (lam * b * power(1.5 * l, b - 1))')} from c""")
_al = f"select duration * (1 + (id % 3)) as life, 300.0 + 20 * (id % 3) as temp, case when status > 0 then 1 else 0 end as ev from ({FX['fx_surv']}) s0"
query("accelerated_life_test", _al, lambda d: rounded(S.accelerated_life_test(d, "life", "temp", 290.0, "arrhenius", "ev")))
