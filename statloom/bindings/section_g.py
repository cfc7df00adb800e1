"""Checked queries: time series."""

from __future__ import annotations

from ..operators import timeseries as G
from .tables import q, qs, query, rounded

_wk = "select date_trunc('week', o_orderdate) as w, sum(o_totalprice) / 1000 as v, count(*) as n from orders group by date_trunc('week', o_orderdate)"
query("exponential_smoothing", "fx_series", lambda d: rounded(G.exponential_smoothing(d, "v", "w", ["k"], 4)))
query("theta_method", "fx_series", lambda d: rounded(G.theta_method(d, "v", "w", ["k"], 4)))
query("croston", "fx_series", lambda d: rounded(G.croston(d, "v", "w", ["k"])))
query("stl_decomposition", "fx_series", lambda d: rounded(G.stl_decomposition(d, "v", "w", ["k"], 13), 5, ["k", "v", "trend"]),
      f"""with i as (select k, w, v, avg(v) over f tr, count(*) over f c from src window f as (partition by k order by w rows between 6 preceding and 6 following))
      select k, {qs(5, v="v", trend="case when c = 13 then tr end")} from i""")
query("structural_breaks", "fx_series", lambda d: rounded(G.structural_breaks(d, "v", "w", ["k"])))
query("mann_kendall_trend", _wk, lambda d: rounded(G.mann_kendall_trend(d, "v", "w"), 4, ["n", "s", "var_s", "z", "sen_slope"]),
      f"""with i as (select row_number() over (order by w) i, v from src), p as (select sum(sign(b.v - a.v)) s, quantile_cont((b.v - a.v) / (b.i - a.i), 0.5) sl from i a join i b on a.i < b.i),
      t as (select sum(c * (c - 1) * (2 * c + 5)) t from (select count(*)::double c from src group by v)), n as (select count(*)::double n from src), x as (select n, s, (n * (n - 1) * (2 * n + 5) - t) / 18 vs, sl from p, t, n)
      select cast(n as bigint) as n, {qs(s='s', var_s='vs', z='(s - sign(s)) / sqrt(vs)', sen_slope='sl')} from x""")
query("flow_duration_curve", _wk, lambda d: rounded(G.flow_duration_curve(d, "v")),
      "with s as (select v, row_number() over (order by v desc) i, count(*) over () n from src), p as (select " + ", ".join(
          f"max(case when i = floor({p} * (n + 1)) then v end) + ({p} * (max(n) + 1) - floor({p} * (max(n) + 1))) * (max(case when i = floor({p} * (n + 1)) + 1 then v end) - max(case when i = floor({p} * (n + 1)) then v end)) as {a}"
          for p, a in ((0.05, "a"), (0.1, "b"), (0.5, "c"), (0.9, "d"), (0.95, "e"), (0.33, "f"), (0.66, "g"))) +
      f", max(n) n from s) select n, {qs(q5='a', q10='b', q50='c', q90='d', q95='e', q90_q50='d / c', slope='(ln(f) - ln(g)) / 0.33')} from p")
query("idf_curve", "fx_idf", lambda d: rounded(G.idf_curve(d, "duration", "intensity")))
query("var_granger", _wk, lambda d: rounded(G.var_granger(d, "w", ["v", "n"], 2)))
query("cointegration_vecm", _wk, lambda d: rounded(G.cointegration_vecm(d, "w", ["v", "n"])))
query("ardl_bounds", _wk, lambda d: rounded(G.ardl_bounds(d, "w", "v", ["n"])))
_rt = "select event_id, (value - 50) / 1000 as r from events"
query("value_at_risk", _rt, lambda d: rounded(G.value_at_risk(d, "r", "event_id", True), 6, ["alpha", "n", "var_historical", "es_historical", "skewness", "excess_kurtosis"]),
      f"""with l as (select -r l from src), m as (select count(*)::double n, avg(l) m, quantile_cont(l, [0.95, 0.99]) qv from l), c as (select avg(power(l - m, 2)) m2, avg(power(l - m, 3)) m3, avg(power(l - m, 4)) m4 from l, m),
      a as (select unnest([0.95, 0.99]) a, unnest(qv) v, n from m)
      select {q('a', 'alpha', 6)}, cast(n as bigint) as n, {qs(6, var_historical='v', es_historical='(select avg(l) from l where l >= v)', skewness='sqrt(n * (n - 1)) / (n - 2) * m3 / power(m2, 1.5)', excess_kurtosis='(n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6)')} from a, c""")
query("extreme_value", _rt, lambda d: rounded(G.extreme_value(d.withColumn("r", -d.r), "r", "event_id", True), 5))
query("risk_adjusted_return", _rt, lambda d: rounded(G.risk_adjusted_return(d, "r", "event_id"), 5),
      f"""with w as (select r, sum(ln(1 + r)) over (order by event_id) lw, event_id from src), m as (select min(exp(lw - mx) - 1) dd from (select lw, max(lw) over (order by event_id) mx from w)),
      a as (select count(*) n, avg(r) m, stddev_samp(r) s, avg(power(least(r, 0), 2)) d from src)
      select n, {qs(5, annual_return='m * 252', annual_volatility='s * sqrt(252)', sharpe='m / s * sqrt(252)', sortino='m / sqrt(d) * sqrt(252)', max_drawdown='dd', calmar='m * 252 / abs(dd)')} from a, m""")
