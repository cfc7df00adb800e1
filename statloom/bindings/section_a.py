"""Checked queries: descriptive statistics, correlation, assumption checks."""

from __future__ import annotations

from ..operators import describe as A
from .tables import q, qs, query, rounded

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_num_desc = " union all ".join(
    f"""select '{c}' as "column", count({c}) as n, {qs(mean=f'avg({c})', std=f'stddev_samp({c})', min=f'min({c})',
    q25=f'quantile_cont({c}, 0.25)', q50=f'quantile_cont({c}, 0.5)', q75=f'quantile_cont({c}, 0.75)', max=f'max({c})')},
    cast(null as bigint) as "unique", cast(null as varchar) as top, cast(null as bigint) as freq from src""" for c in NUM)
_txt_desc = " union all ".join(
    f"""select '{c}' as "column", cast(sum(c) as bigint) as n, cast(null as double) as mean, cast(null as double) as std, cast(null as double) as min,
    cast(null as double) as q25, cast(null as double) as q50, cast(null as double) as q75, cast(null as double) as max,
    count(*) as "unique", (array_agg(v order by c desc, v))[1] as top, max(c) as freq
    from (select {c} as v, count(*) as c from src group by {c})""" for c in ("l_returnflag", "l_linestatus"))
query("descriptive_stats", "lineitem", lambda d: rounded(A.descriptive_stats(d, [*NUM, "l_returnflag", "l_linestatus"])),
      f"select * from ({_num_desc} union all {_txt_desc})")

_pairs = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]
query("correlation", "lineitem", lambda d: rounded(A.correlation(d, NUM), 6),
      " union all ".join(f"select '{a}' as col_a, '{b}' as col_b, count(*) as n, {q(f'corr({a}, {b})', 'r', 6)} from src"
                         for a, b in _pairs))

query("pearson_correlation", "lineitem",
      lambda d: rounded(A.pearson_correlation(d, "l_quantity", "l_discount"), 6,
                        ["n", "pearson_r", "r_squared", "spearman_rho", "kendall_tau_b"]),
      f"""with r as (select l_quantity x, l_discount y,
            rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as rx,
            rank() over (order by l_discount) + (count(*) over (partition by l_discount) - 1) / 2.0 as ry from src),
      p as (select l_quantity x, l_discount y, count(*)::double w from src group by 1, 2),
      cd as (select sum(a.w * b.w * sign(b.y - a.y)) as s from p a join p b on a.x < b.x),
      tx as (select sum(w * (w - 1) / 2) t from (select sum(w) w from p group by x)),
      ty as (select sum(w * (w - 1) / 2) t from (select sum(w) w from p group by y)),
      nn as (select count(*)::double n from src)
      select (select count(*) from src) as n, {q('corr(x, y)', 'pearson_r', 6)}, {q('corr(x, y) * corr(x, y)', 'r_squared', 6)},
        {q('corr(rx, ry)', 'spearman_rho', 6)},
        {q('(select s from cd) / sqrt(((select n * (n - 1) / 2 from nn) - (select t from tx)) * ((select n * (n - 1) / 2 from nn) - (select t from ty)))', 'kendall_tau_b', 6)}
      from r""")

query("partial_correlation", "lineitem",
      lambda d: rounded(A.partial_correlation(d, "l_extendedprice", "l_tax", ["l_quantity"]), 6,
                        ["n", "k", "zero_order_r", "partial_r", "dof"]),
      f"""with c as (select count(*) n, corr(l_extendedprice, l_tax) a, corr(l_extendedprice, l_quantity) b, corr(l_tax, l_quantity) c from src)
      select n, cast(1 as bigint) as k, {q('a', 'zero_order_r', 6)}, {q('(a - b * c) / sqrt((1 - b * b) * (1 - c * c))', 'partial_r', 6)}, n - 3 as dof from c""")

query("correlation_matrix", "lineitem", lambda d: rounded(A.correlation_matrix(d, NUM, "spearman"), 6, ["col_a", "col_b", "n", "r"]),
      "with r as (select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in NUM)
      + " from src) " + " union all ".join(
          f"select '{a}' as col_a, '{b}' as col_b, count(*) as n, {q(f'corr({a}, {b})', 'r', 6)} from r" for a, b in _pairs))

query("vif_multicollinearity", "lineitem",
      lambda d: rounded(A.vif_multicollinearity(d, ["l_quantity", "l_extendedprice"]), 4, ["predictor", "vif", "tolerance"]),
      f"""with c as (select corr(l_quantity, l_extendedprice) r from src)
      select p as predictor, {q('1 / (1 - r * r)', 'vif')}, {q('1 - r * r', 'tolerance')}
      from c, (values ('l_quantity'), ('l_extendedprice')) v(p)""")

query("heteroskedasticity_test", "lineitem",
      lambda d: rounded(A.heteroskedasticity_test(d, "l_extendedprice", ["l_quantity"]).where("test = 'breusch_pagan'"), 4,
                        ["test", "n", "df", "lm", "f"]),
      f"""with f as (select regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a from src),
      e as (select l_quantity x, power(l_extendedprice - a - b * l_quantity, 2) e2 from src, f),
      g as (select count(*) n, regr_r2(e2, x) r2 from e)
      select 'breusch_pagan' as test, n, cast(1 as bigint) as df, {q('n * r2', 'lm')}, {q('r2 / ((1 - r2) / (n - 2))', 'f')} from g""")

query("influence_diagnostics", "lineitem",
      lambda d: rounded(A.influence_diagnostics(d.withColumn("id", d.l_orderkey * 10 + d.l_linenumber), "l_extendedprice", ["l_quantity"], "id"), 6,
                        ["id", "leverage", "cooks_d", "high_leverage", "high_cooks"]),
      f"""with f as (select count(*)::double n, regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a,
           avg(l_quantity) mx, regr_sxx(l_extendedprice, l_quantity) sxx from src),
      e as (select l_orderkey * 10 + l_linenumber as id, n, l_extendedprice - a - b * l_quantity e, 1 / n + power(l_quantity - mx, 2) / sxx h from src, f),
      s as (select sum(e * e) / (max(n) - 2) s2 from e)
      select id, {q('h', 'leverage', 6)}, {q('e * e * h / (2 * s2 * power(1 - h, 2))', 'cooks_d', 6)}, h > 4 / n as high_leverage,
        e * e * h / (2 * s2 * power(1 - h, 2)) > 4 / n as high_cooks from e, s""")

query("distribution_fit", "orders", lambda d: rounded(A.distribution_fit(d, "o_totalprice")))
query("goodness_of_fit", "orders", lambda d: rounded(A.goodness_of_fit(d, "o_totalprice")))
query("qq_analysis", "orders", lambda d: rounded(A.qq_analysis(d, "o_totalprice", "o_orderkey")))
query("kernel_density", "orders", lambda d: rounded(A.kernel_density(d, "o_totalprice"), 8))

query("tail_index", "lineitem", lambda d: rounded(A.tail_index(d, "l_extendedprice"), 4, ["k", "alpha"]),
      f"""with p as (select l_extendedprice x, row_number() over (order by l_extendedprice desc) i, count(*) over () n from src where l_extendedprice > 0),
      t as (select i, x, n, sum(ln(x)) over (order by i rows between unbounded preceding and 1 preceding) s,
            greatest(5, least(cast(floor(0.1 * n) as bigint), n - 2)) as kmax from p),
      h as (select i - 1 as k, s / (i - 1) - ln(x) as me from t where i >= 2 and i <= kmax + 1)
      select k, {q('1 / me', 'alpha')} from h where me > 1e-12""")
query("finite_mixture", "orders", lambda d: rounded(A.finite_mixture(d, "o_totalprice", 3), 2))
query("loss_distribution", "orders", lambda d: rounded(A.loss_distribution(d, "o_totalprice"), 2))

_acf_sql = """with m as (select k, w, v, avg(v) over (partition by k) mu from src), c as (select k, w, v - mu c from m),
  l as (select k, c, {lags} from c), s as (select k, count(*) n, sum(c * c) s0, {sums} from l group by k)"""


def _acf(n):
    return _acf_sql.format(lags=", ".join(f"c * lag(c, {i}) over (partition by k order by w) p{i}" for i in range(1, n + 1)),
                           sums=", ".join(f"sum(p{i}) / sum(c * c) r{i}" for i in range(1, n + 1)))


query("acf_pacf", "fx_series", lambda d: rounded(A.acf_pacf(d, "v", "w", ["k"], 8), 6, ["k", "lag", "n", "acf", "acf_out"]),
      _acf(8) + " " + " union all ".join(
          f"select k, cast({i} as bigint) as lag, n, {q(f'r{i}', 'acf', 6)}, abs(r{i}) > 1.96 / sqrt(n) as acf_out from s" for i in range(1, 9)))
query("ljung_box", "fx_series", lambda d: rounded(A.ljung_box(d, "v", "w", ["k"]), 4, ["k", "n", "lags", "q"]),
      _acf(10) + f" select k, n, cast(10 as bigint) as lags, "
      + q("n * (n + 2) * (" + " + ".join(f"r{i} * r{i} / (n - {i})" for i in range(1, 11)) + ")", "q") + " from s")
query("hurst_exponent", "fx_series", lambda d: rounded(A.hurst_exponent(d, "v", "w", ["k"])))
query("missingness_diagnosis", "fx_nulls", lambda d: rounded(A.missingness_diagnosis(d, ["a", "b", "s"])),
      """select (case when a is null then '1' else '0' end) || (case when b is null then '1' else '0' end) || (case when s is null then '1' else '0' end) as pattern,
      cast(max((a is null)::int + (b is null)::int + (s is null)::int) as bigint) as n_missing, count(*) as rows from src group by 1""")
query("missing_rates", "fx_nulls", lambda d: rounded(A.missing_rates(d, ["a", "b", "s"])),
      " union all ".join(f"""select '{c}' as "column", count(*) - count({c}) as n_missing, {q(f'(count(*) - count({c})) / count(*)', 'rate')} from src""" for c in "abs"))
query("mcar_screen", "fx_nulls", lambda d: rounded(A.mcar_screen(d.withColumn("c", (d.id % 13).cast("double")), ["a", "b", "c"])))
