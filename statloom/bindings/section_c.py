"""Checked queries: contingency tables, epidemiology, survey weights, conjugate Bayes, set-theoretic analysis."""

from __future__ import annotations

from ..operators import tables as C
from .tables import q, qs, query, rounded

_ct = """with c as (select o_orderpriority a, o_orderstatus b, count(*)::double o from src group by 1, 2),
 e as (select a, b, o, sum(o) over (partition by a) ra, sum(o) over (partition by b) cb, sum(o) over () n from c), x as (select *, ra * cb / n ex from e)"""
query("chi_square_test", "orders", lambda d: rounded(C.chi_square_test(d, "o_orderpriority", "o_orderstatus"), 6, ["n", "chi2", "df", "cramers_v", "sparse_cells"]),
      _ct + f""", s as (select max(n) n, sum(power(o - ex, 2) / ex) x2, count(distinct a)::double r, count(distinct b)::double c, cast(sum((ex < 5)::int) as bigint) sp from x)
      select cast(n as bigint) as n, {q('x2', 'chi2', 6)}, cast((r - 1) * (c - 1) as bigint) as df,
      {q('sqrt(greatest(0.0, x2 / n - (c - 1) * (r - 1) / (n - 1)) / least(r - power(r - 1, 2) / (n - 1) - 1, c - power(c - 1, 2) / (n - 1) - 1))', 'cramers_v', 6)}, sp as sparse_cells from s""")
query("chi_square_gof", "orders", lambda d: rounded(C.chi_square_test(d, "o_orderpriority"), 6, ["n", "chi2", "df", "sparse_cells"]),
      f"""with c as (select count(*)::double o from src group by o_orderpriority), m as (select avg(o) e from c)
      select cast(sum(o) as bigint) as n, {q('sum(power(o - e, 2) / e)', 'chi2', 6)}, count(*) - 1 as df, cast(sum((e < 5)::int) as bigint) as sparse_cells from c, m""")
_f22 = "select case when o_totalprice > 300000 then 1 else 0 end as hi, case when o_orderstatus = 'F' then 1 else 0 end as fin from orders"
query("fisher_exact", _f22, lambda d: rounded(C.fisher_exact(d, "hi", "fin"), 6, ["n", "a", "b", "c", "d", "sample_odds_ratio"]),
      f"""with t as (select sum(((1 - hi) * (1 - fin))::double) a, sum(((1 - hi) * fin)::double) b, sum((hi * (1 - fin))::double) c, sum((hi * fin)::double) d, count(*) n from src)
      select n, cast(a as bigint) as a, cast(b as bigint) as b, cast(c as bigint) as c, cast(d as bigint) as d, {q('a * d / (b * c)', 'sample_odds_ratio', 6)} from t""")
query("mcnemar_test", "fx_items", lambda d: rounded(C.mcnemar_test(d, "i1", "i2"), 4, ["n", "b", "c", "statistic", "odds_ratio"]),
      f"""with t as (select count(*) n, sum((i1 * (1 - i2))::double) b, sum(((1 - i1) * i2)::double) c from src)
      select n, cast(b as bigint) as b, cast(c as bigint) as c, {q('case when b + c < 25 then null else power(abs(b - c) - 1, 2) / (b + c) end', 'statistic')}, {q('b / c', 'odds_ratio')} from t""")
query("loglinear", "orders", lambda d: rounded(C.loglinear(d, "o_orderpriority", "o_orderstatus"), 4, ["level_a", "level_b", "observed", "expected", "adjusted_residual", "g2", "pearson", "df"]),
      _ct + f""" select a as level_a, b as level_b, cast(o as bigint) as observed, {qs(expected='ex', adjusted_residual='(o - ex) / sqrt(ex * (1 - ra / n) * (1 - cb / n))',
      g2='2 * sum(o * ln(o / ex)) over ()', pearson='sum(power(o - ex, 2) / ex) over ()')}, cast(8 as bigint) as df from x""")
_cm = "select case when l_discount > 0.05 then 1 else 0 end as ex, case when l_returnflag = 'R' then 1 else 0 end as oc, l_linenumber as st from lineitem"
query("cmh_test", _cm, lambda d: rounded(C.cmh_test(d, "ex", "oc", "st"), 6, ["strata", "n", "mh_odds_ratio", "cmh_chi2"]),
      f"""with t as (select st, sum((ex * oc)::double) a, sum((ex * (1 - oc))::double) b, sum(((1 - ex) * oc)::double) c, sum(((1 - ex) * (1 - oc))::double) d, count(*)::double n from src group by st)
      select count(*) as strata, cast(sum(n) as bigint) as n, {qs(6, mh_odds_ratio='sum(a * d / n) / sum(b * c / n)',
      cmh_chi2='power(abs(sum(a - (a + b) * (a + c) / n)) - 0.5, 2) / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1)))')} from t""")
query("ordinal_association", "orders", lambda d: rounded(C.ordinal_association(d, "o_orderpriority", "o_orderstatus"), 6),
      f"""with c as (select o_orderpriority a, o_orderstatus b, count(*)::double o from src group by 1, 2),
      p as (select sum(case when y.b > x.b then x.o * y.o else 0 end) con, sum(case when y.b < x.b then x.o * y.o else 0 end) dis from c x join c y on x.a < y.a),
      n as (select sum(o) n from c), tx as (select sum(s * (s - 1) / 2) t from (select sum(o) s from c group by a)), ty as (select sum(s * (s - 1) / 2) u from (select sum(o) s from c group by b))
      select cast(n as bigint) as n, {qs(6, concordant='con', discordant='dis', gamma='(con - dis) / (con + dis)', tau_b='(con - dis) / sqrt((n * (n - 1) / 2 - t) * (n * (n - 1) / 2 - u))',
      somers_d_y_given_x='(con - dis) / (n * (n - 1) / 2 - t)', somers_d_x_given_y='(con - dis) / (n * (n - 1) / 2 - u)')} from p, n, tx, ty""")
query("epi_risk_measures", _cm, lambda d: rounded(C.epi_risk_measures(d, "ex", "oc"), 6, ["n", "risk_exposed", "risk_unexposed", "rr", "rr_low", "rr_high", "odds_ratio", "or_low", "or_high", "rd", "rd_low", "rd_high", "nnt", "ar_percent", "par_percent"]),
      f"""with t as (select sum((ex * oc)::double) a, sum((ex * (1 - oc))::double) b, sum(((1 - ex) * oc)::double) c, sum(((1 - ex) * (1 - oc))::double) d, count(*) n, 1.959963984540054 z from src),
      r as (select *, a / (a + b) r1, c / (c + d) r0, sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)) srr, sqrt(1 / a + 1 / b + 1 / c + 1 / d) sor, (a + b) / n pe from t),
      s as (select *, r1 / r0 rr, a * d / (b * c) orr, r1 - r0 rd, sqrt(r1 * (1 - r1) / (a + b) + r0 * (1 - r0) / (c + d)) srd from r)
      select n, {qs(6, risk_exposed='r1', risk_unexposed='r0', rr='rr', rr_low='rr * exp(-z * srr)', rr_high='rr * exp(z * srr)', odds_ratio='orr', or_low='orr * exp(-z * sor)', or_high='orr * exp(z * sor)',
      rd='rd', rd_low='rd - z * srd', rd_high='rd + z * srd', nnt='1 / rd', ar_percent='(rr - 1) / rr * 100', par_percent='pe * (rr - 1) / (1 + pe * (rr - 1)) * 100')} from s""")
_lb = "select l.doc_id, l.quality, l.toxic, cast(d.n_chars as double) as score, cast(d.n_chars * 7919 % 1000 as double) / 1000 as p from labels l join documents d on l.doc_id = d.doc_id"
query("diagnostic_test_eval", _lb, lambda d: rounded(C.diagnostic_test_eval(d, "quality", "score"), 6, ["n_pos", "n_neg", "auc", "auc_se"]),
      f"""with r as (select quality y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 ra, rank() over (partition by quality order by score) + (count(*) over (partition by quality, score) - 1) / 2.0 rc from src),
      n as (select sum(quality)::double p, sum(1 - quality)::double n from src),
      v as (select y, case when y = 1 then (ra - rc) / n else 1 - (ra - rc) / p end v, p, n from r, n),
      a as (select max(p) p, max(n) n, avg(case when y = 1 then v end) auc, var_samp(case when y = 1 then v end) s10, var_samp(case when y = 0 then v end) s01 from v)
      select cast(p as bigint) as n_pos, cast(n as bigint) as n_neg, {qs(6, auc='greatest(auc, 1 - auc)', auc_se='sqrt(s10 / p + s01 / n)')} from a""")
query("roc_curve", _lb, lambda d: rounded(C.roc_curve(d, "quality", "score"), 6),
      f"""with c as (select score s, sum(quality)::double p, sum(1 - quality)::double n from src group by score)
      select s as threshold, {qs(6, tpr='sum(p) over (order by s desc) / sum(p) over ()', fpr='sum(n) over (order by s desc) / sum(n) over ()')} from c""")
query("calibration_assessment", _lb, lambda d: rounded(C.calibration_assessment(d, "p", "quality", "doc_id"), 6, ["n", "brier", "uncertainty", "hosmer_lemeshow", "hl_groups"]),
      f"""with i as (select p, quality y, row_number() over (order by p, doc_id) i, count(*) over () n from src), g as (select least((i - 1) * 10 // n, 9) g, sum(p) e, sum(y)::double o, count(*)::double c from i group by 1)
      select (select count(*) from src) as n, {q('(select avg(power(p - quality, 2)) from src)', 'brier', 6)}, {q('(select avg(quality) * (1 - avg(quality)) from src)', 'uncertainty', 6)},
      {q('sum(power(o - e, 2) / e + power(o - e, 2) / (c - e))', 'hosmer_lemeshow', 6)}, count(*) as hl_groups from g""")
query("reliability_bins", _lb, lambda d: rounded(C.reliability_bins(d, "p", "quality"), 6),
      f"""with b as (select cast(least(floor(p * 10), 9) as bigint) b, count(*)::double n, avg(p) mp, avg(quality) o, 1.959963984540054 z from src group by 1)
      select b as bin, cast(n as bigint) as n, {qs(6, mean_predicted='mp', observed='o', wilson_low='greatest(0, (o + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(o * (1 - o) / n + z * z / (4 * n * n)) / (1 + z * z / n))',
      wilson_high='least(1, (o + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(o * (1 - o) / n + z * z / (4 * n * n)) / (1 + z * z / n))')} from b""")
query("weighted_estimation", "lineitem", lambda d: rounded(C.weighted_estimation(d, "l_extendedprice", "l_quantity", "l_returnflag").drop("total"), 4),
      f"""with m as (select l_returnflag, l_quantity w, l_extendedprice y, sum(l_quantity * l_extendedprice) over (partition by l_returnflag) / sum(l_quantity) over (partition by l_returnflag) mu from src)
      select l_returnflag, count(*) as n, {qs(mean='max(mu)', se='sqrt(count(*)::double / (count(*) - 1) * sum(power(w * (y - mu), 2))) / sum(w)', deff='count(*) * sum(w * w) / power(sum(w), 2)', n_eff='power(sum(w), 2) / sum(w * w)')} from m group by 1""")
_seg = {"AUTOMOBILE": 0.3, "BUILDING": 0.25, "FURNITURE": 0.2, "HOUSEHOLD": 0.15, "MACHINERY": 0.1}
query("poststratification", "customer", lambda d: rounded(C.poststratification(d, "c_mktsegment", _seg, "c_acctbal"), 6),
      "with t(s, p) as (values " + ", ".join(f"('{k}', {v}::double)" for k, v in _seg.items()) + f"""), c as (select c_mktsegment s, count(*)::double k from src group by 1),
      f as (select c.s, p / (k / (select count(*) from src)) f from c join t on c.s = t.s), r as (select c_acctbal y, f from src join f on c_mktsegment = s)
      select count(*) as n, {qs(6, mean_before='avg(y)', mean_after='sum(f * y) / sum(f)', kish_efficiency='power(sum(f), 2) / (count(*) * sum(f * f))', min_weight='min(f)', max_weight='max(f)')} from r""")
_rk = "select c_custkey, c_mktsegment, case when c_acctbal > 4500 then 'high' else 'low' end as bal from customer"
query("raking", _rk, lambda d: rounded(C.raking_margins(d, ["c_mktsegment", "bal"], {"c_mktsegment": _seg, "bal": {"high": 0.4, "low": 0.6}}).select("variable", "level", "n", "share"), 5),
      "with t(v, l, p) as (values " + ", ".join(f"('c_mktsegment', '{k}', {v}::double)" for k, v in _seg.items()) + """, ('bal', 'high', 0.4::double), ('bal', 'low', 0.6::double))
      , n as (select 'c_mktsegment' v, c_mktsegment l, count(*) n from src group by 2 union all select 'bal', bal, count(*) from src group by 2)
      select t.v as variable, t.l as level, n.n as n, """ + q("p", "share", 5) + " from t join n on t.v = n.v and t.l = n.l")
_bp = "select case when o_orderstatus = 'F' then 1 else 0 end as y, case when o_totalprice > 250000 then 'b' else 'a' end as arm, o_orderpriority from orders"
query("bayesian_proportion", _bp, lambda d: rounded(C.bayesian_proportion(d, "y", "o_orderpriority"), 6, ["level", "n", "successes", "posterior_mean", "posterior_mode"]),
      f"""select o_orderpriority as level, count(*) as n, cast(sum(y) as bigint) as successes, {qs(6, posterior_mean='(1 + sum(y)) / (2.0 + count(*))', posterior_mode='sum(y) / count(*)::double')} from src group by 1""")
query("bayesian_ab_test", _bp, lambda d: rounded(C.bayesian_ab_test(d, "y", "arm"), 6, ["arm_a", "arm_b", "n_a", "n_b", "mean_a", "mean_b", "difference"]),
      f"""with g as (select arm, count(*) n, (1 + sum(y)) / (2.0 + count(*)) m from src group by 1)
      select a.arm as arm_a, b.arm as arm_b, a.n as n_a, b.n as n_b, {qs(6, mean_a='a.m', mean_b='b.m', difference='b.m - a.m')} from g a join g b on a.arm < b.arm""")
query("bayesian_poisson_rate", "fx_site", lambda d: rounded(C.bayesian_poisson_rate(d, "n", group="species"), 6, ["level", "n", "events", "exposure", "posterior_mean", "dispersion", "overdispersed"]),
      f"""select species as level, count(*) as n, cast(sum(n) as double) as events, cast(count(*) as double) as exposure, {qs(6, posterior_mean='(0.001 + sum(n)) / (0.001 + count(*))', dispersion='var_samp(n) / avg(n)')},
      var_samp(n) / avg(n) > 1.5 as overdispersed from src group by 1""")
query("capture_recapture", "fx_items", lambda d: rounded(C.capture_recapture(d, ["i1", "i2"]), 4, ["method", "occasions", "observed", "captures", "n_hat", "ci_low", "ci_high"]),
      f"""with t as (select sum(i1)::double n1, sum(i2)::double n2, sum(i1 * i2)::double m, sum(greatest(i1, i2)) o from src),
      e as (select *, (n1 + 1) * (n2 + 1) / (m + 1) - 1 e, sqrt((n1 + 1) * (n2 + 1) * (n1 - m) * (n2 - m) / (power(m + 1, 2) * (m + 2))) s from t)
      select 'chapman' as method, cast(2 as bigint) as occasions, cast(o as bigint) as observed, cast(n1 + n2 as bigint) as captures, {qs(n_hat='e', ci_low='greatest(e - 1.96 * s, o)', ci_high='e + 1.96 * s')} from e""")
query("occupancy_model", "fx_items", lambda d: rounded(C.occupancy_model(d, ["i1", "i2", "i6"])))
_pc = ["p_retailprice", "p_size"]
query("csqca", "select p_retailprice, cast(p_size as double) as p_size, cast(p_partkey % 97 as double) as m from part", lambda d: rounded(C.csqca(d, "p_retailprice", ["p_size", "m"])),
      f"""with m as (select quantile_cont(p_retailprice, 0.5) a, quantile_cont(p_size, 0.5) b, quantile_cont(m, 0.5) c from src),
      d as (select (p_retailprice >= a)::int y, (p_size >= b)::int x1, (src.m >= c)::int x2 from src, m)
      select x1::varchar || x2::varchar as configuration, count(*) as n, {qs(consistency='avg(y)', pri='avg(y)')}, avg(y) >= 0.8 as included from d group by 1""")
_fzsrc = "select p_retailprice, cast(p_size as double) as p_size, cast(p_partkey % 97 as double) as m from part"


def _cal(col, alias):
    return f"1 / (1 + exp(-ln(19.0) * ({col} - {alias}[2]) / case when {col} >= {alias}[2] then {alias}[3] - {alias}[2] else {alias}[2] - {alias}[1] end))"


_fz = f"""with a as (select quantile_cont(p_retailprice, [0.1, 0.5, 0.9]) qa, quantile_cont(p_size, [0.1, 0.5, 0.9]) qb, quantile_cont(m, [0.1, 0.5, 0.9]) qc from src),
 f as (select {_cal('p_retailprice', 'qa')} y, {_cal('p_size', 'qb')} x1, {_cal('m', 'qc')} x2 from src, a)"""
query("fsqca", _fzsrc, lambda d: rounded(C.fsqca(d, "p_retailprice", ["p_size", "m"])),
      _fz + """, c as (select i, j, least(case when i = 1 then x1 else 1 - x1 end, case when j = 1 then x2 else 1 - x2 end) x, y, (x1 > 0.5) = (i = 1) and (x2 > 0.5) = (j = 1) k from f, (values (0), (1)) a(i), (values (0), (1)) b(j)),
      s as (select i::varchar || j::varchar g, sum(k::int) n, sum(x) sx, sum(least(x, y)) sxy, sum(least(x, y, 1 - y)) sn from c group by 1)
      select g as configuration, cast(n as bigint) as n, """ + qs(consistency="sxy / sx", pri="(sxy - sn) / (sx - sn)") + ", sxy / sx >= 0.8 as included from s where n > 0")
query("fsqca_sufficiency", _fzsrc, lambda d: rounded(C.fsqca_sufficiency(d, "p_retailprice", ["p_size", "m"])),
      _fz + f" select 'p_size' as condition, {qs(consistency='sum(least(x1, y)) / sum(x1)', coverage='sum(least(x1, y)) / sum(y)')} from f union all select 'm', {qs(consistency='sum(least(x2, y)) / sum(x2)', coverage='sum(least(x2, y)) / sum(y)')} from f")
query("panel_qca", "fx_panel", lambda d: rounded(C.panel_qca(d, "y", ["x"], "unit", "period")),
      f"""with a as (select quantile_cont(y, [0.1, 0.5, 0.9]) qa, quantile_cont(x, [0.1, 0.5, 0.9]) qb from src), f as (select unit, period, {_cal('y', 'qa')} y, {_cal('x', 'qb')} x from src, a),
      p as (select 'pooled' l, 'all' k, sum(least(x, y)) / sum(x) c, sum(least(x, y)) / sum(y) v from f), b as (select 'between' l, period::varchar k, sum(least(x, y)) / sum(x) c, sum(least(x, y)) / sum(y) v from f group by period),
      w as (select 'within' l, unit::varchar k, sum(least(x, y)) / sum(x) c, sum(least(x, y)) / sum(y) v from f group by unit),
      z as (select *, sum(c) over (partition by l) s, count(*) over (partition by l) n from (select * from b union all select * from w))
      select l as level, k as key, {qs(consistency='c', coverage='v')}, cast(null as double) as distance from p
      union all select l, k, {qs(consistency='c', coverage='v', distance='sqrt(sum(power(c / s - 1.0 / n, 2)) over (partition by l))')} from z""")
_nm = ["l_quantity", "l_discount", "l_tax"]
query("qca_necessity", "lineitem", lambda d: rounded(C.qca_necessity(d, "l_extendedprice", _nm, incl_cut=0.7)),
      f"""with a as (select quantile_cont(l_extendedprice, [0.1, 0.5, 0.9]) qa, {', '.join(f'quantile_cont({c}, [0.1, 0.5, 0.9]) {c}_q' for c in _nm)} from src),
      f as (select {_cal('l_extendedprice', 'qa')} y, {', '.join(f'{_cal(c, c + "_q")} {c}' for c in _nm)} from src, a),
      t as (""" + " union all ".join([f"select '{c}' t, y, {c} x from f union all select '~{c}', y, 1 - {c} from f" for c in _nm]
      + [f"select '{s1}{a}+{s2}{b}', y, greatest({'1 - ' if s1 else ''}{a}, {'1 - ' if s2 else ''}{b}) from f"
         for a, b, s1, s2 in [(*sorted([(a, sa), (b, sb)], key=lambda z: z[1] + z[0]),)[0][:1] + (*sorted([(a, sa), (b, sb)], key=lambda z: z[1] + z[0]),)[1][:1]
                              + tuple(z[1] for z in sorted([(a, sa), (b, sb)], key=lambda z: z[1] + z[0]))
                              for i, a in enumerate(_nm) for b in _nm[i + 1:] for sa in ("", "~") for sb in ("", "~")]])
      + f"""), s as (select t, sum(least(x, y)) / sum(y) c, sum(least(x, y)) / sum(x) v, sum(1 - x) / sum(1 - least(x, y)) r from t group by t)
      select t as term, {qs(consistency='c', coverage='v', ron='r')} from s where c >= 0.7 and v >= 0.5""")
query("nca", "lineitem", lambda d: rounded(C.nca(d, "l_extendedprice", ["l_quantity", "l_discount"]), 6),
      " union all ".join(f"""select * from (with p as (select {c} x, max(l_extendedprice) y from src group by 1), r as (select x, max(y) over (order by x) ce, lead(x) over (order by x) nx, max(y) over () ym from p),
      b as (select min(l_extendedprice) y0, max(l_extendedprice) y1, min({c}) x0, max({c}) x1 from src), d as (select sum((ym - ce) * (nx - x)) / max((x1 - x0) * (y1 - y0)) d from r, b)
      select '{c}' as condition, {q('d', 'd', 6)}, case when d < 0.1 then 'negligible' when d < 0.3 then 'medium' when d < 0.5 then 'large' else 'very large' end as necessity from d)""" for c in ("l_quantity", "l_discount")))
query("pmc_index", _id if (_id := "select *, l_orderkey * 10 + l_linenumber as id from lineitem") else "", lambda d: rounded(C.pmc_index(d, {"price": ["l_quantity", "l_extendedprice"], "terms": ["l_discount", "l_tax"]}, "id"), 6),
      f"""with s as (select min(l_quantity) a, max(l_quantity) b, min(l_extendedprice) c, max(l_extendedprice) d from src),
      x as (select id, ((l_quantity - a) / (b - a) + (l_extendedprice - c) / (d - c)) / 2 x1, (l_discount + l_tax) / 2 x2 from src, s)
      select id, {qs(6, x_price='x1', x_terms='x2', pmc='x1 + x2', pmc_ratio='(x1 + x2) / 2')}, case when (x1 + x2) / 2 >= 0.9 then 'perfect' when (x1 + x2) / 2 >= 0.7 then 'excellent' when (x1 + x2) / 2 >= 0.5 then 'acceptable' else 'poor' end as rating from x""")
