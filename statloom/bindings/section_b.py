"""Checked queries: groups, designed experiments, rank tests, resampling, agreement, multivariate."""

from __future__ import annotations

from ..operators import groups as B
from .tables import q, qs, query, rounded

_gm = """g as (select {g} as g, count(*)::double n, avg({y}) m, var_samp({y}) v from src group by {g})"""


def gm(y, g):
    return _gm.format(y=y, g=g)


_lev = """d as (select {g} g, abs({y} - quantile_cont({y}, 0.5) over (partition by {g})) z from src),
 lg as (select g, count(*)::double n, avg(z) m, var_samp(z) v from d group by g),
 lf as (select sum(n * power(m - gm, 2)) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*))) f from lg, (select avg(z) gm from d))"""
_welch = """w as (select g, n, m, n / v w from g), s as (select sum(w) sw, sum(w * m) / sum(w) mw, count(*) k from w),
 a as (select sum(power(1 - w / sw, 2) / (n - 1)) a, sum(w * power(m - mw, 2)) b, max(k) k from w, s),
 wf as (select b / (k - 1) / (1 + 2.0 * (k - 2) / (k * k - 1) * a) f, (k * k - 1) / (3 * a) df2 from a)"""
_one = """o as (select count(*) k, sum(n) n, sum(n * power(m - gm, 2)) ssb, sum((n - 1) * v) ssw from g, (select sum(n * m) / sum(n) gm from g))"""

query("group_comparison", "orders",
      lambda d: rounded(B.group_comparison(d, "o_totalprice", "o_orderpriority"), 4, ["test", "groups", "n", "statistic", "df1", "df2", "levene_f"]),
      f"""with {gm('o_totalprice', 'o_orderpriority')}, {_welch}, {_lev.format(y='o_totalprice', g='o_orderpriority')}
      select 'welch_anova' as test, (select count(*) from g) as "groups", cast((select sum(n) from g) as bigint) as n, {q('wf.f', 'statistic')},
      cast((select count(*) - 1 from g) as double) as df1, {q('df2', 'df2')}, {q('lf.f', 'levene_f')} from wf, lf""")
query("anova_oneway", "lineitem",
      lambda d: rounded(B.anova_oneway(d, "l_extendedprice", "l_returnflag"), 6, ["n", "groups", "f", "eta_squared", "omega_squared", "welch_f", "welch_df2", "levene_f"]),
      f"""with {gm('l_extendedprice', 'l_returnflag')}, {_one}, {_welch}, {_lev.format(y='l_extendedprice', g='l_returnflag')}
      select cast(n as bigint) as n, k as "groups", {qs(6, f='ssb / (k - 1) / (ssw / (n - k))', eta_squared='ssb / (ssb + ssw)',
      omega_squared='(ssb - (k - 1) * ssw / (n - k)) / (ssb + ssw + ssw / (n - k))', welch_f='wf.f', welch_df2='df2', levene_f='lf.f')} from o, wf, lf""")
query("tukey_hsd", "lineitem", lambda d: rounded(B.tukey_hsd(d, "l_extendedprice", "l_returnflag"), 4, ["group_a", "group_b", "difference", "q"]),
      f"""with {gm('l_extendedprice', 'l_returnflag')}, {_one}
      select a.g as group_a, b.g as group_b, {q('a.m - b.m', 'difference')}, {q('abs(a.m - b.m) / sqrt(ssw / (o.n - o.k) / 2 * (1 / a.n + 1 / b.n))', 'q')}
      from g a join g b on a.g < b.g, o""")
query("ancova", "lineitem",
      lambda d: rounded(B.ancova(d, "l_extendedprice", "l_returnflag", ["l_quantity"]), 6, ["term", "df1", "df2", "f", "partial_eta2"]),
      """with p as (select l_returnflag g, count(*)::double n, regr_syy(l_extendedprice, l_quantity) syy, regr_sxx(l_extendedprice, l_quantity) sxx,
        regr_sxy(l_extendedprice, l_quantity) sxy from src group by 1),
      t as (select regr_syy(l_extendedprice, l_quantity) - power(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity) r0 from src),
      s as (select count(*)::double k, sum(n) n, sum(syy) - power(sum(sxy), 2) / sum(sxx) rf, sum(syy) ry, sum(syy - sxy * sxy / sxx) rs from p),
      r as (select 'l_returnflag' as term, r0 - rf ss, k - 1 df1, n - k - 1 df2, rf e from s, t
       union all select 'l_quantity', ry - rf, 1.0, n - k - 1, rf from s
       union all select 'slope_homogeneity', rf - rs, k - 1, n - 2 * k, rs from s)
      select term, cast(df1 as double) as df1, cast(df2 as double) as df2, """ + qs(6, f='ss / df1 / (e / df2)', partial_eta2='ss / (ss + e)') + " from r")
query("adjusted_means", "lineitem", lambda d: rounded(B.adjusted_means(d, "l_extendedprice", "l_returnflag", ["l_quantity"])),
      f"""with p as (select l_returnflag g, count(*) n, avg(l_extendedprice) my, avg(l_quantity) mx, regr_sxx(l_extendedprice, l_quantity) sxx,
        regr_sxy(l_extendedprice, l_quantity) sxy from src group by 1), b as (select sum(sxy) / sum(sxx) b from p), m as (select avg(l_quantity) m from src)
      select g as level, n, {qs(mean='my', adjusted_mean='my - b * (mx - m)')} from p, b, m""")
_lk = ["q1", "q2", "q3", "q4", "q5"]
_lkd = lambda d: d.select("person", *[d[c].cast("double").alias(c) for c in _lk])
query("repeated_measures_anova", "fx_likert",
      lambda d: rounded(B.repeated_measures_anova(_lkd(d), _lk), 4, ["n", "conditions", "f", "ss_condition", "ss_error", "partial_eta2"]),
      f"""with l as (select person, c, cast(v as double) v from (select person, q1::double q1, q2::double q2, q3::double q3, q4::double q4, q5::double q5 from src) unpivot (v for c in (q1, q2, q3, q4, q5))),
      s as (select v, avg(v) over (partition by person) mp, avg(v) over (partition by c) mc, avg(v) over () g from l),
      t as (select sum(power(mc - g, 2)) a, sum(power(v - mp - mc + g, 2)) e, count(*) / 5 n from s)
      select cast(n as bigint) as n, cast(5 as bigint) as conditions, {qs(f='a / 4 / (e / (4 * (n - 1)))', ss_condition='a', ss_error='e', partial_eta2='a / (a + e)')} from t""")
query("factorial_anova", "lineitem",
      lambda d: rounded(B.factorial_anova(d, "l_extendedprice", "l_returnflag", "l_linestatus").where("term in ('residual', 'l_returnflag:l_linestatus')"), 4, ["term", "df"]),
      """with c as (select count(*) as k from (select distinct l_returnflag, l_linestatus from src)), n as (select count(*) as n from src)
      select 'residual' as term, cast(n - k as double) as df from c, n union all select 'l_returnflag:l_linestatus', cast(2 as double)""")
# Balanced block design: one mean per (treatment, block).
_rc = "select l_returnflag as trt, l_linenumber as blk, avg(l_extendedprice) / 100 as y from lineitem group by l_returnflag, l_linenumber"
_rcq = """with s as (select y, avg(y) over (partition by trt) mt, avg(y) over (partition by blk) mb, avg(y) over () g from src),
 k as (select count(distinct trt)::double t, count(distinct blk)::double b from src),
 r as (select sum(power(mt - g, 2)) a, sum(power(mb - g, 2)) bb, sum(power(y - mt - mb + g, 2)) e, max(t) t, max(b) b from s, k)"""
query("rcbd", _rc, lambda d: rounded(B.rcbd(d, "y", "trt", "blk"), 4, ["term", "ss", "df", "f"]),
      _rcq + f""" select 'trt' as term, {qs(ss='a', df='t - 1', f='a / (t - 1) / (e / ((t - 1) * (b - 1)))')} from r
      union all select 'blk', {qs(ss='bb', df='b - 1', f='bb / (b - 1) / (e / ((t - 1) * (b - 1)))')} from r
      union all select 'residual', {qs(ss='e', df='(t - 1) * (b - 1)')}, null from r""")
query("rcbd_anova", _rc, lambda d: rounded(B.rcbd_anova(d, "y", "trt", "blk"), 4, ["n", "treatments", "blocks", "f_treatment", "f_block", "eta2_treatment", "relative_efficiency"]),
      _rcq + f""", m as (select *, e / ((t - 1) * (b - 1)) mse, bb / (b - 1) msb from r)
      select cast(t * b as bigint) as n, cast(t as bigint) as treatments, cast(b as bigint) as blocks, {qs(f_treatment='a / (t - 1) / mse', f_block='msb / mse',
      eta2_treatment='a / (a + bb + e)', relative_efficiency='((b - 1) * msb + b * (t - 1) * mse) / ((b * t - 1) * mse)')} from m""")
_ls = """select l_orderkey % 5 as r, l_suppkey % 5 as c, (l_orderkey + l_suppkey) % 5 as trt, avg(l_extendedprice) / 100 as y
from lineitem group by l_orderkey % 5, l_suppkey % 5, (l_orderkey + l_suppkey) % 5"""
_lsq = """with s as (select y, avg(y) over (partition by trt) mt, avg(y) over (partition by r) mr, avg(y) over (partition by c) mc, avg(y) over () g from src),
 z as (select sum(power(mt - g, 2)) t, sum(power(mr - g, 2)) r, sum(power(mc - g, 2)) c, sum(power(y - mt - mr - mc + 2 * g, 2)) e from s)"""
_lst = lambda cols: " union all ".join(f"select '{n}' as term, {qs(ss=v, df='4.0', f=f'{v} / 4 / (e / 12)')}{x} from z"
                                      for n, v, x in cols)
query("latin_square", _ls, lambda d: rounded(B.latin_square(d, "y", "trt", "r", "c"), 4, ["term", "ss", "df", "f"]),
      _lsq + _lst([("trt", "t", ""), ("r", "r", ""), ("c", "c", "")]) + f" union all select 'residual', {qs(ss='e', df='12.0')}, null from z")
query("latin_square_anova", _ls, lambda d: rounded(B.latin_square_anova(d, "y", "trt", "r", "c"), 4, ["term", "ss", "df", "f", "eta2"]),
      _lsq + _lst([(n, v, ", " + q(f"{v} / (t + r + c + e)", "eta2")) for n, v in (("trt", "t"), ("r", "r"), ("c", "c"))])
      + f" union all select 'residual', {qs(ss='e', df='12.0')}, null, null from z")
_sp = "select l_linenumber as blk, l_returnflag as wp, l_linestatus as sp, avg(l_extendedprice) / 100 as y from lineitem group by l_linenumber, l_returnflag, l_linestatus"
_spq = """with s as (select blk, wp, sp, y, avg(y) over () g, avg(y) over (partition by blk) mb, avg(y) over (partition by wp) ma, avg(y) over (partition by sp) mp,
  avg(y) over (partition by blk, wp) mba, avg(y) over (partition by wp, sp) mas from src),
 k as (select count(distinct blk)::double b, count(distinct wp)::double a, count(distinct sp)::double p from src),
 z as (select sum(power(mb - g, 2)) sb, sum(power(ma - g, 2)) sa, sum(power(mp - g, 2)) ss, sum(power(mba - mb - ma + g, 2)) sba, sum(power(mas - ma - mp + g, 2)) sas,
  sum(power(y - g, 2)) t from s), e as (select z.*, k.*, t - sb - sa - ss - sba - sas se, a * (b - 1) * (p - 1) de, (a - 1) * (b - 1) dba from z, k)"""
_spf = f""" select 'wp' as term, {qs(ss='sa', df='a - 1', f='sa / (a - 1) / (sba / dba)')} from e
 union all select 'sp', {qs(ss='ss', df='p - 1', f='ss / (p - 1) / (se / de)')} from e
 union all select 'wp:sp', {qs(ss='sas', df='(a - 1) * (p - 1)', f='sas / ((a - 1) * (p - 1)) / (se / de)')} from e"""
query("split_plot", _sp, lambda d: rounded(B.split_plot(d, "y", "blk", "wp", "sp").where("term in ('wp', 'sp', 'wp:sp')"), 4, ["term", "ss", "df", "f"]), _spq + _spf)
query("split_plot_anova", _sp, lambda d: rounded(B.split_plot_anova(d, "y", "blk", "wp", "sp").where("f is not null"), 4, ["term", "ss", "df", "f"]),
      _spq + _spf + f" union all select 'naive_wp', {qs(ss='sa', df='a - 1', f='sa / (a - 1) / ((se + sba) / (de + dba))')} from e")
query("response_surface", "lineitem", lambda d: rounded(B.response_surface(d, "l_extendedprice", ["l_quantity", "l_discount"])))
query("ammi", "lineitem", lambda d: rounded(B.ammi(d, "l_extendedprice", "l_linenumber", "l_returnflag"), 2))
query("gge_biplot", "lineitem", lambda d: rounded(B.gge_biplot(d, "l_extendedprice", "l_linenumber", "l_returnflag"), 2))

_fo = "select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderstatus <> 'P'"
_es = f"""with {gm('o_totalprice', 'o_orderstatus')}, p as (select a.n n1, b.n n2, a.m m1, b.m m2, b.v v2, a.g g1, b.g g2,
  sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) sp from g a join g b on a.g < b.g),
 rk as (select o_orderstatus s, rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0 r from src),
 u as (select sum(r) - count(*) * (count(*) + 1) / 2.0 u from rk where s = 'F')"""
query("cohens_d", _fo, lambda d: rounded(B.cohens_d(d, "o_totalprice", "o_orderstatus"), 6, ["group_1", "group_2", "n1", "n2", "cohens_d", "cles", "glass_delta"]),
      _es + f" select g1 as group_1, g2 as group_2, cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, {qs(6, cohens_d='(m1 - m2) / sp', cles='u / (n1 * n2)', glass_delta='(m1 - m2) / sqrt(v2)')} from p, u")
query("hedges_g", _fo, lambda d: rounded(B.hedges_g(d, "o_totalprice", "o_orderstatus"), 6, ["n1", "n2", "hedges_g", "correction"]),
      _es + f" select cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, {qs(6, hedges_g='(m1 - m2) / sp * (1 - 3 / (4 * (n1 + n2) - 9))', correction='1 - 3 / (4 * (n1 + n2) - 9)')} from p")
query("cliffs_delta", _fo, lambda d: rounded(B.cliffs_delta(d, "o_totalprice", "o_orderstatus"), 6),
      _es + f" select cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, {q('2 * u / (n1 * n2) - 1', 'cliffs_delta', 6)}, case when abs(2 * u / (n1 * n2) - 1) < 0.147 then 'negligible' when abs(2 * u / (n1 * n2) - 1) < 0.33 then 'small' when abs(2 * u / (n1 * n2) - 1) < 0.474 then 'medium' else 'large' end as magnitude from p, u")
query("mann_whitney", _fo, lambda d: rounded(B.mann_whitney(d, "o_totalprice", "o_orderstatus"), 4, ["n1", "n2", "u", "z", "rank_biserial", "hodges_lehmann"]),
      _es + f""", tt as (select sum(power(c, 3) - c) t from (select count(*)::double c from src group by o_totalprice)),
      hl as (select quantile_cont(a.o_totalprice - b.o_totalprice, 0.5) hl from src a join src b on a.o_orderstatus = 'F' and b.o_orderstatus = 'O')
      select cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, {qs(u='u', z='(u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1))))',
      rank_biserial='1 - 2 * u / (n1 * n2)', hodges_lehmann='hl')} from p, u, tt, hl""")
_kr = """with r as (select l_returnflag g, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 r from src),
 gr as (select g, count(*)::double n, avg(r) m from r group by g), nn as (select count(*)::double nn from src),
 t as (select sum(power(c, 3) - c) t from (select count(*)::double c from src group by l_quantity)),
 h as (select (12 / (max(nn) * (max(nn) + 1)) * sum(n * m * m) - 3 * (max(nn) + 1)) / (1 - max(t) / (power(max(nn), 3) - max(nn))) h, count(*) k, max(nn) nn from gr, nn, t)"""
query("kruskal_wallis", "lineitem", lambda d: rounded(B.kruskal_wallis(d, "l_quantity", "l_returnflag"), 4, ["n", "groups", "h", "eta_squared"]),
      _kr + f""" select cast(nn as bigint) as n, k as "groups", {q('h', 'h')}, {q('greatest(0.0, (h - k + 1) / (nn - k))', 'eta_squared')} from h""")
query("dunn_test", "lineitem", lambda d: rounded(B.dunn_test(d, "l_quantity", "l_returnflag"), 4, ["group_a", "group_b", "z"]),
      _kr + f""" select a.g as group_a, b.g as group_b, {q('(a.m - b.m) / sqrt((nn * (nn + 1) / 12 - t / (12 * (nn - 1))) * (1 / a.n + 1 / b.n))', 'z')} from gr a join gr b on a.g < b.g, nn, t""")
query("friedman_test", "fx_likert", lambda d: rounded(B.friedman_test(_lkd(d), "person", _lk), 4, ["n", "conditions", "q", "kendall_w"]),
      f"""with l as (select person, c, v from (select person, q1::double q1, q2::double q2, q3::double q3, q4::double q4, q5::double q5 from src) unpivot (v for c in (q1, q2, q3, q4, q5))),
      r as (select person, c, v, rank() over (partition by person order by v) + (count(*) over (partition by person, v) - 1) / 2.0 r from l),
      s as (select sum(power(sr, 2)) s2 from (select sum(r) sr from r group by c)), t as (select sum(power(c, 3) - c) t from (select count(*)::double c from r group by person, v)),
      n as (select count(*)::double n from src), f as (select (12 / (n * 30) * s2 - 18 * n) / (1 - t / (n * 120)) qv, n from s, t, n)
      select cast(n as bigint) as n, cast(5 as bigint) as conditions, {qs(q='qv', kendall_w='qv / (n * 4)')} from f""")
query("permutation_test", "orders", lambda d: rounded(B.permutation_test(d, "o_totalprice", "o_orderpriority", "o_orderkey", 199)))
query("bootstrap_ci", "orders", lambda d: rounded(B.bootstrap_ci(d, "o_totalprice", "o_orderkey", "mean")))
query("robust_regression", "lineitem", lambda d: rounded(B.robust_regression(d, "l_extendedprice", ["l_quantity"])))
query("quantile_regression", "lineitem", lambda d: rounded(B.quantile_regression(d, "l_extendedprice", ["l_quantity"], [0.5]), 2))

query("bland_altman", "lineitem", lambda d: rounded(B.bland_altman(d, "l_discount", "l_tax"), 6, ["n", "bias", "sd", "loa_low", "loa_high", "share_inside", "slope", "r"]),
      f"""with s as (select l_discount - l_tax d, (l_discount + l_tax) / 2 m from src), a as (select count(*) n, avg(d) b, stddev_samp(d) sd, regr_slope(d, m) sl, corr(d, m) r from s)
      select max(n) as n, {qs(6, bias='max(b)', sd='max(sd)', loa_low='max(b - 1.96 * sd)', loa_high='max(b + 1.96 * sd)', share_inside='avg(case when d between b - 1.96 * sd and b + 1.96 * sd then 1.0 else 0.0 end)', slope='max(sl)', r='max(r)')} from s, a""")
_kp = """with p as (select r1, r2, count(*)::double / (select count(*) from src) p from src group by 1, 2), a as (select r1 c, sum(p) a from p group by 1),
 b as (select r2 c, sum(p) b from p group by 1), m as (select coalesce(a.c, b.c) c, coalesce(a, 0) a, coalesce(b, 0) b from a full join b on a.c = b.c),
 o as (select sum(p) po from p where r1 = r2), e as (select sum(a * b) pe from m), n as (select count(*)::double n from src),
 k as (select po, pe, (po - pe) / (1 - pe) k, n from o, e, n),
 x as (select p.r1, p.r2, p.p, i.a ai, i.b bi, j.a aj, j.b bj from p join m i on p.r1 = i.c join m j on p.r2 = j.c),
 v as (select sum(case when r1 = r2 then p * power(1 - (ai + bi) * (1 - k), 2) else 0 end) + 0 t1, power(max(1 - k), 2) * sum(case when r1 <> r2 then p * power(bi + aj, 2) else 0 end) t2,
   power(max(k - pe * (1 - k)), 2) t3, max(n) n, max(pe) pe from x, k)"""
query("cohens_kappa", "fx_raters", lambda d: rounded(B.cohens_kappa(d, "r1", "r2"), 6, ["n", "observed", "expected", "kappa", "se"]),
      _kp + f" select cast(k.n as bigint) as n, {qs(6, observed='po', expected='k.pe', kappa='k', se='sqrt((t1 + t2 - t3) / (v.n * power(1 - v.pe, 2)))')} from k, v")
query("fleiss_kappa", "fx_raters", lambda d: rounded(B.fleiss_kappa(d, ["r1", "r2", "r3"]).where("category = 'overall'"), 6, ["n", "kappa", "observed", "expected"]),
      f"""with c as (select unnest(['A', 'N', 'R']) c), x as (select id, ln, (r1 = c)::int + (r2 = c)::int + (r3 = c)::int as k, c from src, c),
      a as (select sum(k * k)::double s2, count(*) / 3 n from x), e as (select sum(power(s, 2)) pe from (select sum(k)::double / (3.0 * count(*)) s from x group by c)),
      z as (select n, (s2 - 3.0 * n) / (6.0 * n) pb, pe from a, e)
      select cast(n as bigint) as n, {qs(6, kappa='(pb - pe) / (1 - pe)', observed='pb', expected='pe')} from z""")
query("icc", "fx_likert", lambda d: rounded(B.icc(_lkd(d), _lk), 6, ["n", "icc1", "icc2", "icc3", "icc1k", "icc2k", "icc3k"]),
      f"""with l as (select person, c, v from (select person, q1::double q1, q2::double q2, q3::double q3, q4::double q4, q5::double q5 from src) unpivot (v for c in (q1, q2, q3, q4, q5))),
      s as (select v, avg(v) over (partition by person) mp, avg(v) over (partition by c) mc, avg(v) over () g from l),
      t as (select count(*) / 5 n, sum(power(mp - g, 2)) / (count(*) / 5 - 1) r, sum(power(mc - g, 2)) / 4 c, sum(power(v - mp - mc + g, 2)) / (4 * (count(*) / 5 - 1)) e, sum(power(v - mp, 2)) / (4 * (count(*) / 5)) w from s)
      select cast(n as bigint) as n, {qs(6, icc1='(r - w) / (r + 4 * w)', icc2='(r - e) / (r + 4 * e + 5 * (c - e) / n)', icc3='(r - e) / (r + 4 * e)', icc1k='(r - w) / r', icc2k='(r - e) / (r + (c - e) / n)', icc3k='(r - e) / r')} from t""")
query("cronbach_alpha", "fx_likert", lambda d: rounded(B.cronbach_alpha(_lkd(d), _lk), 6, ["item", "n", "alpha", "item_total_r"]),
      "with v as (select count(*) n, " + ", ".join(f"var_samp({c}) v{c}, var_samp(q1 + q2 + q3 + q4 + q5 - {c}) r{c}, corr({c}, q1 + q2 + q3 + q4 + q5 - {c}) c{c}" for c in _lk)
      + ", var_samp(q1 + q2 + q3 + q4 + q5) t from src), s as (select *, " + " + ".join(f"v{c}" for c in _lk) + " as sv from v) "
      + f"select 'scale' as item, n, {q('5.0 / 4 * (1 - sv / t)', 'alpha', 6)}, cast(null as double) as item_total_r from s union all "
      + " union all ".join(f"select '{c}', n, {q(f'4.0 / 3 * (1 - (sv - v{c}) / r{c})', 'alpha', 6)}, {q(f'c{c}', 'item_total_r', 6)} from s" for c in _lk))
query("mcdonald_omega", "fx_likert", lambda d: rounded(B.mcdonald_omega(_lkd(d), _lk)))
query("efa", "fx_likert", lambda d: rounded(B.efa(_lkd(d), _lk)))
query("factor_analysis", "fx_likert", lambda d: rounded(B.factor_analysis(_lkd(d), _lk)))
_it = ["i1", "i2", "i3", "i4", "i5", "i6"]
query("dif_detection", "fx_items", lambda d: rounded(B.dif_detection(d, _it, "grp"), 4),
      "with l as (select grp = 'r' as ref, i1 + i2 + i3 + i4 + i5 + i6 tot, unnest([" + ", ".join(f"struct_pack(item := '{i}', v := {i})" for i in _it) + "]) s from src), "
      + f"""c as (select s.item, tot - s.v rest, sum((ref and s.v = 1)::int)::double a, sum((ref and s.v <> 1)::int)::double b, sum((not ref and s.v = 1)::int)::double c, sum((not ref and s.v <> 1)::int)::double d from l group by 1, 2),
      n as (select *, a + b + c + d n, a + c m1, b + d m0, a + b n1, c + d n0 from c),
      t as (select item, sum(a * d / n) / nullif(sum(b * c / n), 0) o, power(greatest(abs(sum(a) - sum(n1 * m1 / n)) - 0.5, 0), 2) / nullif(sum(n1 * n0 * m1 * m0 / (n * n * (n - 1))), 0) x from n where n > 1 and n1 > 0 and n0 > 0 group by item)
      select item, {qs(mh_odds_ratio='o', mh_chi2='x', delta_mh='-2.35 * ln(o)')}, case when abs(-2.35 * ln(o)) < 1 then 'A' when abs(-2.35 * ln(o)) < 1.5 then 'B' else 'C' end as ets_class from t""")
query("manova", "lineitem", lambda d: rounded(B.manova(d, ["l_extendedprice", "l_discount"], "l_returnflag").where("statistic in ('wilks', 'pillai')"), 8, ["statistic", "value"]),
      f"""with w as (select sum(regr_syy) a, sum(regr_sxy) b, sum(regr_sxx) c from (select regr_syy(l_extendedprice, l_discount), regr_sxy(l_extendedprice, l_discount), regr_sxx(l_extendedprice, l_discount) from src group by l_returnflag) s(regr_syy, regr_sxy, regr_sxx)),
      t as (select regr_syy(l_extendedprice, l_discount) ta, regr_sxy(l_extendedprice, l_discount) tb, regr_sxx(l_extendedprice, l_discount) tc from src),
      z as (select (a * c - b * b) / (ta * tc - tb * tb) wl, ((ta - a) * tc - 2 * (tb - b) * tb + (tc - c) * ta) / (ta * tc - tb * tb) pl from w, t)
      select 'wilks' as statistic, {q('wl', 'value', 8)} from z union all select 'pillai', {q('pl', 'value', 8)} from z""")
_h2 = "select l_extendedprice, l_discount, l_linestatus from lineitem"
query("hotelling_t2", _h2, lambda d: rounded(B.hotelling_t2(d, ["l_extendedprice", "l_discount"], "l_linestatus"), 6, ["n1", "n2", "t2", "f"]),
      f"""with g as (select l_linestatus s, count(*)::double n, avg(l_extendedprice) m1, avg(l_discount) m2, regr_syy(l_extendedprice, l_discount) a, regr_sxy(l_extendedprice, l_discount) b, regr_sxx(l_extendedprice, l_discount) c from src group by 1),
      p as (select x.n n1, y.n n2, x.m1 - y.m1 d1, x.m2 - y.m2 d2, (x.a + y.a) / (x.n + y.n - 2) a, (x.b + y.b) / (x.n + y.n - 2) b, (x.c + y.c) / (x.n + y.n - 2) c from g x join g y on x.s < y.s),
      t as (select n1, n2, n1 * n2 / (n1 + n2) * (d1 * d1 * c - 2 * d1 * d2 * b + d2 * d2 * a) / (a * c - b * b) t2 from p)
      select cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, {qs(6, t2='t2', f='(n1 + n2 - 3) / (2 * (n1 + n2 - 2)) * t2')} from t""")
query("canonical_correlation", "lineitem", lambda d: rounded(B.canonical_correlation(d, ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax"])))
_id = "select *, l_orderkey * 10 + l_linenumber as id from lineitem"
query("discriminant_analysis", _id, lambda d: rounded(B.discriminant_analysis(d, "l_returnflag", ["l_quantity", "l_discount"], "id")))
query("linear_discriminant", "lineitem", lambda d: rounded(B.linear_discriminant(d, "l_returnflag", ["l_quantity", "l_extendedprice"])))
