"""The driver's tables and derived fixtures as temp views, and the registry of checked queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# Derived inputs, one SELECT each, valid in Spark and DuckDB.
FX = {
    "fx_panel": """select c_nationkey as unit, year(o_orderdate) as period, case when c_nationkey % 3 = 0 then 0 when c_nationkey % 3 = 1 then 1998 else 1999 end as g, case when c_nationkey % 3 = 1 and year(o_orderdate) >= 1998 then 1 when c_nationkey % 3 = 2 and year(o_orderdate) >= 1999 then 1 else 0 end as treated, avg(o_totalprice) / 1000 + case when c_nationkey % 3 = 1 and year(o_orderdate) >= 1998 then 10 when c_nationkey % 3 = 2 and year(o_orderdate) >= 1999 then 10 else 0 end as y, avg(c_acctbal) / 1000 as x
from orders join customer on o_custkey = c_custkey group by c_nationkey, year(o_orderdate)""",
    "fx_treat": """select o_orderkey as id, case when cast(o_orderkey * 7919 % 1000 as double) / 1000 < 0.3 + case when c_acctbal > 4500 then 0.4 else 0 end then 1 else 0 end as t, c_acctbal / 1000 as x1, cast(o_custkey % 7 as double) as x2, o_totalprice / 1000 + 2 * c_acctbal / 1000 + 5 * case when cast(o_orderkey * 7919 % 1000 as double) / 1000 < 0.3 + case when c_acctbal > 4500 then 0.4 else 0 end then 1 else 0 end as y
from orders join customer on o_custkey = c_custkey""",
    "fx_running": """select c_custkey as id, c_acctbal / 1000 as running, 2 * c_acctbal / 1000 + case when c_acctbal >= 4500 then 3 else 0 end + cast(c_custkey * 37 % 100 as double) / 100 as y
from customer""",
    "fx_surv": """select l_orderkey as id, sum(l_quantity) as duration, case when min(l_returnflag) = 'A' then 1 when min(l_returnflag) = 'R' then 2 else 0 end as status, case when l_orderkey % 2 = 0 then 'a' else 'b' end as grp, avg(l_discount) as x
from lineitem group by l_orderkey""",
    "fx_series": """select o_orderpriority as k, date_trunc('week', o_orderdate) as w, count(*) as n, sum(o_totalprice) / 1000 as v
from orders group by o_orderpriority, date_trunc('week', o_orderdate)""",
    "fx_geo": """select p_partkey as id, cast(p_partkey * 7919 % 1000 as double) / 10 as x, cast(p_partkey * 104729 % 997 as double) / 10 as y, p_retailprice / 100 + cast(p_partkey * 7919 % 1000 as double) / 200 as val, p_size as z
from part""",
    "fx_edges": """select a.l_partkey as src, b.l_partkey as dst, count(*) as wt
from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey group by a.l_partkey, b.l_partkey""",
    "fx_site": """select l_suppkey as site, p_brand as species, count(*) as n
from lineitem join part on l_partkey = p_partkey group by l_suppkey, p_brand""",
    "fx_mortality": """select cast(floor(l_quantity / 5) * 5 as int) as age, sum(case when l_returnflag = 'R' and l_discount < 0.01 + l_quantity / 1000 then 1 else 0 end) as deaths, count(*) * 10 as exposure
from lineitem group by floor(l_quantity / 5)""",
    "fx_studies": """select c_nationkey as study, avg(case when o_orderstatus = 'F' then o_totalprice end) as m1, stddev_samp(case when o_orderstatus = 'F' then o_totalprice end) as sd1, count(case when o_orderstatus = 'F' then 1 end) as n1, avg(case when o_orderstatus = 'O' then o_totalprice end) as m2, stddev_samp(case when o_orderstatus = 'O' then o_totalprice end) as sd2, count(case when o_orderstatus = 'O' then 1 end) as n2
from orders join customer on o_custkey = c_custkey group by c_nationkey""",
    "fx_items": """select o_custkey as person, case when o_custkey % 2 = 0 then 'f' else 'r' end as grp, max(case when year(o_orderdate) = 1995 then 1 else 0 end) as i1, max(case when year(o_orderdate) = 1996 then 1 else 0 end) as i2, max(case when year(o_orderdate) = 1997 then 1 else 0 end) as i3, max(case when year(o_orderdate) = 1998 then 1 else 0 end) as i4, max(case when year(o_orderdate) = 1999 then 1 else 0 end) as i5, max(case when year(o_orderdate) = 2001 then 1 else 0 end) as i6
from orders group by o_custkey""",
    "fx_likert": """select o_custkey as person, least(5, 1 + sum(case when o_orderpriority like '1%' then 1 else 0 end)) as q1, least(5, 1 + sum(case when o_orderpriority like '2%' then 1 else 0 end)) as q2, least(5, 1 + sum(case when o_orderpriority like '3%' then 1 else 0 end)) as q3, least(5, 1 + sum(case when o_orderpriority like '4%' then 1 else 0 end)) as q4, least(5, 1 + sum(case when o_orderpriority like '5%' then 1 else 0 end)) as q5
from orders group by o_custkey""",
    "fx_raters": """select l_orderkey as id, l_linenumber as ln, l_returnflag as r1, case when l_orderkey % 5 = 0 then 'N' else l_returnflag end as r2, case when l_orderkey % 7 = 0 then 'A' else l_returnflag end as r3
from lineitem""",
    "fx_choice": """select l_orderkey as choice_id, l_linenumber as alt, l_extendedprice / 10000 as price, l_quantity / 10 as qty, case when row_number() over (partition by l_orderkey order by l_extendedprice / 10000 + cast(l_partkey * 7919 % 1000 as double) / 100, l_linenumber, l_partkey, l_suppkey) = 1 then 1 else 0 end as chosen
from lineitem""",
    "fx_nulls": """select c_custkey as id, case when c_custkey % 10 = 0 then null else c_acctbal end as a, case when c_custkey % 7 = 0 then null else cast(c_nationkey as double) end as b, c_mktsegment as s
from customer""",
    "fx_cash": """select c_nationkey as project, year(o_orderdate) - 1995 as period, sum(o_totalprice) / 1000000 as benefit, sum(o_totalprice) / 1000000 * case when year(o_orderdate) = 1995 then 3 else 0.2 end as cost, count(*) as output
from orders join customer on o_custkey = c_custkey group by c_nationkey, year(o_orderdate)""",
    "fx_triangle": """select year(o_orderdate) as origin, cast(o_orderkey % 5 as int) as dev, sum(o_totalprice) / 1000 * max(1.0 / (1 + o_orderkey % 5)) as claim
from orders where year(o_orderdate) + o_orderkey % 5 <= 2000 group by year(o_orderdate), o_orderkey % 5""",
    "fx_trade": """select s_nationkey as i, c_nationkey as j, sum(l_extendedprice) / 1000000 as z
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by s_nationkey, c_nationkey""",
    "fx_soil": """select p_partkey as id, cast(10 + p_partkey * 7919 % 50 as double) as sand, cast(10 + p_partkey * 104729 % 40 as double) as silt, cast(5 + p_partkey * 31 % 60 as double) as clay
from part""",
    "fx_snp": """select p_brand as snp, 0.1 + cast(min(p_partkey) * 7919 % 100 as double) / 500 as bx, 0.5 * (0.1 + cast(min(p_partkey) * 7919 % 100 as double) / 500) + (cast(min(p_partkey) * 37 % 11 as double) - 5) / 500 as beta_y, 0.02 + cast(min(p_partkey) % 5 as double) / 200 as sey
from part group by p_brand""",
    "fx_idf": """select p_size as duration, 30 / power(p_size + 10, 0.8) + cast(p_size % 3 as double) / 1000 as intensity
from part group by p_size""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_current: dict[int, str] = {}


def views(spark: SparkSession, sf_dir: str) -> None:
    if _current.get(id(spark)) == sf_dir:
        return
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    _current[id(spark)] = sf_dir


def tab(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A table, a fixture or a SELECT as a DataFrame."""
    views(spark, sf_dir)
    return spark.sql(FX.get(sql, sql)) if " " in FX.get(sql, sql) else spark.table(sql)


def query(name: str, source: str, fn: Callable[[DataFrame], DataFrame], sql: str | None = None,
          extra: dict[str, str] | None = None) -> None:
    """Register one checked query: operator over a source, and the same question as DuckDB SQL.

    In the SQL, `src` is the source table.
    """
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = tab(spark, sf_dir, source)
        more = {k: tab(spark, sf_dir, v) for k, v in (extra or {}).items()}
        return fn(src, **more)

    QUERIES[name] = run
    if sql is not None:
        body = FX.get(source, source)
        ctes = [f"src as ({body if ' ' in body else 'select * from ' + body})"]
        ctes += [f"{k} as ({FX.get(v, v)})" for k, v in (extra or {}).items()]
        sql = sql.strip()
        if sql[:5].lower() == "with ":
            rest = sql[5:].lstrip()
            if rest[:10].lower() == "recursive ":
                ORACLE[name] = f"with recursive {', '.join(ctes)}, {rest[10:]}"
            else:
                ORACLE[name] = f"with {', '.join(ctes)}, {rest}"
        else:
            ORACLE[name] = f"with {', '.join(ctes)} {sql}"


def q(expr: str, name: str, digits: int = 4) -> str:
    """A rounded double in oracle SQL, with minus zero removed."""
    return f"cast(round({expr}, {digits}) as double) + cast(0 as double) as {name}"


def qs(digits: int = 4, **exprs: str) -> str:
    return ", ".join(q(e, n, digits) for n, e in exprs.items())


def rounded(df: DataFrame, digits: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Select columns and round the double ones."""
    from pyspark.sql import functions as F, types as T
    cols = keep or df.columns
    fields = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[
        (F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if isinstance(fields[c], (T.DoubleType, T.FloatType))
        else F.col(c).cast("bigint").alias(c) if isinstance(fields[c], (T.IntegerType, T.ShortType))
        else F.col(c) for c in cols])
