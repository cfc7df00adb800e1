"""Semantic profile of a table, data-quality issues, cleaning by a logged plan, structure and roles."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from .plans.frames import collect_bounded, fetch, need, num, numeric_columns, refuse, rows_frame, text_columns
from .plans.order import group_quantiles, quantiles

# Column-name words.
GEO = {"lat", "lon", "lng", "latitude", "longitude", "long", "纬度", "经度"}
CLASS_WORDS = {"class", "label", "category", "target", "species", "cluster", "segment", "variety", "genre", "类别", "类型", "分类", "组别"}
TIME_WORDS = {"year", "date", "time", "month", "day", "week", "quarter", "period", "ts", "timestamp", "年份", "年", "日期", "时间", "月份"}
OUTCOME_WORDS = {"y", "outcome", "target", "response", "yield", "churn", "sales", "price", "income", "disease", "label", "产量", "结果", "销售额"}
TREATMENT_WORDS = {"treat", "treated", "treatment", "exposed", "exposure", "intervention", "policy", "arm", "smoking", "处理", "干预"}
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/M/d", "yyyy-M-d", "yyyy.M.d", "M/d/yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss")


def name_tokens(name: str) -> list[str]:
    parts = re.split(r"[^0-9A-Za-z一-鿿]+", re.sub(r"([a-z])([A-Z])", r"\1_\2", name))
    return [p.lower() for p in parts if p]


def parsed_date(c):
    """First format that parses, else null; only text shaped like a date is tried."""
    shaped = c.rlike(r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|^\d{8}$")
    return F.when(shaped, F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: kind, dtype, n_missing, n_unique, ordinal_like, from one aggregate of all columns."""
    nums, texts = set(numeric_columns(df)), set(text_columns(df))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema.fields):
        c = num(f.name) if f.name in nums else F.col(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            aggs += [F.count(c).alias(f"c{i}")]
            continue
        aggs += [F.count(c).alias(f"c{i}"), F.count_distinct(c).alias(f"u{i}")]
        if f.name in nums:
            aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.sum(F.when(c != F.floor(c), 1).otherwise(0)).alias(f"w{i}")]
        elif f.name in texts:
            t = F.trim(c)
            aggs += [F.avg(F.when(t.rlike(r"\d"), 1.0).when(c.isNotNull(), 0.0)).alias(f"dg{i}"), F.avg(F.when(c.isNotNull(), F.when(parsed_date(t).isNotNull(), 1.0).otherwise(0.0))).alias(f"dt{i}")]
    r = df.agg(*aggs).collect()[0]
    n = r["n"]
    rows = []
    for i, f in enumerate(df.schema.fields):
        cnt = r[f"c{i}"]
        u = r[f"u{i}"] if f"u{i}" in r else None
        kind, ordinal = "unknown", False
        toks = set(name_tokens(f.name))
        if cnt == 0 or u is None:
            kind = "unknown"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kind = "datetime"
        elif isinstance(f.dataType, T.BooleanType):
            kind = "binary"
        elif f.name in nums:
            lo, hi, whole = r[f"lo{i}"], r[f"hi{i}"], r[f"w{i}"] == 0
            fl = isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))
            if u == 2 and lo == 0 and hi == 1:
                kind = "binary"
            elif f.name.lower() in GEO:
                kind = "geo"
            elif whole and u == cnt:
                kind = "id"
            elif whole and u == 2:
                kind = "binary"
            elif whole and toks & CLASS_WORDS and 3 <= u <= 10:
                kind = "categorical"
            elif whole and lo >= 0:
                kind = "continuous" if u > 15 and (fl or hi >= 1000) else "count"
            else:
                kind = "continuous"
            ordinal = bool(whole and 3 <= u <= 7 and lo >= 1 and hi - lo == u - 1)
        elif f.name in texts:
            if r[f"dg{i}"] > 0.5 and r[f"dt{i}"] > 0.9:
                kind = "datetime"
            else:
                kind = "id" if u == cnt else "binary" if u == 2 else "categorical"
        rows.append((f.name, kind, f.dataType.simpleString(), n - cnt, u, ordinal, n))
    return rows_frame(df.sparkSession, "column string, kind string, dtype string, n_missing bigint, n_unique bigint, ordinal_like boolean, n_rows bigint", rows)


def find_time_col(prof: list) -> str | None:
    """First datetime column, else an exact time name, else a whole-number column with a time word."""
    for r in prof:
        if r["kind"] == "datetime":
            return r["column"]
    for r in prof:
        if r["column"].lower() in TIME_WORDS:
            return r["column"]
    for r in prof:
        if set(name_tokens(r["column"])) & TIME_WORDS and r["kind"] in ("count", "continuous") and (r["n_unique"] or 0) < r["n_rows"]:
            return r["column"]
    return None


def detect_structure(df: DataFrame) -> DataFrame:
    """Panel (unit, time), time series or cross-section, geo flag, and treatment candidates: one row."""
    prof = profile(df).collect()
    n = prof[0]["n_rows"]
    t = find_time_col(prof)
    unit = None
    if t is not None:
        for r in prof:
            c = r["column"]
            if c == t or r["kind"] not in ("categorical", "count", "id", "binary") or not r["n_unique"]:
                continue
            if (n - r["n_missing"]) < 0.5 * n or (n - r["n_missing"]) < 2 * r["n_unique"]:
                continue
            if df.where(F.col(c).isNotNull() & F.col(t).isNotNull()).groupBy(c, t).count().where("count > 1").limit(1).count() == 0:
                unit = c
                break
    tu = next((r["n_unique"] for r in prof if r["column"] == t), None)
    series = t is not None and unit is None and tu and n / tu <= 1.5
    geo = any(r["kind"] == "geo" for r in prof)
    tr = ",".join(r["column"] for r in prof if r["kind"] == "binary")
    kind = "panel" if unit else "timeseries" if series else "cross_section"
    return rows_frame(df.sparkSession, "structure string, unit_col string, time_col string, geo boolean, treatment_candidates string, n_rows bigint, n_cols bigint", [(kind, unit, t, geo, tr, n, len(prof))])


def detect_roles(df: DataFrame) -> DataFrame:
    """Outcome, treatment and time candidates by column names, with confidence; all rows back the R-squared evidence."""
    from .plans.gram import gram, r2_of
    prof = profile(df).collect()
    rows = []
    for r in prof:
        toks = set(name_tokens(r["column"]))
        if toks & TREATMENT_WORDS and r["kind"] in ("binary", "categorical"):
            rows.append((r["column"], "treatment", "high"))
        elif toks & OUTCOME_WORDS:
            rows.append((r["column"], "outcome", "high" if r["column"].lower() in OUTCOME_WORDS else "medium"))
        elif r["kind"] == "datetime" or toks & TIME_WORDS:
            rows.append((r["column"], "time", "high" if r["kind"] == "datetime" else "medium"))
    if not any(x[1] == "outcome" for x in rows):
        nums = [r["column"] for r in prof if r["kind"] in ("continuous", "count") and r["column"] not in {x[0] for x in rows}]
        if len(nums) >= 3 and prof[0]["n_rows"] >= 20:
            d = df.select(*[num(c).alias(c) for c in nums]).dropna()
            g = gram(d, nums)
            if g.n >= 20:
                r2 = {c: r2_of(g, c, [x for x in nums if x != c]) for c in nums if g.cross[nums.index(c), nums.index(c)] > 0}
                best = max(r2, key=r2.get) if r2 else None
                if best and r2[best] >= 0.10:
                    rows.append((best, "outcome", "medium"))
    return rows_frame(df.sparkSession, "column string, role string, confidence string", rows)


def resolve_outcome(df: DataFrame, candidates: Sequence[str], outcome: str | None = None) -> str:
    """The dependent variable of a model: the one asked for, else a sure outcome by name, else the first candidate that
    is not named like a treatment (unless it is the likely outcome), else the first. Unsure hints bind nothing."""
    refuse(not candidates, "no candidate column")
    if outcome in candidates:
        return outcome
    roles = [r for r in detect_roles(df.select(*candidates)).collect() if r["role"] == "outcome"]
    sure = [r["column"] for r in roles if r["confidence"] == "high"]
    if sure:
        return sure[0]
    likely = {r["column"] for r in roles}
    free = [c for c in candidates if c in likely or not set(name_tokens(c)) & TREATMENT_WORDS]
    return free[0] if free else candidates[0]


def resolve_predictors(df: DataFrame, outcome: str, predictors: Sequence[str] = (), unit: str | None = None, time: str | None = None, kinds: Sequence[str] = ("continuous", "count", "binary"), cap: int = 5) -> list[str]:
    """Predictors of a model: those asked for that exist, else the first `cap` columns of the given kinds, in table order."""
    asked = [c for c in predictors if c in df.columns and c != outcome]
    if asked:
        return asked[:cap]
    return [r["column"] for r in profile(df).collect() if r["kind"] in kinds and r["column"] not in (outcome, unit, time)][:cap]


def pick_did_treatment(df: DataFrame, unit: str, candidates: Sequence[str]) -> DataFrame:
    """For each candidate the share of units in which it changes, and whether it is the one picked: the largest share, the
    first on ties, none if nothing changes. A flag that is fixed within units is no difference-in-differences treatment."""
    need(df, unit, *candidates)
    # One pass: a candidate changes in a unit when its least and greatest values differ there.
    per = df.groupBy(unit).agg(*[(F.min(c) != F.max(c)).alias(f"v{i}") for i, c in enumerate(candidates)])
    row = per.agg(*[F.avg(F.when(F.col(f"v{i}"), 1.0).otherwise(0.0)).alias(f"v{i}") for i in range(len(candidates))]).collect()[0]
    share = [row[i] or 0.0 for i in range(len(candidates))]
    best = max(range(len(candidates)), key=lambda i: (share[i], -i), default=None)
    return rows_frame(df.sparkSession, "column string, share_varying double, picked boolean", [(c, share[i], share[i] > 0 and i == best) for i, c in enumerate(candidates)])


def _severity(ratio: float) -> str:
    return "high" if ratio >= 0.20 else "medium" if ratio >= 0.05 else "low"


def quality_issues(df: DataFrame) -> DataFrame:
    """Duplicates, missing values, constants, high cardinality, rare levels and outliers."""
    prof = profile(df).collect()
    n = prof[0]["n_rows"]
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType,))]
    rows = []
    dup = n - df.select(*flat).distinct().count()
    if dup:
        rows.append(("duplicate_rows", _severity(dup / n), None, dup))
    texts = set(text_columns(df))
    for r in prof:
        c, u = r["column"], r["n_unique"]
        if r["n_missing"]:
            rows.append(("missing", _severity(r["n_missing"] / n), c, r["n_missing"]))
        if u is not None and u <= 1:
            rows.append(("constant", "medium", c, n))
        if c in texts and u and u > max(50, n / 2):
            rows.append(("high_cardinality", "low", c, u))
    few = [r["column"] for r in prof if r["column"] in texts and r["n_unique"] and r["n_unique"] >= 6]
    if few:
        cut = max(2, round(0.01 * n))
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in few])).alias("s")).select("s.*").dropna()
        rare = long.groupBy("column", "v").count().where(F.col("count") < cut).groupBy("column").count().where("count >= 2")
        rows += [("rare_categories", "low", r["column"], r["count"]) for r in rare.collect()]
    for r in prof:
        if r["kind"] in ("continuous", "count") and n - r["n_missing"] >= 8:
            c = r["column"]
            q1, q3 = quantiles(df, c, [0.25, 0.75])
            iqr = q3 - q1
            if iqr > 0:
                k = fetch(df, k=F.sum(F.when((num(c) < q1 - 1.5 * iqr) | (num(c) > q3 + 1.5 * iqr), 1).otherwise(0)))["k"] or 0
                if k:
                    rows.append(("outliers", _severity(k / n), c, k))
    return rows_frame(df.sparkSession, "kind string, severity string, column string, count bigint", rows)


def clean_plan(df: DataFrame, issues: list | None = None) -> list[tuple[str, str | None]]:
    """Issues to steps: above half missing drops the column, numeric kinds take the median, others the mode."""
    prof = {r["column"]: r for r in profile(df).collect()}
    out = []
    for i in issues if issues is not None else quality_issues(df).collect():
        k, c = i["kind"], i["column"]
        if k == "duplicate_rows":
            out.append(("drop_duplicates", None))
        elif k == "constant":
            out.append(("drop_column", c))
        elif k == "missing":
            r = prof[c]
            out.append(("drop_column", c) if r["n_missing"] > 0.5 * r["n_rows"] else ("impute_median", c) if r["kind"] in ("continuous", "count", "geo") else ("impute_mode", c))
        elif k == "rare_categories":
            out.append(("collapse_rare", c))
        elif k in ("outliers", "high_cardinality"):
            out.append((f"flag_{k}", c))
    return list(dict.fromkeys(out))


def apply_plan(df: DataFrame, plan: Sequence[tuple[str, str | None]]) -> tuple[DataFrame, DataFrame]:
    """Cleaned table and the log of what each step did."""
    log = []
    d = df
    gone = {c for s, c in plan if s == "drop_column"}
    for step, c in plan:
        if c in gone and step != "drop_column":
            continue
        note = "data unchanged"
        if step == "drop_duplicates":
            d, note = d.dropDuplicates(), "first copy kept"
        elif step == "drop_column":
            d, note = d.drop(c), "column removed"
        elif step == "impute_median":
            m = quantiles(d, c, [0.5])[0]
            d, note = d.withColumn(c, F.coalesce(num(c), F.lit(m))), f"median {m}"
        elif step == "impute_mode":
            r = d.where(F.col(c).isNotNull()).groupBy(c).count().agg(F.min(F.struct((-F.col("count")).alias("k"), F.col(c).alias("v"))).alias("s")).collect()[0]["s"]
            d, note = d.withColumn(c, F.coalesce(F.col(c), F.lit(r["v"]).cast(df.schema[c].dataType))), f"mode {r['v']}"
        elif step == "collapse_rare":
            cut = max(2, round(0.01 * d.count()))
            levels = d.where(F.col(c).isNotNull()).groupBy(c).count()
            if levels.where(F.col("count") < cut).count() < 2:
                log.append((step, c, "fewer than two rare levels"))
                continue
            keep = levels.where(F.col("count") >= cut).select(F.col(c).alias("__k"))
            d = d.join(keep, F.col(c) == F.col("__k"), "left").withColumn(c, F.when(F.col(c).isNull(), None).when(F.col("__k").isNull(), "Other").otherwise(F.col(c))).drop("__k")
            note = f"levels below {cut} rows became Other"
        log.append((step, c, note))
    return d, rows_frame(df.sparkSession, "step string, column string, note string", log)


def clean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return apply_plan(df, clean_plan(df))


def diagnostics(df: DataFrame, outcome: str, predictors: Sequence[str] = ()) -> DataFrame:
    """Value diagnostics of an outcome: skew, kurtosis, dispersion, zeros, heteroskedasticity, collinearity, size."""
    from .functions import dist
    from .operators.describe import heteroskedasticity_test, vif_multicollinearity
    y = num(outcome)
    s = fetch(df, n=F.count(y), m=F.avg(y), v=F.var_samp(y), z=F.avg(F.when(y == 0, 1.0).when(y.isNotNull(), 0.0)), lo=F.min(y), w=F.sum(F.when(y != F.floor(y), 1).otherwise(0)))
    n, m, v = s["n"], s["m"], s["v"]
    refuse(not n or n < 4, "four values are needed")
    c = y - F.lit(m)
    p = fetch(df, m2=F.avg(c ** 2), m3=F.avg(c ** 3), m4=F.avg(c ** 4))
    rows = []

    def add(name, value, fired):
        rows.append((name, float(value), bool(fired)))

    if p["m2"]:
        import math
        g1, g2 = p["m3"] / p["m2"] ** 1.5, p["m4"] / p["m2"] ** 2 - 3
        sk, ku = math.sqrt(n * (n - 1)) / (n - 2) * g1, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
        add("skewness", sk, abs(sk) > 1)
        add("excess_kurtosis", ku, abs(ku) > 2)
        if s["w"] == 0 and s["lo"] >= 0 and m > 0:
            phi = v / m
            add("overdispersion", phi, phi > 1.5 and dist.chi2_sf(phi * (n - 1), n - 1) < 0.05)
            add("zero_inflation", s["z"], s["z"] >= 0.10 and s["z"] > 1.2 * math.exp(-m))
    add("small_sample", n, n < 30)
    xs = list(predictors)
    if xs:
        bp = [r for r in heteroskedasticity_test(df, outcome, xs).collect() if r["test"] == "breusch_pagan"][0]
        add("heteroskedasticity", bp["lm"], bp["lm_p"] < 0.05)
    if len(xs) > 1:
        vf = max(r["vif"] for r in vif_multicollinearity(df, xs).collect())
        add("multicollinearity", vf, vf > 10)
    return rows_frame(df.sparkSession, "diagnostic string, value double, fired boolean", rows)
