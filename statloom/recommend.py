"""Which analyses a table can carry: preconditions, rigour, scores, ranking and diverse picks as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .plans.frames import one_row, rows_frame
from .profile import detect_structure, profile

# Id, family, structure it is made for, outcome kind, least rows, least numeric columns, needs a binary
# column, number of disclosed biases.
CATALOG = [
    ("descriptive_stats", "descriptive", "any", "any", 1, 0, False, 0), ("correlation_matrix", "correlation", "any", "continuous", 10, 2, False, 0),
    ("ols_regression", "regression", "cross_section", "continuous", 30, 2, False, 1), ("logistic_regression", "classification", "cross_section", "binary", 50, 1, True, 1),
    ("poisson_regression", "count", "cross_section", "count", 30, 1, False, 1), ("negative_binomial_regression", "count", "cross_section", "count", 30, 1, False, 1),
    ("anova_oneway", "group_comparison", "cross_section", "continuous", 10, 1, False, 1), ("kruskal_wallis", "nonparametric", "cross_section", "continuous", 10, 1, False, 0),
    ("panel_fixed_effects", "panel", "panel", "continuous", 60, 2, False, 1), ("did", "causal", "panel", "continuous", 60, 1, True, 2), ("event_study", "causal", "panel", "continuous", 60, 1, True, 2),
    ("random_effects", "panel", "panel", "continuous", 60, 2, False, 1), ("acf_pacf", "timeseries", "timeseries", "continuous", 30, 1, False, 0),
    ("exponential_smoothing", "forecasting", "timeseries", "continuous", 24, 1, False, 1), ("mann_kendall_trend", "trend", "timeseries", "continuous", 10, 1, False, 0),
    ("structural_breaks", "timeseries", "timeseries", "continuous", 30, 1, False, 1), ("moran_i", "spatial", "geo", "continuous", 20, 1, False, 1), ("gwr", "spatial", "geo", "continuous", 50, 2, False, 2),
    ("kmeans_clustering", "clustering", "any", "continuous", 30, 2, False, 1), ("pca", "dimension", "any", "continuous", 20, 3, False, 0), ("random_forest", "ml", "cross_section", "any", 100, 2, False, 1),
    ("ipw", "causal", "cross_section", "continuous", 100, 2, True, 2), ("cronbach_alpha", "scale", "cross_section", "ordinal", 30, 3, False, 0), ("chi_square_test", "categorical", "any", "categorical", 20, 0, False, 0),
]


def catalog(spark) -> DataFrame:
    return rows_frame(spark, "id string, family string, structure string, outcome string, min_rows bigint, min_numeric bigint, needs_binary boolean, biases bigint", CATALOG)


def data_signals(df: DataFrame) -> DataFrame:
    """Counts by kind and the structure of a table: one row."""
    p = profile(df).collect()
    s = detect_structure(df).collect()[0]
    k = lambda *names: sum(r["kind"] in names for r in p)
    return one_row(df.sparkSession, n_rows=int(p[0]["n_rows"]), n_continuous=k("continuous"), n_count=k("count"), n_binary=k("binary"), n_categorical=k("categorical"), n_ordinal=sum(r["ordinal_like"] for r in p),
                   is_structure=s["structure"], is_geo=bool(s["geo"]))


def check_preconditions(df: DataFrame) -> DataFrame:
    """Every catalogue entry with its unmet conditions."""
    s = F.broadcast(data_signals(df))                         # one row
    t = catalog(df.sparkSession).crossJoin(s)
    unmet = F.array_compact(F.array(
        F.when(F.col("n_rows") < F.col("min_rows"), "rows"), F.when(F.col("n_continuous") + F.col("n_count") < F.col("min_numeric"), "numeric columns"),
        F.when(F.col("needs_binary") & (F.col("n_binary") == 0), "binary column"), F.when((F.col("structure") == "panel") & (F.col("is_structure") != "panel"), "panel"),
        F.when((F.col("structure") == "timeseries") & (F.col("is_structure") != "timeseries"), "time series"), F.when((F.col("structure") == "geo") & ~F.col("is_geo"), "coordinates"),
        F.when((F.col("outcome") == "count") & (F.col("n_count") == 0), "count outcome"), F.when((F.col("outcome") == "ordinal") & (F.col("n_ordinal") < 3), "scale items"),
        F.when((F.col("outcome") == "categorical") & (F.col("n_categorical") + F.col("n_binary") == 0), "categorical column")))
    return t.withColumn("unmet", unmet)


def recommend(df: DataFrame) -> DataFrame:
    """Entries ordered by light, fit and rigour."""
    t = check_preconditions(df)
    nu = F.size("unmet")
    border = F.col("n_rows") < 1.5 * F.col("min_rows")
    rigor = F.when(nu > 0, F.greatest(60 - 10 * nu, F.lit(0))).otherwise(100 - 8 * F.col("biases") - F.when(border, 10).otherwise(0))
    light = F.when(nu > 0, "red").when((F.col("biases") == 0) & ~border, "green").otherwise("yellow")
    st = F.when(F.col("structure") == "any", 0).when((F.col("structure") == F.col("is_structure")) | ((F.col("structure") == "geo") & F.col("is_geo")), F.when(F.col("structure") == "cross_section", 5).otherwise(25)).otherwise(
        F.when(F.col("structure") == "cross_section", -8).otherwise(-22))
    oc = F.when(F.col("outcome") == "any", 0).when(((F.col("outcome") == "continuous") & (F.col("n_continuous") > 0)) | ((F.col("outcome") == "count") & (F.col("n_count") > 0)) | ((F.col("outcome") == "binary") & (F.col("n_binary") > 0))
                                                   | ((F.col("outcome") == "ordinal") & (F.col("n_ordinal") >= 3)) | ((F.col("outcome") == "categorical") & (F.col("n_categorical") > 0)), 12).otherwise(-12)
    fit = F.least(F.greatest(50 + st + oc + F.when(F.col("n_continuous") >= 4, 8).otherwise(0) - F.when(F.col("n_rows") < 30, 12).otherwise(0), F.lit(0)), F.lit(100))
    r = t.select("id", "family", light.alias("light"), fit.cast("bigint").alias("fit"), rigor.cast("bigint").alias("rigor"), F.array_join("unmet", ", ").alias("unmet"))
    order = F.when(F.col("light") == "green", 0).when(F.col("light") == "yellow", 1).otherwise(2)
    return r.orderBy(order, F.col("fit").desc(), F.col("rigor").desc(), "id")


def select_top(df: DataFrame, k: int = 6) -> DataFrame:
    """Best feasible entries, at most one per family first, then the rest by rank."""
    o = [F.when(F.col("light") == "green", 0).when(F.col("light") == "yellow", 1).otherwise(2), F.col("fit").desc(), F.col("rigor").desc(), F.col("id")]
    r = recommend(df).where("light <> 'red'").withColumn("turn", F.row_number().over(Window.partitionBy("family").orderBy(*o)))
    return r.orderBy(F.least("turn", F.lit(2)), *o).limit(k).drop("turn")


def study(df: DataFrame, k: int = 6) -> dict[str, DataFrame]:
    """Profile, issues, cleaned table with its log, and the recommended analyses of the cleaned table."""
    from .profile import clean, quality_issues
    issues = quality_issues(df)
    cleaned, log = clean(df)
    return {"profile": profile(df), "issues": issues, "cleaned": cleaned, "log": log, "recommended": select_top(cleaned, k)}
