"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from statloom.bindings import load

HEADLINE = ["descriptive_stats", "correlation", "pearson_correlation", "anova_oneway", "kruskal_wallis", "cohens_kappa", "chi_square_test", "diagnostic_test_eval", "weighted_estimation",
            "ols_regression", "panel_fixed_effects", "logistic_regression", "ipw", "callaway_santanna", "kaplan_meier", "competing_risks", "cox_regression", "acf_pacf", "value_at_risk",
            "getis_ord_gi", "soil_texture", "diversity_indices", "word_frequency", "tfidf_keywords", "topsis", "rfm_segmentation", "market_basket", "control_chart", "npv_irr", "profile"]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for q in HEADLINE:
        t = time.time()
        queries[q](spark, sf).write.format("noop").mode("overwrite").save()
        took[q] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
