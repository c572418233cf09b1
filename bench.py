"""Runs headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from strandline.plans import catalogue

HEADLINE = ["q_kmer_counts", "q_window_base_counts", "q_window_kmer_counts", "q_pool_windows", "q_robust_stat", "q_alien_runs", "q_confusion", "q_boundary_errors", "q_both_agree", "q_auc", "q_kfold", "q_mcd_scores", "q_pipeline_embedding", "q_window_features", "q_fused_windows", "q_pipeline_composition"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        f = catalogue.queries()[name]
        f(spark, d).write.format("noop").mode("overwrite").save()  # compiles
        began = time.time()
        f(spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
