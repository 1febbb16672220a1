"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from ratelens.queries import all_queries

HEADLINE = (
    "a01_nearest_rank", "a02_scout_metrics", "a05_pool_scores", "a07_check_cadence", "w02_score_risk", "w05_scout_grid",
    "w07_shots_from_cuts", "w08_interval_overlaps", "w09_largest_gap", "w11_coverage_top1", "q01_predict_size",
    "q03_select_candidate", "q04_threshold_bitrate", "q10_pareto", "q11_allocate_budget", "q17_final_gate",
    "j01_reuse_hits", "j02_early_reject", "j06_disambiguate_outputs", "r01_space_savings", "r02_queue_metrics",
    "r05_evaluation_summary", "r06_evaluation_by_family", "s02_media_from_probe", "s05_phase_seconds", "t01_item_state_batch",
    "w10_guard_alignment", "w12_max_disjoint_count", "s10_receipt_store",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ratelens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ratelens-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start executors
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
