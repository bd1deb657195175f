"""Time the headline queries on one machine; prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the cores.  Each query is built and
run twice into a no-op sink that reads every column; the better time counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from nightledger import plans

HEADLINE = [
    "select_hfr_outliers", "select_by_sql_text", "frame_metrics", "diagnostics_documents", "overlay_stars", "streak_fragments", "background_dips", "sequence_group", "deep_page", "presets_combined", "search_ranges", "search_cone", "metric_summary", "query_facets",
    "targets_rollup", "targets_by_filter", "sessions_rollup", "target_night_filters", "object_position", "catalog_counts",
    "user_target_matches", "user_targets_rollup", "calibration_setups", "frame_sessions", "session_medians", "screen_sessions",
    "listing_changes", "header_fields", "header_plate_solution", "sorted_page", "reference_max_fov", "shape_metrics", "trail_scores",
    "empty_patches", "compare_runs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("nightledger-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the executor threads
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
