"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR: one JSON line with seconds for each."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from runlens import catalog_queries  # noqa: E402

HEADLINE = ("global_extrema_events", "window_extrema_events", "threshold_crossing_debounce", "violation_gaps", "state_transitions_orders", "local_extrema_events", "resample_linear", "sync_groups", "movmean_events", "event_windows", "preview_rank", "reconstruction_error", "req_bound_upper", "req_bound_cases", "req_assert", "req_duration", "batch_stats", "global_extrema_lineitem", "window_extrema_lineitem_week", "req_bound_discrete")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", cpus).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog_queries.queries(), {}
    queries[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
