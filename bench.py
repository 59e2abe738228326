"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "cdr_stat", "cdr_problems", "cdr_summary", "minute_expand", "chart_minute", "concurrency_min_max_avg", "perc95_nearest_rank", "category_area", "filter_number_list", "longest_prefix_match",
    "range_join_geoip", "best_weight_match", "left_join_children", "dedup_prefer_rtp", "running_concurrency", "state_segments", "moving_avg_30", "jitter_rfc3550", "fraud_packet_window", "fraud_concurrent_calls",
    "rate_call", "rate_call_peak", "billing_rollup", "rtp_stat_10s", "traffic_in_out", "rrd_rollup", "mos_g711", "chart_seconds",
]


def main() -> None:
    from tallyline.plans import catalog
    from tallyline.session import spark_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = spark_session("bench", cpus=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    took: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(3):  # the first one also compiles
            began = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
