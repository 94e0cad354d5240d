"""Headline timings: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from winnow.session import local_session

HEADLINE = (
    "slice_corrected_d10", "prj7_stride_thin", "bin2_joint_range_classes", "j1_window_members",
    "j3_nearest_scan",
    "a2_weighted_quantile", "a4_nearest_rank_quantile",
    "a11_population_summary", "a29_ks_distance", "a31_calibration_table", "w1_rolling_counts",
    "w8_ewma", "w13_tune_threshold", "e5_trend_fit", "e7_ipw_estimate", "e11_mixture_hybrid",
    "e15_estimate_timeline", "d8_threshold_grid", "m3_drift_state", "l1_chain_verification",
    "l3_row_digest", "g1_circle_fit", "g3_scan_summary",
)


def main() -> None:
    from winnow.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    names = sys.argv[1:] or HEADLINE
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    QUERIES["prj1_accepted_filter"](spark, sf_dir).collect()  # starts workers and code paths
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "lineitem_rows": rows,
        "rows_per_sec": {n: round(rows / t) for n, t in times.items()}}))
    spark.stop()


if __name__ == "__main__":
    main()
