"""Time the headline operators on local cores; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))

# Names in the catalog: the screen, the split, ranking and calibration metrics,
# the bootstrap, the pixel jobs, the composed report and a stream.
HEADLINE = (
    "p3_split_assignment", "j2_prefix_match", "j3_near_duplicate_screen", "j3_near_duplicate_hot_copies", "j9_axis_negatives",
    "a2_build_statistics", "a5_auroc_by_view", "a6_average_precision", "a9_ece", "a13_threshold_at_fpr", "a14_best_threshold",
    "a15_threshold_curve", "a16_view_metrics", "a22_bootstrap_interval", "a27_view_consistency", "a28_single_feature_auroc",
    "w1_balanced_cap", "w2_limit_per_dataset", "f11_canonical_plan", "g1_perceptual_hashes",
    "g14_evaluation_report", "x2_streaming_windowed_counts",
)


def run(spark, query) -> tuple[float, int]:
    """Seconds and rows of a whole evaluation of every output column."""
    start = time.perf_counter()
    rows = query(spark, SF_DIR).toArrow().num_rows
    return time.perf_counter() - start, rows


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from mediasieve.plans import catalog
    from mediasieve.session import build_session

    spark = build_session(f"local[{CPUS}]", 2 * CPUS, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, catalog.QUERIES["a5_auroc_by_view"])             # warm up the JVM
    run(spark, catalog.QUERIES["f4_phash_of_pixels"])           # and the Python workers
    seconds, rows = {}, {}
    for name in HEADLINE:
        seconds[name], rows[name] = run(spark, catalog.QUERIES[name])
        print(f"{name:34s} {seconds[name]:8.2f}s {rows[name]:9d} rows", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": {name: round(value, 3) for name, value in seconds.items()}, "rows": rows,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": CPUS}))


if __name__ == "__main__":
    main()
