"""Headline-query timings: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is fully materialised through the ``noop`` sink (every row is
computed, nothing is collected); the value is the sum of the per-query wall
times after one warm-up query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from casekit.plans import registry  # noqa: E402
from casekit.session import get_session  # noqa: E402

HEADLINE = [
    "critical_rate_by_borough", "critical_rate_by_location", "critical_rate_by_hour", "top_critical_hours",
    "descriptor_counts", "missing_profile", "column_profile_top10", "describe_numeric", "missing_by_class",
    "resolution_time_describe", "coordinate_stats_by_class", "time_features", "frequency_encoding",
    "label_encoding", "stratified_split", "stratified_kfold", "random_oversample", "class_weights_balanced",
    "impute_median_fit", "standardized_test_rows", "anova_f_scores", "eval_summary", "eval_classification_report",
    "eval_roc_auc", "eval_roc_curve", "eval_stability", "knn_kth_distance", "smote_train", "model_sweep_binary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus),
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    registry.load_all()
    names = only or HEADLINE
    # warm-up: JVM, parquet footers, codegen caches
    registry.QUERIES["cases_shape"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus}))


if __name__ == "__main__":
    main()
