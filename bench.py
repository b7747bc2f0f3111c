"""Time the registered queries; prints one JSON line.

``BENCH_SF_DIR``, ``BENCH_CPUS`` and ``BENCH_QUERIES`` (comma-separated names)
choose data, threads and queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from fleetpulse.plans import QUERIES  # noqa: E402

HEADLINE = [
    "failure_risk_by_type",
    "failure_labels",
    "zscore_features",
    "dataset_verification",
    "duplicate_rows",
    "integrate_dropna",
    "corrective_left_join",
    "preventive_left_join",
    "workorder_enrichment",
    "lag_features",
    "sequence_windows",
    "sequence_windows_global",
    "describe_numeric",
    "ks_statistic",
    "t_statistic",
    "chi2_paired",
    "chi2_homogeneity",
    "evaluate_all",
    "youden_threshold",
    "weighted_vote",
    "ensemble_mean_alerts",
    "fold_summary",
    "stratified_folds",
    "upsample_minority",
    "random_forest_scores",
    "isolation_forest",
    "dbscan",
    "smote",
    "stream_scored_alerts",
    "stream_sequences",
    "stream_workorders",
    "permutation_importance",
    "sequence_classifier",
    "ocsvm",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first, so that session start-up is not counted.
    QUERIES["failure_risk_by_type"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").split("sf")[-1],
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
