"""Time the headline queries; prints one JSON line.

Each query is planned and collected once to warm the session up and then timed, so the
figures are those of a running session, not of JVM start-up and code generation.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import workload  # noqa: E402
from tidewatch.session import build_session  # noqa: E402

HEADLINE = [
    "health_check",
    "health_check_by_batch",
    "health_check_bulk",
    "feature_drift",
    "drift_by_batch",
    "psi_numeric",
    "ks_statistic",
    "tvd_many_categories",
    "metrics_binary_by_batch",
    "metrics_multiclass",
    "roc_auc",
    "roc_auc_continuous",
    "profile_numeric_lineitem",
    "profile_categorical",
    "missing_rate",
    "duplicate_guard",
    "latest_with_report",
    "dashboard",
    "job_state",
    "cascade_delete",
    "stratified_split",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    workload.QUERIES[name](spark, folder).collect()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    workload.load_all()
    seconds = {}
    for name in names:
        run(spark, name, folder)
        seconds[name] = round(run(spark, name, folder), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
