"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from loanlens.catalog import registered  # noqa: E402

HEADLINE = (
    "universe",
    "cohort_summary",
    "rollup_summary",
    "by_balance",
    "by_seller",
    "strats",
    "share_elig",
    "wavg_credit",
    "avg_coupon",
    "age_curve",
    "age_curve_by_vintage",
    "cum_lgd",
    "horizon_cpr",
    "ever_60",
    "sweep_channel",
    "sweep_loansize",
    "sweep_specs",
    "stored_age_curve",
    "legacy_report",
    "legacy_report_b",
    "legacy_age_curve",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loanlens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    available = registered()
    available["max_period"](spark, folder).collect()  # start the JVM's workers and open the files
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        available[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
