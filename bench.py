"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of test tables, BENCH_CPUS the local cores. The
engine's source tables are written before the clock starts, as production finds
them stored. So are the analysis tables that the audit and impact queries start
from; their own cost is that of the analysis queries.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tierflow.plans import registered

HEADLINE = (
    "forecast_window",
    "unit_price_avg",
    "instock_by_item",
    "soq_first_weeks",
    "linehaul",
    "universe_material",
    "universe_usn",
    "shipment_percentile",
    "tier_percentile",
    "classify",
    "analysis_material",
    "analysis_usn",
    "diff_uploads",
    "diff_summary",
    "latest_state",
    "apply_summary",
    "not_updated",
    "exec_summary",
    "shift_matrix",
    "pivot_dc",
)


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tierflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    for which in ("before", "after", "usn"):
        registered.analysis_of(spark, sf_dir, which)
    registered.base_of(spark, sf_dir, "after")
    registered.cohort_of(spark, sf_dir)
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
