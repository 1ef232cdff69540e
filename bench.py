"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local threads.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kpiloom.operators import drivers, kpi  # noqa: E402
from kpiloom.session import build_session  # noqa: E402
from workload import all_queries  # noqa: E402
from workload.drivers import LINEITEM_DIMENSIONS, REVENUE  # noqa: E402
from workload.kpis import LINEITEM_KPIS  # noqa: E402

HEADLINE = [
    "kpi_trend_daily", "kpi_trend_weekly_by_slice", "kpi_summary", "kpi_materiality", "kpi_validation", "kpi_bootstrap_interval",
    "waterfall", "waterfall_many_slices", "top_slices", "ratio_decomposition", "diff_in_diff_groups",
    "control_limits", "mad_outliers", "anomaly_corroboration", "change_points",
    "profile_orders", "profile_lineitem", "quality_issues", "quality_score", "duplicate_rows", "exact_quantiles",
    "downsample_weekly", "upsample_weekly", "left_join_chain", "reconcile_mixed_cadence",
    "confidence_levels", "insights", "recommendation_packages", "feedback_multipliers", "call_totals", "cumulative_cost",
    "latest_wins", "cascade_delete", "orphans", "table_checks",
]


def ten_times_lineitem(spark, folder):
    """Lineitem repeated ten times: 6M rows at scale factor 0.1."""
    copies = F.explode(F.sequence(F.lit(1), F.lit(10)))
    return spark.read.parquet(f"{folder}/lineitem.parquet").withColumn("copy", copies)


def large_trend(spark, folder):
    return kpi.kpi_trend(ten_times_lineitem(spark, folder), LINEITEM_KPIS, "l_shipdate")


def large_waterfall(spark, folder):
    rows = ten_times_lineitem(spark, folder)
    movements = drivers.latest_movements(kpi.kpi_trend(rows, REVENUE, "l_shipdate", "month"), REVENUE)
    return drivers.decompose(rows, movements, LINEITEM_DIMENSIONS, "l_shipdate", "month")


LARGE = {"kpi_trend_daily_10x": large_trend, "waterfall_many_slices_10x": large_waterfall}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start threads and codegen
    seconds: dict[str, float] = {}
    runs = {**{name: queries[name].run for name in HEADLINE}, **LARGE}
    for name, run in runs.items():
        start = time.perf_counter()
        run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
