"""Stage latencies, model-call cost and activity history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.session import cut_lineage

# Fixed values
INPUT_USD_PER_MILLION = 0.10
OUTPUT_USD_PER_MILLION = 0.40
PAGE_SIZE = 25
MAX_PAGE_SIZE = 100

# Analysis stages in order, and whether a stage calls a model.
STAGES = [
    ("ingestion", False), ("profiling", False), ("semantic contract", False), ("data quality", False),
    ("canonical model", False), ("KPI discovery", False), ("KPI validation", False), ("KPI computation", False),
    ("materiality", False), ("anomaly detection", False), ("driver analysis", False), ("evidence", False),
    ("confidence", False), ("insight generation", False), ("recommendation packaging", False), ("LLM recommendation", True),
]


def cost_usd(prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Estimated cost of a call at the published rates, to the millionth of a dollar."""
    micro = prompt_tokens * F.lit(INPUT_USD_PER_MILLION) + completion_tokens * F.lit(OUTPUT_USD_PER_MILLION)
    return F.rint(micro) / F.lit(1_000_000.0)


def _cost_total(column: Column) -> Column:
    """Costs carry six decimals, so they add exactly as millionths."""
    return F.coalesce(F.sum(F.rint(column * 1_000_000.0).cast("bigint")), F.lit(0)) / F.lit(1_000_000.0)


def stage_latencies(timings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls, average, minimum and maximum latency per stage, slowest first."""
    grouped = timings.groupBy(*by, "stage").agg(
        F.count(F.lit(1)).alias("calls"),
        (F.sum(F.col("latency_ms").cast("bigint")).cast("double") / F.count("latency_ms")).alias("avg_latency_ms"),
        F.min("latency_ms").alias("min_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
    )
    return grouped.orderBy(*by, F.desc("avg_latency_ms"), "stage")


def call_totals(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls, tokens, cost, cached calls, average latency and cache hit rate; zeros for no calls."""
    n, cached = F.count(F.lit(1)), F.count_if("cached")
    latency = F.try_divide(F.sum(F.col("latency_ms").cast("bigint")).cast("double"), F.count("latency_ms"))
    return calls.groupBy(*by).agg(
        n.alias("total_calls"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("total_prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("total_completion_tokens"),
        _cost_total(F.col("cost_usd")).alias("total_cost_usd"),
        F.coalesce(latency, F.lit(0.0)).alias("avg_latency_ms"),
        cached.alias("cached_calls"),
        F.coalesce(F.try_divide(cached, n), F.lit(0.0)).alias("cache_hit_rate"),
    )


def call_ledger(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of calls, total cost and the last call."""
    shown = F.struct(
        "created_at", "call_id", "kpi_id", "prompt_tokens", "completion_tokens", "latency_ms", "cost_usd", "cached"
    )
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        _cost_total(F.col("cost_usd")).alias("cost_usd"),
        F.max_by(shown, F.struct("created_at", "call_id")).alias("last_call"),
    )


def cached_result(calls: DataFrame, by: Sequence[str] = ("user_id", "package_hash")) -> DataFrame:
    """For each user and package the newest live call, whose result may be reused."""
    live = calls.filter(~F.col("cached"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("created_at"), F.desc("call_id")))
    return live.withColumn("_n", place).filter(F.col("_n") == 1).drop("_n")


def stage_summary() -> dict[str, int]:
    """Number of stages, with and without a model call."""
    with_model = sum(used for _, used in STAGES)
    return {"total_stages": len(STAGES), "llm_stages": with_model, "deterministic_stages": len(STAGES) - with_model}


def cumulative_cost(calls: DataFrame, by: Sequence[str] = ("user_id",)) -> DataFrame:
    """Running cost and ordinal of every call in time order, per user, however large one user's share is.

    Calls are cut into time-ordered ranges of about equal size over all users (the cut also splits a single user or
    instant), each range is summed, and the sums of earlier ranges are added to running sums inside ranges. The cut is
    written once, so both uses see the same ranges even if an executor is lost. Range totals number at most users times
    one plus the number of ranges and are themselves joined by key, not collected.
    """
    order = [*by, "created_at", "call_id"]
    steps = F.rint(F.col("cost_usd") * 1_000_000.0).cast("bigint")
    cut = cut_lineage(calls.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).withColumn("_steps", steps))
    inside = Window.partitionBy(*by, "_range").orderBy("created_at", "call_id")
    running = cut.withColumn("_sum", F.sum("_steps").over(inside)).withColumn("_place", F.row_number().over(inside))
    totals = cut.groupBy(*by, "_range").agg(F.sum("_steps").alias("_t"), F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_range", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_skipped"),
    )
    joined = running.join(offsets, [*by, "_range"])
    return joined.select(
        *calls.columns,
        (F.col("_skipped") + F.col("_place")).alias("call_number"),
        ((F.col("_before") + F.col("_sum")) / F.lit(1_000_000.0)).alias("cumulative_cost_usd"),
    )


def history(
    activity: DataFrame, user_id: str, action_type: str | None = None, target_type: str | None = None,
    since=None, until=None,
) -> DataFrame:
    """A user's activity rows within inclusive bounds; every condition reaches the scan."""
    rows = activity.filter(F.col("user_id") == user_id)
    if action_type:
        rows = rows.filter(F.col("action_type") == action_type)
    if target_type:
        rows = rows.filter(F.col("target_type") == target_type)
    if since is not None:
        rows = rows.filter(F.col("created_at") >= since)
    if until is not None:
        rows = rows.filter(F.col("created_at") <= until)
    return rows


def history_page(rows: DataFrame, page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """One page, newest first; page sizes are held to 1..100."""
    size = min(max(1, page_size), MAX_PAGE_SIZE)
    return rows.orderBy(F.desc("created_at"), F.desc("log_id")).offset((max(1, page) - 1) * size).limit(size)
