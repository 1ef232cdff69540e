"""KPI discovery, trends, validation and summaries: all KPIs of a table from one scan."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.dates import period_of, to_time
from kpiloom.functions.exact import exact_sum, is_numeric, small_mean, without_nan
from kpiloom.functions.series import bootstrap_interval
from kpiloom.model import MIN_PERIODS, Kpi

BASELINE_WINDOW = 7
ZERO_DENOMINATOR = 1e-12
#: Code points of a text that an error shows.
SHOWN = 80


# --- discovery -------------------------------------------------------------------------------------------------------


def candidate_name(measure: Column, aggregation: Column, slices: Column) -> Column:
    by = F.when(F.size(slices) > 0, F.concat(F.lit(" by "), F.array_join(slices, " & "))).otherwise("")
    return F.concat(aggregation, F.lit("("), measure, F.lit(")"), by)


def discover_kpis(contracts: DataFrame, columns: Sequence[str], time_column: str | None, order_by: str = "source_id") -> DataFrame:
    """Candidate KPIs of a table from its contracts: present columns only, the first of equal candidates wins."""
    present = F.array(*[F.lit(c) for c in columns if c != time_column]).cast("array<string>")
    rows = contracts.select(
        F.col(order_by).alias("_contract"), F.posexplode("kpi_definitions").alias("_place", "k")
    ).select(
        "_contract", "_place", F.col("k.column").alias("measure"),
        F.coalesce("k.aggregation", F.lit("sum")).alias("aggregation"),
        F.filter(
            F.coalesce("k.sliceable_by", F.array().cast("array<string>")), lambda s: F.array_contains(present, s)
        ).alias("slice_columns"),
    ).filter(F.array_contains(present, F.col("measure")))
    same = Window.partitionBy("measure", "aggregation", F.array_sort("slice_columns")).orderBy("_contract", "_place")
    first = rows.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") == 1)
    return first.select(
        candidate_name(F.col("measure"), F.col("aggregation"), F.col("slice_columns")).alias("name"),
        "measure", "aggregation", "slice_columns", F.lit(time_column).cast("string").alias("time_column"),
    )


def as_kpis(discovered: DataFrame, dataset_id: str = "") -> list[Kpi]:
    """Definitions as objects. The rows are metadata: at most a few per column of the table."""
    rows = discovered.select("measure", "aggregation", "slice_columns").collect()
    return [Kpi(r.measure, r.aggregation, tuple(r.slice_columns), dataset_id) for r in rows]


# --- trend -----------------------------------------------------------------------------------------------------------


def _can_be_number(data_type: T.DataType) -> bool:
    return is_numeric(data_type) or isinstance(data_type, T.StringType)


def _read_as_number(kpi: Kpi, types: dict[str, T.DataType]) -> bool:
    """Whether the KPI needs the numbers that a text column holds."""
    return kpi.aggregation != "count" and isinstance(types[kpi.measure], T.StringType)


def period_statistics(
    df: DataFrame, kpis: Sequence[Kpi], time_column: str | None, grain: str = "day",
    by: Sequence[str] = (), date_format: str | None = None,
) -> DataFrame:
    """One row per (KPI, period, extra keys): value, non-null values, largest absolute value and error.

    Rows whose time is missing stay as a null period, for validation over the whole table. Every measure is summed and
    counted once however many KPIs use it, then the few result rows are unpivoted. A text measure is read as numbers. What
    cannot be computed, a text that is no number, a decimal total beyond its type or a total that is not finite, is told in
    ``error``; its value is null and all other KPIs go on.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    usable = [k for k in kpis if k.measure in types and (k.aggregation == "count" or _can_be_number(types[k.measure]))]
    measures = {(k.measure, k.scale, _read_as_number(k, types)): i for i, k in enumerate(usable)}
    if time_column is None:
        period = F.lit(None).cast("date")
    else:
        period = period_of(to_time(F.col(time_column), types[time_column], date_format), grain)
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for (c, scale, read), i in measures.items():
        stored, data_type = F.col(f"`{c}`"), T.DoubleType() if read else types[c]
        cell = without_nan(stored.try_cast("double") if read else stored, data_type)
        aggregates.append(F.count(stored if read else cell).alias(f"n{i}"))
        if read:
            no_number = stored.isNotNull() & stored.try_cast("double").isNull()
            aggregates += [F.count(cell).alias(f"m{i}"), F.min(F.when(no_number, F.substring(stored, 1, SHOWN))).alias(f"t{i}")]
        if is_numeric(data_type):
            decimal = isinstance(data_type, T.DecimalType)
            aggregates.append((F.try_sum(cell).cast("double") if decimal else exact_sum(cell, data_type, scale)).alias(f"s{i}"))
            aggregates.append(F.max(F.abs(cell)).cast("double").alias(f"x{i}"))
    keys = [F.col(f"`{b}`") for b in by]
    grouped = df.groupBy(period.alias("period"), *keys) if time_column is not None else df.groupBy(*keys)
    wide = grouped.agg(*aggregates)
    if time_column is None:
        wide = wide.withColumn("period", F.lit(None).cast("date"))
    points = []
    for k in usable:
        read = _read_as_number(k, types)
        i = measures[(k.measure, k.scale, read)]
        has_sum, total = read or is_numeric(types[k.measure]), F.col(f"s{i}")
        numbers = F.col(f"m{i}" if read else f"n{i}")
        error = F.lit(None).cast("string")
        if k.aggregation == "count":
            value = F.col(f"n{i}").cast("double")
        else:
            value = F.coalesce(total, F.lit(0.0)) if k.aggregation == "sum" else F.try_divide(total, numbers.cast("double"))
            error = F.when((numbers > 0) & total.isNull(), F.lit("total exceeds its type")).when(
                F.isnan(total) | (F.abs(total) == float("inf")), F.lit("total is not finite")
            )
            if read:
                text = F.col(f"t{i}")
                error = F.when(text.isNotNull(), F.concat(F.lit("'"), text, F.lit("' is no number"))).otherwise(error)
        points.append(
            F.struct(
                F.lit(k.name).alias("kpi"), F.when(error.isNull(), value).alias("value"), F.col(f"n{i}").alias("value_count"),
                (F.col(f"x{i}") if has_sum else F.lit(None).cast("double")).alias("max_abs"), error.alias("error"),
            )
        )
    empty = F.array().cast("array<struct<kpi:string,value:double,value_count:bigint,max_abs:double,error:string>>")
    return wide.select("period", *by, F.inline(F.array(*points) if points else empty))


def trend_points(statistics: DataFrame, by: Sequence[str] = (), has_time: bool = True) -> DataFrame:
    """The trend table ``(kpi, idx, period, value)``: known periods with a value, numbered in time order."""
    rows = statistics.filter(F.col("value").isNotNull())
    if has_time:
        rows = rows.filter(F.col("period").isNotNull())
    place = (F.row_number().over(Window.partitionBy("kpi", *by).orderBy("period")) - 1).cast("bigint")
    return rows.select("kpi", *by, place.alias("idx"), "period", "value")


def kpi_trend(
    df: DataFrame, kpis: Sequence[Kpi], time_column: str | None, grain: str = "day",
    by: Sequence[str] = (), date_format: str | None = None,
) -> DataFrame:
    """Per-period value of every KPI. Without a time column each KPI is one point over the whole table."""
    statistics = period_statistics(df, kpis, time_column, grain, by, date_format)
    return trend_points(statistics, by, time_column is not None)


# --- validation ------------------------------------------------------------------------------------------------------


def validate_kpis(statistics: DataFrame, kpis: Sequence[Kpi], columns: Sequence[str], has_time: bool = True) -> DataFrame:
    """Status and reason of every KPI; the first failed check decides."""
    described = statistics.sparkSession.createDataFrame(
        [(k.name, k.measure, k.aggregation, k.measure in columns) for k in kpis],
        "kpi string, measure string, aggregation string, column_exists boolean",
    )
    known = F.col("value").isNotNull() | F.col("error").isNotNull()
    in_trend = known & (F.col("period").isNotNull() if has_time else F.lit(True))
    checked = statistics.groupBy("kpi").agg(
        F.count_if(in_trend).alias("period_count"),
        F.sum("value_count").alias("value_count"),
        F.max("max_abs").alias("max_abs"),
    )
    rows = described.join(checked, "kpi", "left")
    periods, n = F.coalesce("period_count", F.lit(0)), F.coalesce("value_count", F.lit(0))
    zero = F.col("aggregation").isin("avg", "rate") & (F.col("max_abs") <= ZERO_DENOMINATOR)
    outcome = (
        F.when(~F.col("column_exists"), _outcome("invalid", F.concat(F.lit("measure column '"), "measure", F.lit("' not in dataset"))))
        .when(periods == 0, _outcome("invalid", F.lit("no values for measure")))
        .when(n == 0, _outcome("invalid", F.lit("measure column is all null")))
        .when(F.coalesce(zero, F.lit(False)), _outcome("invalid", F.lit("zero denominator for ratio aggregation")))
        .when(periods < 2, _outcome("invalid", F.lit("degenerate trend (fewer than 2 period values)")))
        .when(
            periods < MIN_PERIODS,
            _outcome("low-data", F.format_string(f"only %d time periods (< {MIN_PERIODS} required)", periods)),
        )
        .otherwise(_outcome("valid", F.lit("enough time periods with values")))
    )
    return rows.select("kpi", "measure", "aggregation", periods.alias("period_count"), outcome.alias("o")).select(
        "kpi", "measure", "aggregation", "period_count", "o.status", "o.reason"
    )


def _outcome(status: str, reason: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), reason.alias("reason"))


def computable(validated: DataFrame) -> DataFrame:
    """KPIs a batch run works on."""
    return validated.filter(F.col("status") != "invalid")


# --- summary ---------------------------------------------------------------------------------------------------------


def summarize(trend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Latest value, baseline (mean of up to 7 periods before it), benchmark (mean of all) and prior deviation."""
    keys = ["kpi", *by]
    ranked = trend.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("period"))))
    value, back = F.col("value"), F.col("_back")
    return ranked.groupBy(*keys).agg(
        F.max(F.when(back == 1, F.col("period"))).alias("period"),
        F.max(F.when(back == 1, value)).alias("value"),
        small_mean(F.when(back.between(2, BASELINE_WINDOW + 1), value)).alias("baseline"),
        small_mean(value).alias("benchmark"),
        F.stddev_samp(F.when(back > 1, value)).alias("prior_std"),
        F.count(F.lit(1)).alias("period_count"),
    )


def bootstrap_intervals(trend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """95% interval of each KPI's period mean. One group is one series, bounded by its number of periods."""
    keys = ["kpi", *by]
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trend.schema.fields if f.name in keys)

    def interval(series: pd.DataFrame) -> pd.DataFrame:
        ordered = series.sort_values("idx")
        low, high = bootstrap_interval(ordered["value"].to_numpy(dtype=float))
        row = {k: series[k].iloc[0] for k in keys}
        return pd.DataFrame([{**row, "ci_lower": low, "ci_upper": high}])

    slim = trend.select(*keys, "idx", "value")
    return slim.groupBy(*keys).applyInPandas(interval, f"{key_types}, ci_lower double, ci_upper double")


def compute_kpis(trend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summary of every KPI with the bootstrap interval as ``confidence_interval`` (null below three periods)."""
    keys = ["kpi", *by]
    intervals = bootstrap_intervals(trend, by).select(
        *keys,
        F.when(
            F.col("ci_lower").isNotNull(), F.struct(F.col("ci_lower").alias("lower"), F.col("ci_upper").alias("upper"))
        ).alias("confidence_interval"),
    )
    return summarize(trend, by).join(intervals, keys, "left")


def failures(statistics: DataFrame, has_time: bool = True) -> DataFrame:
    """``(kpi, error)`` of every KPI with a period that could not be computed: the text of the earliest such period."""
    rows = statistics.filter(F.col("error").isNotNull())
    if has_time:
        rows = rows.filter(F.col("period").isNotNull())
        error = F.concat(F.col("period").cast("string"), F.lit(": "), F.col("error"))
    else:
        error = F.col("error")
    first = rows.groupBy("kpi").agg(F.min(F.struct("period", error.alias("error"))).alias("first"))
    return first.select("kpi", "first.error")


def batch_results(validated: DataFrame, computed: DataFrame, failing: DataFrame | None = None) -> DataFrame:
    """Every KPI with its computation. Invalid ones stay visible without one; a KPI that cannot be computed is a failure
    with its text, and so is a valid KPI without result."""
    computed = computed.drop("period_count")
    if failing is not None:
        computed = computed.join(failing, "kpi", "left_anti")
    joined = validated.join(computed.withColumn("_done", F.lit(True)), "kpi", "left")
    missing = F.when(F.col("_done").isNull(), F.lit("no computation"))
    if failing is None:
        return joined.withColumn("error", F.when(F.col("status") != "invalid", missing)).drop("_done")
    joined = joined.join(failing, "kpi", "left")
    return joined.withColumn("error", F.when(F.col("status") != "invalid", F.coalesce("error", missing))).drop("_done")


def run_batch(
    statistics: DataFrame, kpis: Sequence[Kpi], columns: Sequence[str], has_time: bool = True, intervals: bool = True
) -> DataFrame:
    """Validate and compute all KPIs at once from their statistics; one that fails does not stop the others.

    ``intervals`` adds the bootstrap interval of each period mean.
    """
    validated, failing = validate_kpis(statistics, kpis, columns, has_time), failures(statistics, has_time)
    sound = computable(validated).select("kpi").join(failing, "kpi", "left_anti")
    trend = trend_points(statistics, has_time=has_time).join(sound, "kpi", "left_semi")
    return batch_results(validated, compute_kpis(trend) if intervals else summarize(trend), failing)


def batch_summary(results: DataFrame) -> DataFrame:
    """Processed and failed counts of a batch run and the names of failed KPIs."""
    return results.agg(
        F.count_if(F.col("error").isNull()).alias("processed"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.col("kpi")))).alias("failures"),
    )


def status_counts(validated: DataFrame) -> DataFrame:
    return validated.groupBy("status").agg(F.count(F.lit(1)).alias("kpis"))
