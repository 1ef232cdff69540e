"""Anomalies of KPI trends: control limits, robust outliers and change points, and their mutual support.

A trend has one row per period, so a series is small and bounded; the work spreads over series. Inputs are trend tables
``(kpi, idx, period, value)``; ``by`` names extra series keys, such as a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions.exact import ordered_total
from kpiloom.functions.series import change_points
from kpiloom.model import MIN_PERIODS
from kpiloom.operators.findings import evidence

# Fixed values
CONTROL_WINDOW = 7
CONTROL_SIGMAS = 3.0
MAD_SCALE = 0.6745
MAD_CUTOFF = 3.5
NEIGHBOURS = 3

# Method name and the text shown for it.
METHOD_LABELS = {
    "change_points": "change point of a penalized segmentation",
    "control_limit_breaches": "±3σ trailing control-limit breach",
    "outliers": "MAD outlier (modified z > 3.5)",
}


def _flags(rows: DataFrame, keys: Sequence[str], method: str) -> DataFrame:
    return rows.select(*keys, F.lit(method).alias("method"), "idx", "period", "value")


def control_limits(trend: DataFrame, by: Sequence[str] = (), whole_series: bool = True) -> DataFrame:
    """Each point with the mean and deviation of the seven points before it, and whether it leaves the limits.

    Mean and deviation are taken over the seven values in order, so equal inputs always land on the same side of the limit.
    Without ``whole_series`` the rows are a part of a series, whose length is not judged here.
    """
    keys = ["kpi", *by]
    series = Window.partitionBy(*keys)
    trailing = series.orderBy("idx").rowsBetween(-CONTROL_WINDOW, -1)
    mean = ordered_total(F.col("_trail")) / F.lit(float(CONTROL_WINDOW))
    spread = F.transform(F.col("_trail"), lambda v: (v - F.col("control_mean")) * (v - F.col("control_mean")))
    deviation = F.sqrt(ordered_total(spread) / F.lit(CONTROL_WINDOW - 1.0))
    full = F.count("value").over(trailing) == CONTROL_WINDOW
    if whole_series:
        full = full & (F.count("value").over(series) >= MIN_PERIODS)
    out = F.abs(F.col("value") - F.col("control_mean")) > CONTROL_SIGMAS * F.col("control_std")
    return (
        trend.withColumns({"_trail": F.collect_list("value").over(trailing), "_full": full})
        .withColumn("control_mean", F.when(F.col("_full"), mean))
        .withColumn("control_std", F.when(F.col("control_mean").isNotNull(), deviation))
        .withColumn("breach", F.coalesce(out, F.lit(False)))
        .drop("_trail", "_full")
    )


def control_limit_breaches(trend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _flags(control_limits(trend, by).filter("breach"), ["kpi", *by], "control_limit_breaches")


def robust_scores(trend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each point with its modified z-score, null for short series and series without absolute deviation.

    Both medians are window values of the same partitioning, so a series is read and moved once.
    """
    series = Window.partitionBy("kpi", *by)
    centre = trend.withColumn("_distance", F.abs(F.col("value") - F.median("value").over(series)))
    enough = F.count("value").over(series) >= MIN_PERIODS
    spread = centre.withColumns({"_mad": F.median("_distance").over(series), "_enough": enough})
    score = F.abs(F.try_divide(F.lit(MAD_SCALE) * F.col("_distance"), F.col("_mad")))
    scored = spread.withColumn("modified_z", F.when(F.col("_enough") & (F.col("_mad") > 0), score))
    return scored.drop("_distance", "_mad", "_enough")


def mad_outliers(trend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Points whose modified z-score exceeds the cutoff."""
    return _flags(robust_scores(trend, by).filter(F.col("modified_z") > MAD_CUTOFF), ["kpi", *by], "outliers")


def level_marks(trend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every point with whether the level changes there. One task handles one series at a time; long series need memory
    for ``(periods / 5) ** 2`` numbers, so use weekly periods for very long histories."""
    keys = ["kpi", *by]
    columns = [*keys, "idx", "period", "value"]
    types = {f.name: f.dataType.simpleString() for f in trend.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", shift boolean"

    def detect(series: pd.DataFrame) -> pd.DataFrame:
        ordered = series.sort_values("idx").reset_index(drop=True)
        points = change_points(ordered["value"].to_numpy(dtype=float), MIN_PERIODS)
        return ordered.assign(shift=ordered.index.isin(points))

    return trend.select(*columns).groupBy(*keys).applyInPandas(detect, schema)


def level_shifts(trend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Change points of every series."""
    return _flags(level_marks(trend, by).filter("shift"), ["kpi", *by], "change_points")


def local_direction(trend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each point against the mean of its neighbours within three steps."""
    series = Window.partitionBy("kpi", *by).orderBy("idx")
    before = F.collect_list("value").over(series.rowsBetween(-NEIGHBOURS, -1))
    after = F.collect_list("value").over(series.rowsBetween(1, NEIGHBOURS))
    local = F.try_divide(ordered_total(F.col("_near")), F.size("_near").cast("double"))
    value, mean = F.col("value"), F.col("local_mean")
    word = F.when(value > mean, "up").when(value < mean, "down").otherwise("flat")
    near = trend.withColumn("_near", F.concat(before, after)).withColumn("local_mean", local)
    return near.drop("_near").withColumn("direction", word)


def marks(trend: DataFrame, by: Sequence[str] = (), change_points: bool = True) -> DataFrame:
    """Every point with its direction and a yes/no column per method, in one pass over the trend without joins.

    ``change_points=False`` leaves out the one method that needs Python; its column is then false.
    """
    points = level_marks(trend, by) if change_points else trend.withColumn("shift", F.lit(False))
    rated = local_direction(robust_scores(control_limits(points, by), by), by)
    outlier = F.coalesce(F.col("modified_z") > MAD_CUTOFF, F.lit(False))
    return rated.select(
        "kpi", *by, "idx", "period", "value", "direction",
        F.col("shift").alias("change_points"), F.col("breach").alias("control_limit_breaches"), outlier.alias("outliers"),
    )


def _marked_methods() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(m), F.lit(m)) for m in METHOD_LABELS]))


def flags_of(marked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Flags as a long table: one row per point and method."""
    return marked.select("kpi", *by, F.explode(_marked_methods()).alias("method"), "idx", "period", "value")


def detect_anomalies(trend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Flags of all three methods as one long table."""
    return flags_of(marks(trend, by), by)


def supported(marked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each flag with its direction and ``corroborating``: other methods' flags within one step, with their directions.

    A point's neighbours are the rows before and after it in its series, so no join is needed. The list is bounded: two
    other methods at three positions.
    """
    here = F.struct("idx", "direction", _marked_methods().alias("methods"))
    series = Window.partitionBy("kpi", *by).orderBy("idx")
    near = F.array(F.lag(here).over(series), here, F.lead(here).over(series))
    placed = marked.withColumn("_near", near).withColumn("method", F.explode(_marked_methods()))

    def others(point: Column) -> Column:
        named = F.filter(point["methods"], lambda m: m != F.col("method"))
        return F.transform(
            named, lambda m: F.struct(point["idx"].alias("idx"), m.alias("method"), point["direction"].alias("direction"))
        )

    close = F.filter("_near", lambda p: p.isNotNull() & (F.abs(p["idx"] - F.col("idx")) <= 1))
    found = F.array_sort(F.flatten(F.transform(close, others)))
    return placed.select("kpi", *by, "method", "idx", "period", "value", "direction", found.alias("corroborating"))


def corroborated(marked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per flag and corroborating flag; uncorroborated flags appear once with nulls."""
    rows = supported(marked, by).withColumn("c", F.explode_outer("corroborating"))
    return rows.select(
        "kpi", *by, "method", "idx", "period", "value", "direction",
        F.col("c.method").alias("other_method"), F.col("c.direction").alias("other_direction"), F.col("c.idx").alias("other_idx"),
    )


def anomaly_findings(
    marked: DataFrame, validated: DataFrame, by: Sequence[str] = (), dataset_id: str = "", source_freshness: str = ""
) -> DataFrame:
    """One finding per flag: direction, corroborating methods, KPI status, a readable lineage and an evidence record."""
    keys = ["kpi", *by]
    status = validated.select(F.col("kpi").alias("_kpi"), F.col("status").alias("kpi_status"), "period_count")
    labels = F.create_map(*[F.lit(x) for pair in METHOD_LABELS.items() for x in pair])
    label = F.try_element_at(labels, F.col("method"))
    joined = supported(marked, by).join(status, F.col("kpi") == F.col("_kpi"), "left").drop("_kpi")
    kind = F.concat(F.lit("anomaly_"), "method")
    lineage = F.array(
        F.concat(F.lit("KPI "), "kpi"),
        F.concat(F.lit("detector: "), label, F.lit(" at trend index "), F.col("idx").cast("string")),
        F.concat(F.lit("period: "), F.col("period").cast("string")),
    )
    return joined.select(
        *keys, F.lit(dataset_id).alias("dataset_id"), "method", "idx", "period", "value", "direction", "kpi_status", "period_count",
        F.col("value").alias("statistic"),
        F.lit(None).cast("double").alias("p_value"), F.lit(None).cast("double").alias("effect_size"),
        F.concat(F.lit("anomaly:"), "method", F.lit(":"), F.col("idx").cast("string")).alias("finding_key"),
        kind.alias("finding_type"),
        label.alias("method_label"),
        F.transform("corroborating", lambda c: F.struct(c["method"].alias("method"), c["direction"].alias("direction"))).alias(
            "corroborating_methods"
        ),
        lineage.alias("lineage"),
        evidence(kind, label, F.col("value"), F.lit(source_freshness), lineage).alias("evidence"),
    )


def method_counts(flags: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Flags per method; methods without flags do not appear."""
    return flags.groupBy(*by, "method").agg(F.count(F.lit(1)).alias("flags"))


def flag_table(marked: DataFrame) -> DataFrame:
    """One row per flagged period with a yes/no column per method."""
    return marked.filter(F.size(_marked_methods()) > 0).drop("direction")


def pivot_flags(flags: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same table from stored long flags."""
    wide = flags.groupBy("kpi", *by, "idx", "period", "value").pivot("method", list(METHOD_LABELS)).agg(F.count(F.lit(1)))
    yes = [(F.coalesce(F.col(m), F.lit(0)) > 0).alias(m) for m in METHOD_LABELS]
    return wide.select("kpi", *by, "idx", "period", "value", *yes)
