"""The window anomaly methods for series of any length: the same results, with a series spread over all tasks.

``anomaly`` gives each series to one task, which suits trends of periods. Here a trend, numbered from 0 without gaps, is cut into
ranges with halo rows, so one KPI with millions of periods (grain ``timestamp``) uses the whole cluster. Medians of a series come
from radix selection, so no task holds a series. Few series are long, so their keys go to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.joins import join_null_safe
from kpiloom.functions.ranges import RANGE_ROWS, numbered, with_halo
from kpiloom.functions.selection import Selection
from kpiloom.model import MIN_PERIODS
from kpiloom.operators import anomaly

#: Series whose medians are selected in one pass over the trend.
SERIES_AT_ONCE = 50


def trend_points(statistics: DataFrame, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """The trend table of ``kpi.trend_points``, numbered by ranges."""
    known = statistics.filter(F.col("value").isNotNull() & F.col("period").isNotNull())
    return numbered(known, ["kpi", *by], "period", ranges=ranges).select("kpi", *by, "idx", "period", "value")


def _by_range(trend: DataFrame, by: Sequence[str], before: int, after: int, range_rows: int, judge) -> DataFrame:
    """Run a method of whole series on ranges with halo rows and keep each range's own rows."""
    return judge(with_halo(trend, before, after, range_rows=range_rows), [*by, "_range"]).filter("_own").drop("_own", "_range")


def control_limits(trend: DataFrame, by: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """As ``anomaly.control_limits``; a series below the least number of periods has no limits."""
    keys = ["kpi", *by]
    rated = _by_range(trend, by, anomaly.CONTROL_WINDOW, 0, range_rows, lambda t, k: anomaly.control_limits(t, k, whole_series=False))
    enough = trend.groupBy(*keys).agg((F.count("value") >= MIN_PERIODS).alias("_enough"))
    judged = join_null_safe(rated, enough, keys)
    return judged.withColumns({
        "control_mean": F.when(F.col("_enough"), F.col("control_mean")), "control_std": F.when(F.col("_enough"), F.col("control_std")),
        "breach": F.col("breach") & F.col("_enough"),
    }).drop("_enough")


def local_direction(trend: DataFrame, by: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """As ``anomaly.local_direction``."""
    return _by_range(trend, by, anomaly.NEIGHBOURS, anomaly.NEIGHBOURS, range_rows, anomaly.local_direction)


def series_medians(trend: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """Exact median of a value and number of values of every series."""
    keys = ["kpi", *by]
    series = trend.select(*keys).distinct().collect()  # one row for each long series
    rows = []
    for at in range(0, len(series), SERIES_AT_ONCE):
        some = series[at : at + SERIES_AT_ONCE]
        columns = {}
        for i, s in enumerate(some):
            mine = F.lit(True)
            for k, v in zip(keys, s, strict=True):
                mine = mine & F.col(f"`{k}`").eqNullSafe(F.lit(v))
            columns[f"m{i}"] = F.when(mine, value)
        chosen = Selection(trend, columns)
        medians = chosen.quantiles([0.5])
        rows += [(*s, medians[f"m{i}"][0.5], chosen.buckets[f"m{i}"].total) for i, s in enumerate(some)]
    kinds = {f.name: f.dataType.simpleString() for f in trend.schema.fields}
    return trend.sparkSession.createDataFrame(rows, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_median double", "_values bigint"]))


def robust_scores(trend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """As ``anomaly.robust_scores``."""
    keys = ["kpi", *by]
    centred = join_null_safe(trend, series_medians(trend, by, F.col("value")), keys)
    centred = centred.withColumn("_distance", F.abs(F.col("value") - F.col("_median"))).drop("_median")
    spread = series_medians(centred, by, F.col("_distance")).select(*keys, F.col("_median").alias("_mad"))
    scored = join_null_safe(centred, spread, keys)
    score = F.abs(F.try_divide(F.lit(anomaly.MAD_SCALE) * F.col("_distance"), F.col("_mad")))
    usable = (F.col("_values") >= MIN_PERIODS) & (F.col("_mad") > 0)
    return scored.withColumn("modified_z", F.when(usable, score)).drop("_distance", "_mad", "_values")


def marks(trend: DataFrame, by: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """As ``anomaly.marks`` without change points."""
    rated = local_direction(robust_scores(control_limits(trend, by, range_rows), by), by, range_rows)
    outlier = F.coalesce(F.col("modified_z") > anomaly.MAD_CUTOFF, F.lit(False))
    return rated.select(
        "kpi", *by, "idx", "period", "value", "direction", F.lit(False).alias("change_points"),
        F.col("breach").alias("control_limit_breaches"), outlier.alias("outliers"),
    )
