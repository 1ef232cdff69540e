"""Which slices of which dimensions moved a KPI between its two latest periods."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions.dates import period_of, to_time, within_periods
from kpiloom.functions.exact import exact_sum, half_even, is_numeric, small_total, without_nan
from kpiloom.functions.text import direction
from kpiloom.model import Kpi

NULL_SLICE = "(null)"
# The waterfall identity holds up to these tolerances.
ABSOLUTE_TOLERANCE = 1e-6
RELATIVE_TOLERANCE = 1e-9
DISPLAY_TOLERANCE = 1e-3


@dataclass(frozen=True)
class Movement:
    """The two periods a KPI is compared between."""

    kpi: Kpi
    before: date
    after: date
    before_value: float
    after_value: float

    @property
    def total(self) -> float:
        return self.after_value - self.before_value


def latest_movements(trend: DataFrame, kpis: Sequence[Kpi]) -> list[Movement]:
    """Last two periods of every KPI. Two short rows per KPI reach the driver, so the fact scan can filter on dates."""
    back = F.row_number().over(Window.partitionBy("kpi").orderBy(F.desc("period")))
    rows = trend.withColumn("_back", back).filter(F.col("_back") <= 2).select("kpi", "_back", "period", "value").collect()
    ends = {(r["kpi"], r["_back"]): r for r in rows}
    found = []
    for k in kpis:
        after, before = ends.get((k.name, 1)), ends.get((k.name, 2))
        if before is not None:
            found.append(Movement(k, before["period"], after["period"], before["value"], after["value"]))
    return found


def decompose(
    df: DataFrame, movements: Sequence[Movement], dimensions: Sequence[str], time_column: str, grain: str = "day",
    date_format: str | None = None,
) -> DataFrame:
    """Contribution of every slice of every dimension to every KPI's movement, one row each.

    Only rows of the compared periods are read (the dates are literals and reach the scan). Those rows are spread to
    (dimension, slice) and aggregated once for all KPIs; equal slices combine before the shuffle, so a slice holding a
    third of the rows is no bottleneck. Additive KPIs contribute after - before. Ratio KPIs contribute a volume part,
    change in count times the KPI's value before, and a rate part, change of the slice's ratio times its count after.
    """
    if not movements:
        raise ValueError("no KPI has two periods to compare")
    types = {f.name: f.dataType for f in df.schema.fields}
    dims = [d for d in dict.fromkeys(dimensions) if d in types]
    time = to_time(F.col(time_column), types[time_column], date_format)
    periods = sorted({p for m in movements for p in (m.before, m.after)})
    rows = df.filter(within_periods(F.col(time_column), types[time_column], periods, grain, date_format))
    measures = list(dict.fromkeys(m.kpi.measure for m in movements))
    slices = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("slice")) for d in dims])
    spread = rows.select(period_of(time, grain).alias("_period"), *measures, F.inline(slices))
    aggregates = []
    for i, m in enumerate(movements):
        c, t = m.kpi.measure, types[m.kpi.measure]
        for side, period in (("b", m.before), ("a", m.after)):
            cell = F.when(F.col("_period") == F.lit(period), F.col(c))
            aggregates.append(F.count(without_nan(cell, t)).alias(f"{side}n{i}"))
            if m.kpi.aggregation != "count" and is_numeric(t):
                aggregates.append(exact_sum(cell, t, m.kpi.scale).alias(f"{side}s{i}"))
            aggregates.append(F.count_if(F.col("_period") == F.lit(period)).alias(f"{side}r{i}"))
    wide = spread.groupBy("dimension", "slice").agg(*aggregates)
    entries = []
    for i, m in enumerate(movements):
        before, after = _slice_value(m.kpi, i, "b"), _slice_value(m.kpi, i, "a")
        if m.kpi.additive:
            contribution = after - before
        else:
            n_before, n_after = F.col(f"bn{i}").cast("double"), F.col(f"an{i}").cast("double")
            contribution = (n_after - n_before) * F.lit(m.before_value or 0.0) + (after - before) * n_after
        entries.append(
            F.when(
                (F.col(f"br{i}") > 0) | (F.col(f"ar{i}") > 0),
                F.struct(
                    F.lit(m.kpi.name).alias("kpi"), F.lit(m.before).alias("before_period"), F.lit(m.after).alias("after_period"),
                    F.lit(float(m.before_value)).alias("before_value"), F.lit(float(m.after_value)).alias("after_value"),
                    F.lit(float(m.total)).alias("total_movement"), F.lit(m.kpi.additive).alias("additive"),
                    before.alias("before"), after.alias("after"), contribution.alias("contribution"),
                ),
            )
        )
    long = wide.select("dimension", "slice", F.inline(F.array_compact(F.array(*entries))))
    moved = F.abs(F.col("total_movement"))
    share = F.coalesce(F.try_divide(F.abs("contribution"), moved) * 100.0, F.lit(0.0))
    return long.select(
        "kpi", "dimension", F.coalesce("slice", F.lit(NULL_SLICE)).alias("slice"),
        "before_period", "after_period", "before_value", "after_value", "total_movement", "additive",
        "before", "after", "contribution", share.alias("share_pct"), direction(F.col("contribution")).alias("direction"),
    )


def _slice_value(kpi: Kpi, i: int, side: str) -> Column:
    if kpi.aggregation == "count":
        return F.col(f"{side}n{i}").cast("double")
    if kpi.aggregation == "sum":
        return F.coalesce(F.col(f"{side}s{i}"), F.lit(0.0))
    return F.coalesce(F.try_divide(F.col(f"{side}s{i}"), F.col(f"{side}n{i}").cast("double")), F.lit(0.0))


def _strength() -> Column:
    return F.abs(F.col("contribution"))


def ranked(drivers: DataFrame) -> DataFrame:
    """All slices, strongest first within each dimension: one global sort, no group is gathered in one task."""
    return drivers.orderBy("kpi", "dimension", F.desc(_strength()), "slice")


def top_slices(drivers: DataFrame, k: int = 6) -> DataFrame:
    """The k strongest slices of every dimension with their rank. Each task keeps k rows per dimension before the shuffle."""
    place = F.row_number().over(Window.partitionBy("kpi", "dimension").orderBy(F.desc(_strength()), F.asc("slice")))
    return drivers.withColumn("rank", place).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def dimension_summary(drivers: DataFrame) -> DataFrame:
    """One row per (KPI, dimension): contribution sum, residual, whether they reconcile, and the strongest slice."""
    grouped = drivers.groupBy(
        "kpi", "dimension", "before_period", "after_period", "before_value", "after_value", "total_movement", "additive"
    ).agg(
        F.count(F.lit(1)).alias("slice_count"),
        small_total(F.col("contribution")).alias("contribution_sum"),
        F.max(_strength()).alias("top_strength"),
    )
    residual = F.col("contribution_sum") - F.col("total_movement")
    size = F.greatest(F.abs(F.col("before_value")), F.abs(F.col("after_value")), F.lit(1.0))
    tolerance = F.greatest(
        F.lit(ABSOLUTE_TOLERANCE), F.abs("total_movement") * RELATIVE_TOLERANCE, size * ABSOLUTE_TOLERANCE
    )
    return grouped.withColumn("residual", residual).withColumn(
        "reconciled", F.when(F.col("additive"), F.abs(F.col("residual")) <= tolerance)
    )


def ranked_dimensions(drivers: DataFrame) -> DataFrame:
    """Dimensions of every KPI in order of their strongest slice."""
    place = F.row_number().over(Window.partitionBy("kpi").orderBy(F.desc("top_strength"), "dimension"))
    return dimension_summary(drivers).withColumn("dimension_rank", place.cast("bigint"))


def display_check(drivers: DataFrame) -> DataFrame:
    """Whether the contributions, rounded as displayed, add up to the displayed total."""
    return drivers.groupBy("kpi", "dimension").agg(
        F.sum(half_even(F.col("contribution"), 4).cast("decimal(38,4)")).cast("double").alias("displayed_sum"),
        F.max(half_even(F.col("total_movement"), 4)).alias("displayed_total"),
    ).withColumn("matches", F.abs(F.col("displayed_sum") - F.col("displayed_total")) < DISPLAY_TOLERANCE)


def dimensions_of(kpi: Kpi, contract_dimensions: Sequence[str]) -> list[str]:
    """The KPI's own slices, then the contract's dimensions, each once."""
    return list(dict.fromkeys([*kpi.slice_columns, *contract_dimensions]))


def merged_dimensions(kpis: DataFrame, contract_dimensions: Column) -> DataFrame:
    """The same merge as a column over a KPI table."""
    return kpis.withColumn("dimensions", F.array_distinct(F.concat("slice_columns", contract_dimensions)))
