"""How much each KPI's latest movement matters, 0..10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.exact import half_even

# Fixed values
STATISTICAL_WEIGHT = 0.5
BUSINESS_WEIGHT = 0.5
THRESHOLD_STD_DEVS = 1.0
MAX_COMPONENT = 10.0
SATURATION = 3.0


def sigmas_moved(value: Column, baseline: Column, deviation: Column) -> Column:
    """Distance from the baseline in prior deviations; a move away from a constant history counts as the maximum."""
    moved = F.abs(value - baseline)
    flat = F.when(moved > 0, F.lit(MAX_COMPONENT)).otherwise(0.0)
    return F.when(deviation > 0, F.try_divide(moved, deviation)).otherwise(flat)


def score_materiality(
    summary: DataFrame,
    threshold: Column | float | None = None,
    weight_statistical: Column | float | None = None,
    weight_business: Column | float | None = None,
    multiplier: Column | float | None = None,
) -> DataFrame:
    """Add ``sigmas`` and ``materiality`` to KPI summaries.

    Settings are columns of ``summary`` (joined from contracts) or constants; missing ones take the defaults. The
    feedback ``multiplier`` scales the capped score.
    """
    def setting(given: Column | float | None, default: float) -> Column:
        if given is None:
            return F.lit(default)
        column = given if isinstance(given, Column) else F.lit(float(given))
        return F.coalesce(column, F.lit(default))

    limit = setting(threshold, THRESHOLD_STD_DEVS)
    limit = F.when(limit > 0, limit).otherwise(THRESHOLD_STD_DEVS)
    ws, wb = setting(weight_statistical, STATISTICAL_WEIGHT), setting(weight_business, BUSINESS_WEIGHT)
    total = ws + wb
    ws_share = F.when(total > 0, F.try_divide(ws, total)).otherwise(STATISTICAL_WEIGHT)
    wb_share = F.when(total > 0, F.try_divide(wb, total)).otherwise(BUSINESS_WEIGHT)
    s = F.col("sigmas")
    significance = F.least(s / F.lit(SATURATION), F.lit(1.0))
    impact = F.when(s >= limit, 1.0).otherwise(F.greatest(F.least(F.try_divide(s, limit), F.lit(1.0)), F.lit(0.0)))
    score = F.least(s * (ws_share * significance + wb_share * impact), F.lit(MAX_COMPONENT))
    scorable = F.col("value").isNotNull() & F.col("baseline").isNotNull() & (F.col("period_count") >= 2)
    adjusted = F.when(scorable, score * setting(multiplier, 1.0)).otherwise(0.0)
    deviation = F.coalesce("prior_std", F.lit(0.0))
    scored = summary.withColumn("sigmas", sigmas_moved(F.col("value"), F.col("baseline"), deviation))
    return scored.withColumn("materiality", half_even(adjusted, 4))


def by_materiality(scored: DataFrame) -> DataFrame:
    """Most material KPI first."""
    return scored.orderBy(F.desc("materiality"), "kpi")
