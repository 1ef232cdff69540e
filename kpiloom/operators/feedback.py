"""Analyst verdicts and the weight multipliers they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions.exact import half_even
from kpiloom.operators.narrative import OTHER, driver_type

# Fixed values
VERDICTS = ("confirm", "correct", "reject")
TARGETS = ("insight", "recommendation")
REJECT_STEP = 0.15
CONFIRM_STEP = 0.075
MIN_MULTIPLIER = 0.25
MAX_MULTIPLIER = 1.0


def checked(feedback: DataFrame) -> DataFrame:
    """Feedback rows as they may be stored; an unknown verdict or target type fails the write."""
    verdict = F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise(F.raise_error(F.lit("unknown verdict")))
    target = F.when(F.col("target_type").isin(*TARGETS), F.col("target_type")).otherwise(
        F.raise_error(F.lit("unknown target type"))
    )
    return feedback.withColumn("verdict", verdict).withColumn("target_type", target)


def typed_feedback(feedback: DataFrame, meta: DataFrame) -> DataFrame:
    """Feedback with the driver type stored for it, ``other`` where none is."""
    stored = meta.select("feedback_id", F.col("driver_type").alias("_type"))
    joined = feedback.drop("driver_type").join(stored, "feedback_id", "left")
    return joined.withColumn("driver_type", F.coalesce(F.when(F.col("_type") != "", F.col("_type")), F.lit(OTHER))).drop("_type")


def verdict_counts(feedback: DataFrame) -> DataFrame:
    """Verdicts per user and driver type; a user with a third of all feedback combines before the shuffle."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    return feedback.groupBy("user_id", "driver_type").agg(*counts)


def multiplier(rejects: Column, confirms: Column) -> Column:
    raw = F.lit(1.0) - F.lit(REJECT_STEP) * rejects + F.lit(CONFIRM_STEP) * confirms
    return half_even(F.least(F.greatest(raw, F.lit(MIN_MULTIPLIER)), F.lit(MAX_MULTIPLIER)), 4)


def adjustments(feedback: DataFrame) -> DataFrame:
    """Weight multiplier per user and driver type."""
    return verdict_counts(feedback).withColumn("multiplier", multiplier(F.col("reject"), F.col("confirm")))


def with_multiplier(rows: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("user_id", "driver_type")) -> DataFrame:
    """Add the current multiplier, 1.0 where there is no feedback."""
    return rows.join(weights.select(*keys, "multiplier"), list(keys), "left").withColumn(
        "multiplier", F.coalesce("multiplier", F.lit(1.0))
    )


def target_driver_types(findings: DataFrame) -> DataFrame:
    """Driver type of each KPI from the newest of its findings that has a dimension, ``other`` if none has one.

    Equal times go by the larger finding id. One row per KPI and task is shuffled, whatever the number of findings.
    """
    usable = F.coalesce(F.col("dimension"), F.lit("")) != ""
    newest = F.when(usable, F.struct("created_at", "finding_id"))
    chosen = findings.groupBy("user_id", "kpi").agg(F.max_by("dimension", newest).alias("dimension"))
    return chosen.select("user_id", "kpi", F.when(F.col("dimension").isNull(), OTHER).otherwise(driver_type(F.col("dimension"))).alias("driver_type"))


def of_target(feedback: DataFrame, user_id: str, target_id: str) -> DataFrame:
    """Feedback on one target, newest first."""
    rows = feedback.filter((F.col("user_id") == user_id) & (F.col("target_id") == target_id))
    return rows.orderBy(F.desc("created_at"), "feedback_id")


def most_recent(feedback: DataFrame, user_id: str, limit: int = 20) -> DataFrame:
    """A user's latest feedback."""
    return feedback.filter(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "feedback_id").limit(limit)
