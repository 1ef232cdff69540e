"""Difference in differences between one slice and the rest."""

from __future__ import annotations

from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.dates import period_of, to_time, within_periods
from kpiloom.functions.exact import exact_mean, without_nan
from kpiloom.functions.series import welch_p_value


def default_treatment(df: DataFrame, dimension: str) -> str:
    """First slice of a dimension in text order over the whole table."""
    first = df.agg(F.min(F.col(dimension).cast("string")).alias("v")).first()["v"]
    if first is None:
        raise ValueError(f"dimension {dimension!r} has no values")
    return first


@F.pandas_udf(T.DoubleType())
def _welch(n1: pd.Series, m1: pd.Series, v1: pd.Series, n2: pd.Series, m2: pd.Series, v2: pd.Series) -> pd.Series:
    rows = zip(n1, m1, v1, n2, m2, v2)
    return pd.Series([None if any(pd.isna(x) for x in r) else welch_p_value(*r) for r in rows], dtype="float64")


def group_statistics(
    df: DataFrame, dimension: str, outcome: str, before: date, after: date, time_column: str, grain: str = "day",
    treatment: str | None = None, date_format: str | None = None, scale: int = 6,
) -> DataFrame:
    """Means, counts and after-period variances of the four groups, one row, from one aggregate over two periods.

    A missing slice belongs to the control group. The mean of an empty group is zero.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    chosen = treatment if treatment is not None else default_treatment(df, dimension)
    time = to_time(F.col(time_column), types[time_column], date_format)
    compared = within_periods(F.col(time_column), types[time_column], [before, after], grain, date_format)
    rows = df.filter(compared).select(
        period_of(time, grain).alias("_period"), F.col(outcome),
        F.coalesce(F.col(dimension).cast("string") == F.lit(chosen), F.lit(False)).alias("_treated"),
    )
    t = types[outcome]
    aggregates = []
    for side, treated in (("treat", F.col("_treated")), ("ctrl", ~F.col("_treated"))):
        for name, period in (("before", before), ("after", after)):
            cell = F.when(treated & (F.col("_period") == F.lit(period)), F.col(outcome))
            aggregates.append(F.coalesce(exact_mean(cell, t, scale), F.lit(0.0)).alias(f"{side}_{name}"))
            aggregates.append(F.count(without_nan(cell, t)).alias(f"n_{side}_{name}"))
            if name == "after":
                aggregates.append(F.var_samp(without_nan(cell, t)).alias(f"var_{side}"))
    label = [F.lit(dimension).alias("treatment_dim"), F.lit(chosen).alias("treatment_value")]
    return rows.agg(*aggregates).select(*label, F.lit(before).alias("before_period"), F.lit(after).alias("after_period"), "*")


def diff_in_diff(df: DataFrame, dimension: str, outcome: str, before: date, after: date, time_column: str, **options) -> DataFrame:
    """Estimate, Welch p-value and effect size (after-period mean gap in pooled deviations)."""
    s = group_statistics(df, dimension, outcome, before, after, time_column, **options)
    estimate = (F.col("treat_after") - F.col("treat_before")) - (F.col("ctrl_after") - F.col("ctrl_before"))
    enough = (F.col("n_treat_after") >= 2) & (F.col("n_ctrl_after") >= 2)
    pooled = F.sqrt((F.col("var_treat") + F.col("var_ctrl")) / 2.0)
    effect = F.when(enough & (pooled > 0), F.try_divide(F.col("treat_after") - F.col("ctrl_after"), pooled))
    p = _welch(
        F.col("n_treat_after").cast("double"), "treat_after", "var_treat",
        F.col("n_ctrl_after").cast("double"), "ctrl_after", "var_ctrl",
    )
    return s.withColumn("did_estimate", estimate).withColumn("effect_size", effect).withColumn("p_value", F.when(enough, p))
