"""Table checks: structure, keys, references, hierarchies and expected movements.

Each check is one row ``(check, passed, measured)``; ``combine`` puts them together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.exact import doubles
from kpiloom.functions.selection import Selection

# Fixed values
SPIKE_FACTOR = 3.0
DROP_FACTOR = 0.55
SHIFT_FACTOR = 1.8


def _check(stats: DataFrame, name: str, passed: Column, measured: Column) -> DataFrame:
    return stats.select(
        F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), measured.cast("double").alias("measured")
    )


def combine(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def all_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.every("passed").alias("all_passed"), F.count_if(~F.col("passed")).alias("failed"))


def row_count(df: DataFrame, name: str, at_least: int | None = None, exactly: int | None = None) -> DataFrame:
    n = F.col("n")
    passed = F.lit(True)
    if at_least is not None:
        passed = passed & (n >= at_least)
    if exactly is not None:
        passed = passed & (n == exactly)
    return _check(df.agg(F.count(F.lit(1)).alias("n")), name, passed, n)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row. A join side with repeated keys would multiply rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def unique_key(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    stats = repeated_keys(df, keys).agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("n"))
    return _check(stats, name, F.col("n") == 0, F.col("n"))


def group_count(df: DataFrame, keys: Sequence[str], name: str, exactly: int) -> DataFrame:
    stats = df.groupBy(*keys).agg(F.count(F.lit(1))).agg(F.count(F.lit(1)).alias("n"))
    return _check(stats, name, F.col("n") == exactly, F.col("n"))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Key values of the child that the parent lacks, with their row counts.

    Child rows are counted per key first, so the join sees each key once and a hot key carries no weight.
    """
    used = child.groupBy(F.col(child_key).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    known = parent.select(F.col(parent_key).alias("key"))
    return used.join(known, "key", "left_anti")


def no_orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    stats = orphans(child, child_key, parent, parent_key).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
    return _check(stats, name, F.col("n") == 0, F.col("n"))


def hierarchy_violations(df: DataFrame, parent: str, child: str, allowed: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows whose (parent, child) pair is not allowed; without a list, pairs whose child has several parents."""
    pairs = df.filter(F.col(parent).isNotNull()).groupBy(parent, child).agg(F.count(F.lit(1)).alias("rows"))
    if allowed is not None:
        listed = F.create_map(*[x for p, cs in allowed.items() for x in (F.lit(p), F.array(*[F.lit(c) for c in cs]))])
        good = F.array_contains(F.try_element_at(listed, F.col(parent)), F.col(child))
        return pairs.filter(~F.coalesce(good, F.lit(False)))
    several = pairs.groupBy(child).agg(F.count(F.lit(1)).alias("_parents")).filter(F.col("_parents") > 1)
    return pairs.join(several.select(child), child, "left_semi")


def consistent_hierarchy(df: DataFrame, parent: str, child: str, name: str, allowed: dict[str, Sequence[str]] | None = None) -> DataFrame:
    stats = hierarchy_violations(df, parent, child, allowed).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
    return _check(stats, name, F.col("n") == 0, F.col("n"))


def value_set(df: DataFrame, column: str, allowed: Sequence[str], name: str) -> DataFrame:
    """The distinct non-null values are exactly the allowed ones."""
    seen = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    listed = F.col("v").isin(list(allowed))
    stats = seen.agg(F.count_if(~listed).alias("extra"), F.count_if(listed).alias("found"))
    return _check(stats, name, (F.col("extra") == 0) & (F.col("found") == len(set(allowed))), F.col("extra"))


def _against_median(trend: DataFrame, kpi: str, period) -> DataFrame:
    rows = trend.filter(F.col("kpi") == kpi)
    return rows.agg(
        F.median("value").alias("m"), F.coalesce(F.max(F.when(F.col("period") == period, F.col("value"))), F.lit(0.0)).alias("v")
    )


def spike(trend: DataFrame, kpi: str, period, name: str, factor: float = SPIKE_FACTOR) -> DataFrame:
    """The period exceeds the median period by the factor."""
    return _check(_against_median(trend, kpi, period), name, F.col("v") > F.col("m") * factor, F.try_divide("v", "m"))


def drop(trend: DataFrame, kpi: str, period, name: str, factor: float = DROP_FACTOR) -> DataFrame:
    """The period stays below the factor of the median period."""
    return _check(_against_median(trend, kpi, period), name, F.col("v") < F.col("m") * factor, F.try_divide("v", "m"))


def level_shift(df: DataFrame, column: str, time_column: str, split, name: str, factor: float = SHIFT_FACTOR) -> DataFrame:
    """The median after the split exceeds the median before it by the factor. Both medians, exact and distributed, come from one selection."""
    value = doubles(df, [column])[column]
    early = F.col(time_column) < F.lit(split)
    sides = Selection(df, {"before": F.when(early, value), "after": F.when(~early, value)}).quantiles([0.5])
    before, after = sides["before"][0.5], sides["after"][0.5]
    known = before is not None and after is not None
    ratio = after / before if known and before else None
    row = [(name, bool(known and after > factor * before), ratio)]
    return df.sparkSession.createDataFrame(row, "check string, passed boolean, measured double")


def ratio_band(df: DataFrame, condition: Column, name: str, low: float, high: float) -> DataFrame:
    """The share of rows meeting a condition lies within the band."""
    stats = df.agg(F.try_divide(F.count_if(condition), F.count(F.lit(1))).alias("r"))
    return _check(stats, name, F.col("r").between(low, high), F.col("r"))


def row_tally(df: DataFrame, condition: Column, name: str, exactly: int) -> DataFrame:
    """Exactly this many rows meet a condition."""
    return _check(df.agg(F.count_if(condition).alias("n")), name, F.col("n") == exactly, F.col("n"))


def above_average(df: DataFrame, column: str, condition: Column, name: str, factor: float) -> DataFrame:
    """The mean over some rows exceeds the overall mean by the factor."""
    stats = df.agg(F.avg(F.when(condition, F.col(column))).alias("part"), F.avg(column).alias("whole"))
    return _check(stats, name, F.col("part") > F.col("whole") * factor, F.try_divide("part", "whole"))
