"""Order-dependent work on series too long for one task.

Rows are cut into ranges of their order. Numbers come from local row numbers and prefix sums over the ranges' sizes; neighbours
across a cut come from the ranges' first and last rows; windows of a few rows see the rows near a cut in both ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions.joins import join_null_safe
from kpiloom.session import cut_lineage

#: Rows of a series in one range.
RANGE_ROWS = 100_000


def in_ranges(rows: DataFrame, keys: Sequence[str], order: str, ranges: int | None = None) -> DataFrame:
    """The rows with the number ``_range`` of their range in the order of keys and ``order``; equal rows share a range.

    Ranges hold about equally many rows, so a series that holds most rows is cut into most ranges.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *[F.col(f"`{k}`") for k in keys], F.col(f"`{order}`"))
    return cut_lineage(dealt.withColumn("_range", F.spark_partition_id()))


def numbered(rows: DataFrame, keys: Sequence[str], order: str, name: str = "idx", ranges: int | None = None) -> DataFrame:
    """Number the rows of each series from 0 in a strict order: local numbers plus the rows of earlier ranges."""
    cut = in_ranges(rows, keys, order, ranges)
    local = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(order))
    sizes = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))  # one row for each series and range
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    placed = join_null_safe(cut.withColumn("_local", local), before, [*keys, "_range"])
    return placed.withColumn(name, (F.col("_before") + F.col("_local") - 1).cast("bigint")).drop("_range", "_local", "_before")


def with_neighbours(rows: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """Add ``_previous`` and ``_next``, the order values of the rows before and after, without a window over all rows."""
    cut = in_ranges(rows, [], order, ranges)
    inside = Window.partitionBy("_range").orderBy(order)
    ends = cut.groupBy("_range").agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    by_range = Window.orderBy("_range")  # one row for each range
    across = ends.select("_range", F.lag("_last").over(by_range).alias("_before"), F.lead("_first").over(by_range).alias("_after"))
    local = cut.withColumns({"_lag": F.lag(order).over(inside), "_lead": F.lead(order).over(inside)})
    out = local.join(F.broadcast(across), "_range")
    return out.withColumns({"_previous": F.coalesce("_lag", "_before"), "_next": F.coalesce("_lead", "_after")}).drop("_range", "_lag", "_lead", "_before", "_after")


def with_halo(rows: DataFrame, before: int, after: int, index: str = "idx", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every row in the range of its index and, if near a cut, as a halo row in the range next to it.

    ``_range`` numbers the ranges and ``_own`` tells a range's own rows. Indices count from 0 without gaps, and ranges are longer
    than a halo; a window over a range then sees what it would see over the whole series.
    """
    if range_rows <= max(before, after):
        raise ValueError("a range must be longer than its halo")
    place, inside = F.floor(F.col(index) / range_rows), F.pmod(F.col(index), F.lit(range_rows))
    homes = F.array_compact(F.array(
        F.struct(place.alias("r"), F.lit(True).alias("own")),
        F.when(inside < after, F.struct((place - 1).alias("r"), F.lit(False).alias("own"))),
        F.when(inside >= range_rows - before, F.struct((place + 1).alias("r"), F.lit(False).alias("own"))),
    ))
    spread = rows.withColumn("_home", F.explode(homes))
    return spread.withColumns({"_range": F.col("_home.r"), "_own": F.col("_home.own")}).drop("_home")
