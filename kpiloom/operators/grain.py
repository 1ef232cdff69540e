"""Grain alignment and the canonical left-join chain."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.dates import Cadence, period_end, period_of, to_time
from kpiloom.functions.exact import exact_mean, exact_sum, is_integral, is_numeric, without_nan
from kpiloom.functions.joins import join_null_safe
from kpiloom.functions.ranges import with_neighbours
from kpiloom.operators.join_keys import as_mapping, found_formats, infer_join_keys

# Name parts that mark a ratio column.
RATIO_HINTS = ("pct", "percent", "rate", "share", "fraction", "ratio")


def ratio_columns(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Columns that average instead of sum: by name, or because at least two values all lie in [0, 1].

    Only columns the name does not decide are read, in one aggregate; the driver sees one row.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    named = {c for c in columns if any(h in c for h in RATIO_HINTS)}
    open_ = [c for c in columns if c not in named]
    if not open_:
        return named
    aggregates = []
    for i, c in enumerate(open_):
        cell = without_nan(F.col(f"`{c}`"), types[c])
        aggregates.append(((F.count(cell) >= 2) & (F.min(cell) >= 0) & (F.max(cell) <= 1)).alias(f"r{i}"))
    row = df.agg(*aggregates).first()
    return named | {c for i, c in enumerate(open_) if row[f"r{i}"]}


def _parts(df: DataFrame, time_column: str) -> tuple[list[str], list[str]]:
    """Dimension columns (everything not numeric) and value columns, without the time column."""
    rest = [f for f in df.schema.fields if f.name != time_column]
    return [f.name for f in rest if not is_numeric(f.dataType)], [f.name for f in rest if is_numeric(f.dataType)]


def downsample(df: DataFrame, time_column: str, to: Cadence | str, date_format: str | None = None) -> DataFrame:
    """One row per (target period, dimensions): ratios average, other numbers sum. Null keys keep their own group.

    A total of whole numbers beyond 64 bits is null.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    dims, values = _parts(df, time_column)
    ratios = ratio_columns(df, values)
    start = period_of(to_time(F.col(time_column), types[time_column], date_format), Cadence.parse(to).grain)
    aggregates = []
    for c in values:
        if c in ratios:
            aggregates.append(exact_mean(F.col(f"`{c}`"), types[c]).alias(c))
        elif is_integral(types[c]):
            whole = F.col(f"`{c}`").cast("bigint")
            aggregates.append(F.when(F.count(whole) == 0, F.lit(0)).otherwise(F.try_sum(whole)).alias(c))
        else:
            aggregates.append(F.coalesce(exact_sum(F.col(f"`{c}`"), types[c]), F.lit(0.0)).alias(c))
    grouped = df.withColumn(time_column, start).groupBy(time_column, *dims).agg(*aggregates)
    return grouped.select(*df.columns)


def upsample(df: DataFrame, time_column: str, source: Cadence | str, date_format: str | None = None) -> DataFrame:
    """Daily rows carrying each period's row forward, up to the last day of the last source period.

    Carry is by row: a null value stays null. Days before a group's first period get null values. Each row emits the
    days until its successor, so no calendar is joined and the only shuffle is one window over source rows. Two rows for
    the same period and dimensions are an error.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    dims, values = _parts(df, time_column)
    grain = Cadence.parse(source).grain
    start = period_of(to_time(F.col(time_column), types[time_column], date_format), grain)
    rows = df.withColumn(time_column, start).filter(F.col(time_column).isNotNull())
    bounds = rows.agg(F.min(time_column).alias("lo"), F.max(time_column).alias("hi")).first()
    day = F.col(time_column)
    grid_end = period_end(F.lit(bounds["hi"]).cast("date"), grain)
    if dims:
        window = Window.partitionBy(*dims).orderBy(time_column)
        rows = rows.withColumns({"_previous": F.lag(time_column).over(window), "_next": F.lead(time_column).over(window)})
    else:
        rows = with_neighbours(rows, time_column)
    following = F.col("_next")
    repeated = F.raise_error(F.lit("two rows share a period and its dimensions; aggregate them before upsampling"))
    last_day = F.when(following == day, repeated.cast("date")).otherwise(
        F.coalesce(F.date_sub(following, 1), grid_end)
    )
    own = F.transform(F.sequence(day, F.col("_last")), lambda d: F.struct(d.alias("d"), F.lit(True).alias("own")))
    lead_in = F.transform(
        F.sequence(F.lit(bounds["lo"]).cast("date"), F.date_sub(day, 1)),
        lambda d: F.struct(d.alias("d"), F.lit(False).alias("own")),
    )
    has_lead_in = F.col("_previous").isNull() & (day > F.lit(bounds["lo"]).cast("date"))
    spread = rows.withColumn("_last", last_day)
    spread = spread.withColumn("_day", F.explode(F.when(has_lead_in, F.concat(lead_in, own)).otherwise(own)))
    out = []
    for c in df.columns:
        if c == time_column:
            out.append(F.col("_day.d").alias(c))
        elif c in values:
            out.append(F.when(F.col("_day.own"), F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return spread.select(*out)


def align_grain(
    df: DataFrame, source: Cadence | str, target: Cadence | str, time_column: str | None, date_format: str | None = None
) -> DataFrame:
    """Bring a source to the target cadence; the same cadence or no time column leaves it unchanged."""
    source, target = Cadence.parse(source), Cadence.parse(target)
    if time_column is None or source == target:
        return df
    if target > source:
        return downsample(df, time_column, target, date_format)
    return upsample(df, time_column, source, date_format)


class Source:
    """One input of ``reconcile``: rows, cadence, its time column and, for text, the date format."""

    def __init__(
        self, df: DataFrame, cadence: Cadence | str = Cadence.DAILY, time_column: str | None = None,
        date_format: str | None = None, time_keys: dict[str, str | None] | None = None,
    ) -> None:
        self.df = df
        self.cadence = Cadence.parse(cadence)
        self.time_column = time_column
        self.date_format = date_format
        self.time_keys = time_keys or ({time_column: date_format} if time_column else {})


def _day_key(column: Column, data_type: T.DataType, date_format: str | None) -> Column:
    return to_time(column, data_type, date_format)


def _with_found_times(source: Source, keys: Sequence[str] | None) -> Source:
    """The source with the time keys that its content shows where it declares none; ``keys`` limits what is looked at."""
    types = {f.name: f.dataType for f in source.df.schema.fields}
    undeclared = [c for c, found in source.time_keys.items() if found is None and isinstance(types.get(c), T.StringType)]
    if source.time_keys and not undeclared and keys is not None:
        return source
    looked_at = undeclared if source.time_keys and keys is not None else (source.df.columns if keys is None else keys)
    declared = {c: found for c, found in source.time_keys.items() if c not in undeclared}
    found = {**found_formats(source.df, [c for c in looked_at if c not in declared]), **declared}
    missing = [c for c in undeclared if c not in found]
    if missing:
        raise ValueError(f"no date format fits column {missing[0]!r}")
    time_column = source.time_column or (next(iter(found)) if len(found) == 1 else None)
    return Source(source.df, source.cadence, time_column, found.get(time_column, source.date_format), found)


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join where null keys match; columns the left side already has are dropped from the right side."""
    overlap = [c for c in right.columns if c in left.columns and c not in keys]
    return join_null_safe(left, right.drop(*overlap), keys)


def reconcile(
    sources: Sequence[Source], join_keys: dict[str, dict[int, str]] | None = None, target: Cadence | str | None = None
) -> DataFrame:
    """One canonical table: align every source, normalize and rename its keys, then left-join in source order.

    ``join_keys`` maps each common key to the column of every source by index; without it keys are found by content. A
    source that declares no time column, or a text one without its format, has its time keys found by content too. Keys whose
    types differ between sources join as text. One source is returned unchanged.
    """
    if not sources:
        raise ValueError("reconcile needs at least one source")
    if len(sources) == 1:
        return sources[0].df
    sources = [_with_found_times(s, None if join_keys is None else [c[i] for c in join_keys.values() if i in c]) for i, s in enumerate(sources)]
    if join_keys is None:
        frames = [s.df for s in sources]
        coarsest = max(s.cadence for s in sources)
        compared = "timestamp" if all(s.cadence == coarsest for s in sources) else coarsest.grain
        join_keys = as_mapping(infer_join_keys(frames, [s.time_keys for s in sources], compared), frames)
    wanted = Cadence.parse(target) if target is not None else min(s.cadence for s in sources)
    frames = []
    for i, source in enumerate(sources):
        frame = align_grain(source.df, source.cadence, wanted, source.time_column, source.date_format)
        types = {f.name: f.dataType for f in frame.schema.fields}
        for common, columns in join_keys.items():
            column = columns.get(i)
            if column in types and (column in source.time_keys):
                frame = frame.withColumn(column, _day_key(F.col(column), types[column], source.time_keys[column]))
        frames.append(frame.withColumnsRenamed({c[i]: k for k, c in join_keys.items() if c.get(i) in frame.columns}))
    for common in join_keys:
        holding = [i for i, f in enumerate(frames) if common in f.columns]
        if len({isinstance(frames[i].schema[common].dataType, T.StringType) for i in holding}) > 1:
            for i in holding:
                frames[i] = frames[i].withColumn(common, F.col(f"`{common}`").cast("string"))

    def add(left: DataFrame, item: tuple[int, DataFrame]) -> DataFrame:
        index, right = item
        keys = [k for k in join_keys if k in left.columns and k in right.columns]
        if not keys:
            raise ValueError(f"source {index} shares no join key with the sources before it")
        return join_on_keys(left, right, keys)

    return reduce(add, list(enumerate(frames))[1:], frames[0])


def sorted_canonical(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The canonical table in key order, as it is shown and stored."""
    return df.orderBy(*keys)
