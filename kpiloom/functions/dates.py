"""Periods, cadences and strict date-text parsing."""

from __future__ import annotations

from datetime import timedelta
from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Cadence(IntEnum):
    """Finer to coarser. A name outside this list is an error, never a silent default."""

    REAL_TIME = 0
    DAILY = 1
    WEEKLY = 2
    MONTHLY = 3

    @classmethod
    def parse(cls, value: "Cadence | str") -> "Cadence":
        if isinstance(value, cls):
            return value
        try:
            return cls[str(value).strip().upper().replace("-", "_").replace(" ", "_")]
        except KeyError:
            raise ValueError(f"unknown cadence {value!r}; use one of {[c.name for c in cls]}") from None

    @property
    def grain(self) -> str:
        return {Cadence.WEEKLY: "week", Cadence.MONTHLY: "month"}.get(self, "day")


GRAINS = ("day", "week", "month", "timestamp")

# Accepted date texts in order of preference, as (name, Spark pattern, shape that must match fully).
# Single-letter fields accept padded and unpadded numbers; the shape insists on a four-digit year.
DATE_FORMATS = [
    ("Y-m-d", "y-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("Y/m/d", "y/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("d-m-Y", "d-M-y", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d/m/Y", "d/M/y", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("m/d/Y", "M/d/y", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("Y-m-d H:M:S", "y-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("Y-m-dTH:M:S", "y-M-d'T'H:m:s", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("Y-m-d H:M", "y-M-d H:m", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$"),
    ("d.m.Y", "d.M.y", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("Ymd", "yyyyMMdd", r"^\d{8}$"),
    ("d-b-Y", "d-MMM-y", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
    ("d b Y", "d MMM y", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("b d, Y", "MMM d, y", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
]

# Share of non-null texts that must parse before a text column counts as a time column.
TEMPORAL_SHARE = 0.9


def is_time_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def parse_text(column: Column, format_name: str) -> Column:
    """Timestamp without zone for text of one named format, null for anything else."""
    pattern, shape = next((p, s) for n, p, s in DATE_FORMATS if n == format_name)
    return F.when(column.rlike(shape), F.try_to_timestamp(column, F.lit(pattern))).cast("timestamp_ntz")


def parses_as(column: Column, format_name: str) -> Column:
    return F.coalesce(parse_text(column, format_name).isNotNull(), F.lit(False))


def best_format(match_counts: Column, values: Column) -> Column:
    """Name of the first format whose share of parsed values exceeds the limit; counts come in list order."""
    names = F.array(*[F.lit(n) for n, _, _ in DATE_FORMATS])
    enough = F.transform(match_counts, lambda n: n > values * F.lit(TEMPORAL_SHARE))
    position = F.array_position(enough, F.lit(True))
    return F.when((values > 0) & (position > 0), F.try_element_at(names, position.cast("int")))


def to_time(column: Column, data_type: T.DataType, format_name: str | None = None) -> Column:
    """A time column of any accepted type as timestamp_ntz; unparseable values become null."""
    if isinstance(data_type, T.StringType):
        if format_name is None:
            raise ValueError("a text time column needs the format found by profiling")
        return parse_text(column, format_name)
    if is_time_type(data_type):
        return column.cast("timestamp_ntz")
    raise TypeError(f"{data_type.simpleString()} is not a time type")


def period_of(time: Column, grain: str) -> Column:
    """First day of the period: Monday for weeks, the 1st for months. ``timestamp`` keeps the full time."""
    if grain == "timestamp":
        return time.cast("timestamp_ntz")
    day = F.to_date(time)
    if grain == "day":
        return day
    if grain in ("week", "month"):
        return F.trunc(day, grain)
    raise ValueError(f"unknown grain {grain!r}; use one of {GRAINS}")


def period_end(period: Column, grain: str) -> Column:
    """Last day of the period that starts on ``period``."""
    if grain == "day":
        return period
    if grain == "week":
        return F.date_add(period, 6)
    if grain == "month":
        return F.last_day(period)
    raise ValueError(f"no last day for grain {grain!r}")


def _following(start, grain: str):
    if grain == "day":
        return start + timedelta(days=1)
    if grain == "week":
        return start + timedelta(days=7)
    if grain == "month":
        return (start.replace(day=1) + timedelta(days=32)).replace(day=1)
    raise ValueError(f"unknown grain {grain!r}; use one of {GRAINS}")


def within_periods(column: Column, data_type: T.DataType, periods: list, grain: str, date_format: str | None = None) -> Column:
    """Rows whose time falls in one of the given period starts.

    A time-typed column is compared as it is stored, against literals of its own type, so the filter reaches the scan.
    """
    if isinstance(data_type, T.StringType):
        column, stored = to_time(column, data_type, date_format), "timestamp_ntz"
    else:
        stored = data_type.simpleString()
    condition = F.lit(False)
    for start in periods:
        first = F.lit(start).cast(stored)
        if grain == "timestamp":
            condition = condition | (column == first)
        else:
            condition = condition | ((column >= first) & (column < F.lit(_following(start, grain)).cast(stored)))
    return condition
