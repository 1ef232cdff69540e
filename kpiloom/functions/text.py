"""Text shown to people, stable keys and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpiloom.functions.exact import half_even

NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"


def is_numeric_text(column: Column) -> Column:
    """Text that reads as a number; type suffixes such as ``1d`` do not."""
    return column.rlike(NUMERIC_TEXT)


def number(value: Column) -> Column:
    """``1,234.50``; ``n/a`` when missing."""
    return F.coalesce(F.format_number(half_even(value.cast("double"), 2), 2), F.lit("n/a"))


def plain(value: Column) -> Column:
    """A double with up to four decimals and no exponent: ``-1500.0``, ``12.25``."""
    return F.regexp_replace(value.cast("decimal(34,4)").cast("string"), r"(\.\d+?)0+$", "$1")


def fixed(value: Column, digits: int) -> Column:
    """A fixed number of decimals without separators, rounded by the exact binary value; missing stays missing."""
    return F.replace(F.format_number(half_even(value.cast("double"), digits), digits), F.lit(","), F.lit(""))


def signed_percent(fraction: Column) -> Column:
    """A fraction as ``+8.4%``."""
    shown = fixed(fraction.cast("double") * 100, 1)
    return F.concat(F.when(F.startswith(shown, F.lit("-")), "").otherwise("+"), shown, F.lit("%"))


def direction(value: Column) -> Column:
    return F.when(value > 0, "up").when(value < 0, "down").otherwise("flat")


def relative_change(before: Column, after: Column) -> Column:
    """(after - before) / abs(before); null when before is zero or either side is missing."""
    return F.when(before != 0, F.try_divide(after - before, F.abs(before)))


def stable_id(*parts: Column) -> Column:
    """Deterministic key of the parts; missing parts count as empty text."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def stable_json(struct: Column) -> Column:
    """JSON text of a struct; build the struct with fields in alphabetical order for a stable text."""
    return F.to_json(struct, {"ignoreNullFields": "false"})


def bullets(text: Column) -> Column:
    """Lines of a bulleted text without markers (``-``, ``*``, dots, ``1.``, ``2)``) and without empty lines."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    stripped = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^[-*•]+", "")))
    unnumbered = F.transform(stripped, lambda x: F.trim(F.when(F.length(x) > 2, F.regexp_replace(x, r"^\d[.)]", "")).otherwise(x)))
    kept = F.filter(unnumbered, lambda x: F.length(x) > 0)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.trim(text)))
