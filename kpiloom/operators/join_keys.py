"""Join keys and time columns found by content.

Each source is scanned once for the date format of its text columns and once for a sketch of the distinct values of every column
that could be a key. Pairs of columns are compared by their sketches, one row a column. What the sketches cannot rule out is
counted exactly, so the outcome does not depend on their error.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.dates import DATE_FORMATS, best_format, is_time_type, parses_as, period_of, to_time
from kpiloom.functions.exact import is_integral
from kpiloom.session import cut_lineage

#: Share of distinct values that must be found on the other side.
CONTAINED = 0.8
#: Share of distinct values among all from which a column identifies its rows.
UNIQUE = 0.95
#: Sketches keep the 2**12 smallest hashes: overlaps of fewer values are exact, larger ones are off by 1.6% of the union.
SKETCH_BITS = 12
#: Standard errors by which a sketch may miss the share before the pair is ruled out without an exact count.
MARGIN = 5


@dataclass(frozen=True)
class KeyPair:
    """Columns of an earlier and a later source that join; ``unique`` if the later one identifies its rows."""

    left: int
    left_column: str
    right: int
    right_column: str
    unique: bool
    shared: int
    left_distinct: int
    right_distinct: int

    @property
    def likeness(self) -> float:
        return self.shared / (self.left_distinct + self.right_distinct - self.shared)


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def found_formats(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str | None]:
    """The time columns among ``columns`` (all by default): None for time types, the name of the format for text.

    A text column is a time column if more than 90% of its values have one format. One scan for all text columns; an empty or
    all-null column is none.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = [c for c in (df.columns if columns is None else columns) if c in types]
    found: dict[str, str | None] = {c: None for c in wanted if is_time_type(types[c])}
    texts = [c for c in wanted if isinstance(types[c], T.StringType)]
    if texts:
        counted = [F.array(*[F.count_if(parses_as(_column(c), n)) for n, _, _ in DATE_FORMATS]).alias(f"m{i}") for i, c in enumerate(texts)]
        values = [F.count(_column(c)).alias(f"n{i}") for i, c in enumerate(texts)]
        row = df.agg(*counted, *values).select(*[best_format(F.col(f"m{i}"), F.col(f"n{i}")).alias(f"f{i}") for i in range(len(texts))]).first()
        found |= {c: row[f"f{i}"] for i, c in enumerate(texts) if row[f"f{i}"] is not None}
    return found


def _comparable(df: DataFrame, formats: dict[str, str | None], grain: str) -> dict[str, tuple[str, Column]]:
    """Kind and comparable text of every column that could be a key: times by their period, texts and whole numbers."""
    out = {}
    for f in df.schema.fields:
        if f.name in formats:
            out[f.name] = ("time", period_of(to_time(_column(f.name), f.dataType, formats[f.name]), grain).cast("string"))
        elif is_integral(f.dataType) or (isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0):
            out[f.name] = ("code", _column(f.name).cast("string"))
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = ("code", _column(f.name))
    return out


def _sketches(frames: Sequence[DataFrame], columns: Sequence[dict[str, tuple[str, Column]]]) -> DataFrame:
    """One row for each column of each source: kind, whether it is a number, values, distinct values and their sketch."""
    parts = []
    for place, (df, of_source) in enumerate(zip(frames, columns, strict=True)):
        if not of_source:
            continue
        types = {f.name: f.dataType for f in df.schema.fields}
        aggregates = []
        for i, (_, text) in enumerate(of_source.values()):
            aggregates += [F.count(text).alias(f"n{i}"), F.theta_sketch_agg(text, F.lit(SKETCH_BITS)).alias(f"s{i}")]
        described = [
            F.struct(
                F.lit(place).alias("source"), F.lit(c).alias("column"), F.lit(kind).alias("kind"),
                F.lit(not isinstance(types[c], T.StringType) and kind == "code").alias("number"), F.col(f"n{i}").alias("n"),
                F.theta_sketch_estimate(f"s{i}").alias("distinct"), F.col(f"s{i}").alias("sketch"),
            )
            for i, (c, (kind, _)) in enumerate(of_source.items())
        ]
        parts.append(df.agg(*aggregates).select(F.inline(F.array(*described))))
    return reduce(DataFrame.unionByName, parts)


def _possible(sketches: DataFrame) -> DataFrame:
    """Pairs of columns of an earlier and a later source that the sketches do not rule out."""
    kept = float(2**SKETCH_BITS)
    rows = cut_lineage(sketches.filter("n > 0"))
    left = rows.select(*[F.col(c).alias(f"l_{c}") for c in rows.columns])
    right = rows.select(*[F.col(c).alias(f"r_{c}") for c in rows.columns])
    both = left.join(right, (F.col("l_kind") == F.col("r_kind")) & (F.col("l_source") < F.col("r_source")))
    shared = F.theta_sketch_estimate(F.theta_intersection("l_sketch", "r_sketch")).cast("double")
    sampled = F.least(F.lit(1.0), F.lit(kept) / F.greatest("l_distinct", "r_distinct"))
    smaller = F.least("l_distinct", "r_distinct")
    both = both.withColumns({"shared": shared, "needed": CONTAINED * smaller, "sampled": sampled})
    error = F.sqrt(F.greatest("shared", "needed") * (1 - F.col("sampled")) / F.col("sampled"))
    slack = F.when(F.col("sampled") < 1, MARGIN / F.sqrt(F.lit(kept))).otherwise(0.0)  # of a distinct count
    maybe_unique = F.col("r_distinct") * (1 + slack) >= UNIQUE * F.col("r_n")
    near = F.col("shared") + MARGIN * error >= F.col("needed") * (1 - slack)
    numbers = F.col("l_number") | F.col("r_number")
    return both.filter(near & (maybe_unique | ~numbers)).select(
        "l_source", "l_column", "r_source", "r_column", numbers.alias("numbers"), maybe_unique.alias("maybe_unique")
    )


def _counted(frames: Sequence[DataFrame], columns: Sequence[dict[str, tuple[str, Column]]], pairs: Sequence) -> list[KeyPair]:
    """The pairs with exact numbers of distinct and shared values and of the later side's values, in one job.

    Values of both sides are grouped first, so that a hot value is one row of the join.
    """
    if not pairs:
        return []
    parts = []
    for i, p in enumerate(pairs):
        sides = []
        for source, column in ((p.l_source, p.l_column), (p.r_source, p.r_column)):
            values = frames[source].select(columns[source][column][1].alias("value")).filter("value IS NOT NULL")
            sides.append(values.groupBy("value").agg(F.count(F.lit(1)).alias("n")))
        left, right = (side.select("value", F.col("n").alias(name)) for side, name in zip(sides, ("l", "r"), strict=True))
        parts.append(left.join(right, "value", "full").agg(
            F.lit(i).alias("pair"), F.count("l").alias("left_distinct"), F.count("r").alias("right_distinct"),
            F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"), F.sum("r").alias("right_values"),
        ))
    out = []
    for row in reduce(DataFrame.unionByName, parts).collect():  # one row a pair of columns
        p = pairs[row.pair]
        unique = row.right_distinct >= UNIQUE * row.right_values
        out.append(KeyPair(p.l_source, p.l_column, p.r_source, p.r_column, unique, row.shared, row.left_distinct, row.right_distinct))
    return out


def _chosen(pairs: Sequence[KeyPair]) -> list[KeyPair]:
    """The most alike pairs, each column once; equal likeness goes by place and name."""
    out, used = [], set()
    for p in sorted(pairs, key=lambda p: (-p.likeness, p.left, p.left_column, p.right_column)):
        if p.right_column not in used and (p.left, p.left_column) not in used:
            used |= {p.right_column, (p.left, p.left_column)}
            out.append(p)
    return out


def infer_join_keys(
    frames: Sequence[DataFrame], formats: Sequence[dict[str, str | None]] | None = None, grain: str = "timestamp"
) -> list[KeyPair]:
    """How each source after the first joins with the sources before it.

    A column that identifies its rows joins the earlier column most like it, if 80% of that column's distinct values are found in
    it. A source without such a column joins by all text and time columns of which, on the side with fewer values, 80% are
    found on the other and that have at least two values. Numbers join by columns that identify rows only, since ranges of
    small numbers overlap by chance. Nulls do not count; a source that shares nothing, or is empty, gets no key. Times compare
    by their period of ``grain``, whatever their type or text format: where one source is weekly, a day that it does not name is no
    difference. Whole numbers compare with equal texts.
    """
    formats = [found_formats(df) for df in frames] if formats is None else formats
    columns = [_comparable(df, found, grain) for df, found in zip(frames, formats, strict=True)]
    if len(frames) < 2 or not all(columns):
        return []
    possible = _possible(_sketches(frames, columns)).collect()  # at most one row for each pair of columns
    order = lambda p: (p.r_source, p.l_source, p.l_column, p.r_column)
    out = []
    keyed = [p for p in _counted(frames, columns, sorted((p for p in possible if p.maybe_unique), key=order))
             if p.unique and p.shared >= CONTAINED * p.left_distinct]
    for right in range(1, len(frames)):
        out += _chosen([p for p in keyed if p.right == right])[:1]
    open_ = set(range(1, len(frames))) - {p.right for p in out}
    shared = _counted(frames, columns, sorted((p for p in possible if p.r_source in open_ and not p.numbers), key=order))
    for right in sorted(open_):
        enough = [p for p in shared if p.right == right and min(p.left_distinct, p.right_distinct) >= 2
                  and p.shared >= CONTAINED * min(p.left_distinct, p.right_distinct)]
        out += _chosen(enough)
    return out


def as_mapping(pairs: Sequence[KeyPair], frames: Sequence[DataFrame]) -> dict[str, dict[int, str]]:
    """The pairs as ``reconcile`` takes them: a common name to the column of each source.

    The name is that of the earliest source's column; where another source has a column of that name which is no part of the
    key, the source's number is added.
    """
    groups: list[dict[int, str]] = []
    for p in sorted(pairs, key=lambda p: (p.right, p.left, p.left_column)):
        group = next((g for g in groups if g.get(p.left) == p.left_column and p.right not in g), None)
        if group is None:
            groups.append(group := {p.left: p.left_column})
        group[p.right] = p.right_column
    mapping = {}
    for group in groups:
        first = min(group)
        name = group[first]
        if name in mapping or any(name in f.columns and group.get(i) != name for i, f in enumerate(frames)):
            name = f"{name}_{first}"
        mapping[name] = group
    return mapping
