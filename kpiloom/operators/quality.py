"""Data-quality issues and the 0..100 score of a source."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.exact import doubles, half_even, is_numeric, without_nan
from kpiloom.functions.selection import Selection
from kpiloom.functions.text import is_numeric_text

# Fixed values
NULL_RATIO_THRESHOLD = 0.05
IQR_FACTOR = 1.5
MIN_OUTLIER_SUPPORT = 8
SEVERITY_WEIGHTS = {"high": 10.0, "medium": 5.0, "low": 2.0}
MAX_IMPACT = 2.0

ISSUE_SCHEMA = "source_id string, column string, issue_type string, severity string, affected_row_count bigint"


def _candidate(column: str, issue: str, severity: Column, count: Column, applies: Column) -> Column:
    fields = F.struct(
        F.lit(column).alias("column"), F.lit(issue).alias("issue_type"),
        severity.alias("severity"), count.alias("affected_row_count"),
    )
    return F.when(applies & (count > 0), fields)


def _graded(ratio: Column, high: float, medium: float) -> Column:
    return F.when(ratio > high, "high").when(ratio > medium, "medium").otherwise("low")


def duplicate_rows(df: DataFrame, fingerprint: bool = False) -> DataFrame:
    """Row count and number of rows that repeat an earlier row (all columns equal, null equals null).

    Copies combine before the shuffle, so a row that fills a third of the table costs no more than any other. With
    ``fingerprint`` only two 64-bit hashes per row are shuffled instead of whole rows, for very wide tables; distinct
    rows then collide with probability about rows**2 / 2**129.
    """
    if fingerprint:
        nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in df.columns])
        cells = [F.col(f"`{c}`") for c in df.columns]
        keyed = df.select(F.xxhash64(nulls, *cells).alias("h1"), F.xxhash64(F.lit(1), *cells, nulls).alias("h2"))
    else:
        keyed = df
    counted = keyed.groupBy(*[F.col(f"`{c}`") for c in keyed.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return counted.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"),
    )


def quality_issues(
    df: DataFrame,
    source_id: str = "",
    measures: Collection[str] = (),
    allow_negative: Collection[str] = (),
    declared_numeric: Collection[str] = (),
    fingerprint: bool = False,
    null_threshold: float = NULL_RATIO_THRESHOLD,
) -> DataFrame:
    """All issues of a source. ``declared_numeric`` names columns profiled as numbers that may now hold text.

    Row, null, negative and type counts and the magnitudes of all numeric columns come from one aggregate over one scan; a second
    scan brings the values near quartiles and outlier bounds, a third the duplicates.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c, t in types.items() if is_numeric(t)]
    ranged = [c for c in (measures or numeric) if c in types and c not in allow_negative and is_numeric(types[c])]
    texts = [c for c in declared_numeric if c in types and isinstance(types[c], T.StringType)]
    names = list(types)
    cell = {c: without_nan(F.col(f"`{c}`"), t) for c, t in types.items()}
    conditions = {"row_count": F.lit(True)}
    conditions |= {f"values_{i}": cell[c].isNotNull() for i, c in enumerate(names) if c not in numeric}
    conditions |= {f"text_{names.index(c)}": cell[c].isNotNull() & ~is_numeric_text(cell[c]) for c in texts}
    found = Selection(df, doubles(df, numeric), conditions)
    fences = found.fences(IQR_FACTOR)
    counts = found.counts | {f"values_{names.index(c)}": found.buckets[c].total for c in numeric}
    counts |= {f"negative_{names.index(c)}": found.below_zero(c) for c in ranged}
    counts |= {f"outlier_{names.index(c)}": outside for c, (_, _, outside) in fences.items()}
    stats = df.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"{c} bigint" for c in counts))
    always = F.lit(True)
    candidates = []
    for i, c in enumerate(names):
        missing = F.col("row_count") - F.col(f"values_{i}")
        ratio = F.try_divide(missing, "row_count")
        candidates.append(_candidate(c, "missing_values", _graded(ratio, 0.3, 0.1), missing, ratio > null_threshold))
    for c in ranged:
        candidates.append(_candidate(c, "invalid_range", F.lit("high"), F.col(f"negative_{names.index(c)}"), always))
    for c in texts:
        candidates.append(_candidate(c, "type_violation", F.lit("medium"), F.col(f"text_{names.index(c)}"), always))
    for c in fences:
        i = names.index(c)
        enough = F.col(f"values_{i}") >= MIN_OUTLIER_SUPPORT
        candidates.append(_candidate(c, "outlier", F.lit("low"), F.col(f"outlier_{i}"), enough))
    issues = stats.select(F.inline(F.array_compact(F.array(*candidates))))
    duplicates = duplicate_rows(df, fingerprint).filter(F.col("duplicates") > 0).select(
        F.lit("(all columns)").alias("column"), F.lit("duplicate_rows").alias("issue_type"),
        _graded(F.try_divide("duplicates", "row_count"), 0.10, 0.02).alias("severity"),
        F.col("duplicates").alias("affected_row_count"),
    )
    return issues.unionByName(duplicates).select(
        F.lit(source_id).alias("source_id"), "column", "issue_type", "severity",
        F.col("affected_row_count").cast("bigint").alias("affected_row_count"),
    )


def score_issues(issues: DataFrame, row_counts: DataFrame) -> DataFrame:
    """Score per source: 100 less a penalty per issue, larger for more affected rows.

    ``row_counts`` has one row per source (``source_id``, ``row_count``), so clean sources score 100.
    """
    weights = F.create_map(*[F.lit(x) for pair in SEVERITY_WEIGHTS.items() for x in pair])
    weight = F.coalesce(F.try_element_at(weights, F.col("severity")), F.lit(2.0))
    share = F.coalesce(F.try_divide("affected_row_count", "row_count"), F.lit(0.0))
    penalty = F.when(F.col("severity").isNotNull(), weight * F.least(1.0 + share, F.lit(MAX_IMPACT))).otherwise(0.0)
    scored = row_counts.join(issues, "source_id", "left").groupBy("source_id", "row_count").agg(
        F.sum(penalty.cast("decimal(20,10)")).cast("double").alias("penalty"), F.count("issue_type").alias("issue_count")
    )
    clamped = F.greatest(F.least(100.0 - F.col("penalty"), F.lit(100.0)), F.lit(0.0))
    return scored.select("source_id", "row_count", "issue_count", half_even(clamped, 1).alias("score"))


def by_severity(issues: DataFrame) -> DataFrame:
    """Issues, most severe first."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return issues.orderBy("source_id", rank, F.desc("affected_row_count"), "column", "issue_type")


def source_rows(df: DataFrame, source_id: str = "") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(source_id).alias("source_id"), "row_count")
