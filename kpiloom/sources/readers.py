"""Scans of business files."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.text import is_numeric_text

# Texts that mean "missing" in a delimited file.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]

FILE_TYPES = ("csv", "json", "parquet")


def standardize_columns(df: DataFrame) -> DataFrame:
    """Trimmed, lower-case names with underscores for spaces, in the same order."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    clashes = sorted(n for n, k in Counter(names).items() if k > 1)
    if clashes:
        raise ValueError(f"columns share a name after standardizing: {clashes}")
    return df.toDF(*names)


def _typed(name: str, counts: dict) -> Column:
    column = F.col(f"`{name}`")
    values = counts["values"]
    if values and counts["booleans"] == values:
        return (F.lower(column) == "true").alias(name)
    if values and counts["integers"] == values:
        return F.trim(column).cast("bigint").alias(name)
    if values and counts["numbers"] == values:
        return F.trim(column).cast("double").alias(name)
    return column


def load_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header. Missing-value texts become null before types are inferred, so they never force text.

    A doubled quote inside quotes is a quote. ``multi_line`` also reads line breaks inside quotes, at the price that a file
    is then read by one task.

    Type inference costs one extra pass; give ``schema`` for large inputs.
    """
    if schema is not None:
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
        raw = spark.read.csv(path, header=True, schema=text, enforceSchema=False, escape='"', multiLine=multi_line)
        cells = [_missing_to_null(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
        return standardize_columns(raw.select(*cells))
    raw = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=multi_line)
    raw = raw.select(*[_missing_to_null(c).alias(c) for c in raw.columns])
    aggregates = []
    for i, c in enumerate(raw.columns):
        cell = F.col(f"`{c}`")
        aggregates += [
            F.count(cell).alias(f"values{i}"),
            F.count_if(cell.rlike("^(?i:true|false)$")).alias(f"booleans{i}"),
            F.count_if(cell.rlike(r"^\s*[+-]?\d{1,19}\s*$") & cell.try_cast("bigint").isNotNull()).alias(f"integers{i}"),
            F.count_if(is_numeric_text(cell)).alias(f"numbers{i}"),
        ]
    found = raw.agg(*aggregates).first()
    kinds = ("values", "booleans", "integers", "numbers")
    typed = [_typed(c, {k: found[f"{k}{i}"] for k in kinds}) for i, c in enumerate(raw.columns)]
    return standardize_columns(raw.select(*typed))


def _missing_to_null(name: str) -> Column:
    cell = F.col(f"`{name}`")
    return F.when(~cell.isin(MISSING_TEXTS), cell)


def load_json(spark: SparkSession, path: str, lines: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """JSON file holding an array of records or one record; ``lines`` reads one record per line, which splits."""
    return standardize_columns(spark.read.json(path, multiLine=not lines, schema=schema))


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return standardize_columns(spark.read.parquet(path))


def load_source(spark: SparkSession, path: str, filetype: str) -> DataFrame:
    """Reader for a file type name such as ``csv`` or ``.JSON``."""
    kind = filetype.strip().lower().lstrip(".")
    readers = {"csv": load_csv, "json": load_json, "parquet": load_parquet}
    if kind not in readers:
        raise ValueError(f"unsupported file type {filetype!r}; use one of {FILE_TYPES}")
    return readers[kind](spark, path)
