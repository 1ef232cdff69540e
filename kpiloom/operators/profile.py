"""Column profiles: one row per (source, column)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.dates import DATE_FORMATS, best_format, is_time_type, parses_as
from kpiloom.functions.exact import half_even, is_float, is_integral, is_numeric, without_nan
from kpiloom.session import cut_lineage

SAMPLE_SIZE = 5
HEAD_ROWS = 50
KEY_RATIO = 0.95
#: Ratios of a sketch from which on near-uniqueness is counted exactly: two of its errors of 5% below the limit.
DOUBTFUL_RATIO = 0.85


def _kind(data_type: T.DataType) -> str:
    if is_time_type(data_type):
        return "time"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if is_integral(data_type):
        return "int"
    if is_numeric(data_type):  # decimals are continuous measures, like doubles
        return "float"
    return "text"


def _cells(field: T.StructField, position: int) -> Column:
    """One cell as (column position, whole number, double, text); only the slot of its type is filled."""
    c = F.col(f"`{field.name}`")
    kind = _kind(field.dataType)
    whole, real, text = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(field.dataType, T.DateType):
        whole = F.unix_date(c).cast("bigint")
    elif isinstance(field.dataType, T.TimestampNTZType):  # without a zone: no conversion may merge two times
        clock = (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * 1_000_000
        micros = (F.date_part(F.lit("SECONDS"), c) * 1_000_000).cast("bigint")
        whole = F.unix_date(F.to_date(c)).cast("bigint") * 86_400_000_000 + clock + micros
    elif kind == "time":
        whole = F.unix_micros(c)
    elif kind in ("int", "bool"):
        whole = c.cast("bigint")
    elif is_float(field.dataType):
        real = without_nan(c, field.dataType).cast("double")
    else:
        text = c.cast("string")
    return F.struct(F.lit(position).alias("position"), whole.alias("w"), real.alias("r"), text.alias("t"))


def _exact_statistics(df: DataFrame) -> DataFrame:
    """Counts, distinct counts, integer range and date-format hits of all columns from one scan and one wide shuffle.

    Cells are counted per (column, value) first. Repeated values therefore cost nothing after the map side, and text is
    parsed once per distinct value instead of once per row.
    """
    fields = df.schema.fields
    cells = df.select(F.inline(F.array(*[_cells(f, i) for i, f in enumerate(fields)])))
    counted = cells.groupBy("position", "w", "r", "t").agg(F.count(F.lit(1)).alias("n"))
    present = F.coalesce(F.col("w").isNotNull() | F.col("r").isNotNull() | F.col("t").isNotNull(), F.lit(False))
    text_columns = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)]
    hits = [
        F.coalesce(F.sum(F.when(parses_as(F.col("t"), name), F.col("n"))), F.lit(0)) if text_columns else F.lit(0)
        for name, _, _ in DATE_FORMATS
    ]
    numeric = [i for i, f in enumerate(fields) if is_numeric(f.dataType)]
    own = F.coalesce(F.col("r"), F.col("w").cast("double"), F.col("t").try_cast("double"))
    number = F.when(F.col("position").isin(numeric), own)
    return counted.groupBy("position").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("value_count"),
        F.count(F.when(present, F.lit(1))).alias("cardinality"),
        F.min("w").alias("min_whole"),
        F.max("w").alias("max_whole"),
        F.min(number).alias("min_number"),
        F.max(number).alias("max_number"),
        F.array(*hits).alias("format_hits"),
    )


def _approximate_statistics(df: DataFrame) -> DataFrame:
    """The same table from one aggregate row: distinct counts come from a bounded sketch.

    Whole-number and text columns that look nearly unique, on which roles depend, are then counted exactly; only these are shuffled.
    """
    aggregates: list[Column] = [F.count(F.lit(1)).alias("row_count")]
    rows = []
    for i, f in enumerate(df.schema.fields):
        c = without_nan(F.col(f"`{f.name}`"), f.dataType)
        whole = c.cast("bigint") if _kind(f.dataType) == "int" else F.lit(None).cast("bigint")
        number = c.cast("double") if is_numeric(f.dataType) else F.lit(None).cast("double")
        text = isinstance(f.dataType, T.StringType)
        hits = [F.count_if(parses_as(c, name)) if text else F.lit(0).cast("bigint") for name, _, _ in DATE_FORMATS]
        aggregates.append(
            F.struct(
                F.count(c).alias("value_count"),
                F.approx_count_distinct(c).alias("cardinality"),
                F.min(whole).alias("min_whole"),
                F.max(whole).alias("max_whole"),
                F.min(number).alias("min_number"),
                F.max(number).alias("max_number"),
                F.array(*hits).alias("format_hits"),
            ).alias(f"s{i}")
        )
        rows.append(F.struct(F.lit(i).alias("position"), "row_count", f"s{i}.*"))
    found = cut_lineage(df.agg(*aggregates).select(F.inline(F.array(*rows))))  # one row for each column
    doubtful = [
        r.position for r in found.filter(F.col("cardinality") > F.col("value_count") * DOUBTFUL_RATIO).select("position").collect()
        if _kind(df.schema.fields[r.position].dataType) in ("int", "text")
    ]  # one row for each column
    if not doubtful:
        return found
    exact = _exact_cardinality(df, doubtful)
    return found.join(exact, "position", "left").withColumn("cardinality", F.coalesce("exact", "cardinality")).drop("exact")


def _exact_cardinality(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """(``position``, ``exact``) distinct values of these columns, by 128 bits of hash: equal ones meet first, then are counted."""
    cells = []
    for i in positions:
        c = F.col(f"`{df.schema.fields[i].name}`")
        text = c.cast("string")
        cells.append(F.when(c.isNotNull(), F.struct(F.lit(i).alias("position"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), F.reverse(text)).alias("g"))))
    values = df.select(F.inline(F.array_compact(F.array(*cells)))).distinct()
    return values.groupBy("position").agg(F.count(F.lit(1)).alias("exact"))


def _samples(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """First values of every column in a stated row order.

    The first rows of the table, a bounded number, answer most columns in one job. Only columns with too few values
    there are searched on their own, each reading that column and keeping five rows per task.
    """
    fields = df.schema.fields
    cells = []
    for i, f in enumerate(fields):
        c = without_nan(F.col(f"`{f.name}`"), f.dataType)
        number = c.cast("double") if is_numeric(f.dataType) else F.lit(None).cast("double")
        cells.append(F.struct(c.cast("string").alias("v"), number.alias("x")).alias(f"c{i}"))
    keys = [f"`{k}`" for k in order_by]
    ties = [f"`{f.name}`" for f in fields if f.name not in order_by and _orderable(f.dataType)]
    head = df.orderBy(*keys, *ties).limit(HEAD_ROWS).select(*cells).collect()
    known, parts = [], []
    for i, f in enumerate(fields):
        values = [r[i] for r in head if r[i]["v"] is not None][:SAMPLE_SIZE]
        if len(values) == SAMPLE_SIZE or len(head) < HEAD_ROWS:
            known.append((i, [v["v"] for v in values], [v["x"] for v in values if v["x"] is not None]))
        else:
            parts.append(_first_values(df, i, f, order_by))
    schema = "position int, sample_values array<string>, sample_numbers array<double>"
    return reduce(DataFrame.unionByName, parts, df.sparkSession.createDataFrame(known, schema))


def _orderable(data_type: T.DataType) -> bool:
    return not isinstance(data_type, (T.MapType, T.VariantType, T.StructType, T.ArrayType))


def _first_values(df: DataFrame, position: int, field: T.StructField, order_by: Sequence[str]) -> DataFrame:
    """First non-null values of one column."""
    c = without_nan(F.col(f"`{field.name}`"), field.dataType)
    names = [f"_k{j}" for j in range(len(order_by))]
    keys = [F.col(f"`{k}`").alias(n) for k, n in zip(order_by, names)]
    first = df.select(c.alias("_v"), *keys).filter(F.col("_v").isNotNull()).orderBy(*names, "_v").limit(SAMPLE_SIZE)
    number = F.col("_v").cast("double") if is_numeric(field.dataType) else F.lit(None).cast("double")
    item = F.struct(*names, F.col("_v").cast("string").alias("v"), number.alias("x"))
    got = first.agg(F.array_sort(F.collect_list(item)).alias("s"))
    return got.select(
        F.lit(position).alias("position"), F.col("s.v").alias("sample_values"),
        F.filter(F.col("s.x"), lambda x: x.isNotNull()).alias("sample_numbers"),
    )


def detected_role() -> Column:
    """Temporal, then float numerical, then near-unique text or dense whole numbers as identifier, then the rest."""
    near_unique = F.col("cardinality_ratio_exact") > KEY_RATIO
    span = F.col("max_whole").cast("decimal(20,0)") - F.col("min_whole").cast("decimal(20,0)")
    dense = (F.col("min_whole") >= 0) & (span <= F.col("value_count") * 2)
    return (
        F.when((F.col("kind") == "time") | F.col("date_format").isNotNull(), "temporal")
        .when(F.col("kind") == "float", "numerical")
        .when((F.col("kind") == "text") & near_unique, "identifier")
        .when((F.col("kind") == "int") & near_unique & dense, "identifier")
        .when(F.col("kind") == "int", "numerical")
        .otherwise("categorical")
    )


def profile(df: DataFrame, source_id: str = "", sample_order: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Profile every column. ``sample_order`` names the row order for sample values; without it none are taken."""
    fields = df.schema.fields
    schema = "source_id string, position int, name string, dtype string, kind string"
    described = df.sparkSession.createDataFrame(
        [(source_id, i, f.name, f.dataType.simpleString(), _kind(f.dataType)) for i, f in enumerate(fields)], schema
    )
    statistics = _approximate_statistics(df) if approximate else _exact_statistics(df)
    rows = described.join(statistics, "position", "left")
    for c in ("row_count", "value_count", "cardinality"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)))
    if sample_order:
        rows = rows.join(_samples(df, sample_order), "position", "left")
    else:
        rows = rows.withColumn("sample_values", F.array().cast("array<string>"))
        rows = rows.withColumn("sample_numbers", F.array().cast("array<double>"))
    hits = F.when(F.col("dtype") == "string", F.col("format_hits"))
    rows = (
        rows.withColumn("date_format", best_format(hits, F.col("value_count")))
        .withColumn("null_count", F.col("row_count") - F.col("value_count"))
        .withColumn("cardinality_ratio_exact", F.coalesce(F.try_divide("cardinality", "value_count"), F.lit(0.0)))
        .withColumn("detected_role", detected_role())
    )
    return rows.select(
        "source_id", "position", "name", "dtype", "row_count", "null_count",
        half_even(F.coalesce(F.try_divide("null_count", "row_count"), F.lit(0.0)), 4).alias("null_ratio"),
        "cardinality",
        half_even(F.col("cardinality_ratio_exact"), 4).alias("cardinality_ratio"),
        ((F.col("row_count") > 0) & (F.col("cardinality") == F.col("row_count"))).alias("is_unique"),
        "detected_role", "date_format", "sample_values", "sample_numbers", "min_number", "max_number",
    )


def time_column(profiles: DataFrame) -> DataFrame:
    """Leftmost time column of each source, with its text format."""
    found = profiles.filter(F.col("detected_role") == "temporal")
    return found.groupBy("source_id").agg(F.min(F.struct("position", "name", "date_format")).alias("c")).select(
        "source_id", F.col("c.name").alias("time_column"), F.col("c.date_format").alias("date_format")
    )
