"""Stored datasets and metadata tables: write, read, preview, upsert, append, cascade delete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiloom.sources.readers import load_source
from kpiloom.sources.snapshots import StoredTable

PREVIEW_ROWS = 20

# Tables keyed by KPI that go when their dataset goes, and tables keyed by source.
KPI_TABLES = ("kpi_computations", "anomalies", "findings", "insights", "recommendation_packages", "llm_calls")
SOURCE_TABLES = ("profiles", "semantic_contracts", "quality_reports", "sources")


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """Write a canonical dataset and return its path. ``csv`` is written gzipped with a header."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.csv(path, header=True, compression="gzip")
    else:
        raise ValueError(f"unsupported dataset format {fmt!r}")
    return path


def dataset_location(datasets: DataFrame, user_id: str, dataset_id: str) -> tuple[str, str]:
    """Path and file type of one dataset row; a single-source dataset points at its source file."""
    owned = datasets.filter((F.col("user_id") == user_id) & (F.col("dataset_id") == dataset_id))
    row = owned.select("path", "filetype").first()
    if row is None:
        raise LookupError(f"dataset {dataset_id} not found")
    return row["path"], row["filetype"]


def read_dataset(spark: SparkSession, datasets: DataFrame, user_id: str, dataset_id: str) -> DataFrame:
    path, filetype = dataset_location(datasets, user_id, dataset_id)
    return load_source(spark, path, filetype)


def preview(df: DataFrame, order_by: Sequence[str], page: int = 1, page_size: int = PREVIEW_ROWS) -> DataFrame:
    """One page of rows in a stated order."""
    return df.orderBy(*order_by).offset((max(1, page) - 1) * page_size).limit(page_size)


def page_counts(df: DataFrame, page_size: int = PREVIEW_ROWS) -> DataFrame:
    """Row count and number of pages, at least one."""
    rows = F.count(F.lit(1))
    pages = F.greatest(F.ceil(rows / F.lit(float(page_size))), F.lit(1)).cast("bigint")
    return df.agg(rows.alias("row_count"), pages.alias("total_pages"))


def preview_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text; times in ISO form, missing values kept as null."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order. Rows beyond the first are cut before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], changed_at: str) -> DataFrame:
    """Replace rows by key: the newest version wins, and an incoming row wins a tie."""
    both = existing.withColumn("_incoming", F.lit(0)).unionByName(incoming.withColumn("_incoming", F.lit(1)))
    return newest(both, keys, [F.desc(changed_at), F.desc("_incoming")]).drop("_incoming")


def append_rows(df: DataFrame, path: str, writer: str | None = None, batch: int | None = None) -> None:
    """Add event rows (feedback, calls, timings, activity) to a stored log, which streams append to as well.

    With a ``writer`` that numbers its batches, a batch that is sent again adds nothing.
    """
    StoredTable(df.sparkSession, path).append(df, writer, batch)


def read_rows(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows of a stored log or table, each once, whoever appended them."""
    return StoredTable(spark, path).read(version)


def delete_datasets(tables: dict[str, StoredTable], dataset_ids: DataFrame) -> None:
    """Delete datasets (column ``dataset_id``), their KPIs and everything derived from stored tables.

    What hangs on a row goes before the row itself, so a deletion that was cut off is completed by running it again.
    """
    gone = dataset_ids.select("dataset_id").distinct()
    if "kpis" in tables:
        gone_kpis = tables["kpis"].read().join(gone, "dataset_id", "left_semi").select("kpi_id")
        for name in KPI_TABLES:
            if name in tables:
                tables[name].delete(gone_kpis, "kpi_id")
        tables["kpis"].delete(gone, "dataset_id")
    tables["canonical_datasets"].delete(gone, "dataset_id")


def delete_sources(tables: dict[str, StoredTable], source_ids: DataFrame) -> None:
    """Delete sources (column ``source_id``) and every dataset built from them from stored tables."""
    gone = source_ids.select("source_id").distinct()
    members = tables["canonical_datasets"].read().select("dataset_id", F.explode("source_ids").alias("source_id"))
    delete_datasets(tables, members.join(gone, "source_id", "left_semi"))
    for name in SOURCE_TABLES:
        if name in tables:
            tables[name].delete(gone, "source_id")


def without_datasets(tables: dict[str, DataFrame], dataset_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables after deleting the given datasets (column ``dataset_id``), their KPIs and everything derived."""
    gone = dataset_ids.select("dataset_id").distinct()
    left = dict(tables)
    if "kpis" in tables:
        gone_kpis = tables["kpis"].join(gone, "dataset_id", "left_semi").select("kpi_id")
        for name in KPI_TABLES:
            if name in tables:
                left[name] = tables[name].join(gone_kpis, "kpi_id", "left_anti")
        left["kpis"] = tables["kpis"].join(gone, "dataset_id", "left_anti")
    left["canonical_datasets"] = tables["canonical_datasets"].join(gone, "dataset_id", "left_anti")
    return left


def without_sources(tables: dict[str, DataFrame], source_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables after deleting the given sources (column ``source_id``) and every dataset built from them."""
    gone = source_ids.select("source_id").distinct()
    members = tables["canonical_datasets"].select("dataset_id", F.explode("source_ids").alias("source_id"))
    left = without_datasets(tables, members.join(gone, "source_id", "left_semi"))
    for name in SOURCE_TABLES:
        if name in tables:
            left[name] = tables[name].join(gone, "source_id", "left_anti")
    return left


def source_usage(sources: DataFrame, datasets: DataFrame) -> DataFrame:
    """Sources with the number of datasets built from each."""
    used = datasets.select(F.explode("source_ids").alias("source_id")).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("derived_dataset_count")
    )
    return sources.join(used, "source_id", "left").withColumn(
        "derived_dataset_count", F.coalesce("derived_dataset_count", F.lit(0).cast("bigint"))
    )


def dataset_members(datasets: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows of a per-source table (reports, contracts, uploads) for every dataset that uses the source."""
    members = datasets.select("dataset_id", F.posexplode("source_ids").alias("ord", "source_id"))
    return members.join(per_source, "source_id")


def weakest_quality(datasets: DataFrame, reports: DataFrame) -> DataFrame:
    """Lowest quality score among each dataset's sources and the source that holds it."""
    pairs = dataset_members(datasets, reports.select("source_id", "score"))
    return pairs.groupBy("dataset_id").agg(F.min(F.struct("score", "source_id")).alias("w")).select(
        "dataset_id", F.col("w.source_id").alias("source_id"), F.col("w.score").alias("score")
    )


def freshness(datasets: DataFrame, sources: DataFrame) -> DataFrame:
    """Latest upload time among each dataset's sources."""
    pairs = dataset_members(datasets, sources.select("source_id", "uploaded_at"))
    return pairs.groupBy("dataset_id").agg(F.max("uploaded_at").alias("source_freshness"))
