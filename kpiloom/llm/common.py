"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.session import scratch_folder

#: ASCII white space that separates words; every other character belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
#: Whether a query removes its shuffle files when it ends, not only when the driver's memory is next collected.
SHUFFLES_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(df: DataFrame, name: str) -> str:
    """A new folder under the shared folder of the session."""
    return f"{scratch_folder(df.sparkSession).rstrip('/')}/{name}-{uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end meanwhile remove their shuffle files at once; the session's own setting is put back."""
    before = spark.conf.get(SHUFFLES_REMOVED, None)
    spark.conf.set(SHUFFLES_REMOVED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_REMOVED)
        else:
            spark.conf.set(SHUFFLES_REMOVED, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and go on from the files.

    Later jobs then neither repeat the work nor depend on executors that may be lost, and the shuffle files of this one are not
    needed any more. The folder's owner clears it.
    """
    path = shared_path(df, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str) -> Column:
    """The text as it is; null is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches small enough that derived arrays stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized_slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``chars`` bytes of ``column``; a longer text comes alone."""
    for batch in batches:
        values, start, size = batch.column(column), 0, 0
        lengths = pa.compute.binary_length(values).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > chars:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
