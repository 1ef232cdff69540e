"""Continuous forms of the two event writes: append, and latest-wins upsert.

The batch forms are ``sources.datasets.append_rows`` and ``upsert``; here a stream of feedback, call, timing or activity
rows reaches the same tables exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kpiloom.sources.datasets import append_rows, newest


def append_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a stored log, the same that ``append_rows`` adds batches to; ``read_rows`` reads both.

    The stream is one writer, named by its checkpoint, and each micro-batch one numbered append: a batch that a restart
    repeats is left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        append_rows(batch, path, f"stream {checkpoint}", batch_id)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def version_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append row versions, one folder per micro-batch.

    A repeated batch overwrites its own folder, so a restart writes nothing twice. ``current_rows`` resolves versions.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def current_rows(spark: SparkSession, path: str, keys: Sequence[str], changed_at: str) -> DataFrame:
    """Latest version per key of a table written by ``version_stream``; a later batch wins a tie."""
    return newest(spark.read.parquet(path), keys, [F.desc(changed_at), F.desc("batch_id")]).drop("batch_id")
