"""Session settings, shared scratch space and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this library is tuned for. Shuffle partitions stay the cluster's choice; AQE merges small ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app_name: str = "kpiloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_folder: str | None = None


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster a missing setting is an error.
    """
    global _local_folder
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="kpiloom-")
    return _local_folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and go on from the written rows, so later jobs see one fixed result even if executors are lost."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(spark))
    return df.checkpoint(eager=True)
