"""A Spark session with the settings that the operators expect, and checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "skyframe", master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """ANSI mode and AQE stay on; Arrow batches are small because one row may hold a whole raster."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the folder in spark.checkpoint.dir, which cuts its plan; without that setting to one for this run (local mode)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return df.checkpoint(eager=True)


def store_of(root: str):
    """(file system, base path) of a folder that every executor reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
