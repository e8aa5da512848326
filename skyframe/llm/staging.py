"""Cuts lineage by writing tables into the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Used only where spark.checkpoint.dir is unset (local mode, tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    return (spark.conf.get("spark.checkpoint.dir", None) or LOCAL_CHECKPOINTS).rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back; later plans start from the files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """`df` computed once and held on the executors' disks until `unpersist` or the session's end.

    A part lost with its executor is computed again from what it came from; nothing is written through the file system.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    held.count()
    return held


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
