"""Cutouts as a stream: row-wise operators work unchanged; ids come from hashes, as counters can't be dealt in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import at_least


def read_cutouts(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def detections(cutouts: DataFrame, level: float) -> DataFrame:
    """(sample_id, raster_id, area, flux): pixels at or over `level` of each new raster, without any state."""
    held = F.filter("data", lambda v: at_least(v, F.lit(float(level))))
    return cutouts.select(F.xxhash64("raster_id").alias("sample_id"), "raster_id", F.size(held).alias("area"), F.aggregate(held, F.lit(0.0), lambda a, v: a + v).alias("flux"))


def write(detected: DataFrame, path: str, checkpoint: str):
    """Appends to Parquet once for all that is there; call again to continue."""
    return detected.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
