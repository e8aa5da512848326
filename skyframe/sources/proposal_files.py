"""Proposal archives read back and joined to their images."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import proposal_name


def read(spark: SparkSession, root: str) -> DataFrame:
    """(file_name, n, xmin, ymin, xmax, ymax, score) of every proposal in the .npz files below `root`; n counts a file's from 0.

    A file that is no archive of boxes and scores of one length has one row with `error` and nothing else. An empty archive has no rows.
    """

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as held:
                        boxes, scores = held["boxes"].astype(float).reshape(-1, 4), held["scores"].astype(float)
                    if len(boxes) != len(scores):
                        raise ValueError(f"{len(boxes)} boxes and {len(scores)} scores")
                    out = pd.DataFrame(boxes, columns=["xmin", "ymin", "xmax", "ymax"]).assign(score=scores, n=np.arange(len(scores)), error=None)
                except Exception as e:
                    out = pd.DataFrame([{"error": f"{type(e).__name__}: {e}"[:200]}], columns=["xmin", "ymin", "xmax", "ymax", "score", "n", "error"])
                yield out.assign(file_name=name, n=out["n"].astype("Int32"))[["file_name", "n", "xmin", "ymin", "xmax", "ymax", "score", "error"]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(root)
    return files.select("path", "content").mapInPandas(opened, "file_name string, n int, xmin double, ymin double, xmax double, ymax double, score double, error string")


def of_images(images: DataFrame, proposals: DataFrame) -> DataFrame:
    """The proposals with the id of their image, joined by the name that an image's file gives its proposal file."""
    named = images.select(F.col("id").alias("image_id"), proposal_name(F.col("file_name")).alias("file_name"))
    return proposals.join(named, "file_name")


def missing(images: DataFrame, proposals: DataFrame) -> DataFrame:
    """(id, file_name) of the images whose proposal file isn't among the proposals read."""
    return images.join(proposals.select("file_name").distinct().withColumnRenamed("file_name", "_npz"), proposal_name(F.col("file_name")) == F.col("_npz"), "left_anti").select("id", "file_name")
