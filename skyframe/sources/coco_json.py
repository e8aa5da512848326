"""COCO documents as DataFrames, and back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COCO_ANNOTATION, COCO_CATEGORY, COCO_IMAGE


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of the documents at `path`."""
    doc = spark.read.option("multiLine", True).schema(f"images array<{COCO_IMAGE}>, annotations array<{COCO_ANNOTATION}>, categories array<{COCO_CATEGORY}>").json(path)
    return tuple(doc.select(F.explode(c).alias("r")).select("r.*") for c in ("images", "annotations", "categories"))


def checked_path(path: str) -> str:
    if not path.endswith(".json"):
        raise ValueError("a COCO document's name ends in .json")
    return path


def document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row with the whole document as JSON: the export boundary of one split, which has to fit a task."""
    rows = lambda df, c: df.groupBy().agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(c))
    joined = rows(images, "images").crossJoin(rows(annotations, "annotations")).crossJoin(rows(categories, "categories"))
    return joined.select(F.to_json(F.struct("images", "annotations", "categories")).alias("value"))


def write_document(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, indent: int | None = None) -> None:
    """Writes one JSON file for readers that want a single document; large sets stay in `write_tables`."""
    text = document(images, annotations, categories).first()[0]
    with open(checked_path(path), "w") as f:
        f.write(json.dumps(json.loads(text), indent=indent) if indent else text)


def write_tables(images: DataFrame, annotations: DataFrame, path: str, by: str | None = None) -> None:
    """The tables as Parquet, partitioned by split where there is one."""
    for name, df in (("images", images), ("annotations", annotations)):
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by and by in df.columns else w).parquet(f"{path}/{name}")
