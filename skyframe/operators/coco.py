"""Assembly of COCO tables: images, annotations, categories, ids and origins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import sample_name
from .kernels import polygons
from .pixels import run_lengths

CATEGORY = (1, "GRG")


def categories(spark, rows: list[tuple[int, str]] = (CATEGORY,)) -> DataFrame:
    if not rows or not all(name for _, name in rows):
        raise ValueError("categories need an id and a name")
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(i).cast("long").alias("id"), F.lit(n).alias("name")) for i, n in rows))))


def sample_ids(samples: DataFrame, order: list[str], bucket: str) -> DataFrame:
    """Adds `id` from 0 in the order of (bucket, order): counts per bucket give offsets, so rows are ranked within buckets only."""
    counts = samples.groupBy(bucket).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(*order)) - 1
    return samples.join(before, bucket).withColumn("id", (F.col("_before") + rank).cast("long")).drop("_before")


def origin_ids(samples: DataFrame, cutout: str, id: str = "id") -> DataFrame:
    """Adds `origin_id`, the first valid sample of the same cutout."""
    return samples.withColumn("origin_id", F.min(id).over(Window.partitionBy(cutout)))


def annotation_rows(boxes: DataFrame, bbox_format: str = "xyxy") -> DataFrame:
    """(id, image_id, category_id, bbox, area, [segmentation,] iscrowd) from (id, image_id, xmin, ymin, xmax, ymax, area[, segmentation]).

    Rows without box or area go.
    """
    if bbox_format not in ("xyxy", "xywh"):
        raise ValueError("bbox_format is 'xyxy' or 'xywh'")
    x, y, a, b = (F.col(c).cast("double") for c in ("xmin", "ymin", "xmax", "ymax"))
    box = F.array(x, y, a, b) if bbox_format == "xyxy" else F.array(x, y, a - x, b - y)
    held = ["segmentation"] if "segmentation" in boxes.columns else []
    return boxes.where("xmin IS NOT NULL AND area > 0").select(
        "id", "image_id", F.lit(CATEGORY[0]).cast("long").alias("category_id"), box.alias("bbox"), F.col("area").cast("double").alias("area"), *held, F.lit(0).alias("iscrowd")
    )


def segmentations(mask: DataFrame, key: str, h: int, w: int, mode: str = "rle") -> DataFrame:
    """(key, segmentation) of each mask(key, x, y): compact run lengths or outlines."""
    if mode not in ("rle", "polygon"):
        raise ValueError("a segmentation is 'rle' or 'polygon'")
    none = {"rle": "struct<size:array<int>,counts:string>", "polygons": "array<array<int>>"}
    if mode == "rle":
        packed = packed_counts(run_lengths(mask, key, h, w), key)
        rle = F.struct(F.array(F.lit(h), F.lit(w)).alias("size"), "counts")
        return packed.select(key, F.struct(rle.alias("rle"), F.lit(None).cast(none["polygons"]).alias("polygons")).alias("segmentation"))
    runs = run_lengths(mask.select(key, F.col("y").alias("x"), F.col("x").alias("y")), key, w, h)  # row by row
    listed = runs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("run", "length"))).alias("r"))
    data = F.flatten(F.transform("r", lambda r: F.array_repeat((r["run"] % 2).cast("double"), r["length"].cast("int"))))
    outlines = polygons(listed.select(key, F.lit(h).alias("h"), F.lit(w).alias("w"), data.alias("data")), key)
    return outlines.select(key, F.struct(F.lit(None).cast(none["rle"]).alias("rle"), F.col("polygons").cast(none["polygons"]).alias("polygons")).alias("segmentation"))


def image_rows(samples: DataFrame, w: int, h: int, prefix: str) -> DataFrame:
    """(id, file_name, width, height, metadata) from samples with ra, dec, angle and metadata columns."""
    if w <= 0 or h <= 0:
        raise ValueError("width and height must be positive")
    angle = F.col("rotation_angle") if "rotation_angle" in samples.columns else None
    turned = F.when(angle != 0, angle) if angle is not None else None
    return samples.select("id", sample_name(prefix, F.col("id"), F.col("ra"), F.col("dec"), turned).alias("file_name"), F.lit(w).alias("width"), F.lit(h).alias("height"), "metadata")


def packed_counts(runs: DataFrame, key: str) -> DataFrame:
    """(key, counts): run lengths as the compact COCO string. Each number, less the one two before from the fourth on, goes in 5-bit groups."""

    @F.pandas_udf("string")
    def pack(lists: pd.Series) -> pd.Series:
        def one(c) -> str:
            out = []
            for i, n in enumerate(c):
                x = int(n) - (int(c[i - 2]) if i > 2 else 0)
                more = True
                while more:
                    low = x & 31
                    x >>= 5
                    more = x != (-1 if low & 16 else 0)
                    out.append(chr(48 + low + 32 * more))
            return "".join(out)

        return lists.map(one)

    held = runs.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("run", "length"))), lambda r: r["length"]).alias("c"))
    return held.select(key, pack("c").alias("counts"))


def unpacked_counts(strings: DataFrame, key: str) -> DataFrame:
    """(key, run, length) from compact COCO strings."""

    @F.pandas_udf("array<long>")
    def unpack(texts: pd.Series) -> pd.Series:
        def one(s: str) -> list[int]:
            out, value, shift = [], 0, 0
            for c in s:
                low = ord(c) - 48
                value |= (low & 31) << shift
                shift += 5
                if low & 32:
                    continue
                if low & 16:
                    value -= 1 << shift
                out.append(value + (out[-2] if len(out) > 2 else 0))
                value = shift = 0
            return out

        return texts.map(one)

    return strings.select(key, F.posexplode(unpack("counts")).alias("run", "length"))
