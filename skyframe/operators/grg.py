"""The central object of an image among its segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import segment
from .pixels import box_columns


def with_central(components: DataFrame, labels: DataFrame, key: str, w: int, h: int, tie: str = "smallest") -> DataFrame:
    """The components with the columns of `segment.settled` and `_central`: (skey, seg_ord, contains_centre, rank) of their image's central segment, or null.

    First choice: segments whose box holds the centre pixel, of these the smallest (`tie='largest'` takes the largest).
    Otherwise the segment with the most positions among those that keep a box, the first key on ties.
    """
    if w != h:
        raise ValueError("the centre is taken from the width and holds for square images only")
    if tie not in ("smallest", "largest"):
        raise ValueError("tie is 'smallest' or 'largest'")
    c = w // 2
    inside = F.lit(c).between(F.col("_box.xmin"), F.col("_box.xmax")) & F.lit(c).between(F.col("_box.ymin"), F.col("_box.ymax"))
    by_rank = -F.col("_rank") if tie == "smallest" else F.col("_rank")
    order = F.struct((~inside).alias("o"), F.when(inside, by_rank).otherwise(-F.col("_positions")).alias("r"), "seg_ord", "skey")
    best = F.min_by(F.struct("skey", "seg_ord", inside.alias("contains_centre"), F.col("_rank").alias("rank")), F.when(F.col("_box").isNotNull(), order))
    return segment.settled(components, labels, key).withColumn("_central", best.over(Window.partitionBy(key)))


def find_central(components: DataFrame, labels: DataFrame, key: str, w: int, h: int, tie: str = "smallest") -> DataFrame:
    """(key, skey, seg_ord, contains_centre, rank): one segment per image that has one, chosen as in `with_central`."""
    held = with_central(components, labels, key, w, h, tie).where("_central IS NOT NULL")
    return held.groupBy(key).agg(F.first("_central").alias("s")).select(key, "s.*")


def central_islands(placed: DataFrame, key: str) -> DataFrame:
    """(key, skey, island_id): the islands that the central segments of `with_central` keep."""
    return placed.where("_owner.skey = _central.skey").select(key, F.col("_central.skey").alias("skey"), F.col("_island").alias("island_id")).distinct()


def in_central(placed: DataFrame) -> DataFrame:
    """The rows of `with_central` with `inside`: whether the position lies in the mask of its image's central segment, the islands that it keeps.

    The row's own island and its owner say so, so labels are not joined again.
    """
    return placed.withColumn("inside", F.coalesce(F.col("_owner.skey") == F.col("_central.skey"), F.lit(False)))


def others_in_central(placed: DataFrame, labels: DataFrame, key: str, x: Column, y: Column) -> DataFrame:
    """As `in_central`, but for the position (x, y) instead of the row's own: whether a pixel there is of an island that the central segment keeps.

    The pixels are sent once more, to the task of their image, where windows find their island's and then their position's answer.
    """
    known = F.col(key).isNotNull()
    pixels = labels.where(known & F.col("island_id").isNotNull()).select(key, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("island_id").alias("_island"), F.lit(True).alias("_pixel"))
    rows = in_central(placed).withColumns({"_x": x, "_y": y, "_pixel": F.lit(False)}).unionByName(pixels.repartition(key), allowMissingColumns=True)
    rows = rows.withColumn("_held", F.when(F.col("_pixel"), F.max("inside").over(Window.partitionBy(key, "_island"))))
    there = F.when(known & F.col("_x").isNotNull() & F.col("_y").isNotNull(), F.max("_held").over(Window.partitionBy(key, "_x", "_y")))
    return rows.withColumn("inside", F.coalesce(there, F.lit(False))).where("NOT _pixel").select(*placed.columns, "inside")


def central_positions(components: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, grg_positions, all_positions) of the images with a central object."""
    one = components.join(found.select(key, F.col("skey").alias("central")), key)
    at = F.struct("seg_ord", "ord", "x", "y")
    points = lambda c: F.transform(F.sort_array(c), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    held = one.groupBy(key).agg(points(F.collect_list(F.when(F.col("skey") == F.col("central"), at))).alias("grg_positions"), points(F.collect_list(at)).alias("all_positions"))
    return held


def full_annotation(components: DataFrame, labels: DataFrame, key: str, w: int, h: int) -> DataFrame:
    """(key, skey, xmin, ymin, xmax, ymax, area): box and mask area of the central object's segment after overlaps."""
    mask = labels.join(central_islands(with_central(components, labels, key, w, h), key), [key, "island_id"])
    return mask.groupBy(key, "skey").agg(*box_columns(), F.count("*").cast("double").alias("area"))
