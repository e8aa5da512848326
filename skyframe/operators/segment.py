"""Segments: the islands of a thresholded raster that a catalogue key's positions fall on.

All markers of a segment get one label, so a segment is the union of the connected components that hold
at least one of its positions. One labelling per (image, threshold) serves all keys; everything after it is relational.
Tables: labels(image, x, y, island_id); components(image, skey, seg_ord, x, y).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_bounds(points: DataFrame, w: int, h: int) -> DataFrame:
    return points.where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))


def segment_islands(components: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, skey, seg_ord, island_id): islands with at least one of the segment's positions."""
    return components.join(labels, [key, "x", "y"]).select(key, "skey", "seg_ord", "island_id").distinct()


def segment_pixels(islands: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return islands.join(labels, [key, "island_id"]).select(key, "skey", "seg_ord", "island_id", "x", "y")


def keys_of(components: DataFrame, key: str) -> DataFrame:
    return components.select(key, "skey", "seg_ord").distinct()


def settled(components: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The components, a row each, with what their segments are after overlaps; columns of its own begin with an underscore.

    `_island`: the island under the position, or null. `_size`, `_rank`, `_positions`: of the row's segment. `_owner`: (skey, seg_ord, rank)
    of the island's largest segment. `_box`: the limits of the islands that the row's segment keeps, or null. Pixels and components are
    sent once, together, each image to one task (as its packed raster was when it was labelled); the rest is windows within an image, so
    what is derived from it by image needs no further exchange.
    """
    rest = [c for c in components.columns if c not in (key, "x", "y")]
    lit = labels.where(F.col(key).isNotNull() & F.col("island_id").isNotNull()).select(key, "x", "y", *(F.lit(None).cast(components.schema[c].dataType).alias(c) for c in rest), F.col("island_id").alias("_lit"))
    at = components.select(key, "x", "y", *rest, F.lit(None).cast(labels.schema["island_id"].dataType).alias("_lit")).union(lit).repartition(key)
    here = F.when(F.col(key).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull(), F.min("_lit").over(Window.partitionBy(key, "x", "y")))
    at = at.withColumn("_island", F.coalesce("_lit", here))
    island, pixel = Window.partitionBy(key, "_island"), F.col("_lit").isNotNull()
    limits = {f"_lit_{c}": f(F.when(pixel, F.col(c[0]))).over(island) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))}
    at = at.withColumns({"_area": F.count("_lit").over(island)} | limits).where(~pixel)
    segment, met = Window.partitionBy(key, "skey"), F.col("_island").isNotNull()
    first = F.row_number().over(Window.partitionBy(key, "skey", "_island").orderBy("x", "y")) == 1
    at = at.withColumn("_new", F.when(first, F.col("_area")))
    at = at.withColumns({"_size": F.coalesce(F.sum("_new").over(segment), F.lit(0)).cast("long"), "_positions": F.count("*").over(segment)})
    at = at.withColumn("_rank", F.dense_rank().over(Window.partitionBy(key).orderBy(F.col("_size").desc(), "seg_ord", "skey")))
    owner = F.min_by(F.struct("skey", "seg_ord", F.col("_rank").alias("rank")), "_rank").over(Window.partitionBy(key, "_island"))
    at = at.withColumn("_owner", F.when(met, owner))
    kept = lambda f, c: f(F.when(F.col("_owner.rank") == F.col("_rank"), F.col(f"_lit_{c}"))).over(segment)
    at = at.withColumns({f"_{c}": kept(f, c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))})
    box = F.when(F.col("_xmin").isNotNull(), F.struct(*(F.col(f"_{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax"))))
    return at.select(*components.columns, "_island", "_size", "_positions", "_rank", "_owner", box.alias("_box"))


def segment_sizes(components: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, skey, seg_ord, size): pixels before overlaps are resolved, 0 for keys without any."""
    return settled(components, labels, key).groupBy(key, "skey", "seg_ord").agg(F.first("_size").alias("size"))


def rank_segments(sizes: DataFrame, key: str) -> DataFrame:
    """Adds `rank`: from 1 by size, larger first, ties by seg_ord."""
    return sizes.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("size").desc(), "seg_ord")))


def overlap_counts(components: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, x, y, n): how many segments claim a pixel."""
    return segment_pixels(segment_islands(components, labels, key), labels, key).groupBy(key, "x", "y").agg(F.count("*").alias("n"))


def owned_islands(components: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, island_id, skey, seg_ord, rank): each contested island goes to its largest segment.

    With one threshold per image, overlaps are whole islands, so claims are settled per island and not per pixel.
    """
    met = settled(components, labels, key).where("_island IS NOT NULL")
    return met.groupBy(key, F.col("_island").alias("island_id")).agg(F.first("_owner").alias("s")).select(key, "island_id", "s.*")


def segmentation_map(components: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, x, y, label): labels number the keys from 1 by seg_ord."""
    order = keys_of(components, key).withColumn("label", F.row_number().over(Window.partitionBy(key).orderBy("seg_ord"))).select(key, "skey", "label")
    owned = owned_islands(components, labels, key).join(order, [key, "skey"]).select(key, "island_id", "label")
    return labels.join(owned, [key, "island_id"]).select(key, "x", "y", "label")


def segment_boxes(components: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, skey, seg_ord, xmin, ymin, xmax, ymax) after overlaps; nulls for keys that keep no pixel."""
    return settled(components, labels, key).groupBy(key, "skey", "seg_ord").agg(F.first("_box").alias("b")).select(key, "skey", "seg_ord", "b.*")


def object_mask(pixels: DataFrame, components: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """All pixels, 0 where no segment of the object's positions covers them."""
    held = components.join(labels, [key, "x", "y"]).select(key, "island_id").distinct()
    covered = labels.join(held, [key, "island_id"], "left_semi").select(key, "x", "y", F.lit(True).alias("_in"))
    return pixels.join(covered, [key, "x", "y"], "left").select(key, "x", "y", F.when(F.col("_in"), F.col("v")).otherwise(0.0).alias("v"))


def points_in_mask(components: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """The components with `inside`."""
    inside = mask.select(key, "x", "y", F.lit(True).alias("inside")).distinct()
    return components.join(inside, [key, "x", "y"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def union_positions(components: DataFrame, key: str) -> DataFrame:
    """(key, n, x, y): all keys' positions in key order, duplicates kept."""
    return components.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("seg_ord", "ord"))).select(key, "n", "x", "y")
