"""Polygons to pixels: even-odd scan lines, and the masks of annotations that come as outlines or run lengths.

A pixel is covered if its centre lies within the outline or on it, so filling an outline through the border pixels of a region
gives the region back, its holes filled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .coco import unpacked_counts
from .pixels import runs_to_mask

#: How near a scan line's crossing has to be to a pixel's centre to count as on it.
ON = 1e-9


def edges(polygons: DataFrame, key: str) -> DataFrame:
    """(key, polygon, edge, x1, y1, x2, y2) of polygons(key, polygon, points), points flat as x, y, x, y, ...; under three points are none."""
    n = F.floor(F.size("points") / 2).cast("int")
    place = lambda i: (F.get("points", 2 * i).cast("double"), F.get("points", 2 * i + 1).cast("double"))

    def edge(i):
        (x1, y1), (x2, y2) = place(i), place((i + 1) % n)
        return F.struct(i.alias("edge"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    return polygons.where(F.size("points") >= 6).select(key, "polygon", F.inline(F.transform(F.sequence(F.lit(0), n - 1), edge)))


def fill(polygons: DataFrame, key: str, h: int, w: int) -> DataFrame:
    """(key, x, y) of the pixels of a raster of h x w that any of a key's polygons(key, polygon, points) covers.

    Each edge gives its crossing with every pixel row it spans (the lower end counts, the upper doesn't); a row's crossings in order
    are taken in pairs. Pixels on an edge are added, as ends and level edges aren't crossings. Work grows with the rows that edges span.
    """
    e = edges(polygons, key)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = lambda a, b: F.explode(F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>")))
    inside = lambda c, n: F.least(F.greatest(c, F.lit(-1)), F.lit(n)).cast("int")
    at = F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.when(F.col("y1") != F.col("y2"), F.col("y2") - F.col("y1")))
    spanned = e.withColumn("y", rows(inside(F.ceil(low), h), inside(F.floor(high), h))).withColumn("at", at)
    cross = spanned.where((F.col("y") >= low) & (F.col("y") < high))
    order = Window.partitionBy(key, "polygon", "y").orderBy("at", "edge")
    paired = cross.select(key, "polygon", "y", "at", F.row_number().over(order).alias("k"), F.lead("at").over(order).alias("to")).where("k % 2 = 1")
    level = F.col("y1") == F.col("y2")
    border = spanned.select(key, "y", F.when(level, F.least("x1", "x2")).otherwise(F.col("at")).alias("at"), F.when(level, F.greatest("x1", "x2")).otherwise(F.col("at")).alias("to"))
    runs = paired.select(key, "y", "at", "to").unionByName(border)
    first, last = inside(F.ceil(F.col("at") - ON), w), inside(F.floor(F.col("to") + ON), w)
    covered = runs.where(F.col("y").between(0, h - 1)).withColumn("x", rows(F.greatest(first, F.lit(0)), F.least(last, F.lit(w - 1)))).select(key, "x", "y")
    return covered.distinct()


def annotation_masks(annotations: DataFrame, h: int, w: int, key: str = "id") -> DataFrame:
    """(key, x, y) of the pixels of annotations(key, segmentation), whichever form it has; run lengths are of h rows.

    Polygons of one annotation are joined. Annotations without a segmentation, or with an empty one, have no pixels.
    """
    shape = F.col("segmentation")
    runs = unpacked_counts(annotations.where(shape["rle"]["counts"].isNotNull()).select(key, shape["rle"]["counts"].alias("counts")), key)
    listed = annotations.where(shape["polygons"].isNotNull()).select(key, F.posexplode(shape["polygons"]).alias("polygon", "points"))
    return runs_to_mask(runs, key, h).unionByName(fill(listed, key, h, w))
