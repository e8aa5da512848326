"""Rasters as packed rows (raster_id, h, w, data) and as pixel rows (raster_id, x, y, v).

Stay packed until a threshold has made the pixels sparse; x is the column, y the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import at_least


def explode_pixels(rasters: DataFrame, key: str = "raster_id", keep: Column | None = None) -> DataFrame:
    """(key, x, y, v) of a packed raster's pixels, only those whose value satisfies `keep` (an expression over v)."""
    out = rasters.select(key, "w", F.posexplode("data").alias("_i", "v")).select(
        key, (F.col("_i") % F.col("w")).cast("int").alias("x"), F.floor(F.col("_i") / F.col("w")).cast("int").alias("y"), F.col("v").cast("double").alias("v")
    )
    return out if keep is None else out.where(keep)


def pack_pixels(pixels: DataFrame, key: str, h: int, w: int, fill: float = 0.0) -> DataFrame:
    """Packed rasters of one shape from pixel rows; missing pixels are `fill`."""
    held = pixels.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * w + F.col("x")).alias("i"), "v"))).alias("_m"))
    data = F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(fill)))
    return held.select(key, F.lit(h).alias("h"), F.lit(w).alias("w"), data.alias("data"))


def threshold(pixels: DataFrame, level: float | Column) -> DataFrame:
    return pixels.where(at_least(F.col("v"), level if isinstance(level, Column) else F.lit(float(level))))


def box_columns() -> list[Column]:
    return [F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax")]


def mask_area(mask: DataFrame, key: str) -> DataFrame:
    return mask.groupBy(key).agg(F.count("*").cast("double").alias("area"))


def mask_box(mask: DataFrame, *keys: str) -> DataFrame:
    """Inclusive limits; keys without pixels have no row (join the keys to get nulls)."""
    return mask.groupBy(*keys).agg(*box_columns())


def box_to_xywh(boxes: DataFrame) -> DataFrame:
    """Left, top, width and height with width = right - left, as boxes of one pixel have no extent."""
    return boxes.select("*", F.col("xmin").alias("left"), F.col("ymin").alias("top"), (F.col("xmax") - F.col("xmin")).alias("width"), (F.col("ymax") - F.col("ymin")).alias("height"))


def total_flux(pixels: DataFrame, key: str) -> DataFrame:
    return pixels.groupBy(key).agg(F.sum("v").alias("flux"))


def run_lengths(mask: DataFrame, key: str, h: int, w: int) -> DataFrame:
    """Column-major run lengths (key, run, length), the first run counting zeros; computed from the sparse mask."""
    along = Window.partitionBy(key).orderBy("p")
    p = mask.select(key, (F.col("x") * h + F.col("y")).alias("p"))
    starts = p.withColumn("g", F.when(F.col("p") - F.lag("p").over(along) == 1, 0).otherwise(1)).withColumn("g", F.sum("g").over(along))
    ones = starts.groupBy(key, "g").agg(F.min("p").alias("a"), (F.max("p") + 1).alias("b"))
    by_start = Window.partitionBy(key).orderBy("a")
    gap = F.col("a") - F.coalesce(F.lag("b").over(by_start), F.lit(0))
    n, last = F.row_number().over(by_start), F.lead("b").over(by_start).isNull()
    parts = ones.select(key, n.alias("n"), F.struct(gap.alias("zeros"), (F.col("b") - F.col("a")).alias("ones"), F.when(last & (F.col("b") < h * w), h * w - F.col("b")).alias("rest")).alias("s"))
    rows = F.array(
        F.struct((2 * F.col("n") - 2).alias("run"), F.col("s.zeros").alias("length")), F.struct((2 * F.col("n") - 1).alias("run"), F.col("s.ones").alias("length")),
        F.struct((2 * F.col("n")).alias("run"), F.col("s.rest").alias("length")),
    )
    return parts.select(key, F.inline(rows)).where("length IS NOT NULL")


def runs_to_mask(runs: DataFrame, key: str, h: int) -> DataFrame:
    """(key, x, y) of the pixels that column-major run lengths (key, run, length) cover; even runs count zeros."""
    before = F.sum("length").over(Window.partitionBy(key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    ones = runs.withColumn("_a", F.coalesce(before, F.lit(0))).where("run % 2 = 1 AND length > 0")
    p = ones.select(key, F.explode(F.sequence(F.col("_a"), F.col("_a") + F.col("length") - 1)).alias("p"))
    return p.select(key, F.floor(F.col("p") / h).cast("int").alias("x"), (F.col("p") % h).cast("int").alias("y"))


def rotate_quarter(pixels: DataFrame, w: int, h: int, quarters: int = 1) -> DataFrame:
    """Exact counter-clockwise turns by 90 degrees: an index permutation."""
    x, y = F.col("x"), F.col("y")
    nx, ny = {0: (x, y), 1: (y, w - 1 - x), 2: (w - 1 - x, h - 1 - y), 3: (h - 1 - y, x)}[quarters % 4]
    return pixels.withColumns({"x": nx.cast("int"), "y": ny.cast("int")})


def crop_centre(pixels: DataFrame, w: int, h: int, cw: int, ch: int) -> DataFrame:
    sx, sy = w // 2 - cw // 2, h // 2 - ch // 2
    inside = F.col("x").between(sx, sx + cw - 1) & F.col("y").between(sy, sy + ch - 1)
    return pixels.where(inside).withColumns({"x": F.col("x") - sx, "y": F.col("y") - sy})


def bilinear(pixels: DataFrame, key: str, h: int, w: int, oh: int, ow: int) -> DataFrame:
    """Plain bilinear resize with edge values beyond the border, as a join of four taps."""
    def taps(i: Column, n: int, out: int) -> tuple[Column, Column, Column]:
        at = F.least(F.greatest((i + 0.5) * (n / out) - 0.5, F.lit(0.0)), F.lit(n - 1.0))
        low = F.floor(at)
        return low.cast("int"), F.least(low + 1, F.lit(n - 1)).cast("int"), at - low

    x0, x1, fx = taps(F.col("ox"), w, ow)
    y0, y1, fy = taps(F.col("oy"), h, oh)
    corners = F.array(*(F.struct(x.alias("x"), y.alias("y"), weight.alias("weight")) for x, y, weight in ((x0, y0, (1 - fx) * (1 - fy)), (x1, y0, fx * (1 - fy)), (x0, y1, (1 - fx) * fy), (x1, y1, fx * fy))))
    spark = pixels.sparkSession
    grid = spark.range(oh * ow).select((F.col("id") % ow).cast("int").alias("ox"), F.floor(F.col("id") / ow).cast("int").alias("oy"))
    grid = grid.select("ox", "oy", F.inline(corners))  # four rows a target pixel, the same for every raster
    return pixels.join(F.broadcast(grid), ["x", "y"]).groupBy(key, "ox", "oy").agg(F.sum(F.col("v") * F.col("weight")).alias("v")).select(key, F.col("ox").alias("x"), F.col("oy").alias("y"), "v")


def tiles(rasters: DataFrame, size: int, stride: float = 0.5) -> DataFrame:
    """The rasters' columns with the corners (tx, ty) of sliding windows of `size`, `stride` sizes apart."""
    step = max(1, int(size * stride))
    corners = lambda n: F.sequence(F.lit(0), F.col(n) - size, F.lit(step))
    return rasters.where((F.col("w") >= size) & (F.col("h") >= size)).withColumn("tx", F.explode(corners("w"))).withColumn("ty", F.explode(corners("h")))


def cutouts(positions: DataFrame, pixels: DataFrame, size: int, key: str = "raster_id") -> DataFrame:
    """(position id, x, y, v) of a size x size stamp centred on each position (key, id, x, y), by cells of one stamp's size."""
    half = size // 2
    cell = lambda c: F.floor(c / size)
    spread = positions.select(key, "id", F.col("x").alias("px"), F.col("y").alias("py"))
    for axis in ("x", "y"):
        first = F.col(f"p{axis}") - half
        spread = spread.withColumn(f"c{axis}", F.explode(F.array_distinct(F.array(cell(first), cell(first + size - 1)))))
    cells = pixels.withColumn("cx", cell(F.col("x"))).withColumn("cy", cell(F.col("y")))
    near = F.col("x").between(F.col("px") - half, F.col("px") - half + size - 1) & F.col("y").between(F.col("py") - half, F.col("py") - half + size - 1)
    return spread.join(cells, [key, "cx", "cy"]).where(near).select("id", (F.col("x") - F.col("px") + half).alias("x"), (F.col("y") - F.col("py") + half).alias("y"), "v")


def aperture_flux(pixels: DataFrame, key: str, x0: float, y0: float, radius: float) -> DataFrame:
    """Sum of the pixels whose centres lie in the circle; an approximation of exact overlap."""
    inside = F.pow(F.col("x") - x0, 2) + F.pow(F.col("y") - y0, 2) <= radius * radius
    return pixels.where(inside).groupBy(key).agg(F.sum("v").alias("flux"))


def paste_centre(small: DataFrame, key: str, sw: int, sh: int, w: int, h: int) -> DataFrame:
    """Pixels shifted into the centre of a w x h raster; pixels that leave it go."""
    dx, dy = w // 2 - sw // 2, h // 2 - sh // 2
    return small.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy}).where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))
