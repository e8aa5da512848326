"""Rasters that no task could hold: tiles with offsets, labelled tile by tile and cut to stamps across their borders.

Tables: tiles(raster_id, x0, y0, h, w, data), whose x0 and y0 are multiples of the tile size; only last columns and rows may be smaller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .kernels import label_runs

#: Pixels of the tiles that a task labels together.
TOGETHER = 1 << 20


def cut_tiles(rasters: DataFrame, size: int, key: str = "raster_id") -> DataFrame:
    """Tiles of packed rasters."""
    corners = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0)), F.lit(size))
    placed = rasters.where("w > 0 AND h > 0").withColumn("x0", F.explode(corners("w"))).withColumn("y0", F.explode(corners("h")))
    placed = placed.withColumns({"_w": F.least(F.lit(size), F.col("w") - F.col("x0")).cast("int"), "_h": F.least(F.lit(size), F.col("h") - F.col("y0")).cast("int")})
    line = lambda r: F.slice("data", ((F.col("y0") + r) * F.col("w") + F.col("x0") + 1).cast("int"), F.col("_w"))
    cut = placed.withColumn("_data", F.flatten(F.transform(F.sequence(F.lit(0), F.col("_h") - 1), line)))
    return cut.select(key, "x0", "y0", F.col("_h").alias("h"), F.col("_w").alias("w"), F.col("_data").alias("data"))


def joined_ids(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, id, least): the least id that each id of the edges (keys, a, b) reaches, without the least ones themselves.

    Alternating steps: neighbours above an id are linked to the least neighbour, then those below; the edges become stars. The number of
    rounds grows with the logarithm of the longest chain.
    """
    at = [*keys, "a"]
    e = checkpointed(edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first())
    seen = state(e)
    while True:
        both = e.unionByName(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*at).agg(F.min("b").alias("m")).select(*at, F.least("m", "a").alias("m"))
        above = both.where("b > a").join(least, at).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = above.groupBy(*at).agg(F.min("b").alias("m"))
        below = above.join(least, at).select(*keys, F.greatest("b", "m").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = checkpointed(below.unionByName(least.withColumnRenamed("m", "b")).distinct())
        now = state(e)
        if now == seen:
            return e.groupBy(*at).agg(F.min("b").alias("least")).withColumnRenamed("a", "id")
        seen = now


def tile_labels(frames: Iterator[pd.DataFrame], level: float, key: str) -> Iterator[pd.DataFrame]:
    """(key, x, y, id) of frames of tiles with their raster's `width`; tiles of one shape are labelled as one image, a blank line apart."""
    for f in frames:
        for (h, w), same in f[(f["h"] > 0) & (f["w"] > 0)].groupby(["h", "w"], sort=False):
            step = max(1, TOGETHER // (h * w))
            for n in range(0, len(same), step):
                part = same.iloc[n : n + step]
                tall = np.zeros((len(part), h + 1, w), bool)
                with np.errstate(invalid="ignore"):
                    for mask, data in zip(tall, part["data"], strict=True):
                        mask[:h] = np.asarray(data, float).reshape(h, w) >= level
                i, island = label_runs(tall.reshape(-1, w))
                at, first = i // ((h + 1) * w), island % ((h + 1) * w)
                x0, y0, width = (part[c].to_numpy(np.int64)[at] for c in ("x0", "y0", "width"))
                yield pd.DataFrame({key: part[key].take(at).array, "x": (i % w + x0).astype(np.int32), "y": (i // w % (h + 1) + y0).astype(np.int32), "id": (first // w + y0) * width + first % w + x0})


def label_tiles(tiles: DataFrame, level: float, size: int, key: str = "raster_id") -> DataFrame:
    """(key, x, y, island_id) of the pixels at or over `level`, as `label_components` gives them for the whole raster.

    Each tile is labelled alone, with ids that are places in the whole raster: its first pixel in scan order, y * width + x. Border
    pixels that face each other across a seam link ids, and linked ids become their least one. A task labels tiles of one shape
    together, as many as have `TOGETHER` pixels, or one larger tile.
    """
    width = tiles.groupBy(key).agg(F.max(F.col("x0") + F.col("w")).cast("long").alias("width"))

    kind = tiles.schema[key].dataType.simpleString()
    own = checkpointed(tiles.join(width, key).mapInPandas(lambda frames: tile_labels(frames, level, key), f"{key} {kind}, x int, y int, id long"))

    def facing(axis: str) -> DataFrame:
        left = own.where((F.col(axis) + 1) % size == 0).withColumn(axis, F.col(axis) + 1).withColumnRenamed("id", "a")
        return left.join(own.where(F.col(axis) % size == 0).withColumnRenamed("id", "b"), [key, "x", "y"]).select(key, "a", "b")

    known = joined_ids(facing("x").unionByName(facing("y")), key)
    return own.join(known, [key, "id"], "left").select(key, "x", "y", F.coalesce("least", "id").alias("island_id"))


def stamps(positions: DataFrame, tiles: DataFrame, size: int, tile: int, key: str = "raster_id") -> DataFrame:
    """(key, id, h, w, data): a size x size stamp centred on each position(key, id, x, y), put together from all tiles that it touches.

    Pixels that no tile covers are NaN, so a stamp over the raster's edge is blank there. A position without any tile has no row. Parts are cut
    out of the tiles before they are sent; a task holds the parts of one stamp at a time.
    """
    half = size // 2
    spread = positions.select(key, "id", (F.col("x") - half).alias("sx"), (F.col("y") - half).alias("sy"))
    for axis in "xy":
        first, last = ((F.floor(c / tile) * tile).cast("int") for c in (F.col(f"s{axis}"), F.col(f"s{axis}") + size - 1))
        spread = spread.withColumn(f"{axis}0", F.explode(F.sequence(first, last, F.lit(tile))))
    met = spread.join(tiles, [key, "x0", "y0"])
    low = lambda a: F.greatest(F.col(f"s{a}"), F.col(f"{a}0"))
    high = lambda a, n: F.least(F.col(f"s{a}") + size, F.col(f"{a}0") + F.col(n))
    met = met.withColumns({"xa": low("x"), "ya": low("y"), "xb": high("x", "w"), "yb": high("y", "h")}).where("xb > xa AND yb > ya")
    line: Column = F.transform(F.sequence(F.col("ya"), F.col("yb") - 1), lambda r: F.slice("data", ((r - F.col("y0")) * F.col("w") + F.col("xa") - F.col("x0") + 1).cast("int"), (F.col("xb") - F.col("xa")).cast("int")))
    parts = met.select(key, "id", (F.col("xa") - F.col("sx")).cast("int").alias("px"), (F.col("ya") - F.col("sy")).cast("int").alias("py"), (F.col("xb") - F.col("xa")).cast("int").alias("pw"), F.flatten(line).alias("part"))

    def put(f: pd.DataFrame) -> pd.DataFrame:
        out = np.full((size, size), np.nan)
        for px, py, pw, part in zip(f["px"], f["py"], f["pw"], f["part"], strict=True):
            block = np.asarray(part, float).reshape(-1, pw)
            out[py : py + len(block), px : px + pw] = block
        return pd.DataFrame({key: f[key][:1], "id": f["id"][:1], "h": size, "w": size, "data": [out.ravel()]})

    kinds = f"{key} {tiles.schema[key].dataType.simpleString()}, id {positions.schema['id'].dataType.simpleString()}"
    out = parts.groupBy(key, "id").applyInPandas(put, f"{kinds}, h int, w int, data array<double>")
    return out.withColumn("data", F.transform("data", lambda v: F.coalesce(v, F.lit(float("nan")))))  # pandas hands NaN over as null
