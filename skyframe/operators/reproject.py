"""Objects moved to another redshift.

Unit factors cancel and the resized image is normalised to the object's flux, so the result is
resize(object) * sum(object) / sum(resized) * (D_L(z1) / D_L(z2))^2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cosmology import angular_diameter_distance, angular_scaling, flux_scaling, luminosity_distance
from ..functions.numeric import divide
from .aperture import overlap
from .kernels import resize, resized_rasters


def reproject(objects: DataFrame, key: str = "raster_id") -> DataFrame:
    """(key, h, w, data, error) of objects (key, h, w, data, z, z_new). Without positive redshifts there is an error and no image."""
    known = (F.col("z") > 0) & (F.col("z_new") > 0)
    scaled = objects.withColumn("_scale", F.when(known, angular_scaling(F.col("z"), F.col("z_new")))).withColumn("_flux", F.when(known, flux_scaling(F.col("z"), F.col("z_new"))))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    sums = scaled.select(key, total("data").alias("_sum"), "_flux")
    out = resized_rasters(scaled, "_scale", key).join(sums, key)
    factor = divide(F.col("_sum"), total("data")) * F.col("_flux")
    return out.withColumn("_f", factor).select(key, "h", "w", F.transform("data", lambda v: v * F.col("_f")).alias("data"), "error")


def redshift_sweep(objects: DataFrame, z_min: float, z_max: float, n: int, key: str = "raster_id") -> DataFrame:
    """Objects at n evenly spaced redshifts: a row for each, keyed by (key, step) in `sweep_id`."""
    step = (z_max - z_min) / max(1, n - 1)
    rows = objects.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("z_new", F.lit(z_min) + F.col("step") * F.lit(step))
    return rows.withColumn("sweep_id", F.concat_ws("/", F.col(key).cast("string"), F.col("step").cast("string")))


def pasted(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """The image in the middle of an h x w frame of zeros; what leaves the frame goes. Middles are at whole pixels, size // 2."""
    out = np.zeros((h, w))
    dy, dx = h // 2 - a.shape[0] // 2, w // 2 - a.shape[1] // 2
    y0, x0, y1, x1 = max(dy, 0), max(dx, 0), min(dy + a.shape[0], h), min(dx + a.shape[1], w)
    out[y0:y1, x0:x1] = a[y0 - dy : y1 - dy, x0 - dx : x1 - dx]
    return out


def sweep(objects: DataFrame, z_min: float, z_max: float, n: int, frame: tuple[int, int], radius: float, key: str = "raster_id") -> DataFrame:
    """(key, step, z_new, h, w, flux, error): each object (key, h, w, data, z) at n evenly spaced redshifts, resized, pasted into the middle of a
    frame (h, w), and summed in a circle of `radius` pixels about the frame's middle.

    An object is read once and taken through all redshifts in its task. Distances of the n redshifts and the frame's pixel shares are looked
    up: both are computed once and are as large as the parameters say. Objects without a positive redshift, and sizes under one pixel, have an error.
    """
    spark, (fh, fw) = objects.sparkSession, frame
    z_new = F.lit(float(z_min)) + F.col("id") * F.lit((z_max - z_min) / max(1, n - 1))
    grid = spark.range(n).select(z_new.alias("z")).select("z", luminosity_distance(F.col("z")).alias("dl"), angular_diameter_distance(F.col("z")).alias("da")).orderBy("z").collect()
    y, x = F.floor(F.col("id") / fw), F.col("id") % fw
    shares = spark.range(fh * fw).select("id", overlap(x - (fw - 1) / 2.0, y - (fh - 1) / 2.0, float(radius)).alias("s")).orderBy("id").toPandas()["s"].to_numpy().reshape(fh, fw)

    def moved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, data, h, w, dl, da in zip(f[key], f["data"], f["h"], f["w"], f["_dl"], f["_da"], strict=True):
                a, rows = np.asarray(data, float).reshape(h, w), []
                for step, g in enumerate(grid):
                    scale = da / g["da"] if np.isfinite(da) and g["da"] > 0 else np.nan
                    oh, ow = (int(h * scale), int(w * scale)) if np.isfinite(scale) else (0, 0)
                    if oh < 1 or ow < 1:
                        rows.append((k, step, g["z"], None, None, None, f"no image at scale {scale}"))
                        continue
                    small = resize(a, oh, ow)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        small = small * (a.sum() / small.sum() * (dl / g["dl"]) ** 2)
                    rows.append((k, step, g["z"], oh, ow, float((pasted(small, fh, fw) * shares).sum()), None))
                out = pd.DataFrame(rows, columns=[key, "step", "z_new", "h", "w", "flux", "error"])
                yield out.astype({"h": "Int32", "w": "Int32"})

    own = F.when(F.col("z") > 0, F.col("z"))
    placed = objects.select(key, "h", "w", "data", luminosity_distance(own).alias("_dl"), angular_diameter_distance(own).alias("_da"))
    return placed.mapInPandas(moved, f"{key} {objects.schema[key].dataType.simpleString()}, step int, z_new double, h int, w int, flux double, error string")
