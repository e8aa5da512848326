"""Photometry in a circle with the exact share of each pixel's area."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sky import _bound


def quadrant_area(x: Column, y: Column, r: float) -> Column:
    """Area of the part of a disc about the origin that lies left of x and below y.

    With c(t) the disc's half height at t, it is the integral over t up to x of c(t) + min(y, c(t)) for y >= 0, in which the minimum is y between
    the places where c equals y. Below the middle the disc's symmetry gives the rest of what lies left of x.
    """
    def half(t: Column) -> Column:
        """Integral of the half height from -r to t."""
        return (t * F.sqrt(F.greatest(r * r - t * t, F.lit(0.0))) + r * r * F.asin(t / r)) / 2.0 + math.pi * r * r / 4

    held = lambda c: F.least(F.greatest(c, F.lit(-float(r))), F.lit(float(r)))

    def area(p: Column) -> Column:
        x, y = p["x"], F.abs(p["y"])
        b = F.sqrt(F.greatest(r * r - y * y, F.lit(0.0)))
        middle = y * F.least(F.greatest(x + b, F.lit(0.0)), 2.0 * b)
        under = half(x) + half(F.least(x, -b)) + middle + half(F.greatest(x, b)) - half(b)
        return F.when(p["y"] >= 0, under).otherwise(2.0 * half(x) - under)

    return _bound(F.struct(held(x).alias("x"), held(y).alias("y")), area)


def overlap(x: Column, y: Column, r: float) -> Column:
    """The share of the unit pixel about (x, y) within a disc of radius r about the origin: 0 to 1."""
    a, b, c, d = x - 0.5, x + 0.5, y - 0.5, y + 0.5
    part = quadrant_area(b, d, r) - quadrant_area(a, d, r) - quadrant_area(b, c, r) + quadrant_area(a, c, r)
    far, near = (F.pow(F.abs(x) + s, F.lit(2.0)) + F.pow(F.abs(y) + s, F.lit(2.0)) for s in (0.5, -0.5))
    return F.when(far <= r * r, 1.0).when((near >= r * r) & (F.abs(x) >= 0.5) & (F.abs(y) >= 0.5), 0.0).otherwise(F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)))


def aperture_sum(pixels: DataFrame, key: str, x0: float | Column, y0: float | Column, radius: float) -> DataFrame:
    """(key, flux, area): sum of v times the pixel's share, and of the shares, over pixels that the circle reaches.

    Pixels outside the circle's square are dropped before anything is computed. NaN pixels make the sum NaN.
    """
    dx, dy = F.col("x") - x0, F.col("y") - y0
    near = pixels.where((F.abs(dx) < radius + 0.5) & (F.abs(dy) < radius + 0.5)).withColumn("_share", overlap(dx.cast("double"), dy.cast("double"), float(radius)))
    return near.where("_share > 0").groupBy(key).agg(F.sum(F.col("v") * F.col("_share")).alias("flux"), F.sum("_share").alias("area"))
