"""Cleaning and scoring of central objects against their masks.

points(image, key, ord, x, y, grg): all component positions, `grg` marking those of the central object. mask(image, x, y).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segment import points_in_mask


def others(points: DataFrame, central: DataFrame, key: str) -> DataFrame:
    """The points whose position isn't one of the central object's; duplicates stay."""
    return points.join(central.select(key, "x", "y").distinct(), [key, "x", "y"], "left_anti")


def clean(points: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """(key, grg, other, updated, removed) per image.

    Points inside the mask become the central object's: its own first, then the others'; those outside, the other way round. An
    image is removed if nothing is left to its object, and updated if one of its object's points lay outside.
    """
    return clean_placed(points_in_mask(points, mask, key), key)


def clean_placed(placed: DataFrame, key: str) -> DataFrame:
    """As `clean`, of points with `inside` (whether they lie in the mask of their image)."""
    at = F.struct((~F.col("grg")).alias("o"), "ord", "x", "y")
    out = F.struct(F.col("grg").alias("o"), "ord", "x", "y")
    xy = lambda c: F.transform(F.sort_array(c), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    held = placed.groupBy(key).agg(
        xy(F.collect_list(F.when(F.col("inside"), at))).alias("grg"), xy(F.collect_list(F.when(~F.col("inside"), out))).alias("other"),
        F.max(F.col("grg") & ~F.col("inside")).alias("updated"),
    )
    return held.withColumn("removed", F.size("grg") == 0)


def cleaned_positions(cleaned: DataFrame, key: str) -> DataFrame:
    """(key, grg_positions, all_component_positions, updated) of the images that `clean` leaves: the object's points, then all others."""
    xy = lambda c: F.transform(c, lambda p: F.array(p["x"], p["y"]))
    return cleaned.where("NOT removed").select(key, xy(F.col("grg")).alias("grg_positions"), xy(F.concat("grg", "other")).alias("all_component_positions"), "updated")


def judge(points: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """(key, all_inside, other_inside): whether all of an object's points lie in its mask, and whether another's does."""
    return judge_placed(points_in_mask(points, mask, key), key)


def judge_placed(placed: DataFrame, key: str) -> DataFrame:
    """As `judge`, of points with `inside`."""
    return placed.groupBy(key).agg(
        F.coalesce(F.bool_and(F.when(F.col("grg"), F.col("inside"))), F.lit(True)).alias("all_inside"), F.coalesce(F.bool_or(F.when(~F.col("grg"), F.col("inside"))), F.lit(False)).alias("other_inside")
    )


def metrics(judged: DataFrame) -> DataFrame:
    """tp, fp, fn, accuracy, precision, recall; 0 for an empty denominator.

    A true positive holds all its points and no other's; every object with a point outside is a false negative and a
    false positive, and an object that holds another's point is a false positive.
    """
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    tp, fn = F.col("all_inside") & ~F.col("other_inside"), ~F.col("all_inside")
    counts = judged.agg(n(tp).alias("tp"), n(~tp).alias("fp"), n(fn).alias("fn"))

    def share(below: Column) -> Column:
        return F.when(below == 0, 0.0).otherwise(F.col("tp") / F.greatest(below, F.lit(1)))

    return counts.select("*", share(F.expr("tp + fp + fn")).alias("accuracy"), share(F.expr("tp + fp")).alias("precision"), share(F.expr("tp + fn")).alias("recall"))
