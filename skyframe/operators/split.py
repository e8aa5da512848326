"""Stratified splits of image families by component count."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = {"train": 0.7, "val": 0.15, "test": 0.15}


def hashed_order(image_id: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), image_id)


def congruential_order(image_id: Column, seed: int) -> Column:
    """A portable pseudo-random order that SQL engines agree on."""
    return (image_id * F.lit(1103515245) + F.lit(seed)) % F.lit(2147483648)


def eligible(images: DataFrame, annotations: DataFrame, counts: DataFrame) -> DataFrame:
    """(image_id, stratum) of unrotated images with an annotation and at least one component."""
    plain = images.where(~F.coalesce("rotated", F.lit(False))).join(annotations.select(F.col("image_id").alias("id")), "id", "left_semi")
    plain = plain.select(F.col("id").alias("image_id"))
    return plain.join(counts.select("image_id", "component_count"), "image_id").where("component_count > 0").select("image_id", F.col("component_count").alias("stratum"))


def stratified(families: DataFrame, splits: dict[str, float] = SPLITS, seed: int = 42, order=hashed_order) -> DataFrame:
    """Adds `split`: within a stratum rows are ordered pseudo-randomly and cut at whole parts of the cumulative ratios.

    Small strata fill later splits first: one row goes to the last split. A stratum is cut by counts per slice of
    the order, so its rows are sorted slice by slice.
    """
    if not math.isclose(sum(splits.values()), 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError("ratios must add up to 1")
    keyed = families.withColumn("_o", order(F.col("image_id"), seed))
    keyed = keyed.withColumn("_slice", F.floor(F.col("_o") / F.lit(2.0**31 / 64 if order is congruential_order else 2.0**58)).cast("int"))
    slices = keyed.groupBy("stratum", "_slice").agg(F.count("*").alias("_n"))
    along = Window.partitionBy("stratum").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy("stratum"))).drop("_n")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("stratum", "_slice").orderBy("_o", "image_id"))
    ranked = keyed.join(slices, ["stratum", "_slice"]).withColumn("_rank", rank)
    names, total, split = list(splits), 0.0, None
    for name in names[:-1]:
        total += splits[name]
        within = F.col("_rank") <= F.floor(F.col("_all") * F.lit(total))
        split = F.when(within, name) if split is None else split.when(within, name)
    split = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
    return ranked.withColumn("split", split).drop("_o", "_slice", "_before", "_all", "_rank")


def with_rotations(chosen: DataFrame, images: DataFrame) -> DataFrame:
    """(split, id) of the chosen origins and of all images made from them."""
    family = images.select("id", F.coalesce("origin_id", "id").alias("image_id"))
    return chosen.select("split", "image_id").join(family, "image_id").select("split", "id").union(chosen.select("split", F.col("image_id").alias("id"))).distinct()


def summary(members: DataFrame, annotations: DataFrame) -> DataFrame:
    """(split, images, annotations)."""
    n = annotations.groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("n"))
    return members.join(n, "id", "left").groupBy("split").agg(F.count("*").alias("images"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("annotations"))


def component_pivot(chosen: DataFrame, splits: list[str] = list(SPLITS)) -> DataFrame:
    """Rows by component count with <split>_count and <split>_percentage (of the split, one decimal)."""
    counts = chosen.groupBy("stratum").pivot("split", splits).agg(F.count(F.lit(1))).fillna(0, splits)
    totals = chosen.groupBy().pivot("split", splits).agg(F.count(F.lit(1))).fillna(0, splits).select(*(F.col(s).alias(f"_{s}") for s in splits))
    rows = counts.crossJoin(F.broadcast(totals))  # one row
    cols = [c for s in splits for c in (F.col(s).cast("long").alias(f"{s}_count"), F.when(F.col(f"_{s}") > 0, F.round(100.0 * F.col(s) / F.greatest(F.col(f"_{s}"), F.lit(1)), 1)).otherwise(0.0).alias(f"{s}_percentage"))]
    return rows.select(F.col("stratum").alias("component_count"), *cols)
