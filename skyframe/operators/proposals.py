"""Region proposals: islands, the largest of them, and the boxes of all their subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pixels import box_columns

#: More islands than this would give over a million subsets.
MOST_ISLANDS = 20


def island_properties(labels: DataFrame, key: str) -> DataFrame:
    """(key, island_id, area, xmin, ymin, xmax, ymax)."""
    return labels.groupBy(key, "island_id").agg(F.count("*").alias("area"), *box_columns())


def largest_islands(islands: DataFrame, key: str, k: int) -> DataFrame:
    """The k largest with `rank` from 1; ties by island id, which is scan order."""
    return islands.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("area").desc(), "island_id"))).where(F.col("rank") <= k)


def subsets(islands: DataFrame, key: str, max_islands: int = 10) -> DataFrame:
    """(key, members, size, xmin, ymin, xmax, ymax, score) of every non-empty subset of the largest islands.

    `members` is a bit mask, bit 0 the largest island; score is the subset's area over all the chosen islands' area.
    """
    if not 1 <= max_islands <= MOST_ISLANDS:
        raise ValueError(f"max_islands must be from 1 to {MOST_ISLANDS}")
    top = largest_islands(islands, key, max_islands)
    held = top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "area", "xmin", "ymin", "xmax", "ymax"))).alias("t"), F.sum("area").alias("all"))
    each = held.withColumn("members", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("t")).cast("int") - 1)))
    own = F.filter("t", lambda i: F.floor(F.col("members") / F.pow(F.lit(2), i["rank"] - 1)) % 2 == 1)
    each = each.withColumn("own", own)
    pick = lambda f, c: f(F.transform("own", lambda i: i[c])).cast("float").alias(c)
    area = F.aggregate("own", F.lit(0).cast("long"), lambda acc, i: acc + i["area"])
    return each.select(
        key, F.col("members").cast("long").alias("members"), F.size("own").alias("size"), pick(F.array_min, "xmin"), pick(F.array_min, "ymin"), pick(F.array_max, "xmax"), pick(F.array_max, "ymax"),
        (area / F.col("all")).cast("float").alias("score"),
    )
