"""Intensity stretches. Those with statistics take them per group and join them back, one row a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import at_least, clip, divide, log10


def sqrt_stretch(v: Column, low: float = 0.0, high: float | None = None) -> Column:
    return F.sqrt(clip(v, low, high))


def asinh_stretch(v: Column, a: float) -> Column:
    return F.asinh(v / F.lit(float(a)))


def linear_stretch(v: Column, low: float = float("-inf"), high: float = float("inf")) -> Column:
    """Limits only, without rescaling."""
    return clip(v, low, high)


def log_stretch(v: Column, epsilon: float) -> Column:
    return log10(v + F.lit(float(epsilon)))


def power_stretch(v: Column, exponent: float) -> Column:
    return F.pow(v, F.lit(float(exponent)))


def _with(df: DataFrame, by: list[str], stats: DataFrame) -> DataFrame:
    """`stats` (a row a group) joined back, null-safe."""
    keys = [stats[b].alias(f"_k{i}") for i, b in enumerate(by)]
    stats = stats.select(*keys, *(c for c in stats.columns if c not in by))
    if not by:
        return df.crossJoin(stats)  # one row
    on = [df[b].eqNullSafe(stats[f"_k{i}"]) for i, b in enumerate(by)]
    return df.join(stats, on, "left").drop(*(f"_k{i}" for i in range(len(by))))


def z_score(df: DataFrame, value: str, by: list[str], out: str = "z") -> DataFrame:
    """(v - mean) / population deviation; NaN or infinite where the deviation is 0."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return _with(df, by, stats).withColumn(out, divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def _nan_or(percentile: Column, value: str) -> Column:
    return F.when(F.max(F.isnan(value)), F.lit(float("nan"))).otherwise(percentile)


def robust_z_score(df: DataFrame, value: str, by: list[str], out: str = "z") -> DataFrame:
    """(v - median) / median absolute deviation, unscaled; 0 where the deviation is 0."""
    medians = df.groupBy(*by).agg(_nan_or(F.percentile(value, 0.5), value).alias("_m"))
    centred = _with(df, by, medians).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    spreads = centred.groupBy(*by).agg(_nan_or(F.percentile("_d", 0.5), "_d").alias("_s"))
    z = F.when(F.col("_s") == 0, 0.0).otherwise(divide(F.col(value) - F.col("_m"), F.col("_s")))
    return _with(centred, by, spreads).withColumn(out, z).drop("_m", "_d", "_s")


def quantile_stretch(df: DataFrame, value: str, by: list[str], low: float = 0.01, high: float = 0.99, out: str = "q") -> DataFrame:
    """(v - q_low) / (q_high - q_low), unclipped; 0 where the quantiles are equal."""
    stats = df.groupBy(*by).agg(F.percentile(value, [low, high]).alias("_q"), F.max(F.isnan(value)).alias("_n"))
    q = F.when(F.col("_n"), F.lit(float("nan"))).when(F.col("_q")[1] == F.col("_q")[0], 0.0).otherwise((F.col(value) - F.col("_q")[0]) / (F.col("_q")[1] - F.col("_q")[0]))
    return _with(df, by, stats).withColumn(out, q).drop("_q", "_n")


def quantise_fixed(v: Column, levels: int = 65535) -> Column:
    """[0, 1] to 0..levels, truncated; null for NaN."""
    return F.when(~F.isnan(v), (clip(v, 0.0, 1.0) * levels).cast("int"))


def quantise_per_group(df: DataFrame, value: str, by: list[str], levels: int = 65535, out: str = "level") -> DataFrame:
    """Least to greatest value of a group to 0..levels, truncated; 0 where the range is 1e-8 or less."""
    stats = df.groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    span = F.col("_b") - F.col("_a")
    return _with(df, by, stats).withColumn(out, F.when(span <= 1e-8, 0).otherwise(((F.col(value) - F.col("_a")) / span * levels).cast("int"))).drop("_a", "_b")


def rgb_encode(v: Column, rms: float, asinh: bool = False) -> tuple[Column, Column, Column]:
    """Stretched values, the 3-sigma mask and the 5-sigma mask."""
    red = asinh_stretch(v, 5 * rms) if asinh else sqrt_stretch(v)
    return red, at_least(v, F.lit(3 * rms)).cast("int"), at_least(v, F.lit(5 * rms)).cast("int")


def contour_levels(levels: Column, rms: float) -> Column:
    return F.transform(levels, lambda x: x * F.lit(rms) * F.lit(1e-3))
