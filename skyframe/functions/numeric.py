"""Arithmetic that treats NaN, zero divisors and logarithms of non-positive numbers as IEEE arrays do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def clip(v: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """`v` within [low, high]; NaN stays NaN."""
    out = v
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(F.isnan(v), v).otherwise(out)


def at_least(v: Column, threshold: float | Column) -> Column:
    """v >= threshold, false for NaN."""
    return ~F.isnan(v) & (v >= threshold)


def divide(a: Column, b: Column) -> Column:
    """a / b with infinities and NaN for a zero divisor."""
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def log10(v: Column) -> Column:
    return F.when(v > 0, F.log10(v)).when(v == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def zero_filled(s: Column, width: int) -> Column:
    """Zeros before `s` up to `width`; longer strings stay whole."""
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))
