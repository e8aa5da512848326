"""Filters of fixed size: 2**bits bits, however many keys there are.

A key sets the bit of its hash's upper bits. A full filter lets everything pass and never drops a key it holds, so what it is
used for stays right at any size; it only saves sending rows that can't match.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26


def bits_for(keys: int, most: int = BITS) -> int:
    """Bits' logarithm of a filter with 16 bits a key or more, up to `most`."""
    return max(16, min(most, (16 * keys).bit_length()))


def _place(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits)


def words_of(keys: DataFrame, hashed: Column, bits: int = BITS) -> DataFrame:
    """(word, bits) of the filter over a column of well-mixed longs: at most 2**(bits - 6) rows."""
    return keys.select(_place(hashed, bits).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))


def array_of(words: DataFrame, bits: int = BITS) -> np.ndarray:
    out = np.zeros(1 << (bits - 6), np.uint64)
    for batch in words.toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    return out


def in_array(array: np.ndarray, hashed: np.ndarray, bits: int = BITS) -> np.ndarray:
    place = hashed >> np.uint64(64 - bits)
    return (array[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def marked(df: DataFrame, hashed: Column, words: DataFrame, bits: int = BITS, name: str = "_may") -> DataFrame:
    """`df` with a boolean: whether the filter may hold the row's key. The filter is the broadcast side."""
    held = df.withColumn("_p", _place(hashed, bits)).withColumn("_word", F.shiftright("_p", 6))
    held = held.join(F.broadcast(words.withColumnsRenamed({"word": "_word", "bits": "_bits"})), "_word", "left")
    return held.withColumn(name, F.coalesce(F.expr("shiftrightunsigned(_bits, cast(_p & 63 as int)) & 1L"), F.lit(0)) == 1).drop("_p", "_word", "_bits")
