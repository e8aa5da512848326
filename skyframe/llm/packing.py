"""Best-fit packing: length patterns fitted to the length histogram by non-negative least squares.

A document's tokens and one end token are cut into pieces of `LENGTH` tokens; a first piece holds what is
left over. Full pieces are sequences of their own. The histogram of the other lengths has at most
LENGTH - 1 bins, whatever the corpus: patterns of one to three lengths that fill a sequence are fitted to it by
non-negative least squares, repeat counts are rounded down, and what remains is packed best-fit, largest
first, over the histogram. The plan (patterns and their counts) is small and goes to every task, where a
piece finds its place from its rank among the pieces of its length.

Ranks are dealt by (length, slice) counts and offsets, so one frequent length isn't gathered in one task.

Nulls: a null text is empty: one piece, the end token. A null doc_id is kept. Repeated rows are packed
each on their own. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

LENGTH = 1024
END_ID = 2
#: Numbers of three-length patterns in the fits; the fit that needs fewest sequences is taken.
TRIPLES = (0, 300, 3000)
#: Slices that the pieces of one length are ranked in.
SLICES = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE of a rank file, one per worker. Its ids are those of the vocabulary's JSON form."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i in range(0, len(ids), 64):
                rows = [], [], [], [], []
                for k, text in enumerate(texts.slice(i, 64).to_pylist()):
                    tokens = np.array([*enc.encode_ordinary(text or ""), end_id], "<u4")
                    limits = [0, *range(len(tokens) % length or length, len(tokens) + 1, length)]
                    for n, (a, b) in enumerate(zip(limits, limits[1:], strict=False)):
                        for to, v in zip(rows, (i + k, n, a, b - a, zlib.crc32(tokens[a:b].tobytes())), strict=True):
                            to.append(v)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows[0], pa.int64())), *(pa.array(r, t) for r, t in zip(rows[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def nnls(a_rows: np.ndarray, a_cols: np.ndarray, a_vals: np.ndarray, b: np.ndarray, n: int, steps: int = 300) -> np.ndarray:
    """min |A x - b| with x >= 0 for a sparse non-negative A, by multiplicative updates."""
    x = np.ones(n)
    atb = np.bincount(a_cols, a_vals * b[a_rows], n)
    for _ in range(steps):
        ax = np.bincount(a_rows, a_vals * x[a_cols], len(b))
        x *= atb / np.maximum(np.bincount(a_cols, a_vals * ax[a_rows], n), 1e-12)
    return x


@dataclass
class Plan:
    """Slot k of length l lies in copy `k // times` of ...: per length, pattern slots with the ranks they start at."""

    first_rank: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    n_sequences: int


def plan_patterns(histogram: dict[int, int], length: int = LENGTH, triples: tuple[int, ...] = TRIPLES) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences) that hold the whole histogram: the best of the fits."""
    return min((_fitted(histogram, length, t) for t in triples), key=lambda found: sum(n for _, n in found))


def _fitted(histogram: dict[int, int], length: int, triples: int) -> list[tuple[tuple[int, ...], int]]:
    left = np.zeros(length + 1, np.int64)
    for k, n in histogram.items():
        left[k] = n
    have = np.flatnonzero(left[:length] > 0)
    found: list[tuple[tuple[int, ...], int]] = []
    patterns = [(int(a), int(length - a)) for a in have if a >= length - a and left[length - a] > 0]
    rng, seen = np.random.default_rng(7), set(patterns)
    if len(have):
        share = left[have] / left[have].sum()
        for a, b in rng.choice(have, (triples, 2), p=share):
            c = length - a - b
            if c > 0 and left[c] > 0 and (t := tuple(sorted((int(a), int(b), int(c)), reverse=True))) not in seen:
                seen.add(t)
                patterns.append(t)
    if patterns:
        rows, cols = np.array([(k, j) for j, p in enumerate(patterns) for k in p]).T
        x = nnls(rows, cols, np.ones(len(rows)), left.astype(float), len(patterns))
        for j in np.argsort(-x, kind="stable"):
            p = patterns[j]
            n = min(int(x[j]), *(int(left[k]) // p.count(k) for k in p))
            if n > 0:
                found.append((p, n))
                for k in p:
                    left[k] -= n
    for k in range(length, 0, -1):
        while left[k] > 0:
            p, room = [k], length - k
            use = left.copy()
            use[k] -= 1
            while room > 0 and len(fits := np.flatnonzero(use[1 : room + 1])):
                best = int(fits[-1]) + 1
                p.append(best)
                use[best] -= 1
                room -= best
            n = min(int(left[q]) // p.count(q) for q in set(p))
            found.append((tuple(p), n))
            for q in p:
                left[q] -= n
    return found


def plan_places(found: list[tuple[tuple[int, ...], int]]) -> Plan:
    ranks: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for p, n in found:
        at = 0
        for k in p:
            slots.setdefault(k, []).append((ranks.get(k, 0), base, at))
            ranks[k] = ranks.get(k, 0) + n
            at += k
        base += n
    arrays = {k: np.array(v, np.int64).T for k, v in slots.items()}
    return Plan({k: v[0] for k, v in arrays.items()}, {k: v[1] for k, v in arrays.items()}, {k: v[2] for k, v in arrays.items()}, base)


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, slices: int = SLICES) -> DataFrame:
    """One row per piece with its sequence_id and its offset there."""
    cut = staged(pieces(docs, vocabulary, length).withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int")), "pieces")
    counts = cut.groupBy("length", "slice").agg(F.count("*").alias("n")).withColumn(
        "first", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `length` rows
    plan = plan_places(plan_patterns(histogram, length))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            rank = f["rank"].to_numpy()
            for k, own in f.groupby("length").indices.items():
                slot = np.searchsorted(plan.first_rank[k], rank[own], "right") - 1
                sequence[own] = plan.sequence[k][slot] + rank[own] - plan.first_rank[k][slot]
                offset[own] = plan.offset[k][slot]
            yield f.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    ranked = (
        cut.join(F.broadcast(counts.select("length", "slice", "first")), ["length", "slice"])  # at most length * slices rows
        .withColumn("rank", F.col("first") + F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
