"""Exact substring dedup: every byte covered by a 100-byte string that also starts earlier is removed.

Suffixes are dealt out by content. The least hash of the 32-byte grams in a 100-byte window names the window, so equal
windows have equal names, and runs of windows of one name are segments. Names that occur once in the corpus hold no
repeat; they are told apart by counts, and a bitmap sized by the corpus keeps most of them from being sent (where it is
full, more is sent and the result is the same). Equal segments count as one before they are sent: the first occurrence
stands for all, the others are repeats of it. What differs under one name goes to the suffix arrays:

Segments of a bucket of names are dealt into shards. A shard's suffixes are sorted once by their first `LENGTH` bytes,
read as letters of `LETTER` bytes at every byte offset, which gives its Burrows-Wheeler transform and the number of
letters that neighbours share. Shards are merged by interleave refinement: after k rounds each suffix of one shard has
its place among the other's suffixes by k letters, and each round moves places to where the transform's letters send
them, by counts alone. The rounds in which a place or an interval still changed are the common prefixes at the seams,
and runs of suffixes that share `LENGTH / LETTER` letters are the repeated intervals. No suffix is sorted again.

A name with over `HOT_SEGMENTS` different segments (the borders of a passage in a great many documents) would gather in
one task. It is split by longer context: its segments get new names by their grams of 64, then 96 bytes, and go the same
way. Under a 96-byte name, segments differ by four bytes at either end and their number is bounded by those.

Nulls: a null text is empty. A null doc_id sorts before all others. Rows that share a doc_id share the removed ranges,
each cut to its length, and aren't earlier than one another. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import array_of, in_array, marked, words_of
from .staging import discard, kept, staged
from .wordarrays import U64, TextChunk, chunks, mix

LENGTH, LETTER = 100, 5
DEPTH = LENGTH // LETTER
#: Bytes of the grams that name windows, and those that name the windows of hot names anew.
GRAM, FINER = 32, (64, 96)
#: Least and most bits of the filters, of names and of documents that may lose something. They grow with the corpus in between.
NAME_BITS, DOC_BITS = (22, 29), (16, 25)
#: Bytes of the segments of one bucket and of one shard, and different segments from which a name is hot.
BUCKET_BYTES, SHARD_BYTES, HOT_SEGMENTS = 1 << 19, 1 << 18, 2000
#: Bytes turned into arrays at once: few enough for a core's cache.
CHUNK = 1 << 17
_LEAST = -(2**63)
#: A filter's words and its number of bits.
Filter = tuple[np.ndarray, int]


def _slide(a: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n neighbours, by doubling."""
    size = 1
    while size * 2 <= n:
        a = f(a[:-size], a[size:]) if len(a) > size else a[:0]
        size *= 2
    rest = n - size
    return (f(a[:-rest], a[rest:]) if len(a) > rest else a[:0]) if rest else a


def windows(c: TextChunk, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, and for each window start the window's name and whether it lies within one text."""
    n = len(c.buf)
    if n < LENGTH:
        e = np.zeros(0, np.uint64)
        return e, e, e.astype(bool)
    grams = c.hashes_of_length(gram)
    names = _slide(grams, LENGTH - gram + 1, np.minimum)
    edge = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(c.off) >= LENGTH)
    edge[c.off[long]] += 1
    edge[c.off[long + 1] - LENGTH + 1] -= 1
    return grams, names, np.cumsum(edge[: len(names)]) > 0


def chosen_grams(grams: np.ndarray, names: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The name of each gram occurrence that names a window."""
    n = LENGTH - GRAM + 1
    over = np.zeros(len(names) + 2 * (n - 1), np.uint64)
    over[n - 1 : n - 1 + len(names)] = np.where(valid, names, U64(0))
    return mix(grams[_slide(over, n, np.maximum)[: len(grams)] == grams])


def segments(c: TextChunk, wanted: Filter | None, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(name, start, end, whether its gram recurs) of the segments whose names' bits are set; starts and ends are byte places in the chunk."""
    grams, names, valid = windows(c, gram)
    if not len(names):
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e.astype(bool)
    change = np.ones(len(names) + 1, bool)
    change[1:-1] = (names[1:] != names[:-1]) | (valid[1:] != valid[:-1])
    limits = np.flatnonzero(change)
    starts, ends = limits[:-1], limits[1:]
    keep = valid[starts]
    starts, ends = starts[keep], ends[keep]
    key = mix(names[starts])
    if wanted is not None:
        keep = in_array(wanted[0], key, wanted[1])
        key, starts, ends = key[keep], starts[keep], ends[keep]
    n = ends - starts + LENGTH - gram
    own = np.repeat(np.arange(len(starts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[own]
    recurs = np.bincount(own, grams[at] == names[starts][own], len(starts)) > 1
    return key, starts, ends - 1 + LENGTH, recurs


def repeated_names(docs: DataFrame, bits: int) -> Filter:
    """The filter of the names of which the corpus has two occurrences or more."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, c in chunks(batch.column("text"), CHUNK):
                names, n = np.unique(chosen_grams(*windows(c)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n.astype(np.int32))], ["name", "n"])

    names = docs.select("text").mapInArrow(counted, "name long, n int").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1")
    return array_of(words_of(names, F.col("name"), bits), bits), bits


def found_segments(pieces: DataFrame, bitmap, with_bytes: bool, gram: int) -> DataFrame:
    """(name, segment, doc, start, end, recurs) of pieces(doc, start, text) and, if asked for, the bytes; segment is their hash."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            begin = batch.column("start").to_numpy()
            for i, _, c in chunks(batch.column("text"), CHUNK):
                key, starts, ends, recurs = segments(c, bitmap and bitmap.value, gram)
                if not len(key):
                    continue
                text = np.searchsorted(c.off, starts, "right") - 1
                at = c.off[text] - begin[i + text]
                cols = {"name": key.view(np.int64), "segment": c.hashes(starts, ends).view(np.int64), "doc": ids[i + text], "start": starts - at, "end": ends - at, "recurs": recurs}
                if with_bytes:
                    whole = c.buf.tobytes()
                    cols["bytes"] = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()})

    return pieces.mapInArrow(found, "name long, segment long, doc long, start long, end long, recurs boolean" + ", bytes binary" * with_bytes)


def _ordered(keys: np.ndarray) -> np.ndarray:
    """The order of non-negative keys, by place among equal ones where key and place fit one number (as letters do)."""
    bits = len(keys).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits > 63:
        return np.argsort(keys, kind="stable")
    return np.sort((keys << bits) | np.arange(len(keys))) & ((1 << bits) - 1)


def _ranked(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by several keys, and the dense rank (from 0) of each element."""
    bits = max((int(k.max()).bit_length() for k in keys), default=0)
    if bits * len(keys) <= 63:
        joined = keys[0].astype(np.int64)
        for k in keys[1:]:
            joined = (joined << bits) | k
        keys = [joined]
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    new = np.zeros(len(order), bool)
    for k in keys:
        there = k[order]
        new[1:] |= there[1:] != there[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return order, ranks


class Transform:
    """Suffixes of some segments in the order of their first `DEPTH` letters, and the letters before them.

    A letter is `LETTER` bytes; 0 stands before a segment's first bytes and after its last ones, and is like no other letter.
    `common` is the number of letters, `DEPTH` at most, that a suffix shares with the one before it in the order.
    """

    def __init__(self, before: np.ndarray, where: np.ndarray, common: np.ndarray, ends: int):
        self.before, self.where, self.common, self.ends = before, where, common, ends

    @property
    def block(self) -> np.ndarray:
        """The number of the repeated interval of each suffix: equal suffixes have equal numbers."""
        return np.cumsum(self.common < DEPTH)

    @classmethod
    def build(cls, pieces: list[bytes], first: int) -> Transform:
        """The transform of one shard; `where` numbers the places of all pieces from `first`, one place past each end included."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        own = np.repeat(np.arange(len(pieces)), sizes + 1)
        place = np.arange(len(own)) - np.repeat(np.cumsum(sizes + 1) - (sizes + 1), sizes + 1)
        left = sizes[own] - place
        flat = np.frombuffer(b"\0".join(pieces) + bytes(1 + LETTER), np.uint8).astype(np.int64)
        letter = np.zeros(len(own), np.int64)
        for k in range(LETTER):
            letter = (letter << 8) | flat[k : k + len(own)]
        letter = np.where(left >= LETTER, letter + 1, 0)

        def on(values: np.ndarray, letters: int) -> np.ndarray:
            """The values so many letters further on; 0 beyond the segment."""
            by = letters * LETTER
            out = np.zeros_like(values)
            out[: len(values) - by] = values[by:]
            out[left < by] = 0
            return out

        _, ranks = _ranked([letter])
        for step in (1, 3):  # ranks by three letters, then by nine
            _, ranks = _ranked([ranks, on(ranks, step), on(ranks, 2 * step)])
        order, _ = _ranked([ranks, on(ranks, 9), on(ranks, DEPTH - 9)])
        common = np.zeros(len(own), np.int64)
        like = np.arange(1, len(own))
        for k in range(DEPTH):
            a, b = order[like - 1] + k * LETTER, order[like] + k * LETTER
            like = like[(letter[a] == letter[b]) & (letter[b] != 0)]
            common[like] = k + 1
        back = np.flatnonzero(place >= LETTER)
        before = np.zeros(len(own), np.int64)
        before[back] = letter[back - LETTER]
        return cls(before[order], first + order, common, int((letter == 0).sum()))

    def moves(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in the order of the suffixes one letter longer, and those letters."""
        order = _ordered(self.before)
        return order, self.before[order]

    def merge(self, other: Transform) -> Transform:
        """Both in one order, by refinement of the interleave alone.

        `low` and `high` bound the other's suffixes that share the letters compared so far with each suffix of this one.
        Suffixes that share them with none have their place, so each round moves the open ones only.
        """
        n, m = len(self.before), len(other.before)
        order, letters = self.moves()
        to, theirs = other.moves()
        starts = np.flatnonzero(np.append(True, theirs[1:] != theirs[:-1]))
        alphabet = theirs[starts]
        held = np.repeat(np.arange(len(alphabet)), np.diff(np.append(starts, m))) * (m + 1) + to
        rank = np.searchsorted(alphabet, letters)
        known = np.append(alphabet, -1)[rank] == letters
        base = rank * (m + 1)
        low, high = np.zeros(n, np.int64), np.full(n, m, np.int64)
        above, below = np.zeros(n, np.int64), np.zeros(n, np.int64)
        # Letters that the other lacks, and ends, have their place after the first letter.
        placed = ~known
        placed[: self.ends] = True
        high[placed] = low[placed] = np.where(np.arange(n) < self.ends, 0, np.searchsorted(held, base))[placed]
        open_ = np.flatnonzero(~placed)
        tails = order[open_]
        for k in range(DEPTH):
            if k == 0:  # no letter compared: every tail is open over all
                a, b = np.searchsorted(held, base[open_]), np.searchsorted(held, base[open_] + m)
            else:
                a, b = low[tails], high[tails]
                wide = a < b
                a = np.searchsorted(held, base[open_] + a)
                top = a.copy()
                top[wide] = np.searchsorted(held, base[open_[wide]] + b[wide])
                b = top
            above[open_[a > low[open_]]] = k
            below[open_[b < high[open_]]] = k
            low[open_], high[open_] = a, b
            still = a < b
            open_, tails = open_[still], tails[still]
        below[high > low] = DEPTH
        from_other = np.ones(n + m, bool)
        from_other[np.arange(n) + low] = False
        out = Transform(*(np.empty(n + m, np.int64) for _ in range(3)), self.ends + other.ends)
        for name in ("before", "where", "common"):
            column = getattr(out, name)
            column[~from_other], column[from_other] = getattr(self, name), getattr(other, name)
        seams = np.flatnonzero(from_other[1:] != from_other[:-1]) + 1
        mine = np.cumsum(~from_other)[seams] - 1  # the last own suffix up to the seam
        out.common[seams] = np.where(from_other[seams], below[mine], above[mine])
        return out


def repeats_of(doc: np.ndarray, start: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the byte runs covered by windows that also start earlier among the pieces."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    limits = [0]
    while limits[-1] < len(pieces):
        limits.append(max(limits[-1] + 1, int(np.searchsorted(np.cumsum(sizes), sizes[: limits[-1]].sum() + SHARD_BYTES, "right"))))
    if len(limits) == 2 and len(pieces) > 1:
        limits.insert(1, len(pieces) // 2)
    shards = [Transform.build(pieces[a:b], int(first[a])) for a, b in zip(limits, limits[1:], strict=False)]
    while len(shards) > 1:
        shards = [a.merge(b) for a, b in zip(shards[::2], shards[1::2], strict=False)] + shards[len(shards) // 2 * 2 :]
    t = shards[0]
    repeated = t.common == DEPTH
    repeated[:-1] |= repeated[1:]
    block, where = t.block[repeated], t.where[repeated]
    own = np.searchsorted(first, where, "right") - 1
    d, p = doc[own], start[own] + where - first[own]
    order = np.lexsort((p, d, block))
    block, d, p = block[order], d[order], p[order]
    least = np.maximum.accumulate(np.where(np.append(True, block[1:] != block[:-1]), np.arange(len(block)), 0)) if len(block) else block
    again = (d != d[least]) | (p != p[least])
    return covered(d[again], p[again])


def covered(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows at (doc, start) as maximal runs (doc, start, end)."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if not len(doc):
        return doc, start, start
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + LENGTH)
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[new], start[new], start[last] + LENGTH


RANGES = "doc long, start long, end long"


def merged_repeats(contested: DataFrame, buckets: int) -> DataFrame:
    """Repeats among the different segments of each name, by merging the transforms of each bucket."""

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc", "start"])
        return pd.DataFrame(dict(zip(("doc", "start", "end"), repeats_of(f["doc"].to_numpy(), f["start"].to_numpy(), list(f["bytes"])), strict=True)))

    dealt = contested.select(F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int").alias("bucket"), "doc", "start", "bytes")
    return dealt.groupBy("bucket").applyInPandas(merge, RANGES)


def later_ones(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The ranges of all occurrences of a segment but its first."""
    firsts = groups.where("n > 1").select("name", "segment", F.struct("first.doc", "first.start").alias("first"))
    later = rows.select("name", "segment", "doc", "start", "end").join(firsts, ["name", "segment"]).where(F.struct("doc", "start") > F.col("first"))
    return later.select("doc", "start", "end")


def open_names(groups: DataFrame) -> DataFrame:
    """The names that hold more than one different segment, or one in which their gram recurs."""
    return groups.groupBy("name").agg(F.count("*").alias("different"), F.max("recurs").alias("any_recurs")).where("different > 1 OR any_recurs").drop("any_recurs")


def contested_segments(pieces: DataFrame, names: Filter | None, gram: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Of pieces(doc, start, text), written: the ranges settled as equal segments, and the segments that differ under one name."""
    spread = pieces.sparkSession.sparkContext.broadcast
    rows = kept(found_segments(pieces, names and spread(names), False, gram))
    groups = kept(rows.groupBy("name", "segment").agg(F.min(F.struct("doc", "start", "end")).alias("first"), F.count("*").alias("n"), F.max("recurs").alias("recurs")))
    settled = staged(later_ones(rows, groups), "ranges")
    rows.unpersist()
    open_ = kept(open_names(groups))  # held: the join deals its rows anew and can split a hot name
    firsts = kept(groups.join(open_, "name").select("name", "segment", "different", "first.doc", "first.start"))
    groups.unpersist()
    open_.unpersist()
    wanted = spread((array_of(words_of(firsts, F.col("name"), bits), bits), bits))
    texts = found_segments(pieces, wanted, True, gram).select("name", "segment", "doc", "start", "bytes")
    contested = staged(firsts.join(texts, ["name", "segment", "doc", "start"]).select("name", "different", "doc", "start", "bytes").distinct(), "contested")
    firsts.unpersist()
    return settled, contested


def removed_ranges(docs: DataFrame, bits: int) -> DataFrame:
    """(doc, start, end) byte ranges of docs(doc, text) to remove; they may overlap. All that it reads is written."""
    whole = docs.select("doc", F.lit(0).cast("long").alias("start"), "text")
    found, contested = contested_segments(whole, repeated_names(docs, bits), GRAM, bits)
    for gram in (*FINER, None):
        here = F.lit(True) if gram is None else F.col("different") <= HOT_SEGMENTS
        size, hot = contested.agg(F.sum(F.when(here, F.length("bytes"))), F.count(F.when(~here, 1))).first()
        found = found.unionByName(merged_repeats(contested.where(here), max(1, -(-(size or 0) // BUCKET_BYTES))))
        if not hot:
            break
        pieces = contested.where(~here).select("doc", "start", F.col("bytes").alias("text"))
        settled, contested = contested_segments(pieces, None, gram, bits)
        found = found.unionByName(settled)
    return found


def dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Only documents that may have ranges are sent to them; a bitmap tells the others.
    """
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc"), "text")
    rows, size = keyed.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    name_bits, doc_bits = (min(max((n or 0).bit_length(), least), most) for n, (least, most) in (((size or 0) // 8, NAME_BITS), (rows * 8, DOC_BITS)))
    found = removed_ranges(keyed.select("doc", "text"), name_bits)
    ranges = staged(found.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "removed")
    discard(found)
    split = marked(keyed, F.xxhash64("doc"), words_of(ranges, F.xxhash64("doc"), doc_bits), doc_bits)
    none = F.expr("cast(NULL AS array<bigint>)")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for text, starts, ends in zip(batch.column("text"), batch.column("starts"), batch.column("ends"), strict=True):
                raw = (text.as_py() or "").encode()
                at, kept, removed, spans = 0, hashlib.sha256(), 0, 0
                if starts.is_valid:
                    a, b = starts.values.to_numpy(), ends.values.to_numpy()
                    order = np.argsort(a, kind="stable")
                    reach = np.maximum.accumulate(b[order])
                    new = np.flatnonzero(np.append(True, a[order][1:] > reach[:-1]))
                    for s, e in zip(a[order][new], reach[np.append(new[1:], len(order)) - 1], strict=True):
                        e = min(int(e), len(raw))
                        if s < e:
                            kept.update(raw[at:s])
                            at, removed, spans = e, removed + e - int(s), spans + 1
                kept.update(raw[at:])
                for to, v in zip(rows, (len(raw), removed, spans, kept.hexdigest()), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = split.where("_may").join(ranges, "doc", "left").select("doc_id", "text", "starts", "ends")
    whole = split.where("NOT _may").select("doc_id", "text", none.alias("starts"), none.alias("ends"))
    return joined.unionByName(whole).mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
