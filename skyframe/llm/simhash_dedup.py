"""Near-duplicate documents by SimHash fingerprints and anchors of covering codes.

The 64 bits are cut into blocks. Two fingerprints that differ in up to four bits differ in a block by at most its reach, as the reaches
plus one add up to five. Each block has a covering code: every word of the block lies within the code's radius of an anchor. A fingerprint
is at home at its nearest anchor of a block and visits every anchor within radius plus reach, so two that are near meet at the home
of either; fingerprints are compared per anchor. The blocks' codes are [15,11] Hamming codes (radius 1) beside free bits, and all words of the
last block (radius 0, reach 0); a fingerprint is sent to `VISITS` anchors or fewer.

A further covering code, of all 64 bits and radius 2, puts fingerprints into cells. Two of a cell differ in at most four bits, so a cell
is linked without comparing anything, and links between cells are all that anchors look for. A crowded anchor (more than `CROWD` rows) is first
compared with the fingerprint that most documents there have; then only cells that aren't in that one's component are compared with
all of the anchor, dealt by the open ones. No group is dropped or capped: beyond the crowd's size, work is open members times members.

Only the different fingerprints take part, so copies never meet. Only crowded anchors are broadcast; of all anchors there are 2**20 + 2**18 at most.

Nulls: a null text and a text without words have fingerprint zero, linked like any other. A null doc_id is never linked and its
component is null. Rows that share a doc_id are fingerprinted each; the id is in the components of all its rows. Empty tables give empty
results. Long texts are hashed in steps of `STEP` shingles. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import components
from .staging import staged

SHINGLE, SEED = 4, 42
DISTANCE = 4
#: Shingles whose bits are counted at once.
STEP = 1 << 16
#: Rows of an anchor from which its most frequent fingerprint is compared first; open rows of it that one task compares with all.
CROWD, DEAL = 20_000, 20_000
#: Rows of anchors that a task holds at once on average, and pairs that it compares at once.
GROUP_ROWS, PAIRS = 200_000, 1 << 21
#: Lowest bit, bits, whether the lowest 15 bits form a Hamming code, and reach of each block: (1 + 1) + (1 + 1) + (0 + 1) > DISTANCE.
BLOCKS = [(0, 23, True, 1), (23, 23, True, 1), (46, 18, False, 0)]
#: Anchors of a fingerprint at most: 8 of the code at unchanged free bits and 8 at one changed free bit, for two blocks; one of the last.
VISITS = 2 * (1 + 7 + 8) + 1


def text_fingerprint(text: bytes | None) -> int:
    """64 bits of which each is set if it is in over half the hashes of the text's shingles, repeats included."""
    words = (text or b"").lower().split()  # of bytes: only A-Z, only 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - SHINGLE + 1)
    first, last = starts[:n], ends[min(SHINGLE, len(words)) - 1 :]
    digest, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + STEP].tolist(), last[at : at + STEP].tolist(), strict=True)], np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fp (the fingerprint as a signed long)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([text_fingerprint(t.as_py()) for t in batch.column("text").cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(hashed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _syndromes(bits: int) -> np.ndarray:
    """The Hamming syndrome of every word of so many bits: bit i (from 0) of the word adds i + 1. All 2**r - 1 syndromes occur."""
    out = np.zeros(1 << bits, np.uint8)
    for i in range(bits):
        out[1 << i : 2 << i] = out[: 1 << i] ^ np.uint8(i + 1)
    return out


_SYNDROME = _syndromes(15)


def nearest(word: np.ndarray) -> np.ndarray:
    """The anchor of the [15,11] Hamming code within one bit of each 15-bit word."""
    s = _SYNDROME[word.astype(np.int64)].astype(np.uint64)
    return word ^ np.where(s > 0, np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1)), np.uint64(0))


def _syndrome31(word: np.ndarray) -> np.ndarray:
    s = np.zeros(len(word), np.uint64)
    for i in range(31):
        s ^= ((word >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return s


def cells(fp: np.ndarray) -> np.ndarray:
    """The nearest anchor of two [31,26] Hamming codes beside two free bits: radius 2, so two of a cell differ in 4 bits at most."""
    out, mask = fp.copy(), np.uint64(2**31 - 1)
    for low in (np.uint64(0), np.uint64(31)):
        s = _syndrome31((fp >> low) & mask)
        out ^= np.where(s > 0, np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1) + low), np.uint64(0))
    return out


def anchors_of(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, anchors, at home) of the fingerprints, in steps: each row once at its home and once at each other anchor it visits.

    Anchors within reach of 1 beyond the radius are those within two bits in the code's part at unchanged free bits, and within one bit at
    one changed free bit. Two changed bits lead to an anchor if their positions add up (by exclusive or) to the syndrome.
    """
    rows = np.arange(len(fp))
    for k, (low, bits, hamming, _) in enumerate(BLOCKS):
        word = (fp >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        name = lambda w, k=k: (w | np.uint64(k << 60)).view(np.int64)
        if not hamming:
            yield rows, name(word), True
            continue
        part, free = word & np.uint64(32767), word >> np.uint64(15)
        home = nearest(part)
        yield rows, name(home | free << np.uint64(15)), True
        for i in range(bits - 15):
            yield rows, name(home | (free ^ np.uint64(1 << i)) << np.uint64(15)), False
        s = _SYNDROME[part.astype(np.int64)].astype(np.int64)
        for i in range(1, 16):
            j = s ^ i  # the other bit; 0 means that bit i alone leads home
            own = np.flatnonzero(i < j)
            yield own, name(part[own] ^ np.uint64(1 << (i - 1)) ^ (np.uint64(1) << (j[own] - 1).astype(np.uint64)) | free[own] << np.uint64(15)), False


def placed(fps: DataFrame) -> DataFrame:
    """(anchor, fp, home, n) of the different fingerprints at all their anchors."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for rows, anchor, home in anchors_of(fp.view(np.uint64)):
                columns = [pa.array(anchor), pa.array(fp[rows]), pa.array(np.full(len(rows), home)), batch.column("n").take(pa.array(rows))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "fp", "home", "n"])

    return fps.select("fp", "n").mapInArrow(place, "anchor long, fp long, home boolean, n long")


class Forest:
    """Components of cells, and the pairs of cells that joined them."""

    def __init__(self, cell: np.ndarray):
        self.names, self.of = np.unique(cell, return_inverse=True)
        self.parent, self.joined = list(range(len(self.names))), []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, rows: np.ndarray, others: np.ndarray) -> None:
        width = len(self.names)
        for pair in np.unique(self.of[rows] * width + self.of[others]).tolist():
            x, y = self.root(pair // width), self.root(pair % width)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.joined.append((int(self.names[pair // width]), int(self.names[pair % width])))

    def settle(self) -> None:
        """Gives rows of one component one number, so that they aren't compared again."""
        self.of = np.array([self.root(i) for i in range(len(self.names))])[self.of]

    def table(self) -> pa.Table:
        return pa.table({k: pa.array([p[i] for p in self.joined], pa.int64()) for i, k in enumerate("ab")})


def meet(t: pa.Table) -> pa.Table:
    """Links of cells within whole anchors: everyone at home there is compared with all of the anchor."""
    t = t.sort_by([("anchor", "ascending"), ("home", "descending")])
    anchor, fp = t.column("anchor").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
    home = t.column("home").combine_chunks().to_numpy(zero_copy_only=False)
    forest = Forest(cells(fp).view(np.int64))
    begin = np.searchsorted(anchor, anchor)
    size = np.searchsorted(anchor, anchor, "right") - begin
    left = np.flatnonzero(home & (size > 1))
    total = np.cumsum(size[left])
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        rows, n = left[at:to], size[left[at:to]]
        first = np.cumsum(n) - n
        i = np.repeat(rows, n)
        j = np.repeat(begin[rows], n) + np.arange(len(i)) - np.repeat(first, n)
        near = np.flatnonzero(np.bitwise_count(fp[i] ^ fp[j]) <= DISTANCE)
        near = near[forest.of[i[near]] != forest.of[j[near]]]
        if len(near):
            forest.join(i[near], j[near])
            forest.settle()
        at = to
    return forest.table()


def meet_open(t: pa.Table) -> pa.Table:
    """Links of cells in a part of a crowded anchor: rows marked `left` are compared with all that they can meet there."""
    fp, home = t.column("fp").to_numpy().view(np.uint64), t.column("home").combine_chunks().to_numpy(zero_copy_only=False)
    forest = Forest(cells(fp).view(np.int64))
    for i in np.flatnonzero(t.column("left").combine_chunks().to_numpy(zero_copy_only=False)):
        near = np.flatnonzero((np.bitwise_count(fp ^ fp[i]) <= DISTANCE) & (home | home[i]) & (forest.of != forest.of[i]))
        if len(near):
            forest.join(np.full(len(near), i), near)
            forest.settle()
    return forest.table()


def cell_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between cells that hold near fingerprints; as many as join the cells of a group."""
    at = placed(fps)
    sizes = staged(at.groupBy("anchor").agg(F.count("*").alias("rows")).where("rows > 1"), "sizes")
    crowded = sizes.where(F.col("rows") > CROWD).select("anchor")
    parts = max(1, -(-(sizes.agg(F.sum("rows")).first()[0] or 0) // GROUP_ROWS))
    few = at.join(F.broadcast(crowded), "anchor", "left_anti").select("anchor", "fp", "home").withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)))
    links = few.groupBy("part").applyInArrow(meet, "a long, b long")
    if crowded.isEmpty():
        return links
    many = staged(with_cells(at.join(F.broadcast(crowded), "anchor")), "crowded")
    most = many.groupBy("anchor").agg(F.max_by(F.struct("fp", "cell"), F.struct("n", "fp")).alias("most")).select("anchor", F.col("most.fp").alias("top"), F.col("most.cell").alias("top_cell"))
    many = many.join(F.broadcast(most), "anchor")
    stars = many.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("top"))) <= DISTANCE).where("cell <> top_cell")
    links = staged(links.unionByName(stars.select(F.col("cell").alias("a"), F.col("top_cell").alias("b"))).distinct(), "links")
    known = components(links)
    label = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in"))
    many = many.join(label("cell"), "cell", "left").join(label("top_cell"), "top_cell", "left")
    many = staged(many.select("anchor", "fp", "home", (F.coalesce("cell_in", "cell") != F.coalesce("top_cell_in", "top_cell")).alias("open")), "open")
    deals = many.where("open").groupBy("anchor").agg(F.ceil(F.count("*") / DEAL).cast("int").alias("deals"))
    every = many.join(F.broadcast(deals), "anchor").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("deals")).cast("int"))
    every = every.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    dealt = every.select("anchor", "deal", "fp", "home", (F.col("open") & (F.col("own") == F.col("deal"))).alias("left"))
    return links.unionByName(dealt.groupBy("anchor", "deal").applyInArrow(meet_open, "a long, b long"))


def with_cells(df: DataFrame) -> DataFrame:
    """The rows, with the cell of their fp."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("cell", pa.array(cells(batch.column("fp").to_numpy().view(np.uint64)).view(np.int64)))

    return df.mapInArrow(add, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", cell long")


def dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id (the least doc_id reachable)."""
    rows = staged(fingerprints(docs), "fingerprints")
    fps = staged(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct")
    linked = components(cell_links(fps))
    named = with_cells(fps.select("fp", "least")).join(linked.withColumnRenamed("id", "cell"), "cell", "left")
    named = staged(named.select("fp", "least", F.coalesce("component", "cell").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = named.join(least, "component").select(F.col("fp").alias("key"), "component_id")
    out = rows.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.col("fp"))).join(final, "key", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
