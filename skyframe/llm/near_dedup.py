"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct word shingles. Each of M registers keeps the truncated, exponentially spaced
minimum of the set's hashes: floor(-log_b of the least exponential variate), so registers of a union are the
larger of both. Equal sets are one class, told by a hash of the whole sorted set. Classes are banded on
`BAND` registers; pairs that meet in a band are kept if the joint likelihood of their larger, smaller and equal registers
allows the wanted similarity, and confirmed on the full sets.

Pairs are formed without a product within a group. First every class meets the least member of each of its
band groups, then, where they aren't in one component yet, a member chosen by hash; confirmed links are joined to
components. The pairs that are alike at all (`ALIKE`) join classes to families. In band groups that hold several families, members
outside the largest one (open) meet all, registers against registers in blocks of up to twice `BLOCK` members, and families with a
likely pair between them become one, so any link of two classes that share a band lies within a family. Only
families that still hold several components are looked at again, in blocks of `BLOCK` members or `BLOCK_BYTES`: full sets of members
outside the largest component (open) are compared with all as a matrix product, and no more links are put out than join components.
Blocks are dealt by open members (`dealt`): a group's other members are copied once a block of open ones, not to each other, so
rows copied and comparisons both grow with a group's open members times its members.

Nulls: a null text or a text without words has the empty set and is linked with nothing. A null doc_id is never linked.
Rows that share a doc_id and a set share the result. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import array_of, bits_for, in_array, marked, words_of
from .staging import discard, staged
from .wordarrays import U64, TextChunk, chunks, mix

BANDS, BAND = 32, 5
REGISTERS = BANDS * BAND
BASE = 1.02
#: Members of a family, and bytes of their sets, that are compared in one block.
BLOCK, BLOCK_BYTES = 800, 16 << 20
#: Logarithm of the most bits of the filter of shared buckets, which grows with them (64 MB).
FILTER_BITS = 29
#: Share of equal registers from which classes are of one family.
ALIKE = 0.5
#: Standard deviations that a register estimate may fall below the wanted similarity.
SLACK = 5.0

_rng = np.random.default_rng(314159)
_XOR = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_MULTIPLY = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(c: TextChunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts of a lower-cased chunk, and the text limits among them."""
    starts, ends, doc = c.words()
    wh = c.hashes(starts, ends)
    n = c.per_text(doc)
    first = np.cumsum(n) - n
    at = np.arange(len(wh)) - first[doc]
    h = np.zeros(len(wh), np.uint64)
    for k in range(size):  # a shorter text is one shingle of all its words
        on = np.flatnonzero((at + k < n[doc]))
        h[on] = mix(h[on] * U64(0x9E3779B97F4A7C15) + wh[on + k] + U64(k + 1))
    own = np.flatnonzero(at < np.maximum(n - size + 1, 1)[doc])
    order = own[np.lexsort((h[own], doc[own]))]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(c.n + 1))


def registers(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts x REGISTERS array of uint16; 0 for the empty set."""
    out = np.zeros((len(off) - 1, REGISTERS), np.uint16)
    full = np.flatnonzero(off[1:] > off[:-1])
    if not len(full):
        return out
    for j in range(REGISTERS):
        v = (h ^ _XOR[j]) * _MULTIPLY[j]
        v ^= v >> U64(29)
        v *= U64(0xBF58476D1CE4E5B9)
        least = np.minimum.reduceat(v, off[full])
        u = (least.astype(np.float64) + 1.0) / 2.0**64
        x = -np.log1p(-np.minimum(u, 1 - 1e-16))  # the least exponential variate of the set
        out[full, j] = np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 1, 65535).astype(np.uint16)
    return out


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row: doc_id, n_shingles, set_key (of the whole sorted set), registers."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, c in chunks(batch.column("text"), lower=True):
                h, off = shingle_sets(c, shingle)
                regs = registers(h, off)
                n = np.diff(off)
                place = np.arange(len(h), dtype=np.uint64) - np.repeat(off[:-1], n).astype(np.uint64)
                keys = []
                for salt in (0x51ED270B, 0x3C6EF372):
                    total = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(mix(h + U64(salt)) * mix(place + U64(salt)) , out=total[1:])
                    keys.append(mix(total[off[1:]] - total[off[:-1]]))
                both = np.column_stack(keys).astype(">u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()),
                        pa.array([both[16 * k : 16 * k + 16] if n[k] else None for k in range(c.n)], pa.binary()),
                        pa.array([r.tobytes() if m else None for r, m in zip(regs, n, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_key", "registers"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sketch, f"doc_id {kind}, n_shingles long, set_key binary, registers binary")


def band_hashes(classes: DataFrame, wanted=None) -> DataFrame:
    """(id, bucket) of each class and band; the band is part of the bucket's hash. `wanted`, a filter and its bits' logarithm, drops other buckets."""
    words, bits = wanted or (None, 0)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, BANDS, BAND).astype(np.uint64)
            h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), regs.shape[:2])
            for k in range(BAND):
                h = mix(h * U64(0x9E3779B97F4A7C15) + regs[:, :, k] + U64(1))
            own, h = np.repeat(np.arange(len(h)), BANDS), h.ravel()
            if words is not None:
                keep = in_array(words.value, h, bits)
                own, h = own[keep], h[keep]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own)), pa.array(h.view(np.int64))], ["id", "bucket"])

    return classes.select("id", "registers").mapInArrow(hashed, f"id {classes.schema['id'].dataType.simpleString()}, bucket long")


def log_likelihood(more: np.ndarray, less: np.ndarray, u: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Log-likelihood of a similarity J, given the counts of registers in which a's is the larger or the smaller one.

    Of the union's members the share u - v*J is a's alone and v - u*J is b's alone (u, v: the sets' shares of both sizes). A register
    is larger in a where the least of all is a's alone by at least a step: with probability p(u - v*J), p(x) = -log_b(1 - x*(b-1)/b).
    """
    v = 1 - u
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-3, 1)
    larger, smaller = p(u - v * similarity), p(v - u * similarity)
    equal = np.maximum(1 - larger - smaller, 1e-3)
    return more * np.log(larger) + less * np.log(smaller) + (REGISTERS - more - less) * np.log(equal)


def likely(more: np.ndarray, less: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the joint registers allow the similarity: by the likelihood ratio of it and the best estimate.

    Sizes bound the similarity exactly. Registers are equal with a probability of J or more, which rules most pairs out without an
    estimate; of the others those are kept whose estimate reaches the similarity or is no more than `SLACK` deviations better than it.
    """
    least, most = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    equal = 1 - (more + less) / REGISTERS
    keep = (100 * least >= round(100 * similarity) * most) & (equal >= similarity - SLACK * np.sqrt(similarity * (1 - similarity) / REGISTERS))
    at = np.flatnonzero(keep)
    if len(at):
        m, l, u, top = more[at, None], less[at, None], (size_a / (size_a + size_b))[at, None], (least / most)[at]
        grid = np.linspace(0.5, 1, 51) * top[:, None]
        tried = log_likelihood(m, l, u, grid)
        best = tried.argmax(1)
        wanted = log_likelihood(m, l, u, np.full((len(at), 1), similarity))[:, 0]
        reached = grid[np.arange(len(at)), best] >= similarity
        keep[at] = reached | (2 * (tried.max(1) - wanted) <= SLACK**2)
    return keep


def alike(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, likely) of the pairs with `ALIKE` equal registers or more."""
    regs = classes.select("id", "registers", "n_shingles")
    joined = pairs.join(regs.toDF("a", "regs_a", "size_a"), "a").join(regs.toDF("b", "regs_b", "size_b"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint16).reshape(-1, REGISTERS) for n in ("regs_a", "regs_b"))
                equal = (a == b).mean(1)
                may = likely((a > b).sum(1), (a < b).sum(1), batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy(), similarity)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(may)], ["a", "b", "likely"]).filter(pa.array(may | (equal >= ALIKE)))

    kind = pairs.schema["a"].dataType.simpleString()
    return joined.select("a", "b", "regs_a", "regs_b", "size_a", "size_b").mapInArrow(compare, f"a {kind}, b {kind}, likely boolean")


def full_sets(ids: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles): the whole sorted sets of the documents `ids`, as binary."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, c in chunks(batch.column("text"), lower=True):
                h, off = shingle_sets(c, shingle)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array([h[off[k] : off[k + 1]].tobytes() for k in range(c.n)], pa.binary())], ["id", "shingles"])

    texts = docs.select(F.col("doc_id").alias("id"), "text")
    texts = marked(texts, F.xxhash64("id"), words_of(ids, F.xxhash64("id"))).where("_may").select("id", "text").join(ids, "id", "left_semi")
    return texts.mapInArrow(hashed, f"id {docs.schema['doc_id'].dataType.simpleString()}, shingles binary").dropDuplicates(["id"])


def confirm(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as wanted."""
    both = pairs.select("a", "b").join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    percent = round(100 * similarity)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(check, f"a {kind}, b {kind}")


def joining_links(sets: list[np.ndarray], component: np.ndarray, opened: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Index pairs of similar sets, one of them open, that join the components, a forest: no two of them join the same components."""
    names, component = np.unique(component, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rows = np.flatnonzero(opened)
    values, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(len(sets)), sizes)
    shared = np.flatnonzero(n[inverse] > 1)  # a shingle of one set is in no intersection
    own, column = own[shared], np.unique(inverse[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    common = np.zeros((len(rows), len(sets)), np.float32)
    for at in range(0, width, 2048):
        a, b = np.searchsorted(column, (at, at + 2048))
        part = np.zeros((len(sets), min(2048, width - at)), np.float32)
        part[own[a:b], column[a:b] - at] = 1
        common += part[rows] @ part.T
    out = []
    for k, i in enumerate(rows):
        c = common[k]
        hits = np.flatnonzero((c > 0) & (100 * c >= round(100 * similarity) * (sizes[i] + sizes - c)) & (component != component[i]))
        for j in hits[np.unique(component[hits], return_index=True)[1]]:
            x, y = root(int(component[i])), root(int(component[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(i), int(j)))
    return out


def dealt(members: DataFrame, group: str, part: str, sized: bool = False) -> DataFrame:
    """Members of the groups that hold several parts, each in the blocks (`left`, `right`) where it meets others, with `opened`: whether it is to meet all of its block.

    A group's open members, those outside its largest part, are cut into blocks 0 to p - 1, the others into p to q - 1, all of at most `BLOCK` members on average and, if `sized`,
    `BLOCK_BYTES` of the column bytes. Blocks i < p and j >= i meet, so an open member is copied q times and another one p times.
    """
    size = F.sum("bytes") if sized else F.lit(0)
    parts = members.groupBy(group, part).agg(F.count("*").alias("n"), size.alias("bytes"))
    groups = parts.groupBy(group).agg(F.max_by(F.struct(part, "n", "bytes"), F.struct("n", part)).alias("most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("parts")).where("parts > 1")
    cuts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    groups = groups.select(
        group, F.col(f"most.{part}").alias("largest"), cuts(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("p"), cuts(F.col("most.n"), F.col("most.bytes")).alias("r")
    )
    opened = F.col(part) != F.col("largest")
    chunk = F.when(F.col("opened"), F.pmod(F.xxhash64("id"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("id"), F.col("r"))).cast("int")
    last = F.when(F.col("opened"), F.col("p") + F.col("r")).otherwise(F.col("p")) - 1
    placed = members.join(groups, group).withColumn("opened", opened).withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return placed.select("id", group, part, (F.col("chunk") <= F.col("other")).alias("opened"), F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"))


def family_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the components of a family, from members(id, family, component, bytes)."""
    blocks = dealt(members, "family", "component", sized=True).join(sets, "id")

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        found = joining_links([np.frombuffer(s, np.uint64) for s in f["shingles"]], f["component"].to_numpy(), f["opened"].to_numpy(), similarity)
        ids = f["id"].to_numpy()
        return pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["a", "b"])

    kind = members.schema["id"].dataType.simpleString()
    return blocks.groupBy("family", "left", "right").applyInPandas(meet, f"a {kind}, b {kind}")


def joining_pairs(regs: np.ndarray, sizes: np.ndarray, family: np.ndarray, opened: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Index pairs with likely registers, one of them open, that join the families, a forest as in `joining_links`."""
    names, family = np.unique(family, return_inverse=True)
    parent = np.arange(len(names))
    out = []
    for i in np.flatnonzero(opened):
        for j in np.flatnonzero(likely((regs[i] > regs).sum(1), (regs[i] < regs).sum(1), np.full(len(sizes), sizes[i]), sizes, similarity) & (parent[family] != parent[family[i]])):
            x, y = parent[family[i]], parent[family[j]]
            if x != y:
                parent[parent == max(x, y)] = min(x, y)
                out.append((int(i), int(j)))
    return out


def bucket_pairs(shared: DataFrame, family: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Likely pairs (a, b, likely) between families that share a bucket, from shared(id, bucket, n) and family(id, family); as many as join the families of a block."""
    placed = shared.where("n > 2").join(family, "id", "left").select("id", "bucket", F.coalesce("family", "id").alias("family"))
    blocks = dealt(placed, "bucket", "family").join(classes.select("id", "n_shingles", "registers"), "id")
    kind = classes.schema["id"].dataType.simpleString()

    def meet(t: pa.Table) -> pa.Table:
        regs = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        found = joining_pairs(regs, t.column("n_shingles").to_numpy(), t.column("family").to_numpy(), t.column("opened").to_numpy(zero_copy_only=False), similarity)
        i, j = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
        ids = t.column("id").combine_chunks()
        return pa.table({"a": ids.take(i), "b": ids.take(j)})

    found = blocks.groupBy("bucket", "left", "right").applyInArrow(meet, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("likely")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each node of the edges (a, b) reaches, without rows for these least ids themselves, by alternating large-star and small-star steps until the edges are stars."""
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def least_of(df: DataFrame, m) -> DataFrame:
        """(u, m). `u` is a new column, so that a join on it deals both sides anew and adaptive execution can split a hub's edges."""
        return df.groupBy("u").agg(m.alias("m")).select(F.col("u").bitwiseXOR(F.lit(0).cast(df.schema["u"].dataType)).alias("u"), "m")

    def stars(df: DataFrame) -> bool:
        """Whether each u has one v, and no v is a u: then every component is its least id and what points to it."""
        sides = df.select(F.col("u").alias("id"), F.col("v").alias("to")).unionByName(df.select(F.col("v").alias("id"), F.lit(None).alias("to")))
        ends = sides.groupBy("id").agg(F.min("to").alias("least"), F.max("to").alias("most"), F.max(F.col("to").isNull()).alias("is_v"))
        return ends.where("least < most OR (least IS NOT NULL AND is_v)").agg(F.count("*")).first()[0] == 0

    while not stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = least_of(both, F.least(F.min("v"), F.col("u")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = least_of(large, F.min("v"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = staged(small, "edges")
        discard(e)
        e = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))


def joined(known: DataFrame, more: DataFrame) -> DataFrame:
    """`components` of the edges that `known` comes from and of `more` (a, b); starts from the stars of `known`, which are fewer than its edges."""
    return components(known.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b")))


def classes_of(rows: DataFrame) -> DataFrame:
    """(set_key, id, n_shingles, registers) of the different sets; id is the least doc_id."""
    return (
        rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    )


def links(classes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(id, component) of the classes that have a link, but the least of each component."""
    by_hash = F.min_by("id", F.xxhash64("id", "bucket"))
    groups = staged(band_hashes(classes).groupBy("bucket").agg(F.min("id").alias("least"), by_hash.alias("any"), F.count("*").alias("n")).where("n > 1"), "groups")
    bits = bits_for(groups.count(), FILTER_BITS)
    full = docs.sparkSession.sparkContext.broadcast(array_of(words_of(groups, F.col("bucket"), bits), bits))
    shared = staged(band_hashes(classes, (full, bits)).join(groups, "bucket").select("id", "bucket", "least", "any", "n"), "shared")
    discard(groups)
    pair = lambda c: shared.where(F.col("id") != F.col(c)).select(F.least("id", c).alias("a"), F.greatest("id", c).alias("b")).distinct()
    near = staged(alike(pair("least").union(pair("any")).distinct(), classes, similarity), "pairs")
    family = components(near)
    across = staged(bucket_pairs(shared, family.withColumnRenamed("component", "family"), classes, similarity), "across")
    if not across.isEmpty():
        near = near.unionByName(across)
        family = joined(family, across)
    either = staged(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), "ids")
    sets = staged(full_sets(either, docs, shingle), "sets")
    stars = near.where("likely")
    first = staged(confirm(stars.join(pair("least"), ["a", "b"], "left_semi"), sets, similarity), "links")
    known = components(first)
    rest = stars.join(pair("least"), ["a", "b"], "left_anti")
    side = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"in_{c}"))
    apart = rest.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("in_a", "a") != F.coalesce("in_b", "b"))
    second = staged(confirm(apart, sets, similarity), "links")
    discard(shared)
    known = joined(known, second)
    members = either.join(known, "id", "left").join(family.withColumnRenamed("component", "family"), "id", "left").join(classes.select("id", "n_shingles"), "id")
    members = staged(members.select("id", F.coalesce("component", "id").alias("component"), F.coalesce("family", "id").alias("family"), (8 * F.col("n_shingles")).alias("bytes")), "members")
    found = joined(known, family_links(members, sets, similarity))
    for done in (near, across, either, sets, first, second, members):
        discard(done)
    return found


def dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    rows = staged(sketches(docs, shingle), "sketches")
    classes = staged(classes_of(rows), "classes")
    linked = links(classes, docs, shingle, similarity)
    final = classes.select("set_key", "id").join(linked, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(final, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents kept by `dedup`, with all their columns; of rows that share a kept doc_id all stay."""
    keep = dedup(docs, shingle, similarity).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.where("doc_id IS NULL").unionByName(docs.join(keep, "doc_id", "left_semi").select(*docs.columns))
