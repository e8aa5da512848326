"""Document fingerprints of closed syncmers, in DataFrame functions only.

A text's grams of `S` code points are hashed. A k-mer of `K` code points is an anchor if the least of its inner gram
hashes is its first or last. Whether a k-mer is one depends on its own characters alone, so anchors survive edits elsewhere;
the edited text's are those of its two parts and of the few k-mers across their border. A fingerprint has all anchors with
their places. A text of under K code points, or without any anchor, has one: the whole text at place 0; an empty text has none.

Texts are matched by position: each anchor with the one before it and their distance (the first with the text's start)
is a link of an offset run, and likeness is the share of links that both have among those that either has. Runs agree
wherever they stand in the text, single anchors that only happen to be equal don't count.

The next document in descending doc_id order is found without a global sort: ids are cut at approximate
quantiles and evenly between them, so that a cut has about `CUT_ROWS` rows or `CUT_BYTES` bytes of text, a window runs
within each cut, and the largest id of a cut is copied to the cut above, which misses it. The copies are at most one id a cut.

Nulls: a null text is empty; null ids come after all others. Rows of one id are ordered by text. Empty tables give empty
results. A very long text is some hundred bytes a code point in its task while it is hashed. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a k-mer and of its inner grams; K - S is a power of two.
K, S = 36, 4
#: Quantile cuts of the ids, and rows and bytes of text that a cut may hold before it is divided.
CUTS, CUT_ROWS, CUT_BYTES = 256, 4000, 16 << 20
#: Copied ids up to this many go to every task.
BROADCAST_IDS = 200_000
_LEAST = -(2**63)
_ANCHORS = "array<struct<at:int,hash:bigint>>"
_NONE = f"cast(array() as {_ANCHORS})"


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """(at, hash) of the closed syncmers of a text, in text order."""
    inner = k - s

    def least(h: Column, size: int, use: Callable[[Column], Column]) -> Column:
        """`use` of the least of each `inner` neighbours, by doubling."""
        if size == inner:
            return use(h)
        return named(F.zip_with(h, F.slice(h, size + 1, F.size(h)), lambda x, y: F.least(x, y)), lambda m: least(m, 2 * size, use))

    def chosen(h: Column, m: Column) -> Column:
        first, last = (lambda i: F.get(h, i)), (lambda i: F.get(h, i + inner))
        closed = F.filter(
            F.sequence(F.lit(0), F.size(h) - (inner + 1)),
            lambda i: (last(i) <= F.get(m, i)) | ((first(i) <= F.get(m, i)) & (first(i) <= last(i))),
        )
        whole = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(0, k, s)))
        return F.transform(closed, lambda i: F.struct(i.alias("at"), whole(i).alias("hash")))

    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{s}}}))."), F.lit(1))
    found = named(F.transform(grams, lambda g: F.xxhash64(g)), lambda h: least(h, 1, lambda m: chosen(h, m)))
    return F.when(F.char_length(text) >= k, found).otherwise(F.expr(_NONE))


def complete(found: Column, text: Column) -> Column:
    """The anchors, or the whole text as one where there are none."""
    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(text).alias("hash")))
    return F.when(F.size(found) > 0, found).when(F.char_length(text) > 0, whole).otherwise(F.expr(_NONE))


def shifted(found: Column, by: Column) -> Column:
    return F.transform(found, lambda a: F.struct((a["at"] + by).cast("int").alias("at"), a["hash"].alias("hash")))


def printed(found: Column) -> Column:
    """place.hash of each anchor in hexadecimal, comma-joined."""
    return F.lower(F.array_join(F.transform(found, lambda a: F.concat(F.hex(a["at"]), F.lit("."), F.hex(a["hash"]))), ","))


def links(found: Column) -> Column:
    """A hash of each anchor, the one before it, and their distance."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("hash"))
    before = F.concat(F.array(start), F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))))
    return F.when(F.size(found) > 0, F.zip_with(before, found, lambda b, a: F.xxhash64(b["hash"], a["hash"], a["at"] - b["at"]))).otherwise(F.expr("cast(array() as array<bigint>)"))


def likeness(a: Column, b: Column) -> Column:
    """Share of links in common; 1 for two empty texts."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))


def in_cuts(rows: DataFrame, key: str, cuts: int = CUTS, cut_rows: int = CUT_ROWS) -> DataFrame:
    """The rows with _cut and _copy: within a _cut, rows by descending key and then the copies hold each row's next lower one.

    After the lowest row of all comes the highest.
    """
    n, size, low, high, bounds = rows.agg(
        F.count("*"), F.sum(F.octet_length("text")), F.min(key), F.max(key), F.percentile_approx(key, [i / cuts for i in range(1, cuts)], 10_000)
    ).first()
    low, high = low or 0, high or 0
    limits = sorted({low, *(bounds or []), min(high + 1, 2**63 - 1)})
    parts = max(1, -(-n // (cuts * cut_rows)), -(-(size or 0) // (cuts * CUT_BYTES)))
    held = F.array(*(F.lit(x).cast("long") for x in limits))
    under = F.greatest(F.size(F.filter(held, lambda x: x <= F.col(key))) - 1, F.lit(0))
    start, end = (F.coalesce(F.get(held, F.col("_q") + k), F.get(held, F.col("_q"))).cast("double") for k in (0, 1))
    inner = F.least(F.lit(parts - 1), F.floor((F.col(key) - start) / F.greatest(end - start, F.lit(1.0)) * parts))
    cut = rows.withColumn("_q", under).withColumn("_cut", (F.col("_q") * parts + inner).cast("long")).drop("_q")
    tops = cut.groupBy("_cut").agg(F.max(key).alias("_top"))  # one row a cut
    above = F.coalesce(F.lead("_cut").over(Window.orderBy("_cut")), F.first("_cut").over(Window.orderBy("_cut")))
    tops = tops.select("_top", above.alias("_to"))
    tops = F.broadcast(tops) if cuts * parts <= BROADCAST_IDS else tops
    copies = cut.join(tops, F.col(key) == F.col("_top")).withColumn("_cut", F.col("_to")).select(*cut.columns)
    return cut.withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_copy", F.lit(True)))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    along = Window.partitionBy("_cut").orderBy("_copy", F.col("_key").desc(), "text")
    seen = (
        in_cuts(rows, "_key").withColumn("next_text", F.lead("text").over(along)).withColumn("found", anchors(F.col("text")))
        .withColumn("own", complete(F.col("found"), F.col("text"))).withColumn("own_links", links(F.col("own")))
        .withColumns({"next": F.lead("found").over(along), "next_links": F.lead("own_links").over(along)})
        .where("NOT _copy").withColumn("n", F.char_length("text")).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    )
    cut = F.col("n") - F.col("half")
    seen = (
        seen.withColumn("head", F.substring(F.col("text"), F.lit(1), cut)).withColumn("tail", F.substring(F.col("next_text"), F.lit(1), F.col("half")))
        .withColumn("edited", F.concat("head", "tail")).withColumn("border", F.greatest(cut - (K - 1), F.lit(0)))
    )
    across = anchors(F.substring(F.col("edited"), F.col("border") + 1, cut - F.col("border") + (K - 1)))
    parts = F.concat(
        F.filter("found", lambda a: a["at"] + K <= cut), shifted(across, F.col("border")),
        shifted(F.filter("next", lambda a: a["at"] + K <= F.char_length("tail")), cut),
    )
    return (
        seen.withColumn("parts", parts).withColumn("changed", complete(F.col("parts"), F.col("edited"))).withColumn("changed_links", links(F.col("changed")))
        .select(
            "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
            printed(F.col("own")).alias("fingerprint"), printed(F.col("changed")).alias("edited_fingerprint"),
            likeness(F.col("own_links"), F.col("changed_links")).alias("near_edited"), likeness(F.col("own_links"), F.col("next_links")).alias("near_next"),
        )
    )
