"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word budget: weights 5, 2, 1 (repeating over the sources by code point, null last) share
all words, and no budget exceeds `MAX_EPOCHS` times its source. A budget is spent in complete epochs first.
What is left goes to documents in the order of their exponential keys -ln(u) / quality weight, prefix-summed
within the source; the document at the limit gives only the words that still fit.

A hot source never meets in one task: keys are cut into `KEY_BUCKETS` ranges per source, ranges are summed
first, and only rows of one range are sorted together. What is global is one row per source.

Nulls: a null text has size 0 and takes nothing; a null source is a source of its own; a null doc_id is a
document like any other. Repeated rows are documents of their own, ordered by doc_id, then size. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Ranges of sampling keys per source.
KEY_BUCKETS = 512
SEED = "mix-1"
SPACES = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for text without symbols, down to 0.1 where every third character is one."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.1), 1.0 - 3.0 * symbols / F.greatest(F.length(text), F.lit(1)))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Resharing the excess ends where each target is min(most * size, level * weight). Sources are taken by
    most * size / weight; a source is capped while the level over it and all later ones is above that ratio.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    return (
        totals.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn("own_level", F.col("left") / F.col("weight_left"))
        .withColumn("level", F.min(F.when(F.col("ratio") > F.col("own_level"), F.struct("ratio", "rank", "own_level"))).over(everything)["own_level"])
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))))
        .select("source", "source_size", "target")
    )


def sampling_key(doc_id: Column, size: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from the md5 of seed, doc_id and size."""
    hexed = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string"))), 1, 12)
    u = (F.conv(hexed, 16, 10).cast("long").cast("double") + 0.5) / float(16**12)
    return -F.ln(u) / weight


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def keyed(docs: DataFrame, weight: Column | None = None, seed: str = SEED, buckets: int = KEY_BUCKETS) -> DataFrame:
    """`docs` with size, sampling_key, bucket (a range of keys) and source_key (never null)."""
    sized = docs.withColumn("size", n_words(F.col("text")))
    key = sampling_key(F.col("doc_id"), F.col("size"), weight if weight is not None else quality_weight(F.col("text")), seed)
    return sized.withColumn("sampling_key", key).withColumns({"bucket": F.least(F.floor((1.0 - F.exp(-F.col("sampling_key"))) * buckets), F.lit(buckets - 1)).cast("int"), "source_key": _source_key(F.col("source"))})


def budgets(light: DataFrame) -> DataFrame:
    """(source_key, bucket, before, source_size, target, epochs, rest): each key range with the words of its source before it and what the source's target leaves after complete epochs."""
    ranges = light.groupBy("source_key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size"))
    totals = ranges.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    plan = targets(totals).withColumn("source_key", _source_key(F.col("source"))).drop("source")
    budget = F.floor("target")
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.drop("source").withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
        .join(plan, "source_key")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
        .drop("bucket_size")
    )


def sample(docs: DataFrame, weight: Column | None = None, seed: str = SEED, buckets: int = KEY_BUCKETS, carry: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, epochs, taken (words, repeats counted) and the columns `carry`."""
    carry = carry or []
    light = staged(keyed(docs, weight, seed, buckets).select("doc_id", "source", *carry, "size", "sampling_key", "bucket", "source_key"), "mix")
    ranges = budgets(light)
    within = Window.partitionBy("source_key", "bucket").orderBy("sampling_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        light.join(ranges, ["source_key", "bucket"])
        .withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))))
        .withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))
        .select("doc_id", "source", *carry, "size", "source_size", "target", F.col("epochs").cast("int").alias("epochs"), "part", "taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Whole documents as often as the mix takes them; the document at a budget's limit comes if at least half of it fits.

    Equal rows share what they take together: each comes as often as all can, and what is left over comes from one of them.

    A source's limit is one place in the order of its keys: rows before it are taken once more than its epochs, rows after it aren't. So
    a row a source is sent to all tasks, and texts are neither joined by a shuffle nor written; only rows at the very limit
    (equal key, doc_id and size) are grouped.
    """
    row = F.xxhash64(*docs.columns).alias("_row")
    light = staged(keyed(docs.select("doc_id", "source", "text", row)).select("doc_id", "source", "_row", "size", "sampling_key", "bucket", "source_key"), "mix")
    ranges = staged(budgets(light), "ranges")
    place = F.struct("sampling_key", F.col("doc_id").isNull().alias("none"), "doc_id", "size")
    by_bucket = Window.partitionBy("source_key").orderBy(F.desc("bucket"))
    last = ranges.where("before <= rest").withColumn("_n", F.row_number().over(by_bucket)).where("_n = 1").select("source_key", "bucket", "before", "rest")
    within = Window.partitionBy("source_key").orderBy("sampling_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = light.join(F.broadcast(last), ["source_key", "bucket"]).withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    limit = placed.where("before + size > rest").groupBy("source_key").agg(F.min(place).alias("_limit"))
    sources = ranges.select("source_key", "epochs").distinct().join(limit, "source_key", "left").join(last.select("source_key", F.col("bucket").alias("_last")), "source_key", "left")
    sources = staged(sources, "limits")
    own = keyed(docs.select(F.struct(*docs.columns).alias("_d"), "doc_id", "source", "text", row)).withColumn("_place", place)
    met = own.join(F.broadcast(sources), "source_key")
    before = (F.col("bucket") < F.col("_last")) | ((F.col("bucket") == F.col("_last")) & (F.col("_limit").isNull() | (F.col("_place") < F.col("_limit"))))
    at_limit = F.col("_place").eqNullSafe(F.col("_limit"))
    n = F.col("epochs") + F.when(F.coalesce(before, F.lit(False)) & (F.col("size") > 0), 1).otherwise(0)
    often = lambda df, n: df.where(n > 0).select("_d", F.explode(F.sequence(F.lit(1).cast("long"), n.cast("long")))).select("_d.*")
    out = often(met.where(~at_limit), n)

    ties = light.withColumn("_place", place).join(F.broadcast(sources.where("_limit IS NOT NULL")), "source_key").where(at_limit)
    groups = ties.groupBy("source_key", "_row").agg(F.count("*").alias("_n"), F.first(F.struct("doc_id")).alias("_of"), F.first("size").alias("size"), F.first("epochs").alias("epochs"))
    first = placed.withColumn("_place", place).join(F.broadcast(limit), "source_key").where(at_limit).groupBy("source_key").agg(F.min("before").alias("before"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source_key").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("_n") * F.col("size")).over(order), F.lit(0))
    shares = groups.join(F.broadcast(first), "source_key").withColumn("_room", F.greatest(room, F.lit(0)))
    shares = shares.withColumn("_full", F.least(F.col("_n"), F.floor(F.col("_room") / F.col("size"))))
    part = (F.col("_full") < F.col("_n")) & (2 * (F.col("_room") - F.col("_full") * F.col("size")) >= F.col("size"))
    shares = shares.withColumn("_sum", F.col("epochs") * F.col("_n") + F.col("_full") + part.cast("long")).selectExpr("source_key", "_row", "_of.doc_id AS _doc", "_sum div _n AS _each", "_sum % _n AS _rest")
    whole = docs.select(F.struct(*docs.columns).alias("_d"), _source_key(F.col("source")).alias("source_key"), row)
    tied = whole.join(staged(shares, "shares"), ["source_key", "_row"]).where(F.col("_d.doc_id").eqNullSafe(F.col("_doc")))
    out = out.unionByName(often(tied, F.col("_each")))
    return out.unionByName(often(tied.groupBy("source_key", "_row").agg(F.first("_d").alias("_d"), F.first("_rest").alias("_rest")), F.col("_rest")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    greatest(0.1::DOUBLE, 1.0::DOUBLE - 3.0::DOUBLE * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', ''))) / greatest(length(coalesce(text, '')), 1)) AS quality
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM r),
l AS (SELECT *, cap / weight::DOUBLE AS ratio,
    ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY cap / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (ORDER BY cap / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS own_level FROM w),
v AS (SELECT own_level AS level FROM l WHERE ratio > own_level ORDER BY ratio, rank LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM v) IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, (SELECT level FROM v) * weight) END AS target FROM l),
k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.source,
    -ln((('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || d.size), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / d.quality AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / greatest(source_size, 1))::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM p
"""
