"""Divergence of the sources of a language by the terms they use.

Texts are cut into terms per task and counted by DuckDB, so that a task sends one row a (language, source, term) and chunk. Spark adds
these counts up and deals them into shards by a hash of language and term. A shard holds whole terms: DuckDB there keeps the terms
of enough documents, and once Spark has each group's size, adds up what each pair of sources differs by over the shard's terms and
ranks each group's terms. Spark merges the shards' sums and rankings.

A pair's sum runs over all kept terms, also those that one or both sources lack. With p the share of a term and z the share that a group
gives a term it lacks, f(p, q) is split into f(z, z) for each kept term, f(p, z) - f(z, z) for each term that one side has, and a rest
f(p, q) - f(p, z) - f(z, q) + f(z, z) for terms that both have. Only the rest needs pairs of rows of a term; a side's part needs the
histogram of its counts. The sums are integers and equal the sum over all terms exactly.

A shard is bounded by `SHARD_ROWS` on average, and a term has one row a source in it at most. Work and rows out grow with the square
of the sources of a language, as the result does.

Nulls: null text, lang and source count as ''. Rows that repeat a document count as documents of their own, and doc_id isn't read.
A group without terms has its pairs (shares of count 0) and no terms; a language without kept terms has pairs of value 0. Ties in a value
rank by the item's UTF-8 bytes. Empty tables give empty results. A long text is cut into terms alone, whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import discard, staged
from .wordarrays import chunks

#: Documents of its language that a kept term is in; ranks of the report of terms.
MIN_DOCS, TOP = 10, 10
#: Bytes of text that a task counts at once, and rows of counts in a shard on average.
COUNT_BYTES, SHARD_ROWS = 8 << 20, 200_000
#: Groups up to which their sizes go to all tasks (some 100 bytes each).
BROADCAST_GROUPS = 100_000
SCALE = 1_000_000_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

COUNT = """
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs
FROM (SELECT row, term, count(*) AS n FROM terms GROUP BY ALL) JOIN rows USING (row)
GROUP BY ALL
"""

KEEP = """
SELECT lang, source, term, n, (sum(n) OVER w)::BIGINT AS lang_n, (source = min(source) OVER w)::BIGINT AS once
FROM shard WINDOW w AS (PARTITION BY lang, term)
QUALIFY sum(docs) OVER w >= {min_docs}
"""

#: z: share of a term without occurrences in the group; p: the term's; q: the term's in the language.
SHARES = """
SELECT lang, source, term,
  (1 + {scale}::HUGEINT * (n + 2) // (group_n + 2 * v))::BIGINT AS p,
  (1 + {scale}::HUGEINT * 2 // (group_n + 2 * v))::BIGINT AS z,
  (1 + {scale}::HUGEINT * (lang_n + 2) // (all_n + 2 * v))::BIGINT AS q
FROM shard
"""

PAIRS = """
SELECT a.lang, a.source, b.source AS other,
  sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p) - (a.p - b.z) * (a.p - b.z) // (a.p + b.z)
    - (a.z - b.p) * (a.z - b.p) // (a.z + b.p) + (a.z - b.z) * (a.z - b.z) // (a.z + b.z))::BIGINT AS value
FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source
GROUP BY ALL
"""

TERMS = """
SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value
FROM shares WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {top}
"""


def _sql() -> duckdb.DuckDBPyConnection:
    """A connection that writes nothing to disk."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "900MB", "temp_directory": ""})


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, added up over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _sql()
        for batch in batches:
            for i, j, c in chunks(batch.column("text"), COUNT_BYTES, lower=True):
                inside = _LETTER[c.buf]
                starts, ends, row = c.runs(inside)
                off = np.zeros(len(starts) + 1, np.int64)
                np.cumsum(ends - starts, out=off[1:])
                names = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(c.buf[inside])])
                con.register("terms", pa.table({"row": pa.array(row), "term": names}))
                con.register("rows", pa.table({"row": pa.array(np.arange(j - i)), "lang": batch.column("lang").slice(i, j - i), "source": batch.column("source").slice(i, j - i)}))
                yield from con.sql(COUNT).to_arrow_table().cast(pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])).to_batches()

    found = docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def in_shards(rows: DataFrame, sql: str, schema: str, total: int, first: str | None = None) -> DataFrame:
    """The SQL's rows over each shard of `rows`; tables of the SQL: shard, or what `first` makes of it, as shares."""

    def run(shard: pa.Table) -> pa.Table:
        con = _sql()
        con.register("shard", shard)
        if first:
            con.execute(f"CREATE TABLE shares AS {first}")
        found = con.sql(sql).to_arrow_table()
        return found.cast(pa.schema([(f.name, pa.string() if pa.types.is_string(f.type) or pa.types.is_large_string(f.type) else pa.int64()) for f in found.schema]))

    n = max(1, -(-total // SHARD_ROWS))
    return rows.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(n))).groupBy("shard").applyInArrow(run, schema)


def difference(p: Column, q: Column) -> Column:
    """f(p, q) of two columns of longs."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def share(count: Column | int, size: Column, v: Column) -> Column:
    """The share 1 + floor(SCALE * (count + 2) / (size + 2 * v)) as a long, from numbers of up to 18 digits."""
    wide = lambda c: c.cast("decimal(28,0)")
    count = F.lit(count).cast("long") if isinstance(count, int) else count
    return F.call_function("div", wide(count + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(size + 2 * v)) + F.lit(1).cast("long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's other sources and its most telling terms."""
    clean = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = staged(term_counts(clean), "terms")
    kept = staged(in_shards(counted, KEEP.format(min_docs=min_docs), "lang string, source string, term string, n long, lang_n long, once long", counted.count()), "kept")
    discard(counted)

    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    v = kept.groupBy("lang").agg(F.sum("once").alias("v"), F.sum("n").alias("all_n"))
    groups = clean.groupBy("lang", "source").agg(F.count("*").alias("docs")).join(by_group, ["lang", "source"], "left").join(v, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = staged(groups.select("lang", "source", zero("group_n"), zero("all_n"), zero("v")), "groups")
    sized = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups

    rows = staged(kept.join(sized, ["lang", "source"]), "sized")
    discard(kept)
    total = rows.count()
    shares = SHARES.format(scale=SCALE)
    both = in_shards(rows, PAIRS, "lang string, source string, other string, value long", total, shares)
    both = both.groupBy("lang", "source", "other").agg(F.sum("value").alias("rest"))
    telling = in_shards(rows, TERMS.format(top=top), "lang string, source string, item string, value long", total, shares)

    known = groups.where("v > 0").withColumn("z", share(0, F.col("group_n"), F.col("v")))
    b = known.select("lang", F.col("source").alias("other"), F.col("z").alias("z_other"))
    p, z, zo = F.col("p"), F.col("z"), F.col("z_other")
    steps = rows.groupBy("lang", "source", "n", "group_n", "v").agg(F.count("*").alias("times"))
    steps = steps.select("lang", "source", "times", share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), share(0, F.col("group_n"), F.col("v")).alias("z"))
    side = steps.join(b, "lang").where("source <> other").groupBy("lang", "source", "other").agg(F.sum(F.col("times") * (difference(p, zo) - difference(z, zo))).alias("own"))
    mirrored = side.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "own")
    rest = both.unionByName(both.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "rest"))
    zeros = known.select("lang", "source", "v", "z").join(b, "lang").where("source <> other").select("lang", "source", "other", (F.col("v") * difference(z, zo)).alias("own"))
    parts = zeros.unionByName(side).unionByName(mirrored).unionByName(rest.withColumnRenamed("rest", "own"))
    empty = groups.where("v = 0").select("lang", "source")
    empty = empty.join(empty.withColumnRenamed("source", "other"), "lang").where("source <> other").withColumn("own", F.lit(0).cast("long"))
    pairs = parts.unionByName(empty).groupBy("lang", "source", "other").agg(F.sum("own").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("part", F.lit(part)).withColumn("rank", F.row_number().over(order)).select("lang", "source", "part", "item", "value", "rank")
    return ranked(pairs.withColumnRenamed("other", "item"), "pair").unionByName(ranked(telling, "term").where(F.col("rank") <= top))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n
    FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS group_n, count(*) OVER (PARTITION BY lang, source) AS v, sum(lang_n) OVER (PARTITION BY lang, source) AS all_n FROM dense),
shares AS (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 2) // (group_n + 2 * v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (lang_n + 2) // (all_n + 2 * v))::BIGINT AS q FROM sized),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 10)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked
"""
