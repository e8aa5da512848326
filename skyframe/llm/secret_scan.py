"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern in each whole text. Their hashes are counted by distinct repositories and
distinct owners over the corpus: a value with at least `WIDE_OWNERS` owners or `WIDE_REPOSITORIES` repositories is a
widely copied example, a rarer live-looking value is an owner's own credential. Base spans always stay; the method adds spans of
kind `live` for long mixed tokens outside them that belong to few owners.

Counting is by (hash, owner, repository), then (hash, owner), then hash, each with a partial sum before its
shuffle, so a value copied into a third of all rows doesn't meet in one task.

Nulls: a null text is empty (no spans, hash of the empty string); a null owner or repository counts as one
more owner or repository. Repeated rows get a result each and count as one repository. Extra columns are ignored.
Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

# The base patterns. Letters of the keywords in either case.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Tokens that may be credentials without a keyword.
LONG = "[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "live")
#: A value with this many owners, or in this many repositories of however few owners, is a copied example.
WIDE_OWNERS, WIDE_REPOSITORIES = 4, 100
MASK = "[SECRET]"

_SPAN = "struct<start:int,rank:int,end:int,value:bigint>"


def _found(text: Column, pattern: str, rank: int, value: Column | None = None) -> Column:
    """Spans of the non-overlapping matches: the texts between them give their starts."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("len"), m.alias("m")))
    own = value if value is not None else (lambda m: m)
    spans = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["len"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + s["gap"] + s["len"]).alias("end"), own(s["m"]).alias("value")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(matches) > 0, spans).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def _assigned(m: Column) -> Column:
    """Hash of an assignment's value, null where it is under 6 characters and the match fails."""
    value = F.regexp_extract(m, ASSIGN, 1)
    return F.when(F.char_length(value) >= 6, F.xxhash64(value))


def _live_looking(m: Column) -> Column:
    """Hash of a token with upper case, lower case and digits, ten kinds of character and no run of four; else null."""
    mixed = m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]") & ~m.rlike(r"(.)\1\1\1")
    return F.when(mixed & (F.size(F.array_distinct(F.split(m, ""))) >= 10), F.xxhash64(m))


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id", keep: list[str | Column] | None = None) -> DataFrame:
    """The columns `keep`, `owner`, `repository`, and the sorted spans `base` and `extra` (outside base spans) of each row."""
    text = F.col("_text")
    held = lambda spans: F.filter(spans, lambda s: s["value"].isNotNull())
    hashed = lambda m: F.xxhash64(m)
    return (
        docs.select(*(keep or []), F.col(owner).alias("owner"), F.col(repository).alias("repository"), F.coalesce("text", F.lit("")).alias("_text"))
        .withColumn("base", F.array_sort(F.concat(held(_found(text, ASSIGN, 0, _assigned)), _found(text, ACCESS, 1, hashed), _found(text, HEX, 2, hashed))))
        .withColumn("extra", held(_found(text, LONG, 3, _live_looking)))
        .withColumn("extra", F.filter("extra", lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"]))))
        .drop("_text")
    )


def ownership(marked: DataFrame) -> DataFrame:
    """(value, owners, repositories): the distinct owners and repositories of each candidate."""
    values = F.array_distinct(F.transform(F.concat("base", "extra"), lambda s: s["value"]))
    return (
        marked.select("owner", "repository", F.explode(values).alias("value")).distinct()
        .groupBy("value", "owner").agg(F.count("*").alias("repositories"))
        .groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    )


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def is_wide(wide_owners: int, wide_repositories: int) -> Column:
    return (F.col("owners") >= wide_owners) | (F.col("repositories") >= wide_repositories)


def scan(
    docs: DataFrame, owner: str = "source", repository: str = "doc_id", wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES
) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live (owner-specific values), n_copied (widely copied ones).

    most_owners and most_repositories are those of the row's most copied value, 0 without values.
    """
    marked = staged(candidates(docs, owner, repository, ["doc_id"]).withColumn("row", F.monotonically_increasing_id()), "secrets")
    values = marked.select("row", F.explode(F.concat("base", "extra")).alias("span")).withColumn("value", F.col("span.value"))
    verdicts = (
        values.join(ownership(marked).withColumnRenamed("value", "of"), F.col("value") == F.col("of"))
        .withColumn("wide", is_wide(wide_owners, wide_repositories))
        .groupBy("row").agg(
            F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"),
            F.collect_list(F.when((F.col("span.rank") == 3) & ~F.col("wide"), F.col("span"))).alias("live"),
            F.count(F.when(~F.col("wide"), 1)).alias("n_live"), F.count(F.when(F.col("wide"), 1)).alias("n_copied"),
        )
    )
    of = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    return marked.join(verdicts, "row", "left").select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", F.coalesce("live", none)))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("most_owners", F.lit(0)).alias("most_owners"), F.coalesce("most_repositories", F.lit(0)).alias("most_repositories"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the mask."""
    limits = "array<struct<s:int,e:int>>"
    merged = F.aggregate(
        F.array_sort(spans), F.expr(f"cast(array() as {limits})"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["e"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["s"].alias("s"), F.greatest(x["end"], F.try_element_at(acc, F.lit(-1))["e"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("s"), x["end"].alias("e"))))),
    )
    ends = F.concat(F.array(F.lit(0)), F.transform(merged, lambda m: m["e"]))
    starts = F.concat(F.transform(merged, lambda m: m["s"]), F.array(F.char_length(text)))
    parts = F.zip_with(ends, starts, lambda e, s: F.substring(text, e + 1, s - e))
    return F.when(F.size(spans) > 0, F.array_join(parts, MASK)).otherwise(text)


def mask_documents(
    docs: DataFrame, owner: str = "source", repository: str = "doc_id", wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES
) -> DataFrame:
    """The documents with all base spans and all owner-specific `live` spans masked and n_chars brought up to date.

    Texts are scanned once: rows and their spans are written, and what is counted and joined reads the spans alone.
    """
    row = [F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("n")]
    found = staged(candidates(docs, owner, repository, row), "masks")
    known = ownership(found)
    plain = found.where(F.size("extra") == 0).select("_row", F.col("base").alias("spans"))
    open_ = found.where(F.size("extra") > 0)
    live = (
        open_.select("n", F.explode("extra").alias("span")).join(known.where(~is_wide(wide_owners, wide_repositories)), F.col("span.value") == F.col("value"), "left_semi")
        .groupBy("n").agg(F.collect_list("span").alias("live"))
    )
    settled = open_.join(live, "n", "left").select("_row", F.when(F.col("live").isNull(), F.col("base")).otherwise(F.concat("base", "live")).alias("spans"))
    out, old = plain.unionByName(settled), F.col("_row")
    text = F.when(old["text"].isNotNull(), masked(old["text"], F.col("spans")))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(old["n_chars"])
    return out.select(*((new[c] if c in new else old[c]).alias(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT doc_id, 0 AS rank, 'assign' AS kind, regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS f,
    regexp_split_to_array(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS g FROM d
  UNION ALL SELECT doc_id, 1, 'access', regexp_extract_all(text, 'AKIA[A-Z0-9]{16,}'), regexp_split_to_array(text, 'AKIA[A-Z0-9]{16,}') FROM d
  UNION ALL SELECT doc_id, 2, 'hex', regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_split_to_array(text, '[0-9a-f]{24,}') FROM d
  UNION ALL SELECT doc_id, 3, 'live', regexp_extract_all(text, '[A-Za-z0-9+/_-]{20,}={0,2}'), regexp_split_to_array(text, '[A-Za-z0-9+/_-]{20,}={0,2}') FROM d),
u AS (SELECT doc_id, rank, kind, f, g, unnest(range(1, len(f) + 1)) AS i FROM m),
p AS (
  SELECT doc_id, rank, kind, f[i] AS m, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM u),
v AS (
  SELECT *, s + length(m) AS e, CASE WHEN rank = 0 THEN regexp_extract(m, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) ELSE m END AS value FROM p),
b AS (SELECT * FROM v WHERE rank < 3 AND (rank > 0 OR length(value) >= 6)),
x AS (
  SELECT * FROM v WHERE rank = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')
    AND NOT list_has_any(list_transform(range(1, length(m) - 2), lambda i: substr(m, i, 4) = repeat(substr(m, i, 1), 4)), [true])
    AND len(list_distinct(string_split(m, ''))) >= 10
    AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = v.doc_id AND b.s < v.e AND v.s < b.e)),
c AS (SELECT * FROM b UNION ALL SELECT * FROM x),
o AS (
  SELECT value, sum(repositories)::BIGINT AS repositories, count(*) AS owners
  FROM (SELECT value, coalesce('=' || source, '') AS owner, count(DISTINCT doc_id) AS repositories FROM c JOIN d USING (doc_id) GROUP BY ALL) GROUP BY value),
a AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3 OR (owners < 4 AND repositories < 100)), '') AS spans,
    count(*) FILTER (owners < 4 AND repositories < 100) AS n_live, count(*) FILTER (owners >= 4 OR repositories >= 100) AS n_copied,
    max(owners) AS most_owners, max(repositories) AS most_repositories
  FROM c JOIN o USING (value) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
  coalesce(most_owners, 0)::BIGINT AS most_owners, coalesce(most_repositories, 0)::BIGINT AS most_repositories
FROM d LEFT JOIN a USING (doc_id)
"""
