"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-gram hashes of the texts are joined to the k-gram positions of license templates. Hits
vote by (row, template, diagonal), a diagonal being the text position less the template position. Diagonals
at most `NEAR` apart are merged, and a span stands if its hits, each verified word by word, cover `COVER` of
the template's k-grams. Base phrases are counted beside and always stay.

The template table is small (`MOST_TEMPLATE_WORDS` is checked) and is the broadcast side. Every row brings a
sentinel gram that always joins, so rows without hits stay and texts are tokenised once.

Nulls: a null text is empty: no words, no labels, score 0, null first and last word. A null doc_id is kept.
Repeated rows get a result each. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The word pattern's separators, and the base phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [(("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved")]

K = 3
NEAR = 2
COVER = 0.6
MOST_TEMPLATE_WORDS = 20_000
_SENTINEL = -(2**62)

# Short notices by which well-known licenses are named in texts.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    """Lower-cased words. lower() beyond A-Z changes neither limits nor phrases, as bytes over 0x7F are all word characters."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def grams(w: Column, k: int = K) -> Column:
    """Hashes of the k words from each place on."""
    at = F.sequence(F.lit(0), F.size(w) - k)
    return F.when(F.size(w) >= k, F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))).otherwise(F.expr("cast(array() as array<bigint>)"))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """(gram, template, label, at, of, gram_words) of each template place, and the sentinel."""
    listed = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, text) in enumerate(templates)))
    t = spark.range(1).select(F.inline(listed))
    t = t.withColumn("w", words(F.col("text"))).select("template", "label", "w", F.posexplode(grams(F.col("w"), k)).alias("at", "gram"))
    places = t.select("gram", "template", "label", "at", (F.size("w") - (k - 1)).alias("of"), F.slice("w", F.col("at") + 1, k).alias("gram_words"))
    if (n := places.count()) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"{n} template words; at most {MOST_TEMPLATE_WORDS} go to every task")
    sentinel = spark.range(1).select(F.lit(_SENTINEL).cast("long").alias("gram"), F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("at"), F.lit(1).alias("of"), F.expr("cast(array() as array<string>)").alias("gram_words"))
    return places.unionByName(sentinel)


def _places(w: Column) -> Column:
    """(start, label) of all base phrases; words are looked through only where all words of a phrase occur in the text."""
    none = F.expr("cast(array() as array<struct<start:int,label:string>>)")

    def one(phrase: tuple[str, ...], label: str) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: _all([F.get(w, i + j) == p for j, p in enumerate(phrase)]))
        may = _all([F.contains(F.lower("text"), F.lit(p)) for p in phrase])
        return F.when(may, F.transform(hits, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))).otherwise(none)

    return F.concat(none, *(one(phrase, label) for phrase, label in PHRASES))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K, near: int = NEAR, cover: float = COVER) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    w = F.col("w")
    rows = (
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", words(F.col("text")).alias("w"))
        .withColumn("base", _places(w))
        .select("row", "doc_id", "w", "base", F.concat(F.array(F.lit(_SENTINEL).cast("long")), grams(w, k)).alias("g"))
        .select("row", "doc_id", "w", "base", F.posexplode("g").alias("at1", "gram"))
    )
    t = template_grams(docs.sparkSession, templates, k).withColumnRenamed("gram", "t_gram")
    hits = (
        rows.join(F.broadcast(t), F.col("gram") == F.col("t_gram"))
        .where((F.col("template") < 0) | (F.slice(w, F.col("at1"), k) == F.col("gram_words")))
        .withColumn("first", F.col("template") < 0)
        .select("row", "template", "label", "of", (F.col("at1") - 1 - F.col("at")).alias("diagonal"), F.when(F.col("first"), F.struct("doc_id", F.size(w).cast("long").alias("n_words"), "base")).alias("head"))
    )
    votes = hits.groupBy("row", "template", "diagonal").agg(F.count("*").alias("hits"), F.first("label").alias("label"), F.first("of").alias("of"), F.first("head", ignorenulls=True).alias("head"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    spans = (
        votes.withColumn("run", F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= near, 0).otherwise(1))
        .withColumn("run", F.sum("run").over(along))
        .groupBy("row", "template", "run").agg(F.sum("hits").alias("hits"), F.first("label").alias("label"), F.first("of").alias("of"), F.first("head", ignorenulls=True).alias("head"))
        .withColumn("share", F.least(F.lit(1.0), F.col("hits") / F.col("of")))
    )
    verified = (F.col("template") >= 0) & (F.col("share") >= cover)
    per_row = spans.groupBy("row").agg(
        F.first("head", ignorenulls=True).alias("head"), F.collect_set(F.when(verified, F.col("label"))).alias("own"), F.max(F.when(verified, F.col("share"))).alias("share")
    )
    base_labels = F.transform(F.col("head.base"), lambda b: b["label"])
    starts = F.transform(F.col("head.base"), lambda b: b["start"].cast("long"))
    sorted_set = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return per_row.select(
        F.col("head.doc_id").alias("doc_id"), F.col("head.n_words").alias("n_words"), F.size("head.base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), sorted_set(base_labels).alias("base_labels"), sorted_set(F.concat(base_labels, "own")).alias("labels"),
        F.when(F.size("head.base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    """The same rows by the words themselves instead of hashes."""
    listed = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{p[0]}', '{p[1]}', {repr(p[2]) if len(p) > 2 else 'NULL'}, '{label}')" for p, label in PHRASES)
    split = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
p AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS i FROM d),
g AS (SELECT r, i, a, lead(a) OVER v AS b, lead(a, 2) OVER v AS c FROM p WINDOW v AS (PARTITION BY r ORDER BY i)),
base AS (SELECT r, i, label FROM g JOIN (VALUES {phrases}) ph(x, y, z, label) ON a = x AND b = y AND (z IS NULL OR c = z)),
t AS (SELECT template, label, {split} AS w FROM (VALUES {listed}) l(template, label, text)),
tp AS (SELECT template, label, len(w) - {K - 1} AS n, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS place FROM t),
tg AS (SELECT *, lead(a) OVER v AS b, lead(a, 2) OVER v AS c FROM tp WINDOW v AS (PARTITION BY template ORDER BY place)),
votes AS (SELECT r, template, label, n, i - place AS diagonal, count(*) AS hits FROM g JOIN tg USING (a, b, c) GROUP BY ALL),
steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER v <= {NEAR} THEN 0 ELSE 1 END AS step FROM votes WINDOW v AS (PARTITION BY r, template ORDER BY diagonal)),
runs AS (SELECT *, sum(step) OVER (PARTITION BY r, template ORDER BY diagonal) AS run FROM steps),
spans AS (SELECT r, label, least(1::DOUBLE, sum(hits)::DOUBLE / n) AS share FROM runs GROUP BY r, template, label, n, run),
own AS (SELECT r, label, share FROM spans WHERE share >= {COVER}::DOUBLE),
bases AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM own) GROUP BY r),
best AS (SELECT r, max(share) AS share FROM own GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1::DOUBLE ELSE coalesce(share, 0::DOUBLE) END AS score
FROM d LEFT JOIN bases USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)
"""


ORACLE = _oracle()
