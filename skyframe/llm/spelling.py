"""Spelling variants grouped by Aho-Corasick automata over halves of words.

Words are counted in the tasks that cut the texts and added up. A word that differs from another by one inserted, deleted or replaced
code point keeps one of the other's halves, at the start or at the end. So each word x puts up two segments, its halves; automaton shards
hold them, and each word y is sent to the shards of the segments that it can hold: its starts and ends as long as the halves of words
of its own length, one less and one more. A shard's automaton finds the segments in its words at once; marks of the word's limits in
both check the offset, lengths are compared, and what is left between the segments is compared code point by code point.

A key (length of x, start, end) that too many words share is split: what lies between its start and end is halved again, so one of the new
halves survives the edit too. In the end a single code point is left, so no key keeps more words than there are letters. x puts up the later
segment with the note that y must not hold the earlier one: each ordered pair is found once, and near words are counted as they are found.

Texts may be of any length; runs of letters are held whole. Null texts have no words, and a null doc_id is written as nothing in front of
the colon. Repeated rows count each. Of near words with equal counts the smallest in code-point order is the form. Empty tables give
empty results. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import ne

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import discard, staged

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
#: One in so many (document, word) pairs loses a letter; shortest word and least count of a word that takes part.
ONE_IN, MIN_LENGTH, MIN_COUNT = 97, 5, 3
#: Words that put up a key, and rows of a key, from which it is split; rows of an automaton shard on average.
CROWD, CROWD_ROWS, SHARD_ROWS = 64, 20_000, 200_000
#: Different words that a task counts before it sends their counts.
HELD = 300_000
#: Limits of a word in an automaton; no letters.
START, END = "\x02", "\x03"


def damaged(run: str, doc_prefix: int) -> str:
    """The run without the code point that its document's hash picks, if it picks one. `doc_prefix`: crc32 of `<doc_id>:`."""
    h = zlib.crc32(run.encode(), doc_prefix)
    if h % ONE_IN:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        send = lambda: pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(LETTERS.findall((text.as_py() or b"").lower().decode())).items():  # of bytes, lower() takes A-Z only
                    word = damaged(run, prefix)
                    if len(word) >= MIN_LENGTH:
                        held[word] += n
                if len(held) >= HELD:
                    yield send()
                    held.clear()
        yield send()

    found = docs.select(F.col("doc_id").cast("string").alias("doc"), F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def halves(rows: DataFrame) -> DataFrame:
    """Each row twice, with the first or the second half of what lies between start and end added to these. `other`: length of the start that y must not have."""
    middle = F.col("length") - F.col("start") - F.col("end")
    cut = F.col("start") + F.floor(middle / 2).cast("int")
    both = F.array(
        F.struct(cut.alias("start"), F.col("end").alias("end"), F.col("other").alias("other")),
        F.struct(F.col("start").alias("start"), (F.col("length") - cut).alias("end"), cut.alias("other")),
    )
    return rows.withColumn("half", F.explode(both)).withColumns({c: F.col(f"half.{c}") for c in ("start", "end", "other")}).drop("half")


def keyed(rows: DataFrame) -> DataFrame:
    """The rows with the hash of their length, start and end. Different keys of one hash meet in a shard, where segments tell them apart."""
    part = lambda at, n: F.substring(F.col("word"), at, n)
    return rows.withColumn("key", F.xxhash64("length", "start", "end", part(F.lit(1), F.col("start")), part(F.length("word") - F.col("end") + 1, F.col("end"))))


def segments(words: DataFrame) -> DataFrame:
    """(word, n, up, length, start, end, other, key): the segments that words put up (`up`) and look for, no key crowded."""
    size = F.length("word")
    lengths: Column = F.filter(F.array(size - 1, size, size + 1), lambda x: x >= MIN_LENGTH)
    whole = words.select("word", "n", F.lit(True).alias("up"), size.alias("length")).unionByName(words.select("word", "n", F.lit(False).alias("up"), F.explode(lengths).alias("length")))
    crowded = halves(whole.withColumns({c: F.lit(0) for c in ("start", "end", "other")}))
    settled = None
    while True:
        rows = staged(keyed(crowded), "segments")
        per = rows.groupBy("key").agg(F.sum(F.col("up").cast("int")).alias("ups"), F.count("*").alias("all"), F.min(F.col("length") - F.col("start") - F.col("end")).alias("middle"))
        split = (F.col("ups") > CROWD) | (F.col("all") > CROWD_ROWS)
        per = staged(per.where("ups > 0 AND all > 1").select("key", (split & (F.col("middle") > 1)).alias("split")), "keys")
        rows = rows.join(per, "key")
        settled = rows.where("NOT split") if settled is None else settled.unionByName(rows.where("NOT split"))
        if per.where("split").isEmpty():
            return settled.drop("split")
        crowded = halves(rows.where("split").drop("key", "split"))


def near(x: str, y: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns x into y; lengths differ by one at most."""
    if len(x) == len(y):
        return sum(map(ne, x, y)) == 1
    if len(x) > len(y):
        x, y = y, x
    at = 0
    while at < len(x) and x[at] == y[at]:
        at += 1
    return x[at:] == y[at + 1 :]


def scan_shard(t: pa.Table) -> pa.Table:
    """(word, n_near, top_n, top) over one shard: near words that each word has among those that put up segments here."""
    up = t.column("up").combine_chunks()
    columns = ("word", "n", "length", "start", "end", "other")
    automaton, held = ahocorasick.Automaton(), {}
    for x, n, length, start, end, other in zip(*(t.filter(up).column(c).to_pylist() for c in columns), strict=True):
        segment = START + x[:start] if start >= end else x[length - end :] + END
        held.setdefault(segment, {}).setdefault(length, []).append((x, n, start, end, other))
    for segment in held:
        automaton.add_word(segment, segment)
    automaton.make_automaton()
    out: dict[str, list] = {c: [] for c in ("word", "n_near", "top_n", "top")}
    for y in set(t.filter(pa.compute.invert(up)).column("word").to_pylist()) if held else ():
        size, found = len(y), []
        for _, segment in automaton.iter(START + y + END):
            by_length = held[segment]
            for length in (size - 1, size, size + 1):
                for x, n, start, end, other in by_length.get(length, ()):
                    if y.startswith(x[:start]) and y.endswith(x[length - end :]) and not (other and y.startswith(x[:other])) and near(x[start : length - end], y[start : size - end]):
                        found.append((-n, x))
        if found:
            top = min(found)
            for c, v in zip(out, (y, len(found), -top[0], top[1]), strict=True):
                out[c].append(v)
    return pa.table({"word": pa.array(out["word"], pa.string()), "n_near": pa.array(out["n_near"], pa.int64()), "top_n": pa.array(out["top_n"], pa.int64()), "top": pa.array(out["top"], pa.string())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, top, top_n) of the words that have near ones: how many, and the most frequent."""
    rows = staged(segments(words), "routed")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    found = rows.withColumn("shard", F.pmod("key", F.lit(shards))).drop("key").groupBy("shard").applyInArrow(scan_shard, "word string, n_near long, top_n long, top string")
    best = F.min(F.struct((-F.col("top_n")).alias("less"), F.col("top").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.word").alias("top"), (-F.col("best.less")).alias("top_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form). Forms are at least twice as frequent, so chains are short and end; each round doubles the steps taken."""
    to = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = staged(to.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(to)
        to = after.select("word", "root")
        if after.where("moved").isEmpty():
            return to


def variants(docs: DataFrame) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root."""
    words = staged(word_counts(docs), "words")
    found = words.join(near_words(words), "word", "left")
    is_form = F.col("top_n") >= 2 * F.col("n")
    pick = lambda c, name: F.when(is_form, F.col(c)).alias(name)
    out = staged(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), pick("top", "form"), pick("top_n", "form_n")), "forms")
    ends = roots(out.where("form IS NOT NULL"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE step AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
coded AS (SELECT run, n, list_transform(range(1, 1 + strlen(coalesce(doc_id::VARCHAR, '') || ':' || run)), lambda k: ('0x' || substr(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), (2 * k - 1)::INT, 2))::BIGINT) AS bytes FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM coded, crc),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS top, max(m) AS top_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top_n >= 2 * w.n THEN b.top END AS form, CASE WHEN b.top_n >= 2 * w.n THEN b.top_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT k.word, f.word, f.form FROM walk k JOIN forms f ON f.word = k.next)
SELECT f.word, f.form, k.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk k ON k.word = f.word AND k.next IS NULL
"""
