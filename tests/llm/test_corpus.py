"""Deduplication, quality rules, mixing, packing, HTML extraction and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyframe.llm import html_text, mixing, near_dedup, packing, quality_rules, queries, suffix_dedup
from skyframe.llm.wordarrays import TextChunk
from tests.conftest import DATA
from tests.llm.conftest import make_docs, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- near duplicates


def brute_components(rows, n: int = 2):
    sets = []
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    parent = {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _, _) in enumerate(rows):
        for b in range(a):
            j = rows[b][0]
            common = len(sets[a] & sets[b])
            if i is not None and j is not None and common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _, _ in rows}, {i: len(s) for (i, _, _), s in zip(rows, sets, strict=True)}


def near_rows():
    rng = random.Random(4)
    rows = []
    for g in range(6):
        words = prose(50 + g, 150).split()
        for c in range(12):
            own = list(words)
            for _ in range(rng.randint(0, 14)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((1000 + 100 * g + c, " ".join(own), "a"))
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark, odd_rows, none):
    rows = [*odd_rows, *near_rows()]
    want, sizes = brute_components(rows)
    got = near_dedup.dedup(make_docs(spark, rows), shingle=2).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], r.doc_id is None or r.doc_id == want[r.doc_id])
    assert near_dedup.dedup(none).count() == 0


def test_joint_likelihood_estimates_similarity():
    rng = np.random.default_rng(3)
    for common, a, b in ((900, 50, 50), (400, 0, 100), (500, 300, 100), (2000, 100, 300)):
        h = rng.integers(0, 2**63, common + a + b, dtype=np.uint64)
        regs = near_dedup.registers(np.concatenate([h[: common + a], h[:common], h[common + a :]]), np.array([0, common + a, 2 * common + a + b])).astype(int)
        more, less = (regs[0] > regs[1]).sum(), (regs[0] < regs[1]).sum()
        grid = np.linspace(0.01, 1, 200) * min(common + a, common + b) / max(common + a, common + b)
        best = grid[near_dedup.log_likelihood(more, less, (common + a) / (2 * common + a + b), grid).argmax()]
        assert abs(best - common / (common + a + b)) < 0.1
        sizes = np.array([common + a]), np.array([common + b])
        assert near_dedup.likely(np.array([more]), np.array([less]), *sizes, 0.8)[0] == (common / (common + a + b) > 0.7)


def exact_components(rows, percent: int = 80):
    """Components by comparing every pair that can be similar: such pairs share one of each set's rarest shingles."""
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        if w:
            sets[i] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)}
    count = Counter(x for s in sets.values() for x in s)
    parent, held, links = {i: i for i, _ in rows}, {}, set()

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sorted(sets.items(), key=lambda p: len(p[1])):
        rare = sorted(s, key=lambda x: (count[x], x))[: len(s) - -(-percent * len(s) // 100) + 1]
        for j in {j for x in rare for j in held.get(x, ())}:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                links.add((i, j))
                parent[max(root(i), root(j))] = min(root(i), root(j))
        for x in rare:
            held.setdefault(x, []).append(i)
    return {i: root(i) for i, _ in rows}, links


def test_recall_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    want, links = exact_components([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.component_id for r in near_dedup.dedup(docs, shingle=2).collect()}
    assert sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links) and all(want[i] == want[c] for i, c in got.items())
    assert got == want  # all links, and none too many


def test_large_groups_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = near_rows()
    edits = [prose(90, 200).split()]
    for c in range(12):  # a chain: only neighbours are similar enough
        edits.append([w if i // 14 != c else f"y{c}{i}" for i, w in enumerate(edits[-1])])
    rows += [(3000 + (7 * i) % 13, " ".join(w), "a") for i, w in enumerate(edits)]
    want, _ = brute_components(rows)
    assert {r.doc_id: r.component_id for r in near_dedup.dedup(make_docs(spark, rows), shingle=2).collect()} == want


@pytest.mark.parametrize("block", [40, 800])
def test_pair_that_no_leader_of_its_buckets_is_like(spark, monkeypatch, block):
    """Two near copies of a passage whose bands are all full of larger texts that hold it: 218 of them a band on average."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(7)
    copy = rng.integers(1, 60_000, near_dedup.REGISTERS).astype(np.uint16)
    classes = []
    for i in range(700):
        own = rng.integers(1, 60_000, near_dedup.REGISTERS).astype(np.uint16).reshape(near_dedup.BANDS, -1)
        bands = rng.choice(near_dedup.BANDS, 10, replace=False)
        own[bands] = copy.reshape(near_dedup.BANDS, -1)[bands]
        classes.append((i, 300, bytearray(own.tobytes())))
    classes += [(i, 100, bytearray(copy.tobytes())) for i in (900, 901)]
    words = prose(8, 100).split()
    rows = [(i, f"only text {i}", "a") for i in range(700)] + [(900, " ".join(words), "a"), (901, " ".join([*words[:-1], "other"]), "a")]
    table = spark.createDataFrame(classes, "id long, n_shingles long, registers binary").repartition(4)
    got = near_dedup.links(table, make_docs(spark, rows), 2, 0.8)
    assert [tuple(r) for r in got.collect()] == [(901, 900)]


def test_large_groups_are_dealt_by_open_members(spark):
    """20,000 members with ten outside the largest part: five like one of the others, five like none. Others are copied once a block of open ones."""
    rng = np.random.default_rng(5)
    n, near, far = 20_000, range(20_000, 20_005), range(20_005, 20_010)
    regs = rng.integers(1, 60_000, (n + 10, near_dedup.REGISTERS)).astype(np.uint16)
    sets = rng.integers(0, 2**62, (n + 10, 20)).astype(np.uint64)
    for i in near:
        regs[i], sets[i] = regs[7 * (i - n)], sets[7 * (i - n)]
        regs[i, 0], sets[i, 0] = 0, i
    sets.sort(axis=1)
    pdf = pd.DataFrame({"id": range(n + 10), "n_shingles": 20, "registers": [r.tobytes() for r in regs], "shingles": [s.tobytes() for s in sets]})
    table = spark.createDataFrame(pdf, "id long, n_shingles long, registers binary, shingles binary").repartition(4)
    part = F.when(F.col("id") < n, F.lit(0).cast("long")).otherwise(F.col("id")).alias("part")
    want = {(7 * (i - n), i) for i in near}

    shared = table.select("id", F.lit(5).cast("long").alias("bucket"), F.lit(n + 10).alias("n"))
    found = near_dedup.bucket_pairs(shared, table.select("id", part.alias("family")), table, 0.8).collect()
    assert {(r.a, r.b) for r in found} == want
    members = table.select("id", F.lit(1).cast("long").alias("family"), part.alias("component"), F.lit(160).alias("bytes"))
    assert near_dedup.dealt(members, "family", "component", sized=True).count() == n + 10 * (1 + n // near_dedup.BLOCK)
    found = near_dedup.family_links(members, table.select("id", "shingles"), 0.8).collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in found} == want


@pytest.mark.parametrize("n_open, n_rest", [(0, 9), (3, 9), (9, 9), (17, 17)])
def test_blocks_hold_every_open_pair_once(spark, monkeypatch, n_open, n_rest):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = [(i, 1, 100 + min(i, n_open)) for i in range(n_open + n_rest)]
    met = Counter()
    blocks: dict[tuple, list] = {}
    for r in near_dedup.dealt(spark.createDataFrame(rows, "id long, g long, part long"), "g", "part").collect():
        blocks.setdefault((r.left, r.right), []).append(r)
    for b in blocks.values():
        met.update({(min(x.id, y.id), max(x.id, y.id)) for x in b if x.opened for y in b if x.id != y.id})
    assert {(i, j) for i in range(n_open) for j in range(i + 1, n_open + n_rest)} <= set(met)
    assert all(i < n_open for i, _ in met)


def test_one_of_each_keeps_columns(spark, odd_rows):
    docs = make_docs(spark, odd_rows)
    got = near_dedup.one_of_each(docs)
    assert got.columns == docs.columns
    ids = sorted((r.doc_id for r in got.collect()), key=lambda i: -1 if i is None else i)
    assert ids == [None, 1, 2, 3, 4, 5, 8, 8, 11, 12, 13, 14, 15]


def test_sketches_are_mergeable_and_estimate():
    a, b = (TextChunk.of([prose(s, 400).encode()]) for s in (1, 2))
    (ha, oa), (hb, ob) = (near_dedup.shingle_sets(c, 2) for c in (a, b))
    both = np.unique(np.concatenate([ha, hb]))
    r = [near_dedup.registers(h, np.array([0, len(h)]))[0] for h in (ha, hb, both)]
    assert np.array_equal(np.maximum(r[0], r[1]), r[2])
    part = ha[: len(ha) // 2]
    r2 = near_dedup.registers(part, np.array([0, len(part)]))[0]
    assert abs((r[0] == r2).mean() - 0.5) < 0.15


def test_components_of_long_chains(spark):
    e = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = near_dedup.components(e.union(spark.createDataFrame([(100, 101)], "a long, b long")))
    assert {r.id: r.component for r in got.collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}


# --- substrings


def brute_removed(rows):
    seen, out = set(), {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                covered[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        spans = sum(1 for k in range(len(b)) if covered[k] and not (k and covered[k - 1]))
        out[i] = (len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [0, 2000])
def test_removed_bytes_equal_brute_force(spark, odd_rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    rng = random.Random(6)
    passage = prose(60, 40)
    rows = [r for i, r in enumerate(odd_rows) if r[0] != 8] + [(8, prose(1, 3000), "a")]
    rows += [(500 + i, f"{prose(600 + i, rng.randint(1, 60))} {passage[rng.randint(0, 9):]} {prose(700 + i, 20)}", "a") for i in range(25)]
    rows += [(600, "x" * 99, "a"), (601, "x" * 100, "a"), (602, "x" * 101, "a"), (603, passage * 3, "a")]
    want = brute_removed(rows)
    got = suffix_dedup.dedup(make_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_repeated_rows_and_empty_tables(spark, none):
    text = prose(61, 60)
    got = suffix_dedup.dedup(make_docs(spark, [(1, text, "a"), (1, text, "a"), (2, text, "a")])).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, len(text.encode())]
    assert suffix_dedup.dedup(none).count() == 0


def test_merged_transforms_equal_one_sort():
    pieces = [prose(s, 60).encode() for s in range(6)] + [prose(2, 60).encode()[40:], b"ab" * 150]
    first = np.cumsum([len(p) + 1 for p in pieces]) - [len(p) + 1 for p in pieces]
    whole = suffix_dedup.Transform.build(pieces, 0)
    merged = suffix_dedup.Transform.build(pieces[:3], 0).merge(suffix_dedup.Transform.build(pieces[3:], int(first[3])))
    ends = np.repeat(first + [len(p) for p in pieces], [len(p) + 1 for p in pieces])
    full = lambda t: [w for w in t if w + 100 <= ends[w]]  # noqa: E731  suffixes of 100 bytes or more
    groups = lambda t: {g for b in np.unique(t.block) if (g := frozenset(full(t.where[t.block == b].tolist())))}
    assert groups(whole) == groups(merged) and len(merged.where) == len(whole.where)


def test_merged_common_prefixes_equal_those_of_the_texts():
    pieces = [prose(s % 4, 40).encode()[s * 3 :] for s in range(9)] + [b"a" * 260, b"\0" * 120 + b"a" * 120]
    first = np.cumsum([len(p) + 1 for p in pieces]) - [len(p) + 1 for p in pieces]
    build = suffix_dedup.Transform.build
    t = build(pieces[:2], 0).merge(build(pieces[2:5], int(first[2]))).merge(build(pieces[5:8], int(first[5])).merge(build(pieces[8:], int(first[8]))))

    def letters(w):
        own = np.searchsorted(first, w, "right") - 1
        tail = pieces[own][w - first[own] :]
        return [tail[k : k + 5] for k in range(0, min(len(tail) - 4, 100), 5)]

    suffixes = [letters(w) for w in t.where]
    assert sorted(t.where.tolist()) == list(range(sum(len(p) + 1 for p in pieces)))
    assert all(a <= b for a, b in zip(suffixes, suffixes[1:], strict=False))
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert t.common[1:].tolist() == [shared(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False)]


def test_the_transforms_find_what_equal_segments_leave(spark, monkeypatch):
    passage = prose(60, 40)
    rows = [(i, f"{prose(800 + i, 30)} {passage} {prose(900 + i, 30)}", "a") for i in range(8)]
    docs = make_docs(spark, rows)
    whole = sum(r.n_removed for r in suffix_dedup.dedup(docs).collect())
    monkeypatch.setattr(suffix_dedup, "merged_repeats", lambda contested, buckets: contested.selectExpr("doc", "start", "start AS end").where("false"))
    assert whole == sum(v[1] for v in brute_removed(rows).values()) > sum(r.n_removed for r in suffix_dedup.dedup(docs).collect())


# --- quality rules


def brute_statistics(t: str):
    w = WORD.findall(t)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    mark = {j + k for j in range(len(w) - 2) if tri[(w[j], w[j + 1], w[j + 2])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(mark)


def test_statistics_equal_brute_force(spark, odd_rows, odd, none):
    trees = None
    got = quality_rules.apply_rules(odd, trees).collect()
    for r in got:
        t = next(t for i, t, _ in odd_rows if i == r.doc_id) or ""
        want = brute_statistics(t)
        assert tuple(r)[1:6] == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert (r.base_failed, r.kept) == (failed, not failed)
    assert len(got) == len(odd_rows) and quality_rules.apply_rules(none, trees).count() == 0


def test_trees_separate_and_stay_monotone(spark, none):
    rng = np.random.default_rng(3)
    x = rng.random((2000, len(quality_rules.FEATURES)))
    y = (x[:, 2] + 0.3 * rng.random(2000) < 0.6).astype(float)
    trees = quality_rules.fit_trees(x[:1000], y[:1000])
    assert ((trees.score(x[1000:]) > 0) == (y[1000:] > 0)).mean() > 0.85
    rows = np.repeat(x[1000:1050], 20, 0)
    rows[:, 2] = np.tile(np.linspace(0, 1, 20), 50)
    assert (np.diff(trees.score(rows).reshape(50, 20), axis=1) <= 1e-12).all()
    docs = make_docs(spark, [(i, prose(i, 80) if i % 2 else " ".join(w + "%%%" for w in prose(i, 80).split()), "a") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    fitted = quality_rules.fit(docs, labels)
    held_out = quality_rules.apply_rules(docs, fitted).where("doc_id >= 150").collect()
    assert all(r.kept == bool(r.doc_id % 2) for r in held_out)
    kept = quality_rules.filter_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 100
    again = quality_rules.fit(docs.union(docs).repartition(7), labels)
    assert all(np.array_equal(getattr(again, f), getattr(fitted, f)) for f in ("feature", "split", "value"))  # repeated rows count once
    assert quality_rules.fit(none, labels) is None and quality_rules.fit(docs, labels.limit(0)) is None


# --- mixing


def test_mix_equals_its_sql(spark, duck, same):
    same(queries.op6_mix(spark, f"{DATA}/sf0.001").toPandas(), duck.execute(mixing.ORACLE).df())


def test_mix_budgets(spark, odd, odd_rows, none):
    got = mixing.sample(odd).toPandas()
    assert len(got) == len(odd_rows) and (got.taken <= 3 * got["size"]).all()
    by = got.groupby(got.source.fillna("~null")).agg(target=("target", "first"), taken=("taken", "sum"), source_size=("source_size", "first"), own=("size", "sum"))
    assert (by.source_size == by.own).all() and ((by.target - by.taken).abs() < 1).all() and (by.target <= 3 * by.own).all()
    assert abs(by.target.sum() - by.own.sum()) < 1e-6
    assert sorted(mixing.sample(odd).toPandas().taken) == sorted(got.taken)
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 6
    assert mixing.sample(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_repeated_rows_take_their_share(spark):
    """Equal rows across a budget's limit come as often in all as the sample takes them, not each as often as one of them."""
    rows = [(1, prose(1, 30), "a")] * 40 + [(i, prose(i, 20), "a") for i in range(2, 12)] + [(50 + i, prose(i, 30), "b") for i in range(60)] + [(200, prose(5, 40), "b")] * 3
    docs = make_docs(spark, rows)
    taken = mixing.sample(docs).toPandas()
    n = taken.epochs + ((taken.part > 0) & (2 * taken.part >= taken["size"]))
    of_one = n[taken.doc_id == 1]
    assert of_one.min() < of_one.max()  # the limit is among them
    got = {r.doc_id: r["count"] for r in mixing.mixed_documents(docs).groupBy("doc_id").count().collect()}
    assert got == {i: k for i, k in n.groupby(taken.doc_id).sum().items() if k}


def test_mix_sends_no_texts(spark):
    """Only rows at a source's limit are grouped; the others are decided where they are read, by a row a source."""
    docs = make_docs(spark, [(i, prose(i, 5 + i % 40), "abc"[i % 3]) for i in range(300)] + [(None, prose(5, 9), "a")] * 3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at size, where a table a document is too large to broadcast
    try:
        mixed = mixing.mixed_documents(docs)
        branch = mixed._jdf.queryExecution().sparkPlan().children().apply(0).toString()
        assert "SortMergeJoin" not in branch and "ShuffledHashJoin" not in branch
        got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    taken = mixing.sample(docs).toPandas()
    n = taken.epochs + ((taken.part > 0) & (2 * taken.part >= taken["size"]))
    want = n.groupby(taken.doc_id.fillna(-1)).sum()
    assert {-1 if k is None else k: v for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_targets_reshare_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = dict(zip(sorted(k for k in sizes if k) + [None], (5, 2, 1, 5), strict=True))
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        level = left / sum(weights[k] for k in open_)
        over = {k for k in open_ if level * weights[k] > 3 * sizes[k]}
        for k in over or open_:
            target[k] = 3.0 * sizes[k] if over else level * weights[k]
        left -= sum(target[k] for k in over)
        open_ = open_ - over if over else set()
    assert got == pytest.approx(target)


# --- packing


def test_packing_covers_every_token_once(spark, odd, odd_rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(odd).toPandas()
    want = []
    for i, text, _ in odd_rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: (-1 if pd.isna(r[0]) else r[0], *r[1:])
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(key, want))
    by = got.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id").length.cumsum() - by.length == by.offset).all() and by.groupby("sequence_id").length.sum().max() <= 1024
    assert packing.pack(none).count() == 0


def test_both_encoders_agree():
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(packing.default_vocabulary())

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.characters(exclude_categories=["Cs"])) | st.text(alphabet="ab '\n\t’s1é😀  ", max_size=60))
    def agree(s):
        assert t.encode(s, add_special_tokens=False).ids == e.encode_ordinary(s)

    agree()


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(5)
    h = Counter(rng.integers(1, 1024, 5000).tolist())
    found = packing.plan_patterns(h)
    held = Counter()
    for p, n in found:
        assert sum(p) <= 1024
        for k in p:
            held[k] += n
    assert held == h and sum(n for _, n in found) <= 1.01 * -(-sum(k * n for k, n in h.items()) // 1024)


# --- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="content-{n}"><article class="post p{n}"><h1>Head &amp;  line</h1><p>One <b>two</b>
 three<p>Four&nbsp;five &lt;six&gt; &#8212; <i>seven<ul><li>a<li>b</ul><!-- no --><div class="ad">Buy</div><form>Name <input></form><style>p{{}}</style></article>
<section class="comments"><article class="comment"><p>A reader says a great many words here, {n} times over and over again, more than the article.</p></article></section></div>
<aside>Side</aside><footer>&copy; 2020</footer>"""
TEXT = "Head & line\nOne two three\nFour five <six> — seven\na\nb"


def test_pages(spark, none):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(n=i), 5) for i in range(6)]
    rows += [(10, None, None, 5), (11, "", "", 5), (12, "http://h0.example.com/x", "plain <b>text", 5), (12, "http://h0.example.com/x", "plain <b>text", 5)]
    rows += [(20, "http://div.example.com/", "<body><div class='menu'>x y</div><div id=main><div class=body><p>Long enough text of the page.</p>tail</div></div></body>", 5), (21, "http://long.example.com/", "<p>" + "w " * 200_000, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = html_text.extract(pages, html_text.host_paths(pages)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].text == TEXT and by[i].n_chars == len(TEXT) for i in range(6))
    assert [by[i].text for i in (10, 11, 12, 20)] == ["", "", "plain text", "Long enough text of the page.\ntail"]
    assert by[21].n_chars == 399_999
    votes = {r.label: r for r in html_text.path_votes(pages).where("host = 'h0.example.com'").collect()}
    assert votes["article.p#.post"].pages == 3 and votes["section.comments"].share > 0.4 and votes["div.cookie-notice"].recurring == 1
    chosen = html_text.host_paths(pages).where("host = 'h0.example.com'").first()
    assert chosen.winners == [votes["article.p#.post"].path] and votes["section.comments"].path in chosen.left_out
    empty = pages.limit(0)
    assert html_text.extract(empty, html_text.host_paths(empty)).count() == 0


LOST = [
    ('<div class="search-results-content"><p>A story.</p><p>More of it.</p></div>', "A story.\nMore of it."),
    ('<div class="post"><div class="legal-news"><p>The court said so.</p></div></div>', "The court said so."),
    ("<nav><a>x</a></nav><form><article><h1>Head</h1><p>In a form.</p></article><button>Send</button></form>", "Head\nIn a form."),
    ("<div><p>Before the table</p><table><tr><td>one<td>two<tr><td>three</table></div>", "Before the table\none\ntwo\nthree"),
    ("<article><h1>Head</h1><p>lead</p><div class=body>" + "<p>long text</p>" * 40 + "</div></article>", "\n".join(["Head", "lead", *["long text"] * 40])),
    ("<!--><p>x</p>", "x"),
    ("<!---><p>x</p><!-- y > --><p>z</p>", "x\nz"),
    ("<aside><p>Beside nothing.</p></aside><nav><a>x</a></nav>", ""),
    ("<div><section class=intro><p>a</p></section><section class=body><p>" + "b " * 400 + "</p></section><section class=end><p>c</p></section></div>", None),
]


@pytest.mark.parametrize("page, text", LOST)
def test_main_text_stays(page, text):
    assert html_text.text_of(html_text.parse(page)) == ("a\n" + ("b " * 400).strip() + "\nc" if text is None else text)


def test_odd_pages_take_linear_time():
    odd = ["<a " * 200_000, "<div>" * 100_000 + "x", "<ul><li>" * 50_000 + "x", "<p><table><td>" * 30_000, "<svg>" * 100_000, "<![CDATA[" * 100_000 + ">", "<!--" * 100_000, '<a x="' * 100_001 + ">", "<div>" * 50_000 + "</b>" * 50_000]
    began = time.perf_counter()
    for page in odd:
        html_text.text_of(html_text.parse(page))
    assert time.perf_counter() - began < 40


def hosts_of_pages():
    """(url, html, main text) of pages of made-up hosts, each with a template of its own; no name hints at anything but where it misleads."""
    rng = random.Random(12)
    line = lambda n: " ".join(rng.choice("ka lo mi te su ra vo ne".split()) + str(rng.randrange(10**6)) for _ in range(n))
    p = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    for n in range(12):
        main, readers, teaser = [line(rng.choice([3, 60])) for _ in range(3)], [line(60) for _ in range(rng.choice([1, 5]))], line(6)
        for k, (html, text) in enumerate([
            # readers' posts under a name that says nothing, longer than the text on some pages: they differ, but stay outside the article
            (f"<article><h1>{teaser}</h1>{p(main)}</article><div class=q7>{p(readers)}</div>", [teaser, *main]),
            # a notice under a name that says nothing, the same on every page, inside the text's own container
            (f"<div class=m1><div class=z{n}><p>We keep records of visits to improve this place.</p></div>{p(main)}</div>", main),
            # a misleading name on the text, and a real menu
            (f"<div class=menu><ul><li><a>{teaser}</a></li></ul></div><div class=share-stories>{p(main)}</div>", main),
            # the text in two sections of different weight, with a heading beside them
            (f"<main><h1>{teaser}</h1><section class=s1>{p(main)}</section><section class=s2>{p(readers)}</section></main><footer>{p([line(5)])}</footer>", [teaser, *main, *readers]),
            # a strong name that holds nearly all of the text on every page
            (f"<div class=login><a>{teaser}</a></div><div class=notice>{p(main)}</div>", main),
        ]):
            yield f"https://host{k}.example.org/{n}", f"<html><body><nav><a>{line(4)}</a></nav>{html}</body></html>", "\n".join(text)


def test_hosts_decide_by_votes(spark):
    made = list(hosts_of_pages())
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(made)], "page_id long, url string, html string")
    want = {i: t for i, (_, _, t) in enumerate(made)}
    got = {r.page_id: r.text for r in html_text.extract(pages, html_text.host_paths(pages)).collect()}
    assert got == want
    alone = {r.page_id: r.text for r in html_text.extract(pages, None).collect()}
    wrong = {made[i][0].split("/")[2] for i in want if alone[i] != want[i]}
    assert {"host1.example.org", "host4.example.org"} <= wrong  # without votes a page can't tell


def test_votes_and_verdicts_match_brute_force(spark):
    """Votes, winners and verdicts of the hosts recomputed page by page in plain Python, over the made-up hosts and pages of few, mixed and repeated kinds."""
    made = [(i, u, h) for i, (u, h, _) in enumerate(hosts_of_pages())]
    made += [(100 + i, f"http://few{i % 4}.example.com/{i}", PAGE.format(n=i)) for i in range(10)] + [(120, "http://few1.example.com/", None), (121, None, "<p>no host")]
    made += [(200, "http://lone.example.com/", '<div class="comment"><p>A lone essay.</p></div>')]
    by_host: dict[str, list] = {}
    for _, u, h in made:
        by_host.setdefault((u or "").split("//")[-1].split("/")[0], []).append(html_text.parse(h or ""))
    want = {}
    for name, pages in by_host.items():
        said = [html_text.tells(p) for p in pages]
        total: dict[int, dict] = {}
        texts: dict[tuple, int] = {}
        for page in said:
            for path, parent, _, article, text, votes, share, hint in page:
                t = total.setdefault(path, {"parent": parent, "article": False, "pages": 0, "votes": 0.0, "share": 0.0, "hint": 0.0})
                t["article"] |= article
                for k, v in (("pages", 1), ("votes", votes), ("share", share), ("hint", hint)):
                    t[k] += v
                texts[path, text] = texts.get((path, text), 0) + 1
        for path, t in total.items():
            t["again"] = sum(n for (p, _), n in texts.items() if p == path and n > 1) / t["pages"]
            t["share"] /= t["pages"]
            t["hint"] /= t["pages"]
        in_articles = sum(t["votes"] for t in total.values() if t["article"]) >= 0.25 * sum(t["votes"] for t in total.values())
        winners, left_out, stays, unsure = [], [], [], []
        for path, t in total.items():
            strong, mostly = round(t["hint"], 6) >= 0.8, round(t["share"], 6) >= 0.8
            if path == 0 or t["pages"] < 0.05 * len(pages):
                continue
            if strong and mostly and t["pages"] < 3:
                unsure.append(path)
                continue
            recurs = t["pages"] >= 3 and t["again"] - total[t["parent"]]["again"] >= 0.5 and t["share"] < 0.2
            gone = (strong and not mostly) or (t["hint"] >= 0.3 and t["share"] < 0.5) or recurs
            if gone:
                left_out.append(path)
            elif t["hint"] > 0:
                stays.append(path)
            if not gone and round(t["votes"], 6) >= 0.05 * len(pages) and (t["article"] or not in_articles):
                winners.append(path)
        if winners or left_out or stays or unsure:
            want[name] = tuple(sorted(x) for x in (winners, left_out, stays, unsure))
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    got = {r.host: (r.winners, r.left_out, r.kept, r.unsure) for r in html_text.host_paths(pages).collect()}
    assert got == want
    texts = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    for i, u, h in made:
        won, out, stay, maybe = want.get((u or "").split("//")[-1].split("/")[0], ([], [], [], []))
        assert texts[i] == html_text.text_of(html_text.parse(h or ""), frozenset(won), dict.fromkeys(out, True) | dict.fromkeys(stay, False), frozenset(maybe))
    assert texts[200] == "A lone essay."


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    rows = [(i, prose(i, 90) + (" password=abcdef" + str(i) if i % 7 == 0 else ""), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "s0") for i in range(10)] + [(200, "short", "s0"), (201, None, "s1"), (202, "a b c " * 40, "s2")]
    make_docs(spark, rows, False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = docs
    ids = lambda n: sorted(r.doc_id for r in seen[n].select("doc_id").collect())
    assert ids("quality rules") == [*range(60), *range(100, 110)]
    assert ids("near duplicates") == list(range(60)) == ids("secrets")
    assert seen["secrets"].where("text LIKE '%password%'").count() == 0 and seen["secrets"].where("text LIKE '%[SECRET]%'").count() == 9
    assert set(ids("mixing")) <= set(range(60)) and len(ids("mixing")) > 40
    assert seen["packing"].select("doc_id").distinct().count() == len(set(ids("mixing")))
    assert all(seen[n].columns == ["doc_id", "text", "lang", "source", "n_chars"] for n, _ in corpus_pipeline.STAGES[:-1])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()
