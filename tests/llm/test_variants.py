"""Source divergence, SimHash near-duplicates and spelling variants against SQL and brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from skyframe.llm import simhash_dedup, source_divergence, spelling
from tests.llm.conftest import make_docs, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- source divergence


def by_sql(docs, min_docs: int):
    con = duckdb.connect()
    con.register("documents", docs.select("lang", "source", "text").toArrow())
    return con.sql(source_divergence.ORACLE.replace(">= 10", f">= {min_docs}")).df()


def divergence_rows(spark, odd_rows):
    rows = [(i, t, ["en", None, "de"][k % 3], s) for k, (i, t, s) in enumerate(odd_rows)]
    rows += [(100 + k, prose(7 + k % 9, 60 + k), ["en", "de"][k % 2], f"s{k % 5}") for k in range(40)]
    rows += [(200, "alone", "fr", "x"), (201, "  12 34 ", "fr", "y"), (202, None, "fr", None)]
    return spark.createDataFrame([(*r, 7, 7, 7) for r in rows], "doc_id long, text string, lang string, source string, term int, n int, shard int")


@pytest.mark.parametrize("min_docs", [2, 10])
def test_divergence_equals_sql(spark, odd_rows, same, monkeypatch, min_docs):
    monkeypatch.setattr(source_divergence, "SHARD_ROWS", 50)
    monkeypatch.setattr(source_divergence, "COUNT_BYTES", 700)
    docs = divergence_rows(spark, odd_rows)
    got = source_divergence.audit(docs, min_docs=min_docs).toPandas()
    assert set(got["part"]) == {"pair", "term"} or min_docs == 10
    same(got, by_sql(docs, min_docs))


def test_divergence_without_broadcast(spark, odd_rows, same, monkeypatch):
    monkeypatch.setattr(source_divergence, "BROADCAST_GROUPS", 0)
    docs = divergence_rows(spark, odd_rows)
    same(source_divergence.audit(docs, min_docs=3).toPandas(), by_sql(docs, 3))


def test_divergence_of_nothing(spark, none):
    assert source_divergence.audit(none).count() == 0


def test_pairs_mirror_each_other_and_terms_stop_at_ten(spark, odd_rows):
    got = source_divergence.audit(divergence_rows(spark, odd_rows), min_docs=2).toPandas()
    pairs = {(r.lang, r.source, r.item): r.value for r in got[got["part"] == "pair"].itertuples()}
    assert all(pairs[lang, b, a] == v for (lang, a, b), v in pairs.items())
    assert got[got["part"] == "term"]["rank"].max() == 10


# --- SimHash


def brute_fingerprint(text) -> int:
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    """(doc_id, fingerprint) -> component by comparing every pair."""
    own = [(i, brute_fingerprint(t)) for i, t, _ in rows]
    ids = sorted({i for i, _ in own if i is not None})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held: dict[int, set] = {}
    for i, f in own:
        held.setdefault(f, set()).add(i)
    least = {f: min(i for i in s if i is not None) for f, s in held.items() if s != {None}}
    at = {f: f for f in least}

    def top(f):
        while at[f] != f:
            f = at[f]
        return f

    prints = list(least)
    for k, f in enumerate(prints):
        for g in prints[:k]:
            if (f ^ g).bit_count() <= 4:
                at[top(f)] = top(g)
    component: dict[int, int] = {}
    for f in prints:
        t = top(f)
        component[t] = min(component.get(t, least[f]), least[f])
    del root
    return [(i, f"{f:016x}", None if i is None else component[top(f)]) for i, f in own]


def simhash_rows():
    rng = random.Random(8)
    rows = []
    for g in range(5):
        words = prose(90 + g, 400).split()
        for c in range(14):
            own = list(words)
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(len(own))] = f"y{rng.randrange(10**6)}"
            rows.append((3000 + 100 * g + c, " ".join(own), "a"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowd", [simhash_dedup.CROWD, 3])
def test_simhash_equals_brute_force(spark, odd_rows, monkeypatch, crowd):
    """With a low limit all anchors count as crowded."""
    monkeypatch.setattr(simhash_dedup, "CROWD", crowd)
    monkeypatch.setattr(simhash_dedup, "DEAL", min(crowd, simhash_dedup.DEAL))
    monkeypatch.setattr(simhash_dedup, "GROUP_ROWS", 500)
    monkeypatch.setattr(simhash_dedup, "PAIRS", 64)
    rows = [*odd_rows, *simhash_rows()]
    got = sorted(map(str, (tuple(r) for r in simhash_dedup.dedup(make_docs(spark, rows)).collect())))
    want = brute_classes(rows)
    assert got == sorted(map(str, want))
    assert len({c for _, _, c in want}) < len(rows) - 30  # there are links


def test_simhash_of_nothing(spark, none):
    assert simhash_dedup.dedup(none).count() == 0


def test_empty_texts_are_linked(spark):
    got = simhash_dedup.dedup(make_docs(spark, [(4, None, "a"), (2, "", "a"), (9, " ", "a"), (None, "", "a")])).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(4, "0" * 16, 2), (2, "0" * 16, 2), (9, "0" * 16, 2), (None, "0" * 16, None)}


def test_near_fingerprints_meet_at_an_anchor():
    """Two that differ by up to four bits meet at the home of either; cells hold nothing further apart than that."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    home, visits = ([set() for _ in x] for _ in range(2))
    for v, out, only in ((x, home, True), (y, visits, False)):
        for rows, anchor, at_home in simhash_dedup.anchors_of(v):
            if at_home or not only:
                for r, a in zip(rows.tolist(), anchor.tolist(), strict=True):
                    assert a not in out[r]
                    out[r].add(a)
    assert all(h & v for h, v in zip(home, visits, strict=True))
    assert max(map(len, visits)) == simhash_dedup.VISITS
    cell = simhash_dedup.cells(x)
    assert np.bitwise_count(cell ^ x).max() == 2 and (simhash_dedup.cells(cell) == cell).all()


def test_a_dense_group_is_linked_by_few_pairs(spark):
    """20,000 fingerprints around one: cells and the most frequent one link nearly all of them."""
    rng = np.random.default_rng(6)
    fps = {0x0123456789ABCDEF: 500}
    while len(fps) < 20_000:
        v = 0x0123456789ABCDEF
        for b in rng.choice(64, rng.integers(1, 7), replace=False).tolist():
            v ^= 1 << b
        fps[v] = 1
    values = np.array(list(fps), np.uint64)
    table = spark.createDataFrame([(int(f.view(np.int64)), n) for f, n in zip(values, fps.values(), strict=True)], "fp long, n long")
    links = simhash_dedup.cell_links(table).collect()
    cell = np.unique(simhash_dedup.cells(values).view(np.int64))
    parent = {int(c): int(c) for c in cell}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for r in links:
        parent[root(r.a)] = root(r.b)
    tops = {int(c): root(int(c)) for c in cell}
    own = simhash_dedup.cells(values).view(np.int64)
    label = np.array([tops[int(c)] for c in own])
    for k in range(0, len(values), 97):  # no pair apart
        near = np.bitwise_count(values ^ values[k]) <= 4
        assert (label[near] == label[k]).all()


# --- spelling


def brute_words(rows):
    n: Counter[str] = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def distance_one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    n = brute_words(rows)
    form, near = {}, {}
    for w in n:
        own = [x for x in n if distance_one(w, x)]
        near[w] = len(own)
        top = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = top if top and n[top] >= 2 * n[w] else None

    def end(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], end(w), n[w], near[w], n[form[w]] if form[w] else None) for w in n}


def spelling_rows():
    """Frequent words and their misspellings, chains of them, doubled letters, shared halves, and words that sort out of order."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaa", "überall", "Überall", "ÿÿÿÿÿ"]
    rows = []
    for k in range(160):
        words = []
        for _ in range(150):
            w = rng.choice(base[: 10 + k % 56])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "c" + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((k, rng.choice([" ", "-", "1", "\n"]).join(words), "a"))
    return rows


@pytest.mark.parametrize("crowd", [spelling.CROWD, 1])
def test_variants_equal_brute_force(spark, odd_rows, monkeypatch, crowd):
    """With a low limit nearly all keys are split down to one code point."""
    monkeypatch.setattr(spelling, "CROWD", crowd)
    monkeypatch.setattr(spelling, "SHARD_ROWS", 700)
    monkeypatch.setattr(spelling, "HELD", 50)
    rows = [*odd_rows, *spelling_rows(), (None, "schreiben schreiben schreiben schrieben", "b")]
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(make_docs(spark, rows)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_variants(rows)
    assert any(r != f for _, f, r, *_ in got if f)  # chains


def test_variants_of_nothing(spark, none):
    assert spelling.variants(none).count() == 0
    assert spelling.variants(make_docs(spark, [(1, None, "a"), (2, "", None), (3, "ab ab ab", "a")])).count() == 0


def test_a_shared_half_is_split(spark, monkeypatch):
    """Thousands of words with one first half: keys are split until none is crowded."""
    rng = random.Random(12)
    words = sorted({"inter" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(6000)})
    table = spark.createDataFrame([(w, 3 + len(w) * 0 + (zlib.crc32(w.encode()) % 50)) for w in words], "word string, n long")
    per = spelling.segments(table).where("up").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert per <= spelling.CROWD
    got = {r.word: (r.n_near, r.top) for r in spelling.near_words(table).collect()}
    held, n = set(words), {r.word: r.n for r in table.collect()}
    for w in words[::7]:
        near = {v for k in range(len(w)) for c in "abcdefghinter" for v in (w[:k] + c + w[k + 1 :],) if v != w and v in held}
        assert got.get(w, (0, None)) == (len(near), min(near, key=lambda x: (-n[x], x), default=None))
