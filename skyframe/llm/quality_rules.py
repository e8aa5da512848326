"""Quality rules: document statistics, base rules, and gradient-boosted trees over the statistics.

Trees are fitted on the driver on a bounded sample of labelled documents (`SAMPLE_ROWS`), flattened into
numpy node arrays and scored for whole Arrow batches. Features in `MONOTONE` may only lower the score.

Nulls: a null text has no words and fails the base rule. Empty tables give empty results. Repeated rows
are scored each on their own. Without labels of both kinds, or with under 40 labelled documents that pass the base rule, no trees are fitted
and the base rule decides: a threshold that keeps 99.8 % of the good ones can't be told from fewer. Very long texts are scored whole, alone in their chunk.
Of the documents' columns only those asked for are put out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordarrays import U64, TextChunk, chunks, mix

#: Bound of the labelled sample that the trees are fitted on.
SAMPLE_ROWS = 4000
#: Share of the sample's good documents that the threshold has to keep.
KEEP_GOOD = 0.998
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "punctuation", "line_words", "non_ascii"]
#: Features that may only lower the score.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!?.,;:\"'()[]{}-_/\\@=+~^`")] = True


def statistics(c: TextChunk) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts and the feature matrix of the texts of a chunk."""
    buf, byte_text = c.buf, np.repeat(np.arange(c.n), np.diff(c.off))
    starts, ends, doc = c.words()
    n_words = c.per_text(doc)
    in_word = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=in_word[1:])
    word_chars = c.per_text(doc, in_word[ends] - in_word[starts])
    count = lambda where: c.per_text(byte_text[where])
    n_symbols = count(_SYMBOL[buf])
    wh = c.hashes(starts, ends) + mix(doc.astype(np.uint64) + U64(11))
    repeat = np.zeros(len(wh), bool)
    if len(wh) > 2:
        tri = mix(wh[:-2] * U64(0x9E3779B97F4A7C15) + mix(wh[1:-1]) * U64(0xC2B2AE3D27D4EB4F) + wh[2:])
        same = np.flatnonzero(doc[:-2] == doc[2:])
        _, inverse, n = np.unique(tri[same], return_inverse=True, return_counts=True)
        hit = same[n[inverse] > 1]
        for k in range(3):
            repeat[hit + k] = True
    n_repeat = c.per_text(doc[repeat])
    distinct_words = c.per_text(doc[np.unique(wh, return_index=True)[1]])
    lines, line_ends, line_doc = c.runs(buf != 10)
    if len(lines):
        worded = np.zeros(len(buf) + 1, np.int64)
        worded[1:][starts] = 1
        worded = np.cumsum(worded)
        has = worded[line_ends] > worded[lines]
        lines, line_ends, line_doc = lines[has], line_ends[has], line_doc[has]
    lh = c.hashes(lines, line_ends) + mix(line_doc.astype(np.uint64) + U64(11))
    n_lines = c.per_text(line_doc)
    n_dup = n_lines - c.per_text(line_doc[np.unique(lh, return_index=True)[1]])
    w, chars = np.maximum(n_words, 1), np.maximum(np.diff(c.off), 1)
    features = np.column_stack([
        np.log1p(n_words), word_chars / w, n_symbols / w, n_dup / np.maximum(n_lines, 1), n_repeat / w, distinct_words / w,
        count((buf >= 65) & (buf <= 90)) / chars, count((buf >= 48) & (buf <= 57)) / chars, count(_PUNCT[buf]) / chars,
        n_words / np.maximum(n_lines, 1), count(buf >= 128) / chars,
    ])
    return dict(zip(BASE, (n_words, word_chars, n_symbols, n_dup, n_repeat), strict=True)), features


@dataclass
class Trees:
    """Complete binary trees of one depth as node arrays: split feature, split value, and the leaves' values."""

    depth: int
    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    bias: float
    threshold: float = -np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, s, v in zip(self.feature, self.split, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > s[at])
            total += v[at - (2**self.depth - 1)]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 2.0, bins: int = 32) -> Trees:
    """Logistic gradient boosting on quantile histograms; monotone features bound their children's values by the mid-value."""
    n, k = x.shape
    sign = np.array([MONOTONE.get(f, 0) for f in FEATURES[:k]] + [0] * max(0, k - len(FEATURES)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    code = np.column_stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(k)])
    rate_of_good = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(rate_of_good / (1 - rate_of_good)))
    margin, inner = np.full(n, bias), 2**depth - 1
    out = ([], [], [])
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p) + 1e-6
        feature, split, value = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(2 * inner + 1)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        node = np.zeros(n, np.int64)
        value[0] = 0.0
        for at in range(inner):
            own = np.flatnonzero(node == at)
            left, right = 2 * at + 1, 2 * at + 2
            value[left] = value[right] = value[at]
            low[left], low[right], high[left], high[right] = low[at], low[at], high[at], high[at]
            if len(own) < 20:
                node[own] = left
                continue
            best = (1e-3, None)
            gs, hs = g[own].sum(), h[own].sum()
            for j in range(k):
                if not len(cuts[j]):
                    continue
                gl = np.cumsum(np.bincount(code[own, j], g[own], len(cuts[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(code[own, j], h[own], len(cuts[j]) + 1))[:-1]
                wl = np.clip(-gl / (hl + l2), low[at], high[at])
                wr = np.clip(-(gs - gl) / (hs - hl + l2), low[at], high[at])
                gain = -(gl * wl + (hl + l2) * wl**2 / 2) - ((gs - gl) * wr + (hs - hl + l2) * wr**2 / 2)
                gain[(sign[j] * (wr - wl) < 0) | (hl < 1) | (hs - hl < 1)] = -np.inf
                b = int(gain.argmax())
                if gain[b] - gs**2 / (hs + l2) / 2 > best[0]:
                    best = (gain[b] - gs**2 / (hs + l2) / 2, (j, b, wl[b], wr[b]))
            if best[1] is None:
                node[own] = left
                continue
            j, b, wl, wr = best[1]
            feature[at], split[at], value[left], value[right] = j, cuts[j][b], wl, wr
            if sign[j]:
                mid = (wl + wr) / 2
                for child, upper in ((left, sign[j] > 0), (right, sign[j] < 0)):
                    if upper:
                        high[child] = min(high[child], mid)
                    else:
                        low[child] = max(low[child], mid)
            node[own] = np.where(code[own, j] > b, right, left)
        leaves = rate * value[inner:]
        margin = margin + leaves[node - inner]
        for to, a in zip(out, (feature, split, leaves), strict=True):
            to.append(a)
    return Trees(depth, *(np.array(a) for a in out), bias)


def _scored(batches: Iterator[pa.RecordBatch], trees: Trees | None, features: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, c in chunks(batch.column("text")):
            base, x = statistics(c)
            cols = {name: batch.column(name).slice(i, j - i) for name in batch.schema.names if name != "text"}
            cols |= {name: pa.array(v, pa.int64()) for name, v in base.items()}
            if features:
                cols["features"] = pa.array(list(x), pa.list_(pa.float64()))
            else:
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                score = trees.score(x) if trees else np.zeros(len(x))
                cols["base_failed"] = pa.array(failed)
                cols["kept"] = pa.array(~failed & ((score >= trees.threshold) if trees else True))
                cols["score"] = pa.array(1 / (1 + np.exp(-score)))
            yield pa.RecordBatch.from_pydict(cols)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, keep_good: float = KEEP_GOOD) -> Trees | None:
    """Trees from at most `sample_rows` labelled documents, chosen by hash; None without both kinds of label."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.select("quality", "text")  # one text a doc_id, the same in every run
    got = rows.mapInArrow(lambda it: _scored(it, None, True), "quality int, " + ", ".join(f"{b} long" for b in BASE) + ", features array<double>").select("quality", "n_words", "n_repeat_words", "features").collect()
    got = [r for r in got if r[1] >= 50 and 100 * r[2] <= 50 * r[1]]
    if len(got) < 40 or len({r[0] for r in got}) < 2:
        return None
    x, y = np.array([r[3] for r in got]), np.array([float(r[0]) for r in got])
    order = np.lexsort((*x.T, y))
    trees = fit_trees(x[order], y[order])
    good = trees.score(x[y == 1])
    trees.threshold = min(0.0, float(np.quantile(good, 1 - keep_good)))
    return trees


def apply_rules(docs: DataFrame, trees: Trees | None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of each document with its base counts, base_failed, kept and score."""
    keep = keep or ["doc_id"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{b} long" for b in BASE), "base_failed boolean", "kept boolean", "score double"])
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(lambda it: _scored(it, trees, False), schema)


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    trees = fit(docs, labels)

    def kept(batches):
        for batch in batches:
            at = batch.schema.names.index("text")
            masks = [r.column("kept") for r in _scored(iter([pa.RecordBatch.from_arrays([batch.column(at)], ["text"])]), trees, False)]
            if masks:
                yield batch.filter(pa.concat_arrays(masks))

    return docs.mapInArrow(kept, docs.schema)
