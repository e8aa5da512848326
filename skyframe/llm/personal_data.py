"""Personal data: base patterns, and a skip-chain conditional random field over the tokens near them.

Nodes are the white-space tokens that hold a digit, an @ or a +, or an obfuscated at. Neighbouring nodes share chain
potentials; repeated or similar nodes share skip potentials with the occurrence before, however far away: one kind for the same place in
mentions with the same last seven digits (`same`), one for the same token alone (`skip`). Loopy sum-product message passing over whole Arrow batches gives each
node's label (none, email, ip, card, phone); nodes in base spans are held to theirs, nodes side by side that repeat one mention share their mean. Adjacent nodes of one label form a span if it has that label's looser format
(`formed`): phones without a +, cards with dots or slashes, defanged addresses, obfuscated emails. Base spans always stay,
the field adds spans that they do not touch.

Potentials are fitted by pseudo-likelihood on the nodes of at most `SAMPLE_DOCS` documents chosen by hash (at most
`SAMPLE_NODES` nodes of each), labelled by the base patterns; nodes of dropped matches are left out. As the patterns can't label
what they miss, each text gets `MENTIONS` of its matches written again at its end in other forms: alone and similar to the match
(labelled like it), with other digits after a word that tells the kind (likewise), cards twice side by side, and with other digits alone (labelled none).

Nulls: a null text is empty (no spans). Repeated rows get a result each. Empty tables give empty results; with
no labelled nodes the field adds nothing. Very long texts take linear time. Extra columns are ignored. Positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order of their kinds.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: Bounds of the sample that the potentials are fitted on.
SAMPLE_DOCS, SAMPLE_NODES, MENTIONS = 1500, 200, 4
#: Posterior from which a node takes a label, and rounds of message passing.
POSTERIOR, ROUNDS = 0.8, 8
#: Log-potential that holds a node to its base span's label.
KNOWN = 30.0

#: A match starts where a run of digits does; saying so keeps long runs linear.
_COMPILED = {k: re.compile(("(?<![0-9])" if k == "ip" else "") + p) for k, p in PATTERNS.items()}
_NEEDS = {"email": re.compile("@"), "ip": re.compile(r"[0-9]\.[0-9]"), "card": re.compile("[0-9]"), "phone": re.compile(r"\+[0-9]")}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@+]|[\[({]at[\])}]")
_OBFUSCATED = re.compile(r"[A-Za-z0-9._%+-]+(?:[\[({]dot[\])}][A-Za-z0-9._%+-]+)*(?:@|[\[({]at[\])}])[A-Za-z0-9-]+(?:(?:\.|[\[({](?:dot|\.)[\])}])[A-Za-z0-9-]+)+")
_DEFANGED = re.compile(r"[0-9]+(?:(?:\.|\[\.\]|\(\.\)|\[dot\])[0-9]+){3}")
_CARD, _PHONE = re.compile(r"[0-9](?:[\x20./-]?[0-9])+"), re.compile(r"[+(]?[0-9](?:[\x20()./-]{0,2}[0-9])+")
#: Words before a mention that tell its kind, in the order of the kinds.
_CUES = [re.compile(rf"\b(?:{w})\b[\W_]*$", re.I) for w in ("e-?mail|mail|contact", "ip|host|server|addr", "card|visa|mastercard|credit", "tel|phone|call|fax|mobile")]
_EDGES = re.compile(r"^[^+(\w]*|[^\w)]*$")
_DIGITS = re.compile("[0-9]")
_NOT_DIGITS = re.compile("[^0-9]")
_GAP = re.compile(r"[\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    """Whether a match of a kind's pattern is kept."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    if kind in ("card", "phone"):
        digits = _NOT_DIGITS.sub("", found)
        return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping email matches, found from each @ outward so that long words stay linear."""
    at, free = text.find("@"), 0
    local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
    domain = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in local:
            start -= 1
        m = domain.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind number, start, end) of the kept matches by kind, then start; and the limits of the dropped ones."""
    kept, dropped = [], []
    for k, kind in enumerate(KINDS):
        if not _NEEDS[kind].search(text):
            continue
        found = emails(text) if kind == "email" else (m.span() for m in _COMPILED[kind].finditer(text))
        for s, e in found:
            if valid(kind, text[s:e]):
                kept.append((k, s, e))
            elif e - s > 7:
                dropped.append((s, e))
    return kept, dropped


def node_features(t: str) -> list[float]:
    digits = _NOT_DIGITS.sub("", t)
    n, letters = len(digits), sum(c.isalpha() for c in t)
    dotted = t.split(".")
    limits = (1, 2, 3, 4, 5, 8, 11, 16, 20)
    return [
        1.0, "@" in t, "@" in t and "." in t.rpartition("@")[2], t.startswith("+"), t.startswith("(") and t.endswith(")"), n == len(t) and n > 0,
        len(dotted) == 4 and all(d.isdecimal() for d in dotted), "-" in t and letters == 0, letters > 0 and n > 0, letters == 0,
        16 <= n <= 19 and letters == 0 and luhn(digits), len(t) > 24, *(a <= n < b for a, b in zip(limits, limits[1:], strict=False)), n == 0, n >= 20,
        "@" not in t and bool(_OBFUSCATED.fullmatch(t)), ("[" in t or "(" in t) and bool(_DEFANGED.fullmatch(t)),
    ]


def run_features(text: str, run: list[tuple[int, int]]) -> list[float]:
    """What nodes side by side share (up to a + or a node of over 12 digits): their digits in all, and words before them that tell a kind."""
    digits = _NOT_DIGITS.sub("", "".join(text[s:e] for s, e in run[:20]))
    n, before = len(digits), text[max(0, run[0][0] - 24) : run[0][0]]
    several = 1 < len(run) <= 20
    return [several and n <= 19, several and 8 <= n <= 15, several and 16 <= n <= 19, several and 16 <= n <= 19 and luhn(digits), *(bool(c.search(before)) for c in _CUES)]


@dataclass
class Nodes:
    """The nodes of one text: limits, whether the one before is beside it, each one's previous similar node (-1: none), and whether that is of a mention with the same last digits."""

    spans: list[tuple[int, int]]
    chained: list[bool]
    similar: list[int]
    same: list[bool]
    run: list[int]  # the first node of those side by side
    features: list[list[float]]


def nodes_of(text: str) -> Nodes:
    spans, chained, similar, same, run, features, keys, long = [], [], [], [], [], [], [], []
    last: dict[str, int] = {}
    mention: dict[str, tuple[int, int]] = {}  # last node and number of digits of the last mention with some last seven digits
    before = -1
    for m in _WORD.finditer(text):
        raw, s = m.group(), m.start()
        if not _MARK.search(raw):
            continue
        lead = _EDGES.match(raw).end()
        tail = len(raw)
        while tail > lead and not (raw[tail - 1].isalnum() or raw[tail - 1] == ")"):
            tail -= 1
        if tail <= lead:
            continue
        t = raw[lead:tail]
        digits = _NOT_DIGITS.sub("", t)
        keys.append(digits if len(digits) > 3 else t.lower())
        long.append(len(digits) > 12)
        chained.append(before >= 0 and s - before < 4 and not _GAP.sub("", text[before:s]))
        spans.append((s + lead, s + tail))
        features.append(node_features(t))
        before = m.end()
    at = 0
    for k in range(1, len(spans) + 1):
        if k == len(spans) or not chained[k] or text[spans[k][0]] == "+" or long[k] or long[k - 1]:
            shared, tail = run_features(text, spans[at:k]), _NOT_DIGITS.sub("", text[spans[max(at, k - 20)][0] : spans[k - 1][1]])[-7:]
            end, most = mention.get(tail, (-1, 0))
            left = total = sum(len(_DIGITS.findall(text, *spans[i])) for i in range(max(at, k - 20), k))  # digits from the node to the run's end
            for i in range(at, k):
                features[i] += shared
                near = len(tail) == 7 and k - i <= 20
                own = [f"{tail}:{k - i}", keys[i]] if near else [keys[i]]
                whole = last.get(own[0], -1) if near else -1
                if near:
                    if whole < 0 and left <= most:  # the mention before is cut into other tokens
                        whole = end
                    left -= len(_DIGITS.findall(text, *spans[i]))
                similar.append(whole if whole >= 0 else last.get(keys[i], -1))
                same.append(whole >= 0)
                run.append(at)
                last.update(dict.fromkeys(own, i))
            if len(tail) == 7:
                mention[tail] = k - 1, total
            at = k
    return Nodes(spans, chained, similar, same, run, features)


@dataclass
class Field:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # label before x label
    skip: np.ndarray
    same: np.ndarray | None = None  # as skip, where unset

    def posteriors(self, x: np.ndarray, edges: np.ndarray, skips: np.ndarray, known: np.ndarray | None = None, rounds: int = ROUNDS, same: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of all nodes; edges and skips are (earlier, later) node pairs, `known` labels (-1: none) are held, `same` tells the skips between mentions with the same last digits."""
        own = x @ self.unary
        if known is not None:
            held = np.flatnonzero(known >= 0)
            own[held, known[held]] += KNOWN
        own -= own.max(1, keepdims=True)
        pairs = np.concatenate([edges, skips]).astype(np.int64).reshape(-1, 2)
        if not len(pairs):
            p = np.exp(own)
            return p / p.sum(1, keepdims=True)
        kinds = np.array([self.chain, self.skip, self.skip if self.same is None else self.same])
        kind = np.zeros(len(pairs), int)
        kind[len(edges) :] = 1 if same is None else 1 + same
        psi = np.exp(kinds[kind])
        a, b = pairs.T
        ahead, back = np.zeros((len(pairs), own.shape[1])), np.zeros((len(pairs), own.shape[1]))
        for _ in range(rounds):
            belief = own.copy()
            np.add.at(belief, b, ahead)
            np.add.at(belief, a, back)
            to_b = np.exp(belief[a] - back - (belief[a] - back).max(1, keepdims=True))
            to_a = np.exp(belief[b] - ahead - (belief[b] - ahead).max(1, keepdims=True))
            new_ahead = np.log(np.einsum("ei,eij->ej", to_b, psi) + 1e-30)
            new_back = np.log(np.einsum("ej,eij->ei", to_a, psi) + 1e-30)
            ahead = 0.5 * ahead + 0.5 * (new_ahead - new_ahead.max(1, keepdims=True))
            back = 0.5 * back + 0.5 * (new_back - new_back.max(1, keepdims=True))
        belief = own.copy()
        np.add.at(belief, b, ahead)
        np.add.at(belief, a, back)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit_field(x: np.ndarray, y: np.ndarray, before: np.ndarray, after: np.ndarray, similar: np.ndarray, same: np.ndarray, steps: int = 1500) -> Field:
    """Pseudo-likelihood: a softmax of a node's features and of the labels beside it (-1: none) and at similar nodes, apart for both kinds of skips.

    Each node counts three times: as it is, with the labels beside it hidden, and with all labels hidden, so that no part relies
    on another that a text may lack.
    """
    n_labels = len(KINDS) + 1
    hot = lambda v: np.eye(n_labels)[np.maximum(v, 0)] * (v >= 0)[:, None]
    hide = np.full_like(before, -1)
    skips = np.where(same == 0, similar, -1), np.where(same == 0, -1, similar)
    seen = (before, after, *skips), (hide, hide, *skips), (hide, hide, hide, hide)
    z = np.concatenate([np.concatenate([x, *map(hot, v)], 1) for v in seen])
    y = np.tile(y, len(seen))
    w, target = np.zeros((z.shape[1], n_labels)), np.eye(n_labels)[y]
    weight = (len(y) / np.maximum(target.sum(0), 1)) ** 0.5  # rare labels count more
    weight = (weight[y] / weight[y].mean())[:, None]
    scale = np.sqrt(np.maximum((weight * z * z).mean(0), 5 / len(z)))  # rare features move as fast as frequent ones
    z = z / scale
    pace = 2.0 / max(1.0, float(np.linalg.norm(z.T @ (z * weight), 2)) / len(z))
    ahead = w
    for step in range(steps):  # Nesterov's accelerated gradient
        s = z @ ahead
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        after_w = ahead - pace * (z.T @ (weight * (p - target)) / len(z) + 1e-5 * ahead)
        ahead = after_w + step / (step + 3) * (after_w - w)
        w = after_w
    w = w / scale[:, None]
    k = x.shape[1]
    b, a, s, t = (w[k + i * n_labels : k + (i + 1) * n_labels] for i in range(4))
    return Field(w[:k], (b + a.T) / 2, (s + s.T) / 2, (t + t.T) / 2)


def touched(spans: list[tuple[int, int]], limits: list[tuple[int, int]]) -> list[int]:
    """For each of the sorted disjoint `spans` the number of one of the `limits` it overlaps, or -1; in one pass over both, sorted."""
    order = sorted(range(len(limits)), key=limits.__getitem__)
    out, at, reach, which = [], 0, -1, -1
    for s, e in spans:
        while at < len(order) and limits[order[at]][0] < e:
            if limits[order[at]][1] > reach:
                reach, which = limits[order[at]][1], order[at]
            at += 1
        out.append(which if reach > s else -1)
    return out


def mentions(text: str, kept: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, str]]:
    """(word before, label, mention): matches written in other forms, see the module's text."""
    for i, (k, s, e) in enumerate(kept[:: max(1, len(kept) // MENTIONS)][:MENTIONS]):
        found, kind = text[s:e], KINDS[k]
        other, third, fourth = (re.sub("[0-9]", lambda d: str((int(d.group()) * m + 7 * d.start() + i) % 10), found) for m in (3, 9, 7))
        forms = (lambda v: v), (lambda v: re.sub("[^0-9]+", " ", v)), (lambda v: re.sub("[^0-9]+", ".", v)), (lambda v: re.sub("[^0-9]+", "", v))
        bare = lambda v, n=0: forms[(s + i + n) % 4](v.lstrip("+").strip()).strip(" .")
        if kind == "email":
            name, _, domain = found.rpartition("@")
            for n, cue in enumerate(("and", "mail")):
                yield cue, k + 1, name + "x" * n + ("(at)", "[at]")[i % 2] + domain.replace(".", ("[dot]", ".")[(i + n) % 2])
        elif kind == "ip":
            yield "and", k + 1, found.replace(".", "[.]")
            yield "host", k + 1, other.replace(".", "[.]")
            yield "part", 0, ".".join(found.split(".")[:3])
        elif kind == "card":
            yield "card", k + 1, ".".join(re.findall("[0-9]{1,4}", _NOT_DIGITS.sub("", found)))
            yield "with", k + 1, f"{found} {found}"
            yield "part", 0, other
        else:
            yield "and", k + 1, bare(found)
            yield "with", k + 1, bare(found, 1)
            yield "phone", k + 1, bare(other)
            yield "part", 0, bare(third)
            yield "list", 0, bare(fourth, 1)


def _labelled(text: str) -> tuple[Nodes, list[int]]:
    """The nodes of a text and its mentions, and their labels: 0 none, kind + 1, or -1 in a dropped match."""
    kept, dropped = base_spans(text)
    own, spans, labels = text, [(s, e) for _, s, e in kept], [k + 1 for k, _, _ in kept]
    for word, label, mention in mentions(text, kept):
        own += f"\n{word} "
        spans.append((len(own), len(own) + len(mention)))
        labels.append(label)
        own += mention + " on"
    nodes = nodes_of(own)
    sure, unsure = touched(nodes.spans, spans), touched(nodes.spans, dropped)
    return nodes, [labels[i] if i >= 0 else -(j >= 0) for i, j in zip(sure, unsure, strict=True)]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            nodes, labels = _labelled(text or "")
            for i in range(max(0, len(labels) - SAMPLE_NODES), len(labels)):
                if labels[i] >= 0:
                    beside = labels[i - 1] if nodes.chained[i] else -1
                    after = labels[i + 1] if i + 1 < len(labels) and nodes.chained[i + 1] else -1
                    rows.append([labels[i], beside, after, labels[nodes.similar[i]] if nodes.similar[i] >= 0 else -1, nodes.same[i], *map(float, nodes.features[i])])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float32()))], ["node"])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field | None:
    held = docs.where("doc_id IS NOT NULL").where(F.col("text").rlike("@|[0-9]{3}"))
    chosen = held.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    rows = held.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text")
    got = rows.mapInArrow(_sampled, "node array<float>").limit(sample_docs * SAMPLE_NODES).toArrow()
    if not len(got):
        return None
    m = got.column("node").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1)
    m = m[np.lexsort(m.T[::-1])]  # the same order in every run
    y, before, after, similar, same = m[:, :5].astype(int).T
    return fit_field(m[:, 5:].astype(float), y, before, after, similar, same) if (y > 0).any() else None


def one_decision(p: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """Label probabilities, those of nodes with one number in `repeat` (the first of them) replaced by their mean."""
    total = np.zeros_like(p)
    np.add.at(total, repeat, p)
    return (total / np.maximum(np.bincount(repeat, minlength=len(p)), 1)[:, None])[repeat]


def formed(kind: str, found: str) -> bool:
    """Whether a mention found by the field has its kind's looser format."""
    digits = _NOT_DIGITS.sub("", found)
    if kind == "email":
        return bool(_OBFUSCATED.fullmatch(found))
    if kind == "ip":
        return bool(_DEFANGED.fullmatch(found)) and all(int(p) <= 255 for p in re.findall("[0-9]{1,9}", found))
    if kind == "card":
        return 16 <= len(digits) <= 19 and bool(_CARD.fullmatch(found)) and luhn(digits)
    return 7 <= len(digits) <= 15 and bool(_PHONE.fullmatch(found))


def _spans(text: str, label: int, run: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Spans of one kind within adjacent nodes of its label; phones begin anew at each +, cards after 16 digits."""
    kind = KINDS[label - 1]
    parts: list[list[tuple[int, int]]] = []
    digits = 0
    for s, e in run:
        if not parts or kind in ("email", "ip") or text[s] == "+" or (kind == "card" and digits >= 16):
            parts.append([])
            digits = 0
        parts[-1].append((s, e))
        digits += len(_DIGITS.findall(text, s, e))
    for p in parts:
        s, e = p[0][0], p[-1][1]
        while e > s and not (text[e - 1].isalnum()):
            e -= 1
        if formed(kind, text[s:e]):
            yield label - 1, s, e


def spans_of(texts: list[str], field: Field | None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, base and added spans) of each text, one message passing for all."""
    based = [base_spans(t) for t in texts]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    work = [(i, nodes_of(texts[i])) for i in range(len(texts)) if field is not None]
    work = [(i, n) for i, n in work if n.spans]
    if work:
        x = np.array([f for _, n in work for f in n.features], float)
        edges, skips, same, base, known, repeat = [], [], [], 0, [], []
        for i, n in work:
            spans = [b[1:] for b in based[i][0]]
            known += [based[i][0][b][0] + 1 if b >= 0 else -1 for b in touched(n.spans, spans)]
            edges += [(base + k - 1, base + k) for k, c in enumerate(n.chained) if c]
            skips += [(base + j, base + k) for k, j in enumerate(n.similar) if j >= 0]
            for k, f in enumerate(n.same):  # nodes side by side that repeat one mention
                repeat.append(repeat[-1] if f and k and n.same[k - 1] and n.run[k] == n.run[k - 1] else base + k)
            same += [f for f, j in zip(n.same, n.similar, strict=True) if j >= 0]
            base += len(n.spans)
        p = field.posteriors(x, np.array(edges, np.int64).reshape(-1, 2), np.array(skips, np.int64).reshape(-1, 2), np.array(known, np.int64), same=np.array(same, int))
        p = one_decision(p, np.array(repeat))
        label = np.where(p[:, 1:].max(1) >= POSTERIOR, p[:, 1:].argmax(1) + 1, 0)
        base = 0
        for i, n in work:
            own, covered = label[base : base + len(n.spans)], based[i][0]
            base += len(n.spans)
            run: list[tuple[int, int]] = []
            for j in np.flatnonzero(own):
                if run and not (n.chained[j] and own[j - 1] == own[j]):
                    added[i] += _spans(texts[i], own[last], run)  # noqa: F821
                    run = []
                run.append(n.spans[j])
                last = j
            if run:
                added[i] += _spans(texts[i], own[last], run)
            added[i].sort(key=lambda a: a[1:])
            free = touched([a[1:] for a in added[i]], [b[1:] for b in covered])
            added[i] = [a for a, b in zip(added[i], free, strict=True) if b < 0]
    return [(b, sorted({*b, *a})) for (b, _), a in zip(based, added, strict=True)]


def _printed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[int(k)]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (base and added)."""
    nothing = hashlib.sha256(b"").hexdigest()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                text = batch.column("text").cast(pa.large_string()).fill_null("")
                counts, total = np.zeros((len(batch), len(KINDS)), np.int64), np.zeros(len(batch), np.int64)
                digest, printed = [nothing] * len(batch), [""] * len(batch)
                rows = np.flatnonzero(pc.match_substring_regex(text, r"[0-9@]|[\[({]at[\])}]").to_numpy(zero_copy_only=False))
                for i, (base, spans) in zip(rows, spans_of(text.take(pa.array(rows)).to_pylist(), field), strict=True):
                    for k, _, _ in base:
                        counts[i, k] += 1
                    total[i] = len(spans)
                    digest[i], printed[i] = hashlib.sha256(_printed(base).encode()).hexdigest(), _printed(spans)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(digest), pa.array(printed), pa.array(total)],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(found, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_spans long")
