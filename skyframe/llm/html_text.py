"""HTML main text by consensus host paths.

A page is read into units, its sectioning elements and lists, and the text blocks in them. A unit's path is that of
the tags and classes above it, digits generalised. Each page scores its units by the prose they hold themselves and
votes for their paths; it also tells Spark, for every path, the share of its prose below it, how much its names hint at
boilerplate, and a hash of its text. Spark sums this by host:

* Paths with `VOTE_SHARE` of a host's votes win. A page is extracted again from the lowest unit that holds all its
  units on winning paths, or, where it has none, those that hold `VOTE_SHARE` of its own prose. Ancestors that are an
  article, or else a main element, or have prose of their own beside it, take its place, as does what is around a
  section. Units in an article win alone where articles hold `ARTICLE_SHARE` of the votes.
* Names are a hint only. A unit whose names or tag hint at menus, footers, adverts, comments and the like is left out,
  unless its path holds the host's prose: half of it where the hint is weak, `MOSTLY` of it where it is strong.
* A path without any hint is left out if its text recurs from page to page while the text around it doesn't, and it
  holds little of the prose.

A path on under `VOTE_SHARE` of a host's pages has no consensus; then the page alone decides by the same rules. So a host
has at most 1 / VOTE_SHARE winners and verdicts of 1 / VOTE_SHARE times the units of a page.

Scripts, styles, form controls and hidden elements are no text. Character references are decoded, white space within a
block becomes one space, and blocks are joined by one line feed. A path with a strong hint that holds `MOSTLY` of the prose on a
host of fewer than `LEAST_PAGES` is unsure: it is left out unless the page has no text without it and only its names speak against it.

Html is parsed once: units, blocks and what a page tells of its paths are written and read by all that follows.

Nulls: a null html is empty text; all null urls are one host. Repeated rows vote and return each on their own. Empty tables
give empty results. Extra columns are ignored. Very long pages and deep nesting take linear time and memory.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Share of a host's votes (or pages) from which a path has a say.
VOTE_SHARE = 0.05
#: Share of the votes from which units in an article or main element keep those outside from winning.
ARTICLE_SHARE = 0.25
#: Share of the prose from which a path with a strong hint is main text after all, and pages it takes to say so.
MOSTLY, LEAST_PAGES = 0.8, 3
#: Bytes up to which the table of paths goes to every task.
BROADCAST_BYTES = 32 << 20
#: Pages that a task holds parsed at a time.
SLICE = 64

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea select svg math object audio video canvas title".split())
SWALLOW = frozenset("script style textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
UNITS = frozenset("article aside body center details dialog div dl fieldset figure footer form header main menu nav ol search section table ul".split())
PROSE = frozenset("p h1 h2 h3 h4 li dd td blockquote pre".split())
CLOSES_P = BLOCKS - frozenset("html head body caption tbody td tfoot th thead tr".split())
#: Open elements that a start tag ends: (those, the elements that keep it from reaching further up).
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
SCOPES = [(("p",), ("td", "th", "button", "table")), *dict.fromkeys(ENDS.values())]
#: Tags that hint at boilerplate, strongly and weakly.
STRONG, WEAK = 1.0, 0.6
TAG_HINTS = {
    **dict.fromkeys("nav aside footer dialog menu head button".split(), STRONG),
    **dict.fromkeys("form fieldset header search".split(), WEAK),
}
#: Words in a class, id or role that hint at boilerplate: strongly as a whole name, weakly as a part of one.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist disqus cookie "
    "cookies consent footer header masthead menu nav navbar navigation navlink navlinks newsletter notice notices pagination pager "
    "popup modal promo promoted related recommended replies respond share sharing sidebar signup subscribe social sponsor "
    "sponsored toolbar widget complementary contentinfo search login legal copyright skip".split()
)
#: Name words that stay a strong hint within longer names.
ALWAYS = frozenset("comment comments commentlist disqus cookie cookies consent advert advertisement sidebar sponsored newsletter breadcrumbs".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)
DIGITS = re.compile("[0-9]+")
SPACE = re.compile(r"\s+")
WORDS = re.compile("[a-z]+")


def hint_of(names: str) -> float:
    """How much class, id and role names hint at boilerplate."""
    most = 0.0
    for name in names.lower().split():
        words = WORDS.findall(name)
        if "".join(words) in NAMES or any(w in ALWAYS for w in words):
            return STRONG
        if any(w in NAMES for w in words):
            most = WEAK
    return most


@dataclass
class Page:
    """Units (0 is the page) with their parents, path hashes, labels, hints and whether they are in an article, and the blocks (unit, text, weight) in page order."""

    parent: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])
    label: list[str] = field(default_factory=lambda: [""])
    hint: list[float] = field(default_factory=lambda: [0.0])
    article: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[int, str, float]] = field(default_factory=list)

    def add(self, parent: int, tag: str, classes: str, hint: float) -> int:
        self.article.append(self.article[parent] or tag in ("article", "main"))
        label = tag + "".join(f".{DIGITS.sub('#', c)}" for c in sorted(classes.split()))
        self.parent.append(parent)
        self.path.append(xxhash.xxh64_intdigest(label, self.path[parent]) >> 1)
        self.label.append(label)
        self.hint.append(hint)
        return len(self.parent) - 1


@dataclass(slots=True)
class Open:
    """An open element: its unit, whether its text is dropped, whether it is prose, in an article, in a link, and the outermost element of each scope."""

    tag: str
    unit: int
    hidden: bool
    prose: bool
    article: bool
    link: bool
    nearest: tuple[int, ...]


def parse(page: str) -> Page:
    out = Page()
    stack = [Open("", 0, False, False, False, False, (-1,) * len(SCOPES))]
    opened: dict[str, int] = {}
    piece: list[str] = []
    linked = 0
    lacking: set[str] = set()  # end marks that don't come any more

    def end_block() -> None:
        nonlocal linked
        if piece:
            text = SPACE.sub(" ", entities.unescape("".join(piece))).strip()
            piece.clear()
            if text:
                free = max(0, len(text) - linked)
                out.blocks.append((stack[-1].unit, text, free if stack[-1].prose else free / 4))
        linked = 0

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    def after(mark: str, at: int, pattern: re.Pattern | None = None) -> int:
        """Where the text after the next `mark` begins, or -1."""
        if mark in lacking:
            return -1
        if pattern:
            m = pattern.search(page, at)
            e = m.end() if m else -1
        else:
            e = page.find(mark, at)
            e += len(mark) if e >= 0 else 0
        if e < 0:
            lacking.add(mark)
        return e

    def text(a: int, b: int) -> None:
        nonlocal linked
        if b > a and not stack[-1].hidden:
            piece.append(page[a:b])
            linked += (b - a) * stack[-1].link

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or (lt > last and not page.startswith("<!--", lt)):
            text(at, n)
            break
        text(at, lt)
        head = page[lt + 1 : lt + 2]
        if head in ("!", "?"):
            if page.startswith("<!--", lt):
                e = after("-->", lt + 2)  # <!--> is a whole comment
                at = e if e >= 0 else n
            elif page.startswith("<![CDATA[", lt) and (e := after("]]>", lt + 9)) >= 0:
                if not stack[-1].hidden:
                    piece.append(page[lt + 9 : e - 3].replace("&", "&amp;"))
                at = e
            else:
                e = after(">", lt)
                at = e if e >= 0 else n
            continue
        m = TAG.match(page, lt)
        if not m:
            text(lt, lt + 1)
            at = lt + 1
            continue
        at = m.end()
        tag, rest = m.group(2).lower(), m.group(3)
        if m.group(1):
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                if tag in BLOCKS:
                    end_block()
                close(k)
            continue
        if tag in RAW:
            if not rest.endswith("/"):
                e = after(f"</{tag}", at, re.compile(rf"</{re.escape(tag)}\s*>", re.I))
                at = e if e >= 0 else (n if tag in SWALLOW else at)
            continue
        if tag in ("br", "hr") and not stack[-1].hidden:
            piece.append(" ")
        block = tag in BLOCKS
        if block:
            end_block()
        if tag in VOID:
            continue
        if tag in CLOSES_P and stack[-1].nearest[0] >= 0:
            close(stack[-1].nearest[0])
        if tag in ENDS and (k := stack[-1].nearest[SCOPES.index(ENDS[tag])]) >= 0:
            close(k)
        classes, hint, hidden = "", 0.0, False
        if rest:
            got = {a.lower(): v.strip("\"'") for a, v in ATTRIBUTE.findall(rest)}
            classes = got.get("class", "")
            hint = hint_of(f"{classes} {got.get('id', '')} {got.get('role', '')}")
            hidden = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "")
        if not (block or tag in ("a", "span", "button")):
            continue
        above = stack[-1]
        if tag in ("html", "body", "article", "main"):
            hint = STRONG if hint == STRONG and tag == "article" and "comment" in classes.lower() else 0.0
        hint = max(hint, 0.0 if tag == "header" and above.article else TAG_HINTS.get(tag, 0.0))
        hidden |= tag in ("button", "head") or (tag == "a" and hint > 0)
        unit = out.add(above.unit, tag, classes, hint) if tag in UNITS or (block and hint > 0) else above.unit
        k = len(stack)
        nearest = tuple((before if before >= 0 else k) if tag in ended else -1 if tag in limits else before for (ended, limits), before in zip(SCOPES, above.nearest, strict=True))
        stack.append(Open(tag, unit, above.hidden or hidden, above.prose or tag in PROSE, above.article or tag in ("article", "main"), above.link or tag == "a", nearest))
        opened[tag] = opened.get(tag, 0) + 1
    end_block()
    return out


@dataclass
class Measures:
    """Of each unit: the share of the page's prose it holds itself and in all."""

    own: list[float]
    share: list[float]


def measure(p: Page) -> Measures:
    own = [0.0] * len(p.parent)
    for unit, _, weight in p.blocks:
        own[unit] += weight
    share = list(own)
    for u in range(len(own) - 1, 0, -1):
        share[p.parent[u]] += share[u]
    total = share[0] or 1.0
    return Measures([x / total for x in own], [x / total for x in share])


def text_hashes(p: Page) -> list[int]:
    """Of each unit: a hash of all its text."""
    out = [0] * len(p.parent)
    for unit, t, _ in p.blocks:
        out[unit] += xxhash.xxh64_intdigest(t)
    for u in range(len(out) - 1, 0, -1):
        out[p.parent[u]] += out[u]
    return [t & (2**63 - 1) for t in out]


def dropped_alone(hint: float, share: float) -> bool:
    """What one page says of a unit: it is left out if its names hint at it, unless the hint is weak and it holds half of the prose."""
    return hint >= STRONG or (hint >= WEAK and share < 0.5)


def text_of(p: Page, winners: frozenset[int] = frozenset(), verdicts: dict[int, bool] | None = None, unsure: frozenset[int] = frozenset()) -> str:
    """The page's main text by the host's winning paths, its verdicts (path: left out or not) and the paths left out only where there is other text."""
    m, n = measure(p), len(p.parent)
    verdicts = verdicts or {}
    tag = lambda x: p.label[x].partition(".")[0]
    out = [verdicts[p.path[u]] if p.path[u] in verdicts else dropped_alone(p.hint[u], m.share[u]) for u in range(n)]
    gone, depth = [False] * n, [0] * n
    for u in range(1, n):
        depth[u] = depth[p.parent[u]] + 1
        gone[u] = gone[p.parent[u]] or out[u]
    if unsure and all(gone[u] for u, _, _ in p.blocks):
        for u in range(1, n):
            out[u] &= p.path[u] not in unsure or tag(u) in TAG_HINTS
            gone[u] = gone[p.parent[u]] or out[u]
    held = [u for u in range(n) if m.own[u] > 0 and not gone[u]]
    left = sum(m.own[u] for u in held)
    chosen = [u for u in held if p.path[u] in winners]
    if not chosen:
        chosen = [u for u in held if m.own[u] >= VOTE_SHARE * left]
        if sum(m.own[u] for u in held if p.article[u]) >= ARTICLE_SHARE * left:
            chosen = [u for u in chosen if p.article[u]]
    if not chosen:
        chosen = [u for u, _, _ in p.blocks if not gone[u]]
        if not chosen:
            return ""
    top = chosen[0]
    for u in chosen[1:]:
        while u != top:
            if depth[u] >= depth[top]:
                u = p.parent[u]
            else:
                top = p.parent[top]
    above, u = [], top
    while u:
        u = p.parent[u]
        above.append(u)
    line = [top, *above]
    named = next((x for x in line if tag(x) == "article"), None) or next((x for x in line if tag(x) == "main"), None)
    beside = next((x for x in reversed(above) if m.own[x] > 0 and tag(x) not in ("body", "")), top)
    top = min((x for x in (top, named, beside) if x is not None), key=lambda x: depth[x])
    while tag(top) == "section" and tag(p.parent[top]) not in ("body", ""):  # a section is a part of what is around it
        top = p.parent[top]
    inside = [False] * n
    for u in range(top, n):
        inside[u] = not gone[u] and (u == top or (u > 0 and inside[p.parent[u]]))
    return "\n".join(t for u, t, _ in p.blocks if inside[u])


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1))


SAID = "path long, parent long, label string, article boolean, text long, votes double, share double, hint double"
PARSED = f"units array<struct<parent:int,path:long,label:string,hint:double,article:boolean>>, blocks array<struct<unit:int,text:string,weight:double>>, said array<struct<{SAID.replace(' ', ':').replace(',:', ',')}>>"


def structs(rows: list[list[tuple]], kind: str) -> pa.Array:
    """Lists of structs from lists of tuples, by columns."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split(":") for f in kind[kind.index("struct<") + 7 : kind.index(">")].split(",")]
    columns = list(zip(*(t for row in rows for t in row), strict=True)) or [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [name for name, _ in fields])
    limits = [0]
    for row in rows:
        limits.append(limits[-1] + len(row))
    return pa.ListArray.from_arrays(pa.array(limits, pa.int32()), values)


def tells(p: Page) -> list[tuple]:
    """What a page says of each of its paths."""
    m, text = measure(p), text_hashes(p)
    mine: dict[int, list] = {}
    for u in range(len(p.parent)):
        got = mine.setdefault(p.path[u], [p.path[p.parent[u]], p.label[u], p.article[u], 0, 0.0, 0.0, 0.0])
        got[3] += text[u]
        got[4] += 0.0 if dropped_alone(p.hint[u], m.share[u]) else m.own[u]
        got[5] += m.share[u]
        got[6] = max(got[6], p.hint[u])
    return [(path, *got[:3], got[3] & (2**63 - 1), got[4], min(got[5], 1.0), got[6]) for path, got in mine.items()]


def parsed(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, host, its units and blocks, and what it says of its paths."""
    schema = {c.split(" ", 1)[0]: c.split(" ", 1)[1] for c in PARSED.split(", ")}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                found = [parse(page.as_py() or "") for page in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"), part.column("url"), part.column("host"),
                        structs([list(zip(p.parent, p.path, p.label, p.hint, p.article, strict=True)) for p in found], schema["units"]),
                        structs([p.blocks for p in found], schema["blocks"]), structs([tells(p) for p in found], schema["said"]),
                    ],
                    ["page_id", "url", "host", *schema],
                )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", host(F.col("url")).alias("host"), "html").mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, {PARSED}")


def path_votes(pages: DataFrame) -> DataFrame:
    """`votes_of` html."""
    return votes_of(parsed(pages))


def votes_of(read: DataFrame) -> DataFrame:
    """(host, path, parent, label, article, pages, votes, share, hint, recurring): sums, means, and the share of pages whose text at the path another page has too. Path 0 counts the pages."""
    told = read.select("host", F.inline("said"))
    by_text = told.groupBy("host", "path", "text").agg(
        F.min("parent").alias("parent"), F.min("label").alias("label"), F.max("article").alias("article"), F.count("*").alias("pages"), *(F.sum(c).alias(c) for c in ("votes", "share", "hint"))
    )
    mean = lambda c: F.sum(c) / F.sum("pages")
    return by_text.groupBy("host", "path").agg(
        F.min("parent").alias("parent"), F.min("label").alias("label"), F.max("article").alias("article"), F.sum("pages").alias("pages"), F.sum("votes").alias("votes"),
        mean("share").alias("share"), mean("hint").alias("hint"), mean(F.when(F.col("pages") > 1, F.col("pages")).otherwise(0)).alias("recurring"),
    )


def host_paths(pages: DataFrame, vote_share: float = VOTE_SHARE) -> DataFrame:
    """`paths_of` html."""
    return paths_of(parsed(pages), vote_share)


def paths_of(read: DataFrame, vote_share: float = VOTE_SHARE) -> DataFrame:
    """(host, winners, left_out, kept, unsure): path hashes. Sums are rounded, so that the order of adding doesn't count."""
    paths = staged(votes_of(read), "votes").withColumns({c: F.round(c, 6) for c in ("votes", "share", "hint", "recurring")})
    whole = paths.groupBy("host").agg(
        F.max(F.when(F.col("path") == 0, F.col("pages"))).alias("of"),
        (F.sum(F.when(F.col("article"), F.col("votes")).otherwise(0)) >= ARTICLE_SHARE * F.sum("votes")).alias("articles"),
    )
    around = paths.select("host", F.col("path").alias("parent"), F.col("recurring").alias("around"))
    known = paths.where("path <> 0").join(whole, "host").join(around, ["host", "parent"], "left").where(F.col("pages") >= vote_share * F.col("of"))
    mostly = (F.col("hint") >= (STRONG + WEAK) / 2) & (F.col("share") >= MOSTLY)
    unsure = mostly & (F.col("pages") < LEAST_PAGES)
    strong = (F.col("hint") >= (STRONG + WEAK) / 2) & ~mostly
    weak = (F.col("hint") >= WEAK / 2) & (F.col("share") < 0.5)
    again = (F.col("pages") >= LEAST_PAGES) & (F.col("recurring") - F.col("around") >= 0.5) & (F.col("share") < 0.2)
    judged = known.select("host", "path", "hint", ((F.col("votes") >= vote_share * F.col("of")) & (F.col("article") | ~F.col("articles"))).alias("wins"), (~unsure & (strong | weak | again)).alias("out"), unsure.alias("unsure"))
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("path"))))
    return (
        judged.where("wins OR out OR hint > 0").groupBy("host")
        .agg(
            listed(F.col("wins") & ~F.col("out") & ~F.col("unsure")).alias("winners"), listed(F.col("out")).alias("left_out"),
            listed(~F.col("out") & ~F.col("unsure") & (F.col("hint") > 0)).alias("kept"), listed(F.col("unsure")).alias("unsure"),
        )
    )


def extract(pages: DataFrame, paths: DataFrame | None) -> DataFrame:
    """`texts_of` html."""
    return texts_of(parsed(pages), paths)


def texts_of(read: DataFrame, paths: DataFrame | None) -> DataFrame:
    """Per row: page_id, url, text, n_chars. Without `paths` every page decides alone."""
    lists = ["winners", "left_out", "kept", "unsure"]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                texts = []
                for page, won, out, kept, unsure in zip(zip(*(members(part.column(c)) for c in ("units", "blocks")), strict=True), *(part.column(c).to_pylist() for c in lists), strict=True):
                    (parent, path, label, hint, article), blocks = page
                    verdicts = dict.fromkeys(out or [], True) | dict.fromkeys(kept or [], False)
                    texts.append(text_of(Page(parent, path, label, hint, article, list(zip(*blocks, strict=True))), frozenset(won or []), verdicts, frozenset(unsure or [])))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = read.select("page_id", "url", "host", "units", "blocks")
    if paths is None:
        rows = rows.withColumns({c: F.expr("cast(NULL AS array<bigint>)") for c in lists})
    else:
        n_hosts, n_paths = paths.agg(F.count("*"), F.coalesce(F.sum(sum(F.size(c) for c in lists)), F.lit(0))).first()
        few = 128 * n_hosts + 8 * n_paths <= BROADCAST_BYTES
        rows = rows.join(F.broadcast(paths) if few else paths, "host", "left")
    kinds = {c: read.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return rows.select("page_id", "url", "units", "blocks", *lists).mapInArrow(again, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def members(column: pa.ListArray) -> Iterator[list[list]]:
    """Per row, its structs as lists by field."""
    limits = column.offsets.to_pylist()
    fields = [f.to_pylist() for f in column.values.slice(limits[0], limits[-1] - limits[0]).flatten()]
    for a, b in zip(limits, limits[1:], strict=False):
        yield [f[a - limits[0] : b - limits[0]] for f in fields]


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars, by the consensus of each host."""
    read = staged(parsed(pages), "parsed")
    return texts_of(read, staged(paths_of(read), "paths"))
