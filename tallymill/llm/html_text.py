"""Main text of web pages by minimum cut.

A page becomes a list of text blocks with their place in the document tree. A log-linear classifier
gives each block a cost for either label: how a block reads (``features``) has fitted weights, so have
the class names of the sections around it, and elements with a meaning have fixed ones. It is fitted
on a bounded sample of the pages, at most ``SAMPLE`` of them by a hash of their id, whose blocks are
labelled by rule: what is inside navigation, footers, asides, forms or a section named like one is
boilerplate, what else is inside an article is content; other blocks have no label. Costs become the capacities of its edges to the two
terminals, and neighbouring blocks (in page order, and within one section) are tied by smoothness
edges that weaken with their distance in the tree. The minimum cut between the terminals separates
content from boilerplate. Blocks whose own costs outweigh all their ties are fixed first, which
leaves the minimum unchanged; the rest is solved by blocking flows along shortest paths.

The cut is per page, so a page is one task's work and no page is shuffled.

Cases: null and empty pages have empty text; unclosed tags end with their section; elements without
visible text hide what is inside up to their end tag or the end of a section around them, and
where the page has no end tag for them, up to the next block; a tag cut off at the page's end is
dropped; references are decoded once; repeated rows are done each by itself; an empty table gives
an empty result; columns other than id, url and html are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by what they do to the text.
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select option textarea button datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr input".split())
#: These can't stand inside themselves, so another start tag ends them.
ALONE = frozenset("option button select".split())
FOREIGN = frozenset("svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"}, "ul": {"p"}, "ol": {"p"}, "div": {"p"}, "table": {"p"}, "article": {"p"}, "section": {"p"}, "footer": {"p"}, "nav": {"p"}, "aside": {"p"}, "header": {"p"}, "form": {"p"}, "main": {"p"}}
SECTIONS = frozenset("article main section nav aside footer header form div body table ul ol dl blockquote dialog menu".split())
#: Where one of these starts or ends, svg and math without an end tag are over.
BLOCKS = SECTIONS | frozenset(CLOSES) | frozenset("h4 h5 h6 pre figure address center details fieldset html".split())
#: Weights of the classifier, in log-odds for content. A section counts by its element and by the
#: words of its class, id and role.
ELEMENT = {"article": 4.0, "main": 3.0, "nav": -7.0, "menu": -7.0, "aside": -6.0, "footer": -7.0, "form": -6.0, "dialog": -6.0, "header": -5.0, "blockquote": 0.5, "address": -1.0}
GOOD_WORDS = frozenset("article articlebody content main post entry story text body prose".split())
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist disqus reply replies respond discussion share sharing social related recommended more newsletter subscribe subscription signup login search searchbox widget toolbar pagination pager tags copyright disclaimer legal".split())
#: Bad only by themselves: an article-header is none of the page's headers.
WEAK_WORDS = frozenset("header footer more tags legal side search discussion".split())
STATES = frozenset("has with no is without".split())
GOOD, BAD = 2.0, -6.0
#: Weights of how a block reads where there is nothing to fit them on: constant, length, links, heading, sentence.
DEFAULT = (-0.5, 0.5, -3.0, 0.5, 0.5)
#: What the fit weighs against them: as many blocks of either label, and how firmly the defaults hold.
BLOCKS_OF_LABEL, RIDGE = 50, 4.0
#: Pages and blocks of the fit, and the labelled blocks that a class name needs for a weight of its own.
SAMPLE, SAMPLE_BLOCKS, NAMED_BLOCKS = 500, 50_000, 8
#: A learned name must be this sure to count (log-odds); it counts as the listed ones do.
SURE = 3.0
#: Smoothness: the tie of two blocks, divided by one more than their distance in the tree.
TIE = 1.5
SCALE = 1000

#: An svg that holds no other one is passed over as a whole, if it has an end tag.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<svg\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<!/)>(?:(?!<svg\b).)*?</svg\s*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<[/a-zA-Z!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Model:
    """Weights of `features`, and class names that turned out to be good or bad."""

    weights: tuple[float, ...] = DEFAULT
    good: frozenset[str] = frozenset()
    bad: frozenset[str] = frozenset()


@dataclass(slots=True)
class Section:
    """An open element of the tree."""

    tag: str
    parent: Section | None
    depth: int
    weight: float  # with all around it
    in_article: bool
    names: frozenset[str]  # words of class, id and role
    label: int | None  # by rule: content, boilerplate or neither


@dataclass(slots=True)
class Block:
    text: str
    section: Section | None
    linked: int  # characters inside links
    heading: bool


def names_of(attrs: str) -> list[set[str]]:
    """The words of each class, id and role; what only says that a page has something doesn't count."""
    found = [set(WORD.findall(n)) for m in NAMED.finditer(attrs) for n in (m[1] or m[2] or m[3] or "").lower().split()]
    return [words for words in found if not words & STATES]


def name_weight(words: set[str], model: Model = Model()) -> float:  # noqa: B008
    """Of a class, id or role."""
    good = words & GOOD_WORDS
    if bad := words & BAD_WORDS:
        return 0.0 if good and bad <= WEAK_WORDS else BAD
    if good:
        return GOOD
    return BAD if words & model.bad else GOOD if words & model.good else 0.0


def opened(tag: str, attrs: str, around: Section | None, model: Model) -> Section:
    in_article = around.in_article if around else False
    names = names_of(attrs) if attrs and tag not in ("html", "body") else []
    element = 0.0 if tag == "header" and in_article else ELEMENT.get(tag, 0.0)
    named = min((name_weight(n, model) for n in names), key=lambda x: (x >= 0, -x), default=0.0)
    by_list = min((name_weight(n) for n in names), key=lambda x: (x >= 0, -x), default=0.0)
    label = around.label if around else None
    if element < -1 or by_list < 0:
        label = 0
    elif label is None and (element > 1 or by_list > 0):
        label = 1
    weight = inside(around.weight if around else 0.0, element + named)
    return Section(tag, around, around.depth + 1 if around else 1, weight, in_article or tag in ("article", "main"), frozenset().union(*names), label)


def inside(around: float, weight: float) -> float:
    """Weight of a section within others: boilerplate inside an article is boilerplate."""
    return weight + (min(0.0, around) if weight < 0 else around)


def is_empty(tag: str, attrs: str) -> bool:
    return tag in VOID or (tag in FOREIGN and attrs.endswith("/"))


def ended(page: str) -> set[int]:
    """Where the tags of UNSEEN elements start that have an end tag of their own."""
    out: set[int] = set()
    begun: dict[str, list[int]] = {}
    for m in TOKEN.finditer(page):
        tag = (m["tag"] or "").lower()
        if tag not in UNSEEN:
            continue
        same = begun.setdefault(tag, [])
        if not m["end"]:
            if tag in ALONE:
                same.clear()
            if not is_empty(tag, m["attrs"]):
                same.append(m.start())
        elif same:
            at = same.pop()
            out.add(at)
            for others in begun.values():
                while others and others[-1] > at:
                    others.pop()
    return out


def blocks(page: str, model: Model = Model()) -> list[Block]:  # noqa: B008
    """The page's blocks with visible text, in page order."""
    out: list[Block] = []
    open_: list[Section] = []
    counts: Counter[str] = Counter()  # of the open tags
    hidden: list[tuple[str, int, bool]] = []  # tag, sections around it, has an end tag
    parts: list[tuple[str, bool]] = []
    links = 0
    has_end = ended(page)

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join([t for t, _ in parts])).split())
            if text:
                tag = open_[-1].tag if open_ else ""
                out.append(Block(text, open_[-1] if open_ else None, sum(len(t) for t, in_link in parts if in_link), tag[:1] == "h" and tag[1:].isdigit()))
            parts.clear()

    def close(to: int) -> None:
        while len(open_) > to:
            counts[open_.pop().tag] -= 1

    def unhide(tag: str) -> None:
        """Ends the innermost hidden element of this tag, with all that is open inside."""
        for i in range(len(hidden) - 1, -1, -1):
            if hidden[i][0] == tag:
                close(hidden[i][1])
                del hidden[i:]
                break

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not hidden:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in UNSEEN:
            end_block()
            if m["end"] or tag in ALONE:
                unhide(tag)
            if not m["end"] and not is_empty(tag, m["attrs"]):
                hidden.append((tag, len(open_), m.start() in has_end))
        elif tag == "br":
            parts.append((" ", links > 0))
        elif tag in INLINE:
            if tag == "a":
                links = 0 if m["end"] else 1
        elif hidden and hidden[-1][0] in FOREIGN and not hidden[-1][2] and tag not in BLOCKS:
            continue
        else:
            end_block()
            links = 0
            if tag == "body":
                hidden.clear()
            while hidden and not hidden[-1][2] and tag not in VOID:
                hidden.pop()
            if m["end"]:
                if counts[tag] > 0:
                    at_tag = len(open_) - 1
                    while open_[at_tag].tag != tag:
                        at_tag -= 1
                    close(at_tag)
            elif tag not in VOID:
                while open_ and open_[-1].tag in CLOSES.get(tag, ()):
                    close(len(open_) - 1)
            while hidden and hidden[-1][1] > len(open_):
                hidden.pop()
            if not m["end"] and tag not in VOID:
                open_.append(opened(tag, m["attrs"], open_[-1] if open_ else None, model))
                counts[tag] += 1
    if at < len(page) and not hidden:
        parts.append((page[at:], links > 0))
    end_block()
    return out


def features(b: Block) -> tuple[float, ...]:
    """How a block reads: constant, length, share of links, is it a heading, does it end a sentence."""
    n = len(b.text)
    return 1.0, math.log1p(n / 20), min(1.0, b.linked / n), float(b.heading), float(b.text[-1] in ".!?\"”»")


def log_odds(b: Block, model: Model = Model()) -> float:  # noqa: B008
    """The classifier: how much more likely content is than boilerplate."""
    return (b.section.weight if b.section else 0.0) + sum(w * x for w, x in zip(model.weights, features(b), strict=True))


def _tree_distance(a: Section | None, b: Section | None) -> int:
    steps = 0
    while a is not b:
        if a is not None and (b is None or a.depth >= b.depth):
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def ties(found: list[Block]) -> dict[tuple[int, int], int]:
    """Smoothness edges: next in page order, and next under the same parent section."""
    edges: dict[tuple[int, int], int] = {}
    last_under: dict[int, int] = {}
    for i, b in enumerate(found):
        near = {i - 1} if i else set()
        parent = id(b.section.parent) if b.section else 0
        if parent in last_under:
            near.add(last_under[parent])
        last_under[parent] = i
        for j in near:
            edges[j, i] = int(SCALE * TIE / (1 + _tree_distance(found[j].section, b.section)))
    return edges


def _labelled(page: str | None) -> Iterator[tuple[int, tuple[float, ...], list[str]]]:
    """Label, features and section names of the blocks that the rules label."""
    for b in blocks(page or ""):
        if b.section is not None and b.section.label is not None:
            names, at = set(), b.section
            while at is not None and (at.label == b.section.label or at.names):
                names |= at.names if at.label == b.section.label else set()
                at = at.parent
            yield b.section.label, features(b), sorted(names)


def fitted(rows: list[tuple[int, tuple[float, ...], list[str]]]) -> Model:
    """Weights by Newton's method, held near the default ones, and the names that are sure."""
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model()
    x = np.array([r[1] for r in rows])
    share = BLOCKS_OF_LABEL / np.where(y == 1, y.sum(), (1 - y).sum())
    usual = np.array(DEFAULT)
    w = usual.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (share * (p - y)) + RIDGE * (w - usual))
        w -= step
        if abs(step).max() < 1e-6:
            break
    counts = {k: Counter(n for r in rows if r[0] == k for n in r[2]) for k in (0, 1)}
    sure: dict[int, set[str]] = {0: set(), 1: set()}
    for n in counts[0].keys() | counts[1].keys():
        bad, good = counts[0][n], counts[1][n]
        if bad + good >= NAMED_BLOCKS:
            odds = math.log((good + 0.5) / (1 + y.sum())) - math.log((bad + 0.5) / (1 + (1 - y).sum()))
            if abs(odds) >= SURE:
                sure[int(odds > 0)].add(n)
    return Model(tuple(w.tolist()), frozenset(sure[1]), frozenset(sure[0]))


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Model:
    """The classifier from a bounded sample of the pages; the default weights where the rules label nothing."""
    share = 2 * SAMPLE / max(1, pages.count())
    ids = pages.select(F.col(id_col).alias("id")).where("id IS NOT NULL")
    if share < 1:
        ids = ids.where(F.xxhash64("id") < int((share - 0.5) * 2.0**64))
    ids = ids.distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).join(F.broadcast(ids), "id", "left_semi").select(F.xxhash64("id").alias("place"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.string())
        for batch in batches:
            found = [(place, n, *x) for place, page in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n, x in enumerate(_labelled(page))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["place", "block", "label", "x", "names"])

    blocks = sample.mapInArrow(run, "place long, block int, label int, x array<double>, names array<string>")
    # bounded, numbers only, and the same ones whatever the partitions
    rows = blocks.orderBy("place", "block", "label", "x", "names").limit(SAMPLE_BLOCKS).select("label", "x", "names").collect()
    return fitted([(r["label"], tuple(r["x"]), r["names"]) for r in sorted(rows)])


def min_cut(gain: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """On which side each node is: True (source) costs -gain where gain < 0, False costs gain where it is > 0, a cut edge its weight."""
    n = len(gain)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        if w and a != b:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    side: list[bool | None] = [None] * n
    gain = gain[:]
    waiting = deque(range(n))
    while waiting:
        a = waiting.popleft()
        if side[a] is None and abs(gain[a]) >= sum(near[a].values()):
            side[a] = gain[a] > 0
            for b, w in near[a].items():
                gain[b] += w if side[a] else -w
                del near[b][a]
                waiting.append(b)
            near[a] = {}
    rest = [a for a in range(n) if side[a] is None]
    if rest:
        source, sink = n, n + 1
        flow: dict[int, dict[int, int]] = {a: dict(near[a]) for a in rest} | {source: {}, sink: {}}
        for a in rest:
            s, t = (source, a) if gain[a] > 0 else (a, sink)
            if gain[a]:
                flow[s][t] = abs(gain[a])
                flow[t].setdefault(s, 0)
        while True:
            level = {source: 0}
            queue = deque([source])
            while queue:
                a = queue.popleft()
                for b, room in flow[a].items():
                    if room > 0 and b not in level:
                        level[b] = level[a] + 1
                        queue.append(b)
            if sink not in level:
                break
            left = {a: iter(flow[a]) for a in level}
            path = [source]
            while path:  # a blocking flow: each edge of the level graph is used up or left behind once
                a = path[-1]
                if a == sink:
                    steps = list(zip(path, path[1:], strict=False))
                    least = min(flow[i][j] for i, j in steps)
                    for i, j in steps:
                        flow[i][j] -= least
                        flow[j][i] = flow[j].get(i, 0) + least if i != source and j != sink else 0
                    first = next(k for k, (i, j) in enumerate(steps) if not flow[i][j])
                    del path[first + 1 :]
                    continue
                for b in left[a]:
                    if level.get(b) == level[a] + 1 and flow[a][b] > 0:
                        path.append(b)
                        break
                else:
                    path.pop()
        for a in rest:
            side[a] = a in level
    return [bool(s) for s in side]


def main_text(page: str | None, model: Model = Model()) -> str:  # noqa: B008
    found = blocks(page or "", model)
    if not found:
        return ""
    keep = min_cut([int(SCALE * log_odds(b, model)) for b in found], ties(found))
    return " ".join([b.text for b, k in zip(found, keep, strict=True) if k])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text: the main text of each page."""
    model = train(pages, id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(x, model) for x in part.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string")
