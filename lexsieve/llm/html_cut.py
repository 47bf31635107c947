"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks: runs of text between block-level tags, with the elements above them. A logistic block
classifier and the evidence of the markup give every block a cost as content and as boilerplate, the capacities
of its edges to the two terminals. Neighbours in page order and blocks of one parent element are joined by
smoothness edges, weaker the farther they lie apart in the element tree. The maximum flow separates the page; blocks
on the content side are the text.

The classifier is trained here without hand labels: on a bounded sample of pages, blocks below <article> or
<main> are positive seeds and blocks below navigation, footers, forms, adverts and the like negative ones (those told by a
class name only on pages that have positive seeds). It sees
only text features (length, links, punctuation, headings, place), so it also judges pages that lack such markup.

Edge cases: null and empty pages have no text; comments, scripts, styles and other raw elements are never text;
unclosed and crossed tags are closed as browsers do; repeated pages and null ids are extracted like any other
row; long pages are cut whole, in one pass over their characters (an unclosed quote ends the meaning of quotes, a < that
nothing closes is text); without seeds of both kinds the classifier leans to content slightly and the markup decides; extra
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.llm.linear import minimise, sigmoid
from lexsieve.plans.scale import spread

#: Pages that the block classifier is trained on at most, chosen by the hash of their id.
TRAIN_PAGES = 1_000

# Element names of HTML and words of class names.
RAW = frozenset("script style noscript template iframe svg annotation annotation-xml object title textarea select canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta mprescripts mspace param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
                   "sub sup time tt u var br wbr img "
                   "math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub "
                   "msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
                     "section table ul".split())
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
               "option": {"option"}, "p": {"p"}}
CONTENT_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset("nav header footer aside form menu dialog button head".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OTHER_WORDS = frozenset("ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr "
                        "notice popup modal overlay newsletter subscribe subscription comment comments reply replies disqus sidebar aside widget "
                        "related recommended share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer header masthead "
                        "login signup pagination pager toolbar copyright legal disclaimer".split())
#: Evidence of a word of OTHER_WORDS, once for all elements above a block; the classifier and neighbours can outvote it.
WORD_EVIDENCE = -2.0
#: Evidence of elements and roles that hold boilerplate, and of hidden elements, which nothing below undoes.
OTHER_EVIDENCE, HIDDEN = -8.0, -16.0
CONTENT_WORDS = frozenset("article content post entry story main".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Element:
    tag: str
    number: int
    depth: int
    evidence: float
    up: "Element | None"  # the element around it
    level: int = 0  # block-level elements from the root to here
    holder: "Element | None" = None  # the nearest block-level element, itself included

    def __post_init__(self) -> None:
        above = self.up.holder if self.up else None
        self.holder = above if self.tag in INLINE and above else self
        self.level = (above.level if above else 0) + (self.holder is self)

    @property
    def around(self) -> "Element | None":
        """The block-level element around the holder."""
        above = self.holder.up
        return above.holder if above else None


def apart(a: Element, b: Element) -> int:
    """Steps between two block-level elements in the tree."""
    steps = 0
    while a is not b:
        if a.level >= b.level:
            a, steps = a.around, steps + 1
        else:
            b, steps = b.around, steps + 1
        if a is None or b is None:
            return steps
    return steps


@dataclass
class Block:
    holder: Element
    evidence: float
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Tags:
    """Tags of a page from left to right, each character looked at a bounded number of times."""

    def __init__(self, page: str) -> None:
        self.page, self.quotes, self.last = page, True, page.rfind(">")

    def _end(self, at: int) -> int:
        """Place of the > that ends a tag; one in quotes does not, unless the page ends before the quote."""
        if self.quotes:
            stop = _STOP.search(self.page, at)
            while stop and stop[0] != ">":
                close = self.page.find(stop[0], stop.end())
                stop = _STOP.search(self.page, close + 1) if close >= 0 else None
            if stop:
                return stop.start()
            self.quotes = False  # an unclosed quote: from here on quotes are plain characters
        return self.page.find(">", at)

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the next tag or comment; the name of anything but elements is empty."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0 or start + 1 >= len(page):
                return None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, False, "", ""
            if start > self.last:
                return None  # nothing ends a tag any more: text
            closing = page[start + 1] == "/"
            name = _NAME.match(page, start + 1 + closing)
            if name:
                end = self._end(name.end())
                return start, end + 1, closing, name[0], page[name.end():end]
            if page[start + 1] in "!?/":
                return start, page.find(">", start) + 1, False, "", ""
            at = start + 1


def evidence_of(tag: str, attributes: str, above: float) -> float:
    """What an element says about the text below it: over 0 content, under 0 boilerplate; boilerplate is inherited.

    <article> and <main> below a form, a wrapper with a role or a name start anew, weaker than elsewhere; only what is hidden
    stays so. A <header> inside content holds its title and says nothing of its own.
    """
    if above <= HIDDEN:
        return above
    own = 3.0 if tag in CONTENT_TAGS else 0.0
    if tag in OTHER_TAGS and not (tag == "header" and above > 0):
        own = OTHER_EVIDENCE
    if attributes and not attributes.isspace():
        told = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        words = {w.lower() for w in _WORDS.findall(told.get("class", "") + " " + told.get("id", ""))}
        style = told.get("style", "").replace(" ", "").lower()
        if "hidden" in told or told.get("aria-hidden") == "true" or "display:none" in style:
            return HIDDEN
        if told.get("role", "").lower() in OTHER_ROLES:
            own = OTHER_EVIDENCE
        elif words & OTHER_WORDS and tag not in ("html", "body", "main") and not (
                words & CONTENT_WORDS and tag in CONTENT_TAGS and not above < 0) and not (tag == "header" and above > 0):
            own = min(own, WORD_EVIDENCE)
        elif (words & CONTENT_WORDS or told.get("role") == "main") and own == 0:
            own = 1.5
    if own == 3.0 and above < 0:
        return 3.0 if tag == "main" and above >= WORD_EVIDENCE else 3.0 + max(above, WORD_EVIDENCE)
    return min(own, above) if own < 0 else own if above >= 0 and own > above else above


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    root = Element("", 0, 0, 0.0, None)
    stack, numbers, blocks, tags = [root], 1, [], Tags(page)
    current: Block | None = None
    opened: Counter[str] = Counter()
    at, n = 0, len(page)

    def add(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if current is None:
            if raw.isspace():
                return
            holder = stack[-1].holder
            near = (holder.tag, holder.around.tag if holder.around else "")
            current = Block(holder, stack[-1].evidence, any(_HEADING.fullmatch(t) for t in near))
            blocks.append(current)
        said = html.unescape(raw)
        current.parts.append(said)
        if opened["a"]:
            current.linked += len(said)

    def leave(to: int) -> None:
        for e in stack[to:]:
            opened[e.tag] -= 1
        del stack[to:]

    while at < n:
        found = tags.after(at)
        if found is None:
            add(page[at:])
            break
        start, end, close, tag, attributes = found
        add(page[at:start])
        at = end
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            current = None
        if close:
            if opened[tag]:  # what lies above it is closed as well
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                leave(k)
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                over = re.compile(rf"</{tag}\b", re.I).search(page, at)
                end = page.find(">", over.end()) if over else -1
                at = end + 1 if end >= 0 else n
            continue
        shut = CLOSES_SAME.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        if any(opened[t] for t in shut):
            holder = stack[-1].holder
            while holder is not None and holder is not root:
                if holder.tag in shut:
                    leave(holder.depth)
                    break
                if holder.tag not in ("td", "th"):
                    break
                holder = holder.around
        if tag not in VOID:
            above = stack[-1]
            stack.append(Element(tag, numbers, len(stack), evidence_of(tag, attributes, above.evidence), above))
            opened[tag] += 1
            numbers += 1
    return [b for b in blocks if b.text()]


_HEADING = re.compile("h[1-6]")
FEATURES = 8


def features_of(blocks: list[Block], texts: list[str]) -> np.ndarray:
    """Text features of the blocks of one page; no markup that serves as evidence."""
    n = len(blocks)
    out = np.empty((n, FEATURES))
    for i, (block, text) in enumerate(zip(blocks, texts, strict=True)):
        chars = len(text)
        out[i] = (1.0, np.log1p(chars), min(block.linked / chars, 1.0), sum(map(text.count, ".!?,;:")) * 10 / (chars + 10),
                  float(chars < 40), float(block.heading), i / n, float(text[-1] in ".!?\"'"))
    return out


def neutral() -> np.ndarray:
    """What untrained (zero) weights stand for: the same slight lean to content for every block, so that the markup decides."""
    return np.where(np.arange(FEATURES) == 0, 0.1, 0.0)


def train_blocks(pages: DataFrame, *, key: str = "page_id", page: str = "html", max_pages: int = TRAIN_PAGES) -> np.ndarray:
    """Weights of the block classifier, from the seeds of a bounded sample of pages."""
    known = pages.where(F.col(key).isNotNull())
    chosen = known.select(key).distinct().orderBy(F.xxhash64(key), key).limit(max_pages)  # bounded by the parameter
    sample = spread(known.select(F.col(key), F.col(page).alias("page")), key).join(F.broadcast(chosen), key).select("page")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                blocks = blocks_of(text or "")
                rows = features_of(blocks, [b.text() for b in blocks])
                told = np.array([b.evidence for b in blocks])
                # each page tells the mean of its seeds, so long pages do not outvote the others
                # names of classes are seeds only beside content that no name is above
                most = WORD_EVIDENCE if (told >= 3).any() else -3
                for label in (0, 1):
                    own = rows[told <= most] if label == 0 else rows[told >= 3]
                    if len(own):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([label]), pa.array([own[np.linspace(0, len(own) - 1, min(len(own), 16)).astype(int)].reshape(-1)])], ["y", "x"])

    table = sample.mapInArrow(seeds, "y long, x array<double>").toArrow()
    found = [(y, np.array(x).reshape(-1, FEATURES)) for y, x in zip(table["y"].to_pylist(), table["x"].to_pylist(), strict=True)]
    if len({y for y, _ in found}) < 2:
        return np.zeros(FEATURES)
    x = np.concatenate([r for _, r in found])
    y = np.concatenate([np.full(len(r), float(k)) for k, r in found])
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w
        return float(weight @ np.logaddexp(0, np.where(y == 1, -z, z)) + 1e-3 * (w @ w)), x.T @ (weight * (sigmoid(z) - y)) + 2e-3 * w

    order = np.lexsort(x.T)  # the sum must not depend on the order of tasks
    x, y, weight = x[order], y[order], weight[order]
    return minimise(loss, np.zeros(FEATURES), 200)


def minimum_cut(content: np.ndarray, other: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Which nodes lie on the content side of the minimum cut.

    content[i] is paid if node i is not content, other[i] if it is, an edge's weight if its ends differ. Dinic's
    algorithm, after the flow that runs straight through each node.
    """
    n = len(content)
    both = np.minimum(content, other)
    source, sink = (content - both).tolist(), (other - both).tolist()
    near: list[list[int]] = [[] for _ in range(n)]
    head, room = [], []
    for a, b, weight in edges:
        near[a].append(len(head)), head.append(b), room.append(weight)
        near[b].append(len(head)), head.append(a), room.append(weight)
    while True:
        level, frontier = [-1] * n, [i for i in range(n) if source[i] > 1e-9]
        for i in frontier:
            level[i] = 0
        reached = any(sink[i] > 1e-9 for i in frontier)
        while frontier and not reached:
            ahead = []
            for i in frontier:
                for e in near[i]:
                    if room[e] > 1e-9 and level[head[e]] < 0:
                        level[head[e]] = level[i] + 1
                        ahead.append(head[e])
            frontier = ahead
            reached = any(sink[i] > 1e-9 for i in frontier)
        if not reached:
            return np.array([v >= 0 for v in level])
        place = [0] * n
        for start in range(n):
            while level[start] == 0 and source[start] > 1e-9:
                path, i = [], start
                while sink[i] <= 1e-9:
                    while place[i] < len(near[i]):
                        e = near[i][place[i]]
                        if room[e] > 1e-9 and level[head[e]] == level[i] + 1:
                            break
                        place[i] += 1
                    if place[i] < len(near[i]):
                        path.append(near[i][place[i]])
                        i = head[path[-1]]
                    elif path:
                        i = head[path.pop() ^ 1]
                        place[i] += 1
                    else:
                        break
                if sink[i] <= 1e-9:
                    break
                flow = min([source[start], sink[i], *(room[e] for e in path)])
                source[start] -= flow
                sink[i] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def main_text(page: str, weights: np.ndarray, order: float = 0.4, kin: float = 0.8) -> str:
    """The content blocks of a page, joined by an empty line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    texts = [b.text() for b in blocks]
    told = np.array([b.evidence for b in blocks])
    chance = sigmoid(features_of(blocks, texts) @ (weights if weights.any() else neutral()) + 2.0 * told)
    edges, last_child = [], {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, order / (1 + apart(blocks[i - 1].holder, block.holder))))
        holder = block.holder.around.number if block.holder.around else -1
        if holder in last_child:
            edges.append((last_child[holder], i, kin / 2))
        last_child[holder] = i
    keep = minimum_cut(-np.log(np.maximum(1 - chance, 1e-12)), -np.log(np.maximum(chance, 1e-12)), edges)
    return "\n\n".join(t for t, k in zip(texts, keep, strict=True) if k)


def extract_text(pages: DataFrame, weights: np.ndarray, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "", weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("page"))
    return spread(rows, "page_id").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
