"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into blocks: runs of text between block-level tags, each with what encloses it. A logistic classifier,
fitted here on generated pages whose blocks are labelled (``html_pages``), gives each block its log odds for main text:
the capacity of its edge to one terminal or the other. Smoothness edges, which cost when their ends differ, join
neighbours in page order, weaker the more elements lie between them in the tree, and blocks of one element or of
sibling elements; across the border of an aside, notice or the like they are weak. The minimum cut is the cheapest labelling; blocks on the source side are the main text. So a short line
between paragraphs follows them, and a long teaser between menus follows those. Blocks whose own capacity is at least
that of all their other edges keep their side in a minimum cut and are settled beforehand; the flow runs over the rest.

Names of classes and ids that tell of menus, adverts, notices and the like count for what they enclose, but not for an
``article`` or ``main`` inside them, nor for the holder of the page's heading and most of its text: themes put such
names on wrappers of whole pages. In a name of other words too (``market-share``) they are no more than a hint, which counts
against short and linked blocks. Readers' comments are also told by their build: like parts, each with a short line of a date or
time and more below it. Names of reader comments, and nav, aside and footer elements, count for all they
enclose. Only text inside script, style, title, textarea, select, template, iframe and the like is no block at all.
Character references are decoded, white space inside a block becomes one space, empty blocks vanish, and blocks are
joined by one line feed. Nothing else is dropped. Malformed pages are read in one pass: every step is linear in the
page, up to the flow among unsettled blocks.

Null and empty pages, and pages without main text, give an empty text. Repeated rows are treated alike, null ids kept,
an empty table gives no rows; other columns are passed over, whatever their names. The work is per page inside
``mapInArrow``: no shuffle, memory of one slice of pages.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_pages
from ._text import slices

#: Elements of HTML by role; fixed values of the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe noembed noframes select xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table"
    " tbody td tfoot th thead title tr ul".split()
)
#: A start tag of the first kind ends an open element of the second, up to the nearest of the third.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that hold no main text whatever encloses it; those that do so up to an article; those that frame main text.
ASIDE = frozenset("nav footer aside menu button search".split())
NOTICE = frozenset("form header dialog fieldset label noscript".split())
FRAME = frozenset("article main".split())
_END = re.compile(r">|=\s*+([\"'])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.IGNORECASE)
#: Words of names; a name that begins with a qualifier tells of the page, not of the element.
_QUALIFIED = re.compile(r"(?:no|not|non|has|have|with|without|is|can|show|hide|open|closed|js)(?![a-z])", re.IGNORECASE)
_JUNK = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|banner|breadcrumbs?|byline|cookies?|consent|copyright|disclaimer|footer|foot|gdpr|header"
    r"|login|masthead|menu\w*|modal|nav\w*|newsletter|notices?|notification|pager|pagination|popup|promo\w*|recommend\w*|related"
    r"|search|share\w*|sharing|sidebar|signup|social|sponsor\w*|subscribe|tags|toolbar|widget\w*)(?![a-z])",
    re.IGNORECASE,
)
_COMMENT = re.compile(r"(?<![a-z])(?:comments?|commentlist|disqus|replies|reply|respond|discussion)(?![a-z])", re.IGNORECASE)
_BODY = re.compile(r"(?<![a-z])(?:article|body|content|entry|main|post|story|text)(?![a-z])", re.IGNORECASE)
#: Words that say where or what kind of element a name's other words are of, and nothing of what it holds.
_PLACE = frozenset(
    "area bar block bottom box btn button buttons center col column container fixed group holder inner item items left link links list"
    " mobile module outer page panel primary right row secondary section site sticky sub top unit widget wrap wrapper".split()
)
_HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_LETTERS = re.compile(r"[^a-z]+")
_MARKS = re.compile(r"[.!?,;:]")
#: A line that says when: a year, a date, a time of day, so long ago. SIGNED: length up to which it heads an item; LEVELS: how far up.
_WHEN = re.compile(r"\b(?:19|20)\d\d\b|\b\d{1,2}[:.]\d\d\b|\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|\b\d+\s+\w+\s+ago\b")
SIGNED, LEVELS = 90, 4
#: Capacities of smoothness edges: neighbours in page order, by DECAY for each element more than siblings have between
#: them; blocks of one element; blocks of sibling elements. BORDER: what is left of them where one end is inside an
#: aside, notice, comment or hidden element and the other is not.
NEXT, DECAY, SIBLING, COUSIN, BORDER = 1.2, 0.45, 0.6, 0.2, 0.2
FEATURES = ("bias", "frame", "aside", "notice", "comment", "hidden", "named", "linked", "long", "marks", "heading", "outside", "hint", "hint_linked", "hint_long", "thread")


@dataclass(slots=True)
class Element:
    tag: str
    number: int
    #: Block-level elements around it, itself included; numbers of the two innermost.
    depth: int
    parent: int
    grandparent: int
    aside: bool = False
    #: Number of the innermost element that names a notice, 0: none.
    notice: int = 0
    comment: bool = False
    frame: bool = False
    named: bool = False
    hidden: bool = False
    heading: bool = False
    hint: bool = False
    #: The block-level element around it.
    above: Element | None = None


def told(word: str) -> tuple[bool, bool, bool, bool]:
    """What a class or id says: a notice or the like, reader comments, main text, and a hint of a notice.

    Words of notices tell of one where the name has none but them, words of places and of main text (``cookie-notice``,
    ``post-share-buttons``). Beside any other word they may be the subject (``market-share``, ``copyright-law``), and beside a
    word of main text a header may hold the title, so then they are a hint, which counts with what the block is like.
    """
    if _QUALIFIED.match(word):
        return False, False, False, False
    parts = [part for part in _LETTERS.split(word.lower()) if len(part) > 1]
    junk = [_JUNK.fullmatch(part) is not None for part in parts]
    comment, body = any(map(_COMMENT.fullmatch, parts)), any(map(_BODY.fullmatch, parts))
    if not any(junk):
        return False, comment, body, False
    alone = all(j or part in _PLACE or _COMMENT.fullmatch(part) or (_BODY.fullmatch(part) and part != "text") for part, j in zip(parts, junk, strict=True))
    titled = body and parts[-1] in ("header", "head")
    return alone and not titled, comment, False, not alone or titled


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    at: Element
    #: Elements between the block before and this one.
    apart: int
    odds: float = 0.0


class _Reader:
    """Blocks of one page, from its tags in order. Each step is of constant cost but for what it takes off the stack."""

    def __init__(self) -> None:
        self.stack = [Element("", 0, 0, 0, 0)]
        self.places: dict[str, list[int]] = {}
        self.inner = [0]
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.made = self.linked = 0
        self.from_depth = self.low = 0
        self.headed: set[int] = set()

    def end_block(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                at = self.stack[-1]
                self.blocks.append(Block(text, self.linked, at, self.from_depth + at.depth - 2 * min(self.low, at.depth)))
                self.from_depth = self.low = at.depth
                if at.heading and at.notice:
                    self.headed.add(at.notice)
            self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            self.parts.append(plain)
            if self.places.get("a"):
                self.linked += len(plain.strip())

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def drop(self, k: int) -> None:
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.inner.pop()
        self.low = min(self.low, self.stack[-1].depth)

    def start(self, tag: str, rest: str) -> None:
        block = tag in BLOCK
        if block:
            self.end_block()
            if (k := self.inner[-1]) and self.stack[k].tag == "p":
                self.drop(k)
            if tag in ENDS:
                closes, upto = ENDS[tag]
                if (k := self.last(closes)) > self.last(upto):
                    self.drop(k)
        elif tag == "br":
            self.parts.append("\n")
        if tag in VOID:
            return
        above = self.stack[-1]
        self.made += 1
        named = junk = comment = hidden = hint = False
        if rest and not rest.isspace():
            for name, value in _NAMES.findall(rest):
                name, value = name.lower(), value.strip("\"'").replace("_", "-")
                if name in ("class", "id", "role"):
                    for word in value.split():
                        of = told(word)
                        junk, comment, named, hint = junk | of[0], comment | of[1], named | of[2], hint | of[3]
                elif name == "style":
                    hidden |= _HIDDEN.search(value) is not None
                else:
                    hidden |= name == "hidden" or value.lower() == "true"
        frame = tag in FRAME
        whole = tag in ("html", "body")
        named &= not (junk or comment or hint)
        notice = self.made if (junk and not whole and not frame) or (tag in NOTICE and not (tag == "header" and above.frame)) else 0 if frame else above.notice
        clean = not notice and not (above.aside or tag in ASIDE) and not (above.comment or comment and not whole)
        element = Element(
            tag,
            self.made,
            above.depth + block,
            self.made if block else above.parent,
            above.parent if block else above.grandparent,
            above.aside or tag in ASIDE,
            notice,
            above.comment or comment and not whole,
            clean and (above.frame or frame),
            clean and (above.named or named),
            above.hidden or hidden,
            above.heading or tag in HEADINGS,
            not frame and (above.hint or hint and not whole),
            above if above.tag in BLOCK else above.above,
        )
        self.places.setdefault(tag, []).append(len(self.stack))
        if block:
            self.inner.append(len(self.stack))
        self.stack.append(element)

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_block()
        k = self.last((tag,))
        if k and (tag in BLOCK or k > self.inner[-1]):
            self.drop(k)


def _tag_end(page: str, at: int, closed: dict[str, bool]) -> int:
    """Where the tag whose name ends at ``at`` ends. Quotes of attribute values hide a ``>``, if they are closed."""
    while (found := _END.search(page, at)) is not None:
        at = found.end()
        quote = found[1]
        if quote is None:
            return at
        if closed.get(quote, True):
            end = page.find(quote, at)
            closed[quote] = end >= 0
            at = end + 1 if end >= 0 else at
    return len(page)


def blocks(page: str) -> tuple[list[Block], set[int]]:
    """Text blocks of a page in order, and the elements named as notices that hold a heading."""
    reader, at, closed = _Reader(), 0, {}
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            reader.text(page[at:])
            break
        follows = page[begin + 1 : begin + 3]
        if not follows or not (follows[0] in "!?/" or follows[0].isascii() and follows[0].isalpha()):
            reader.text(page[at : begin + 1])
            at = begin + 1
            continue
        reader.text(page[at:begin])
        if follows[0] in "!?" or follows[0] == "/" and not (follows[1:].isascii() and follows[1:].isalpha()):
            stop = "-->" if page.startswith("<!--", begin) else ">"
            end = page.find(stop, begin + 2)
            at = end + len(stop) if end >= 0 else len(page)
            continue
        name = _NAME.match(page, begin + 1 + (follows[0] == "/"))
        at = _tag_end(page, name.end(), closed)
        tag, rest = name[0].lower(), page[name.end() : at - 1]
        if follows[0] == "/":
            reader.end(tag)
        elif tag in RAW and not rest.endswith("/"):
            if tag in BLOCK:
                reader.end_block()
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else len(page)
        else:
            reader.start(tag, rest)
    reader.end_block()
    return reader.blocks, reader.headed


def _around(at: Element) -> Iterator[Element]:
    """Block-level elements around a block, from the inside, ``LEVELS`` of them."""
    element = at if at.tag in BLOCK else at.above
    for _ in range(LEVELS):
        if element is None or not element.number:
            return
        yield element
        element = element.above


def threads(found: list[Block]) -> list[bool]:
    """Which blocks belong to a thread: an element of two and more like parts, most of which say shortly who wrote when and go on
    with other blocks; and the heading before it. So readers' comments are known whatever their names."""
    blocks_of: dict[int, int] = {}
    parts: dict[int, dict[int, str]] = {}
    signed: dict[int, set[int]] = {}
    for block in found:
        dated = len(block.text) <= SIGNED and _WHEN.search(block.text) is not None
        chain = list(_around(block.at))
        for part in chain:
            blocks_of[part.number] = blocks_of.get(part.number, 0) + 1
            if part.above is not None:
                parts.setdefault(part.above.number, {})[part.number] = part.tag
                if dated:
                    signed.setdefault(part.above.number, set()).add(part.number)
    holders = set()
    for holder, items in signed.items():
        items = {k for k in items if blocks_of[k] > 1}
        tags = {parts[holder][k] for k in items}
        if len(items) > 1 and len(tags) == 1 and 3 * len(items) > 2 * sum(t in tags for t in parts[holder].values()):
            holders.add((holder, tags.pop()))
    inside = [any(part.above is not None and (part.above.number, part.tag) in holders for part in _around(block.at)) for block in found] if holders else [False] * len(found)
    return [own or (block.at.heading and k + 1 < len(found) and inside[k + 1]) for k, (own, block) in enumerate(zip(inside, found, strict=True))]


def features(found: list[Block], headed: set[int]) -> np.ndarray:
    """A row of ``FEATURES`` for each block; length and punctuation speak only where no enclosing element does."""
    total, under, framed = 0, {}, False
    for block in found:
        at = block.at
        framed |= at.frame and not at.hidden
        if not (at.aside or at.comment or at.hidden):
            total += len(block.text)
            under[at.notice] = under.get(at.notice, 0) + len(block.text)
    wrapper = {k for k in headed if 2 * under.get(k, 0) > total}
    rows = []
    for block, thread in zip(found, threads(found), strict=True):
        at, size = block.at, len(block.text)
        notice = at.notice > 0 and at.notice not in wrapper
        linked, plain = min(block.linked / size, 1.0) * (not at.frame), not (at.aside or notice or at.comment or at.hidden)
        marked = plain and _MARKS.search(block.text) is not None
        hint = at.hint and plain
        hinted = (hint, hint * min(block.linked / size, 1.0), hint * min(size / 100, 1.0))
        rows.append((1.0, at.frame, at.aside, notice, at.comment, at.hidden, at.named, linked, plain * min(size / 200, 1.0), marked, at.heading, framed and not at.frame, *hinted, thread))
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


def fit(pages: list[tuple[str, list[str]]], penalty: float = 1.0) -> np.ndarray:
    """Weights of ``FEATURES`` (log odds for main text) from pages with the texts of their main blocks, by ridge-penalised
    logistic regression with Newton steps."""
    x, y = [], []
    for page, main in pages:
        found, headed = blocks(page)
        x.append(features(found, headed))
        wanted = set(main)
        y += [block.text in wanted for block in found]
    x, y = np.concatenate(x), np.array(y, np.float64)
    weights, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - penalty * weights)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return weights


@lru_cache(maxsize=4)
def default_weights(pages: int = 300, seed: int = 1) -> tuple[float, ...]:
    """Weights fitted to ``pages`` generated pages."""
    return tuple(fit(html_pages.labelled_pages(pages, seed)).tolist())


class FlowGraph:
    """Maximum flow by shortest augmenting paths in levels (Dinic), without recursion."""

    def __init__(self, n: int):
        self.edges: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def add(self, u: int, v: int, forth: float, back: float = 0.0) -> None:
        for a, b, room in ((u, v, forth), (v, u, back)):
            self.edges[a].append(len(self.to))
            self.to.append(b)
            self.room.append(room)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in self.edges[u]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Push the maximum flow; which nodes the source still reaches."""
        while (level := self.levels(source))[sink] >= 0:
            turn, path, u = [0] * len(self.edges), [], source
            while True:
                if u == sink:
                    least = min(self.room[e] for e in path)
                    cut = len(path)
                    for k, e in enumerate(path):
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                        if self.room[e] <= 1e-9 and k < cut:
                            cut = k
                    u = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                own = self.edges[u]
                while turn[u] < len(own) and not (self.room[own[turn[u]]] > 1e-9 and level[self.to[own[turn[u]]]] == level[u] + 1):
                    turn[u] += 1
                if turn[u] < len(own):
                    path.append(own[turn[u]])
                    u = self.to[path[-1]]
                elif path:
                    level[u] = -1
                    u = self.to[path.pop() ^ 1]
                else:
                    break
        return [x >= 0 for x in level]


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks and their capacities."""
    edges: list[tuple[int, int, float]] = []
    parents: dict[int, int] = {}
    above: dict[int, int] = {}
    inside = [(b.at.aside, b.at.notice, b.at.comment, b.at.hidden) for b in found]

    def join(near: int, k: int, weight: float) -> None:
        edges.append((near, k, weight if inside[near] == inside[k] else BORDER * weight))

    for k, block in enumerate(found):
        if k:
            join(k - 1, k, NEXT * DECAY ** max(block.apart - 2, 0))
        if (near := parents.get(block.at.parent)) is not None:
            join(near, k, SIBLING)
        elif (near := above.get(block.at.grandparent)) is not None:
            join(near, k, COUSIN)
        parents[block.at.parent] = above[block.at.grandparent] = k
    return edges


def cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes a minimum cut leaves on the source side."""
    n, odds = len(odds), list(odds)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for u, v, w in edges:
        around[u][v] = around[u].get(v, 0.0) + w
        around[v][u] = around[v].get(u, 0.0) + w
    pull = [sum(a.values()) for a in around]
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if side[k] is not None or abs(odds[k]) < pull[k] or odds[k] == 0:
            continue
        side[k] = odds[k] > 0
        for v, w in around[k].items():
            if side[v] is None:
                odds[v] += w if side[k] else -w
                pull[v] -= w
                queue.append(v)
    left = [k for k in range(n) if side[k] is None]
    if left:
        number = {k: i for i, k in enumerate(left)}
        graph, source = FlowGraph(len(left) + 2), len(left)
        for i, k in enumerate(left):
            graph.add(source, i, max(odds[k], 0.0))
            graph.add(i, source + 1, max(-odds[k], 0.0))
            for v, w in around[k].items():
                if v > k and side[v] is None:
                    graph.add(i, number[v], w, w)
        reached = graph.source_side(source, source + 1)
        for i, k in enumerate(left):
            side[k] = reached[i]
    return side


def main_text(page: str | None, weights: tuple[float, ...] | None = None) -> str:
    """Main text of a page."""
    found, headed = blocks(page or "")
    if not found:
        return ""
    odds = features(found, headed) @ np.array(default_weights() if weights is None else weights)
    side = cut(odds.tolist(), smoothness(found))
    return "\n".join(block.text for block, kept in zip(found, side, strict=True) if kept)


def _extract(weights: tuple[float, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            texts = [main_text(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", weights: tuple[float, ...] | None = None) -> DataFrame:
    """``id_column``, ``url_column``, ``text`` and ``n_chars`` (code points of ``text``) for every row.

    ``weights``: of a classifier by ``fit``; by default of the one for generated pages.
    """
    chosen = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    kind = chosen.schema["id"].dataType.simpleString()
    out = chosen.mapInArrow(partial(_extract, default_weights() if weights is None else weights), f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_column, "url": url_column})
