"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A classifier gives each block a log-odds of being content; that
cost is the capacity of its edge from the source (content) or to the sink (boilerplate). Blocks
that follow each other, and blocks that share a parent or grandparent in the page's tree, are
joined by edges that cost something to cut. The minimum cut, found by augmenting paths, is the
labelling of least total cost; the blocks on the source's side are the main text.

The classifier is a logistic model of the text (length, links, marks, kind of element) and of the
words in class and id of the elements around it, to which the landmark elements and roles around
the block add their costs. The model is fitted on a bounded sample of the pages at hand, at most
``SAMPLE_PAGES`` pages of at most ``SAMPLE_CHARS`` characters, chosen by a hash of their ids, where
the blocks that lie in a landmark give the labels; it is held close to fixed weights, which remain
where the sample teaches nothing.

No single word decides. A name such as has-sidebar or comments-open says nothing about what the
element holds; names that speak for and against content cancel out; and what looks like
boilerplate but holds most of the page's text, while no article, main part or content lies outside
it, is taken for a frame around the page.

Defined results: null or empty html, and pages without content, give an empty text. Broken markup
is read as far as it goes, in time that grows with the page's length: an unclosed comment, script
or style hides the rest, a quote that is never closed ends with its tag. Rows that repeat get
equal results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.util import bound_batches, in_hash_sample, strings

SAMPLE_PAGES, SAMPLE_CHARS = 200, 100_000
#: Costs of cutting between successive blocks and between blocks with one parent or grandparent.
NEXT, PARENT, GRANDPARENT = 1.0, 0.8, 0.3
#: The log-odds of the text alone lie within this.
TEXT_LIMIT = 3.5

# Elements and words of the markup.
HIDDEN = frozenset("script style template noscript iframe object svg math canvas textarea select button head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body p div li ul ol dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr caption section article nav footer header aside main form "
    "fieldset blockquote pre figure figcaption hr address details summary dialog menu center".split()
)
CLOSES_P = BLOCKS - {"html", "body"}
LANDMARKS = {"article": 3.0, "main": 2.5, "header": -4.0, "nav": -4.0, "footer": -4.0, "aside": -4.0, "form": -4.0, "dialog": -4.0, "menu": -4.0}
ROLES = {"main": 2.5, "article": 3.0, "navigation": -4.0, "banner": -4.0, "contentinfo": -4.0, "complementary": -4.0, "search": -4.0, "dialog": -4.0, "alert": -4.0, "alertdialog": -4.0}
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter "
    "subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs sidebar widget related recommended recommendations share sharing social footer "
    "header masthead comment comments disqus reply replies respond login search pagination pager toolbar copyright disclaimer alert".split()
)
GOOD_WORDS = frozenset("article content post entry story main text body".split())
STATE_FIRST = frozenset("has have no not with without is are show hide supports enable disable can".split())
STATE_LAST = frozenset("open opened closed enabled disabled active inactive on off loaded visible ready allowed status".split())
HIDDEN_COST = -8.0

_NAME = re.compile(r"[^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARKS = re.compile(r"[.,;:!?]")


@dataclass
class Block:
    """A run of text between two borders of block elements."""

    text: str
    tag: str
    place: int  # the innermost element around it
    box: int  # the innermost block element around it
    linked: int  # characters inside links
    land: float = 0.0  # log-odds from the landmarks around it
    bad: float = 0.0  # marks of boilerplate around it
    good: float = 0.0  # marks of content around it


@dataclass
class Tree:
    """The elements of a page, each after the one that holds it; the first one is the page itself."""

    tag: list[str] = field(default_factory=lambda: [""])
    up: list[int] = field(default_factory=lambda: [0])
    box_up: list[int] = field(default_factory=lambda: [0])  # the block element around a block element
    depth: list[int] = field(default_factory=lambda: [0])  # in block elements
    land: list[float] = field(default_factory=lambda: [0.0])
    bad: list[float] = field(default_factory=lambda: [0.0])
    good: list[float] = field(default_factory=lambda: [0.0])

    def add(self, tag: str, up: int, box_up: int, depth: int, marks: tuple[float, float, float]) -> int:
        for column, value in zip((self.tag, self.up, self.box_up, self.depth, self.land, self.bad, self.good), (tag, up, box_up, depth, *marks), strict=True):
            column.append(value)
        return len(self.up) - 1

    def steps(self, x: int, y: int) -> int:
        """Steps between two block elements of the tree."""
        n = 0
        while x != y:
            if self.depth[x] >= self.depth[y]:
                x = self.box_up[x]
            else:
                y = self.box_up[y]
            n += 1
        return n


def _name_marks(value: str, tag: str) -> tuple[bool, bool]:
    """Whether names in a class or id speak for boilerplate, and for content; the element's own name says nothing new."""
    bad = good = False
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if len(words) > 1 and (words[0] in STATE_FIRST or words[-1] in STATE_LAST):
            continue
        is_bad, is_good = [w for w in words if w in BAD_WORDS and w != tag], any(w in GOOD_WORDS for w in words)
        if is_bad and is_good and set(is_bad) == {"header"}:
            continue  # the head of an article holds its title
        bad |= bool(is_bad)
        good |= is_good and not is_bad
    return bad, good


def _marks(tag: str, attributes: str) -> tuple[float, float, float]:
    """(land, bad, good) of an element by itself."""
    land, bad, good = LANDMARKS.get(tag, 0.0), False, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            land = ROLES.get(value.lower(), land)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return HIDDEN_COST, 0.0, 0.0
        elif name in ("class", "id") and tag not in ("html", "body", "main"):
            b, g = _name_marks(value, tag)
            bad, good = bad or b, good or g
    if bad and good:
        return land, 0.5, 0.0
    if bad and land > 0:  # a reader's comment may be an article of its own
        land = 0.0
    return land, float(bad), float(good)


def _tags(html: str) -> Iterator[tuple[str, bool, str, str, bool, int]]:
    """(text before, closing, name, attributes, closed in itself, end) of each tag; comments and the page's end have no name.

    Send a place to go on from there. Every search remembers what it found, so the page is read
    in one go however broken it is.
    """
    at, n = 0, len(html)
    ahead = {">": -1, '"': -1, "'": -1, "-->": -1}

    def find(what: str, start: int) -> int:
        if ahead[what] < start:
            found = html.find(what, start)
            ahead[what] = found if found >= 0 else n
        return ahead[what]

    run = 0  # where the text before the next tag starts
    while True:
        lt = html.find("<", at)
        if lt < 0:
            yield html[run:], False, "", "", False, n
            return
        after = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            end = min(n, find("-->", lt + 4) + 3)
            step = yield html[run:lt], False, "", "", False, end
        elif after in ("!", "?"):
            end = min(n, find(">", lt) + 1)
            step = yield html[run:lt], False, "", "", False, end
        elif "a" <= after.lower() <= "z" or (after == "/" and "a" <= html[lt + 2 : lt + 3].lower() <= "z"):
            start = lt + 1 + (after == "/")
            name = _NAME.match(html, start)
            close = name.end()
            while True:
                close = _PLAIN.match(html, close).end()
                if close >= n or html[close] == ">":
                    break
                quote = html[close]
                end = find(quote, close + 1)
                good = end < n and html[end - 1] != "=" and (html[end + 1 : end + 2] in ("", ">", "/") or html[end + 1].isspace())
                if good or (end < n and end < find(">", close)):
                    close = end + 1
                else:  # never closed: the tag ends at its first bracket
                    close = find(">", close)
                    break
            if close >= n:
                if find(">", lt) >= n:  # no tag any more
                    yield html[run:lt], False, "", "", False, n
                    return
                close = find(">", lt)
            attributes = html[name.end() : close]
            step = yield html[run:lt], after == "/", name[0].lower(), attributes, attributes.endswith("/"), close + 1
            end = close + 1
        else:
            at = lt + 1
            continue
        run = at = max(end, step or 0)
        if step:
            yield "", False, "", "", False, at


def blocks(html: str) -> list[Block]:
    """The text blocks of a page, in page order, with the costs of what lies around them."""
    return parse(html)[0]


def parse(html: str) -> tuple[list[Block], Tree]:
    """The text blocks of a page in page order, and its elements."""
    out: list[Block] = []
    tree = Tree()
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # name, element, block element
    open_: dict[str, list[int]] = {}  # places in the stack by name
    text: list[str] = []
    links = linked = 0

    def close_block() -> None:
        nonlocal linked
        if text:
            value = " ".join(unescape("".join(text)).split())
            text.clear()
            if value:
                _, place, box = stack[-1]
                out.append(Block(value, tree.tag[box], place, box, min(linked, len(value))))
        linked = 0

    def pop_to(place: int) -> None:
        nonlocal links
        while len(stack) > place:
            tag = stack.pop()[0]
            open_[tag].pop()
            links -= tag == "a"

    def find(tags: Iterable[str], border: Iterable[str] = ()) -> int:
        last = lambda some: max((open_[t][-1] for t in some if open_.get(t)), default=0)
        found = last(tags)
        return found if found > last(border) else 0

    reader = _tags(html)
    item = next(reader)
    while True:
        run, closing, tag, attributes, closed, end = item
        skip = None
        if run:
            text.append(run)
            if links:
                linked += len(run)
        block = tag in BLOCKS
        if not tag:
            pass
        elif closing:
            if block:
                close_block()
            elif tag in ("td", "th"):
                text.append(" ")
            if place := find((tag,)):
                pop_to(place)
        else:
            if tag == "br" or tag in ("td", "th", "img", "option"):
                text.append(" ")
            if tag in HIDDEN and not closed:
                body = re.compile(r"</head\s*>|(?=<body\b)" if tag == "head" else rf"</{tag}\b[^>]*>", re.I).search(html, end)
                skip = body.end() if body else len(html)
            else:
                if block:
                    close_block()
                    if tag in CLOSES_P and (place := find(("p",), ("td", "th", "button"))):
                        pop_to(place)
                    if tag == "li" and (place := find(("li",), ("ul", "ol", "menu"))) or tag in ("dt", "dd") and (place := find(("dt", "dd"), ("dl",))) or tag == "tr" and (place := find(("tr",), ("table",))):
                        pop_to(place)
                if tag not in VOID and not closed:
                    links += tag == "a"
                    _, up, box = stack[-1]
                    number = tree.add(tag, up, box, tree.depth[box] + block, _marks(tag, attributes))
                    open_.setdefault(tag, []).append(len(stack))
                    stack.append((tag, number, number if block else box))
        try:
            item = reader.send(skip) if skip is not None else next(reader)
        except StopIteration:
            break
    close_block()
    _weigh(out, tree)
    return out, tree


def _weigh(found: list[Block], tree: Tree) -> None:
    """Set the costs of what lies around each block.

    Costs add up on the way down. A part that speaks against content ends what an article around
    it says; an article in such a part counts by half. Frames around the page cost nothing.
    """
    n = len(tree.up)
    frame = _frames(found, tree)
    land, bad, good = [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(1, n):
        up, own, marks = tree.up[i], tree.land[i], tree.bad[i]
        if frame[i]:
            own, marks = max(own, 0.0), 0.0
        outer, bad[i], good[i] = land[up], bad[up] + marks, max(good[up], tree.good[i])
        if tree.tag[i] == "header" and outer > 0 and not marks:
            own = max(own, 0.0)  # the head of an article
        if own < 0 or marks:
            outer, good[i] = min(outer, 0.0), 0.0
        if own > 0:
            outer = max(outer, own) if outer >= 0 and not bad[i] else outer + own / 2
        land[i] = outer + min(own, 0.0)
    for b in found:
        b.land, b.bad, b.good = land[b.place], min(bad[b.place], 3.0), good[b.place]


def _frames(found: list[Block], tree: Tree) -> list[bool]:
    """Which elements are frames around the page, told by what they hold, however long it is.

    An element whose names speak against content is one if it holds the page's headline (its first h1,
    or else h2, outside of landmarks) and all that speaks for content, such as an article; where names of
    both kinds meet in one element, the headline is enough. Any element,
    landmarks too, is one if all of the page is in it: boilerplate of its own, an h1 or h2, and paragraphs.
    """
    n = len(tree.up)
    against = [tree.land[i] < 0 or tree.bad[i] > 0 for i in range(n)]
    speaks, inside = [False] * n, [False] * n  # for content; in a landmark that speaks against it
    for i in range(1, n):
        own = tree.land[i] > 0 and not tree.bad[i] or tree.land[i] >= 0 and tree.good[i] > 0
        speaks[i] = own or speaks[tree.up[i]] and not against[i]
        inside[i] = tree.land[i] < 0 or inside[tree.up[i]]
    whole, fine, heads, paragraphs, boilerplate, top = ([0] * n for _ in range(6))
    first: tuple[str, int] | None = None
    for b in found:
        size, heading = len(b.text), b.tag in ("h1", "h2")
        whole[b.place] += size
        fine[b.place] += size * speaks[b.place]
        heads[b.place] += heading
        paragraphs[b.place] += b.tag == "p"
        boilerplate[b.place] += 2 * b.linked > size
        if heading and not inside[b.place] and (first is None or b.tag < first[0]):
            first = (b.tag, b.place)
    if first:
        top[first[1]] = 1
    for i in range(n - 1, 0, -1):
        for column in (whole, fine, heads, paragraphs, boilerplate, top):
            column[tree.up[i]] += column[i]
        boilerplate[tree.up[i]] += against[i]
    return [
        against[i]
        and tree.land[i] > HIDDEN_COST
        and ((tree.land[i] >= 0 and top[i] > 0 and fine[i] == fine[0] and (fine[i] > 0 or tree.bad[i] < 1)) or (whole[i] == whole[0] and heads[i] > 0 and paragraphs[i] > 0 and boilerplate[i] > 0))
        for i in range(n)
    ]


#: Weights where nothing is learned: bias, words, linked share, marks a word, heading, list item, paragraph, and the names around.
START = np.array([-1.0, 0.5, -3.0, 1.0, 0.3, -0.5, 0.5, -3.5, 2.0])
#: How many of them belong to the text itself.
OF_TEXT = 7


def features(block: Block) -> list[float]:
    n = block.text.count(" ") + 1
    return [
        1.0,
        math.log(n),
        block.linked / len(block.text),
        min(1.0, len(_MARKS.findall(block.text)) / n),
        float(block.tag[:1] == "h" and block.tag[1:].isdigit()),
        float(block.tag in ("li", "dt", "dd", "tr")),
        float(block.tag in ("p", "blockquote", "pre")),
        block.bad,
        block.good,
    ]


def fit(pages: list[str], rounds: int = 200, pull: float = 0.01) -> np.ndarray:
    """Weights of the classifier, learned from the blocks of ``pages`` that lie in a landmark."""
    found = [b for html in pages for b in blocks(html) if b.land]
    x = np.array([features(b) for b in found]).reshape(-1, len(START))
    y = np.array([float(b.land > 0) for b in found])
    if len(y) == 0 or y.min() == y.max():
        return START
    cost = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = START.copy()
    for _ in range(rounds):
        error = cost * (1 / (1 + np.exp(-(x @ w))) - y)
        w -= 0.5 * (x.T @ error / len(y) + pull * (w - START))
    return w


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node stays on the source's side of a minimum cut.

    A positive value is the capacity from the source, a negative one that to the sink. Sources
    are served one by one, along shortest paths with room left. What a source with capacity left
    can reach without meeting the sink stays on its side for good and is not visited again.
    """
    n = len(odds)
    source, sink = [max(0.0, x) for x in odds], [max(0.0, -x) for x in odds]
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        room[i][j] = room[i].get(j, 0.0) + w
        room[j][i] = room[j].get(i, 0.0) + w
    settled = [False] * n
    tiny = 1e-9
    for s in range(n):
        while source[s] > tiny and not settled[s]:
            came = {s: s}
            queue, target = deque([s]), -1
            while queue:
                u = queue.popleft()
                if sink[u] > tiny:
                    target = u
                    break
                for v, left in room[u].items():
                    if left > tiny and v not in came and not settled[v]:
                        came[v] = u
                        queue.append(v)
            if target < 0:
                for u in came:
                    settled[u] = True
                break
            flow, v = min(source[s], sink[target]), target
            while v != s:
                flow = min(flow, room[came[v]][v])
                v = came[v]
            source[s] -= flow
            sink[target] -= flow
            v = target
            while v != s:
                u = came[v]
                room[u][v] -= flow
                room[v][u] += flow
                v = u
    return settled


def label(found: list[Block], tree: Tree, weights: np.ndarray) -> list[bool]:
    """Whether each block is content."""
    if not found:
        return []
    x = np.array([features(b) for b in found])
    text = np.clip(x[:, :OF_TEXT] @ weights[:OF_TEXT], -TEXT_LIMIT, TEXT_LIMIT) + x[:, OF_TEXT:] @ weights[OF_TEXT:]
    odds = [b.land + float(t) for b, t in zip(found, text, strict=True)]
    edges: list[tuple[int, int, float]] = []
    last: dict[tuple[int, int], int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT / (1 + tree.steps(found[i - 1].box, b.box))))
        up = b.box
        for cost in (PARENT, GRANDPARENT):
            up = tree.box_up[up]
            below_page = tree.tag[up] in ("html", "body")  # there only what is text of its own, and nothing speaks against
            if up and (not below_page or cost == PARENT and b.land >= 0 and not b.bad):
                key = (cost == PARENT, up)
                if key in last:
                    edges.append((last[key], i, cost))
                last[key] = i
    return min_cut(odds, edges)


def main_text(html: str | None, weights: np.ndarray) -> str:
    """The blocks of a page that are content, joined by an empty line."""
    found, tree = parse(html or "")
    return "\n\n".join(b.text for b, good in zip(found, label(found, tree, weights), strict=True) if good)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> np.ndarray:
    """Fit the text model on a bounded sample of the pages."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter(F.length("html") <= SAMPLE_CHARS)
    # about 2 * SAMPLE_PAGES rows; never more than twice that, should many rows share an id
    found = rows.filter(in_hash_sample(F.col("id"), SAMPLE_PAGES, pages.count())).limit(4 * SAMPLE_PAGES).coalesce(1).collect()
    found.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r["id"])), r["html"]))
    return fit([r["html"] for r in found[:SAMPLE_PAGES]])


def extract(pages: DataFrame, weights: np.ndarray | None = None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, url, text (its main text), n_chars."""
    bound_batches(pages.sparkSession)
    weights = train(pages, id_col, html_col) if weights is None else weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, weights) for h in strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint").withColumnsRenamed({"page_id": id_col, "url": url_col})
