"""Main text of web pages by minimum-cut labelling.

A page is split into text blocks. A classifier over a block's text and links (length, sentence marks,
share of text in links) gives it a cost of being called boilerplate (its source capacity) and one of
being called content (its sink capacity); nothing else is known of a block by itself. The graph's other
nodes are the marked elements of the page: an article, a nav, an element of class ``notice``. They are tied to a
terminal, the source if they speak for content, by as much as their mark is worth: tags and names that
leave no doubt for good, names that may mean something else by a few log odds. Edges, on the same scale, cost
what labelling their two ends differently costs:

* a block and the nearest marked element around it, or the page itself where nothing in it is marked as content;
* a marked element and the next one around it;
* a block and the one before it, the less the farther they are apart in the element tree, and a block and the one
  before it under the same parent, unless an element that is marked for good holds one of them only.

The maximum flow from source to sink leaves a minimum cut: blocks still reachable from the source are content. So
a short paragraph between long ones stays, prose in a footer goes, and what stands in an element of a
doubtful name goes if it is a line or two, but stays if its text outweighs the name. Scripts, styles, comments
and hidden elements never become blocks.

The flow takes time in proportion to the page for chains and trees of blocks, as blocks whose own
capacity exceeds their edges' and blocks at the end of a chain are settled one by one; the rest goes
by blocking flows.

No page is labelled, so the classifier's and the marks' weights are fixed values below. A page in which
no element is marked as content counts as one itself, weakly: short plain paragraphs stay, lists of links don't.

Edge cases. A null or empty page, and one without content, has the text ''. Unclosed elements end as
HTML's usual rules have it (a p ends a p, an li an li); a page that breaks off inside a tag loses
that tag. A < that only looks like a tag (words without = before the next <, or before the end) is
text. A skipped element without an end tag loses its tag only, a script, style or other raw text all
that follows. Marks of html and body don't count. Equal pages get equal texts. Whole pages are read;
extra columns are dropped; repeated rows and null keys are rows like others.
"""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import map_lists

#: Attributes as HTML's tokenizer has them: a quote counts as one only right after the equals sign. Where
#: such a quote is never closed, the tag ends at its first >.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)("
    r"(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|(?![\"'])[^\s>]++|(?=>)))?+|=)*+>|[^>]*>)|<[!?][^>]*(?:>|\Z)|<(?=/?[a-zA-Z]).*\Z",
    re.S,
)
_RAW = {name: re.compile(rf"</{name}(?=[\s/>]).*?>|\Z", re.S | re.I) for name in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "noframes", "xmp", "math", "object", "canvas", "video", "audio")}
#: Of these an element without an end tag hides nothing: its tag alone is skipped.
_OPTIONAL = frozenset("svg select math object canvas video audio".split())
_PAIRS = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I) for name in _OPTIONAL}
_HINT = re.compile(r"(?<![\w-])(class|id|role|aria-label|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "button", "legend", "option", "optgroup", "summary"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: More than all edges of an element hold: it is on its side for good.
CERTAIN = 1e9
#: Fixed values: (tie to a terminal, positive for content; capacity of the edge to each block) of elements by tag.
TAG_MARK = {
    "article": (CERTAIN, 4.0), "main": (CERTAIN, 3.0), "label": (-4.0, 4.0),
    "nav": (-CERTAIN, 8.0), "header": (-CERTAIN, 5.0), "footer": (-CERTAIN, 8.0), "aside": (-CERTAIN, 8.0), "form": (-CERTAIN, 8.0), "menu": (-CERTAIN, 8.0), "button": (-CERTAIN, 8.0),
    "fieldset": (-CERTAIN, 6.0), "dialog": (-CERTAIN, 8.0), "search": (-CERTAIN, 8.0),
}
#: Words of class, id, role and labels that mean boilerplate, those that often do, which of them say
#: so of elements that hold others only, those that say nothing beside them, and those that mark content.
BAD_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts comment comments commentlist consent cookie cookies disqus gdpr newsletter paywall popup replies reply respond responses sponsor sponsored tracking "
    "breadcrumb breadcrumbs complementary contentinfo footer login masthead menu modal nav navbar navigation pager pagination search sidebar signup subscribe".split()
)
DOUBTFUL_WORDS = frozenset(
    "banner discussion hidden notice notices notification notifications promo promoted promotion recommended related teaser "
    "alert copyright form overlay share sharing skip social tags toc toolbar widget".split()
)
AROUND_WORDS = frozenset(
    "alert breadcrumb breadcrumbs complementary contentinfo copyright footer form login masthead menu modal nav navbar navigation overlay pager pagination search share sharing sidebar "
    "signup skip social subscribe tags toc toolbar widget".split()
)
PLAIN_WORDS = frozenset(
    "area article articles bar block body bottom box btn button buttons col column container content div entry global group header id inner item items layer left link links list main outer page panel policy "
    "post posts primary region right row secondary section site slot stories story text thread title top unit wrap wrapper x".split()
)
GOOD_WORDS = frozenset("article articlebody body content entry hentry main page post story text".split())
#: What names are worth, as above: bad ones, doubtful ones, any on an element of text, good ones.
BAD_NAME, DOUBTFUL_NAME, TEXT_NAME, GOOD_NAME = (-CERTAIN, 8.0), (-4.0, 8.0), (-4.0, 4.0), (3.0, 2.0)
#: The page's edge to a block where nothing is marked as content, and a marked element's to the next.
PAGE, INSIDE = 1.5, 1.0
#: The classifier of texts, in log odds, and the capacities of edges between blocks.
BIAS, LINK_WEIGHT, LENGTH_WEIGHT, SENTENCE_WEIGHT = -1.2, -2.5, 0.35, 0.4
HEADING_WEIGHT = {"h1": 0.8, "h2": 0.4, "h3": 0.3}
FOLLOWS, NEAR = 0.8, 0.6
#: Elements that hold text rather than others.
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th figcaption caption pre summary".split())


#: On these an id is an anchor that says nothing.
ANCHORS = TEXT_ELEMENTS | {"section", "article"}


@dataclass(slots=True)
class Mark:
    tie: float  # to the source if positive, to the sink if negative
    hold: float  # capacity of the edge to each block
    above: Mark | None  # of the next marked element around

    def certain(self) -> Mark | None:
        """The nearest mark that is for good, this one included."""
        held: Mark | None = self
        while held is not None and abs(held.tie) < CERTAIN:
            held = held.above
        return held


@dataclass(slots=True)
class Node:
    tag: str
    mark: Mark | None  # of the nearest marked element, itself included
    parent: Node | None
    hidden: bool
    inside: bool  # an article or main is above
    depth: int


@dataclass(slots=True)
class TextBlock:
    text: str
    node: Node
    score: float  # log odds of being content by text and links alone


def _name_of(tag: str, attributes: str) -> tuple[tuple[float, float] | None, bool]:
    """What an element's names are worth, and whether it is hidden.

    A name such as ``cookie-notice`` counts if one of its words is bad and the others are bad or plain;
    ``share-price`` and ``no-sidebar`` say nothing.
    """
    worth, hidden = None, False
    of_text = tag in TEXT_ELEMENTS
    known = BAD_WORDS | DOUBTFUL_WORDS
    asked = known - AROUND_WORDS if of_text else known
    for name, value in _HINT.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif name in ("class", "role", "aria-label", "itemprop") or name == "id" and tag not in ANCHORS:
            for token in value.split():
                words = {x.lower() for x in _WORDS.findall(token)}
                if words & asked and words <= known | PLAIN_WORDS:
                    found = TEXT_NAME if of_text else BAD_NAME if words & BAD_WORDS else DOUBTFUL_NAME
                    worth = found if worth is None or worth[0] > found[0] else worth
                elif words & GOOD_WORDS and words <= GOOD_WORDS | PLAIN_WORDS and worth is None and not of_text:
                    worth = GOOD_NAME
    return worth, hidden


def _marked(node: Node, tag: str, worth: tuple[float, float] | None) -> Mark | None:
    """The mark that blocks of a new element under ``node`` have: its own, or else that of what is around it. Good
    marks say nothing in an element that is boilerplate for good, a header nothing in an article."""
    found = TAG_MARK.get(tag) if not (tag == "header" and node.inside) else None
    if worth is not None and (found is None or worth[0] < min(found[0], 0.0)):
        found = worth
    if found is None or found[0] > 0 and node.mark is not None and node.mark.tie <= -CERTAIN:
        return node.mark
    return Mark(*found, node.mark)


def _ends(page: str, name: str) -> dict[int, int]:
    """Where the closed elements of a name begin and end."""
    begun, ends = [], {}
    for found in _PAIRS[name].finditer(page):
        if not found[1]:
            if name not in ("svg", "math") or not found[0].endswith("/>"):
                begun.append(found.start())
        elif begun:
            ends[begun.pop()] = found.end()
    return ends


def _loose(tail: str) -> bool:
    """Is what stands from a < to the end of the page words rather than a tag that breaks off?"""
    return tail[:1] == "<" and bool(re.fullmatch(r"</?[a-zA-Z][^\s/>]*\s+[^=/\"']*", tail)) and len(tail.split()) > 1


def blocks(page: str) -> list[TextBlock]:
    """The text blocks of a page in their order, with the classifier's scores."""
    node = Node("", None, None, False, False, 0)
    out: list[TextBlock] = []
    parts: list[str] = []
    closed: dict[str, dict[int, int]] = {}
    linked = at = in_link = 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and not node.hidden:
                share = min(1.0, linked / len(text))
                marks = text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?")
                score = BIAS + HEADING_WEIGHT.get(node.tag, 0.0) + LENGTH_WEIGHT * min(8, len(text) / 40) + LINK_WEIGHT * share + SENTENCE_WEIGHT * min(3, marks)
                out.append(TextBlock(text, node, score))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    size = len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        name = found[2]
        if not name:
            if at == size and _loose(found[0]):  # the page ends in what is no tag
                say(found[0])
            continue
        if "<" in found[3] and "=" not in found[3] and "<" in _QUOTED.sub("", found[3]):
            at = found.start(3) + found[3].rindex("<")
            say(page[found.start() : at])
            continue
        name = name.lower()
        if found[1]:  # an end tag
            if name == "a":
                in_link = 0
            elif name == "br":
                say(" ")
            elif name == "p" or name in BLOCK:
                top = node
                while top.parent is not None and top.tag != name:
                    top = top.parent
                end()
                if top.parent is not None:
                    node = top.parent
            continue
        if name in _RAW:
            if name != "title":
                say(" ")
            if name in ("svg", "math") and found[3].endswith("/>"):
                continue
            if name in _OPTIONAL:
                if name not in closed:
                    closed[name] = _ends(page, name)
                at = closed[name].get(found.start(), at)
            else:
                at = _RAW[name].search(page, at).end()
            continue
        if name in ("br", "wbr"):
            say(" " if name == "br" else "")
            continue
        if name in VOID and name != "hr":
            continue
        if name not in BLOCK:
            if name == "a":
                in_link = 1
            continue
        end()
        if name in CLOSES_P:
            top = node
            while top.parent is not None and top.tag not in ("p", "article", "section", "div", "main", "body", "li", "td", "th", "aside", "form"):
                top = top.parent
            if top.tag == "p":
                node = top.parent
        if name in ENDS:
            top = node
            while top.parent is not None and top.tag not in ENDS[name] and top.tag not in FENCES[name]:
                top = top.parent
            if top.tag in ENDS[name]:
                node = top.parent
        if name == "hr":
            continue
        worth, hidden = _name_of(name, found[3][:-1]) if len(found[3]) > 1 and name not in ("html", "body") else (None, False)
        node = Node(name, _marked(node, name, worth), node, hidden or node.hidden or name == "head", node.inside or name in ("article", "main"), node.depth + 1)
    end()
    return out


_LEAST = 1e-9


def maximum_flow(size: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut. Edges hold in both directions.

    What goes straight from source over a node to the sink is settled first. Then nodes are settled
    one by one where the flow is certain: a node with more left to send (or more room) than its edges
    hold fills them all, and a node with a single edge passes on what it has. The rest goes by
    blocking flows over shortest paths.
    """
    extra = [a - b for a, b in zip(source, sink, strict=True)]  # > 0: left to send; < 0: room
    near: list[dict[int, float]] = [{} for _ in range(size)]
    for a, b, capacity in edges:
        if a != b and capacity > 0:
            near[a][b] = near[a].get(b, 0.0) + capacity
            near[b][a] = near[b].get(a, 0.0) + capacity
    side: list[bool | None] = [None] * size
    follows: list[tuple[int, int]] = []  # nodes that end up on the side of another
    total = [sum(x.values()) for x in near]
    queue = list(range(size))
    waiting = [True] * size
    while queue:
        i = queue.pop()
        waiting[i] = False
        if side[i] is not None or near[i] is None:
            continue
        own = near[i]
        if extra[i] > total[i] + _LEAST or -extra[i] >= total[i] - _LEAST:
            side[i] = extra[i] > total[i] + _LEAST
            sign = 1.0 if side[i] else -1.0
            for j, capacity in own.items():
                extra[j] += sign * capacity
        elif len(own) == 1:
            (j, _), = own.items()
            extra[j] += extra[i]
            follows.append((i, j))
        else:
            continue
        for j, capacity in own.items():
            del near[j][i]
            total[j] -= capacity
            if not waiting[j] and side[j] is None:
                waiting[j] = True
                queue.append(j)
        near[i] = None
    left = [i for i in range(size) if near[i] is not None]
    if left:
        number = {i: k for k, i in enumerate(left)}
        found = _blocking_flows([extra[i] for i in left], [{number[j]: c for j, c in near[i].items()} for i in left])
        for i, reached in zip(left, found, strict=True):
            side[i] = reached
    for i, j in reversed(follows):
        side[i] = side[j]
    return side


def _blocking_flows(extra: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Which nodes can still be reached once no more can be sent from nodes with a positive ``extra``
    to those with a negative one."""
    size = len(extra)
    # Edge e leads to head[e] and has rest[e] left; e ^ 1 is its mirror image.
    head: list[int] = []
    rest: list[float] = []
    out: list[list[int]] = [[] for _ in range(size)]
    for i, own in enumerate(near):
        for j, capacity in own.items():
            if i < j:
                out[i].append(len(head))
                out[j].append(len(head) + 1)
                head += [j, i]
                rest += [capacity, capacity]
    while True:
        level = [-1] * size
        layer = [i for i in range(size) if extra[i] > _LEAST]
        for i in layer:
            level[i] = 0
        starts, reached, depth = list(layer), False, 0
        while layer and not reached:
            depth += 1
            following = []
            for i in layer:
                for e in out[i]:
                    j = head[e]
                    if rest[e] > _LEAST and level[j] < 0:
                        level[j] = depth
                        following.append(j)
                        reached = reached or extra[j] < -_LEAST
            layer = following
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * size
        for start in starts:
            path: list[int] = []
            i = start
            while extra[start] > _LEAST:
                if extra[i] < -_LEAST and path:
                    amount = min(extra[start], -extra[i], min(rest[e] for e in path))
                    extra[start] -= amount
                    extra[i] += amount
                    back = len(path)
                    for k, e in enumerate(path):
                        rest[e] -= amount
                        rest[e ^ 1] += amount
                        if rest[e] <= _LEAST and back == len(path):
                            back = k
                    i = head[path[back] ^ 1] if back < len(path) else i
                    del path[back:]
                    continue
                own = out[i]
                while turn[i] < len(own):
                    e = own[turn[i]]
                    if rest[e] > _LEAST and level[head[e]] == level[i] + 1:
                        path.append(e)
                        i = head[e]
                        break
                    turn[i] += 1
                else:
                    if not path:
                        break
                    i = head[path.pop() ^ 1]
                    turn[i] += 1


def distance(a: Node, b: Node) -> int:
    """Steps from one element to another over the nearest one that holds both."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def graph(found: list[TextBlock]) -> tuple[list[float], list[float], list[tuple[int, int, float]]]:
    """Source and sink capacities and edges: blocks first, then the marked elements around them and the page."""
    source = [math.log1p(math.exp(b.score)) for b in found]
    sink = [math.log1p(math.exp(-b.score)) for b in found]
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    marks: dict[int, int] = {}

    def node_of(mark: Mark) -> int:
        held, below = mark, None
        while held is not None and id(held) not in marks:
            marks[id(held)] = i = len(source)
            source.append(max(0.0, held.tie))
            sink.append(max(0.0, -held.tie))
            if below is not None:
                edges.append((below, i, INSIDE))
            held, below = held.above, i
        if below is not None and (held is not None or bare):
            edges.append((below, page if held is None else marks[id(held)], INSIDE))
        return marks[id(mark)]

    own: list[Mark | None] = []  # the marks for good that blocks are in
    bare = not any(b.node.inside for b in found)
    page = len(source)
    if bare:
        source.append(CERTAIN)
        sink.append(0.0)
    for i, block in enumerate(found):
        if block.node.mark is not None:
            edges.append((i, node_of(block.node.mark), block.node.mark.hold))
        elif bare:
            edges.append((i, page, PAGE))
        own.append(block.node.mark and block.node.mark.certain())
        if i and own[i - 1] is own[i]:
            edges.append((i - 1, i, 2 * FOLLOWS / max(2, distance(found[i - 1].node, block.node))))
        parent = id(block.node.parent)
        if parent in last and own[last[parent]] is own[i]:
            edges.append((last[parent], i, NEAR))
        last[parent] = i
    return source, sink, edges


def labels(found: list[TextBlock]) -> list[bool]:
    """True for the blocks that are content."""
    source, sink, edges = graph(found)
    return maximum_flow(len(source), source, sink, edges)[: len(found)]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of every row."""

    def make():
        def each(urls, sources):
            texts = [main_text(x) for x in sources]
            return [[*range(len(texts))], urls, texts, [len(x) for x in texts]]

        return each

    return map_lists(pages.select(key, url, html), make, {"url": "string", "text": "string", "n_chars": "long"}, keep=key)
