"""HTML extraction: a minimum cut separates a page's content from its boilerplate.

A page becomes a list of blocks of text, each with the elements around it.  A classifier's
costs of calling a block content or boilerplate are its capacities to the two terminals;
neighbouring blocks, and blocks of one parent, are tied by smoothness edges that weaken with
their distance in the tree.  The maximum flow's cut is the cheapest labelling.

The classifier is fixed: there are no labelled pages.  Its weights concern the elements and
class names around a block, links, length and punctuation.  A block whose own signs mislead, as a
paragraph that is one link, goes with its neighbours where these are sure.

Cases: a null or empty page, and one without content, give an empty text; unclosed and
misplaced tags are read as browsers do in the common cases; scripts, styles and comments never
become blocks; repeated rows are read each; blocks whose costs are even count as boilerplate; a
very long page is read whole; extra columns pass through ``extract``, where outputs replace input
columns of their names; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_texts

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

# Element names.
RAW = frozenset("script style textarea title template iframe xmp noembed noframes".split())
#: Of these the rest of a page belongs to one that isn't closed; the others are then read as markup.
ENDLESS = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr canvas object svg math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot".split()
)
#: Elements that end an open paragraph are all that aren't inline; these end one of their own kind.
OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = frozenset("ul ol dl table tbody thead tfoot tr article main section div nav footer aside body html".split())

# Weights of the classifier, in log odds.
ELEMENTS = {
    "nav": -9.0, "footer": -9.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0, "button": -8.0, "select": -8.0,
    "header": -7.0, "head": -20.0, "figcaption": -0.5, "address": -2.0, "fieldset": -6.0,
    "article": 4.0, "main": 2.5, "p": 0.8, "blockquote": 0.5, "pre": 0.8, "h1": 1.5, "h2": 1.0, "h3": 0.8, "li": -0.2, "td": -0.2,
}
NAMES = (
    (-9.0, "nav navbar navigation menu footer foot sidebar sidenav breadcrumb breadcrumbs pagination pager toolbar masthead skip"),
    (-9.0, "ad ads adv advert adverts advertisement advertising sponsor sponsored banner promo promotion adsense"),
    (-9.0, "cookie cookies consent gdpr notice notices notification popup modal overlay alert newsletter subscribe signup login paywall"),
    (-9.0, "comment comments reply replies respond disqus discussion"),
    (-7.0, "header share sharing social related recommended recommendations widget teaser teasers tags tagcloud copyright legal disclaimer hidden aside side rail"),
    (1.5, "article content entry post story main body text maintext articlebody"),
)
#: Words of layout: behind a name above they change nothing (ad-slot); any other word does (share-price).
LAYOUT = frozenset(
    "area bar block bottom box col column container content first fixed form foot group head heading holder inner item items last left link links "
    "list main outer page panel right row section site slot small sticky text title top unit wrap wrapper zone".split()
)
WEIGHT_OF = {name: w for w, names in NAMES for name in names.split()}
WORDS_OF = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPLIT = re.compile(r"[^A-Za-z]+")
ROLES = {"navigation": -9.0, "banner": -8.0, "contentinfo": -9.0, "complementary": -8.0, "search": -8.0, "dialog": -8.0, "main": 2.5, "article": 4.0}

NEXT_TO, SIBLINGS = 2.0, 1.5


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    depth: int
    low: float  # least weight by its kind
    named: float  # least weight by its names; void if it holds the article
    best: float  # greatest weight on the way up
    linked: bool
    inside: bool = False  # an article
    holds: bool = False
    worst: float | None = None

    def least(self) -> float:
        """The least weight on the way up, once the page is read."""
        way, up = [], self
        while up is not None and up.worst is None:
            way.append(up)
            up = up.parent
        worst = 0.0 if up is None else up.worst
        for x in reversed(way):
            worst = x.worst = min(worst, x.low if x.holds else min(x.low, x.named))
        return worst


@dataclass(slots=True)
class Block:
    text: str
    at: Element
    linked: int


def _weights(tag: str, attributes: str) -> tuple[float, float, float]:
    """The least weights by an element's kind and by its class and id, and the greatest by both."""
    w = ELEMENTS.get(tag, 0.0)
    low, named, high = min(w, 0.0), 0.0, max(w, 0.0)
    if attributes and not attributes.isspace():
        for name, *values in ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "")
            name = name.lower()
            if name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    low = min(low, -12.0)
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                low = min(low, -12.0)
            elif name == "role":
                w = ROLES.get(value.lower(), 0.0)
                low, high = min(low, w), max(high, w)
            elif name in ("class", "id"):
                for token in value.split():
                    parts = [x.lower() for part in SPLIT.split(token) for x in (part, *WORDS_OF.findall(part))]
                    weights = [WEIGHT_OF.get(x, 0.0) for x in parts]
                    # in a compound the last word says what it is
                    strange = len(parts) > 1 and parts[-1] not in WEIGHT_OF and parts[-1] not in LAYOUT
                    named = min(named, *weights, 0.0) if not strange else min(named, 0.4 * min(weights))
                    high = max(high, *weights)
    return (0.0, 0.0, 0.0) if tag in ("body", "html") else (low, named, high)  # a page's own names say little


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order, white space made single."""
    root = Element("", None, 0, 0.0, 0.0, 0.0, False)
    here, parts, linked, out = root, [], 0, []
    begin: Element | None = None

    def flush() -> None:
        nonlocal parts, linked, begin
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, begin or here, linked))
        parts, linked, begin = [], 0, None

    def say(text: str) -> None:
        nonlocal linked, begin
        if text:
            parts.append(text)
            if not text.isspace():
                begin = begin or here
                if here.linked:
                    linked += len(text)

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:-3], quote=False))
            continue
        tag = tag.lower()
        if m[1]:
            up = here
            while up is not root and up.tag != tag and not (tag in INLINE and up.tag not in INLINE):
                up = up.parent
            if tag not in INLINE:
                flush()
            if up.tag == tag and up is not root:
                here = up.parent
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag not in RAW:
                here = _closed(here, tag, root)
        if tag in VOID or m[3].endswith("/") and tag not in ("p", "div", "a", "span"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if close or tag in ENDLESS:
                at = close.end() if close else end
                continue
        low, named, high = _weights(tag, m[3])
        if tag == "header" and here.inside:  # an article's own header has its headline
            low = max(low, 0.0)
        inside = here.inside or tag in ("article", "main")
        here = Element(tag, here, here.depth + 1, low, named, max(here.best, high), here.linked or tag == "a", inside)
        if tag in ("article", "main"):
            up = here.parent
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent
    flush()
    return out


def _closed(here: Element, tag: str, root: Element) -> Element:
    """Where a block element opens: a paragraph before it has ended, as has an item of its kind."""
    kinds = OWN_KIND.get(tag, ())
    up, new = here, here
    while up is not root and (up.tag not in BOUNDS or up.tag in kinds):
        if up.tag == "p" or up.tag in kinds or (up.tag == "head" and tag not in ("title", "meta", "link")):
            new = up.parent
        up = up.parent
    if tag == "body":
        while new is not root and new.tag != "html":
            new = new.parent
    return new


SENTENCE = re.compile(r"[.!?…]['\"”»)]*(?:\s|$)")
RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved|cookie|newsletter|sign up|log ?in\b|subscribe|read more|privacy policy|terms of (?:use|service)", re.I)


def odds(block: Block) -> float:
    """Log odds that a block is content."""
    n = len(block.text)
    x = -0.6 + block.at.least() + block.at.best
    x += min(2.0, n / 80) - 4.0 * block.linked / max(1, n)
    x += min(1.5, 0.5 * len(SENTENCE.findall(block.text)))
    if n < 200 and RIGHTS.search(block.text):
        x -= 2.0
    return x


def apart(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def minimum_cut(content: list[float], other: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut.

    ``content`` are capacities from the source, ``other`` to the sink, edges go both ways.  Flow
    straight through a node comes first; the rest is sent level by level.
    """
    n = len(content)
    rest = [c - o for c, o in zip(content, other, strict=True)]  # above 0 what the source can still send
    out: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, c in edges:
        out[a].append(len(to))
        to.append(b)
        room.append(c)
        out[b].append(len(to))
        to.append(a)
        room.append(c)
    tiny = 1e-9
    while True:
        # levels: how far each node is from those that can still send
        level = [0 if r > tiny else -1 for r in rest]
        queue = deque(i for i in range(n) if not level[i])
        met = False
        while queue:
            i = queue.popleft()
            met = met or rest[i] < -tiny
            for e in out[i]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not met:
            return [x >= 0 for x in level]
        # flow along edges that go up one level, each edge left behind once it leads nowhere
        tried = [0] * n
        for start in range(n):
            path: list[int] = []
            i = start
            while rest[start] > tiny:
                if rest[i] < -tiny:
                    flow = min(rest[start], -rest[i], *(room[e] for e in path)) if path else 0.0
                    rest[start] -= flow
                    rest[i] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    k = next((k for k, e in enumerate(path) if room[e] <= tiny), len(path))
                    if rest[start] > tiny:
                        i = to[path[k] ^ 1] if k < len(path) else i
                        del path[k:]
                    continue
                while tried[i] < len(out[i]):
                    e = out[i][tried[i]]
                    if room[e] > tiny and level[to[e]] == level[i] + 1:
                        break
                    tried[i] += 1
                if tried[i] < len(out[i]):
                    path.append(out[i][tried[i]])
                    i = to[path[-1]]
                elif path:
                    i = to[path.pop() ^ 1]
                    tried[i] += 1
                else:
                    break


def main_text(page: str) -> str:
    """The page's content, one line per block."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    content, other = [], []
    for b in blocks:
        x = max(-30.0, min(30.0, odds(b)))
        content.append(math.log1p(math.exp(x)))  # what it costs to call it boilerplate
        other.append(math.log1p(math.exp(-x)))
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT_TO / (1 + apart(blocks[i - 1].at, b.at))))
        parent = id(b.at.parent)
        if parent in last:
            edges.append((last[parent], i, SIBLINGS))
        last[parent] = i
    keep = minimum_cut(content, other, edges)
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars`` to the columns in ``keep`` (default: all but the page)."""
    schema = T.StructType([T.StructField("text", T.StringType())])
    keep = [c for c in pages.columns if c != column] if keep is None else keep

    def make():
        return lambda texts: [pa.array([main_text(t) for t in texts], pa.string())]

    rows, s = map_texts(pages, column, schema, make, keep)
    kept = [f"`{c}`" for c in keep if c.lower() not in ("text", "n_chars")]
    return rows.select(*kept, f"{s}.text", F.char_length(f"{s}.text").cast("long").alias("n_chars"))


def report(pages: DataFrame) -> DataFrame:
    return extract(pages, keep=["page_id", "url"])
