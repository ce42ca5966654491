"""Main text of web pages by tree scoring.

A page becomes a small tree without scripts, styles, forms, menus, headers, footers, sidebars, notices, adverts and
comments. Each paragraph passes points to its ancestors: one, one per comma, and up to three for its length; the parent
gets them whole, the grandparent half, further ancestors ever less. A container's points are discounted by its link
density. The best container and those siblings that read like it are kept, with everything inside them, as blocks.

What surrounds an article is told by its element or by a class, id or role that says nothing else (`cookie-banner`). Where
such a word is only part of a name (`section-header`, `notice-board`), the element is kept if it reads like text.

Defined results: a null or empty page, and one without text outside what is dropped, give an empty text; unclosed and
misnested tags, kept or dropped, are closed where the next block begins or with what they stand in; a tag without an end
is text where no `>` follows, else it ends at the next one, as do all tags behind an unclosed quote; elements nested deeper
than `MOST_LEVELS` count as children of the last level, none of their text is lost; equal rows give equal texts; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# possessive, so that a tag without an end is given up after one pass
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_TAG = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# fixed values: HTML's element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
DROPPED = frozenset("head nav header footer aside form menu dialog button select datalist svg math canvas audio video object map search".split())
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("article main section div body html td blockquote".split())
#: What an open element of the key ends at: a start tag of the value closes it.
IMPLIED = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": BLOCK}
#: Words in class, id or role of what surrounds an article.
SURROUND = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popup|pop-up|modal|overlay|newsletter|subscri\w+|signup|sign-up|login|paywall|menus?|menubar|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|masthead|headers?|footers?|copyright|sidebars?|side-bar|rail|widgets?|related|recommend\w*|shar(?:e|ing)|social|comments?|comment-?list|disqus|respond|replies|contentinfo|complementary|search|skip-link"
)
#: Words that say nothing beside those.
NEUTRAL = re.compile(r"site|page|top|bottom|left|right|sticky|fixed|global|primary|secondary|main|inner|outer|container|wrap\w*|box|block|bar|area|slot|unit|list|items?|links?|buttons?|icons?|row|col|columns?|js|the|[a-z]?\d*")


def _names(value: str) -> tuple[bool, bool]:
    """Whether some name of an attribute says only what surrounds an article, and whether one says so in part."""
    sure = partly = False
    for name in value.lower().split():
        if SURROUND.fullmatch(name):
            sure = True
            continue
        parts = re.split("[_-]+", name)
        hits = [SURROUND.fullmatch(p) is not None for p in parts]
        if any(hits):
            partly = True
            sure = sure or all(h or NEUTRAL.fullmatch(p) for h, p in zip(hits, parts))
    return sure, partly


class Node:
    __slots__ = ("children", "doubtful", "dropped", "level", "links", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, doubtful: bool = False):
        self.tag, self.parent, self.children, self.dropped, self.doubtful = tag, parent, [], dropped, doubtful
        self.points = self.size = self.links = 0
        self.level = parent.level + 1 if parent else 0


#: Nesting beyond this is flattened; dropped elements may nest as much again.
MOST_LEVELS = 400


def _dropped(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element surely surrounds the article, and whether it may."""
    if tag in DROPPED or tag in RAW:
        return True, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    doubtful = False
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True, False
        if name in ("class", "id", "role"):
            sure, partly = _names(value)
            if sure:
                return True, False
            doubtful = doubtful or partly
    return False, doubtful


_ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I | re.A) for tag in RAW}


def _token(html: str, place: int, state: dict) -> re.Match | None:
    """The next comment, declaration or tag from a place on. state: where the last `>` is, and whether quotes count no more."""
    while (at := html.find("<", place)) >= 0:
        found = (_LOOSE if state["loose"] else _TOKEN).match(html, at) or state["loose"] and html.startswith(("<!", "<?"), at) and _TOKEN.match(html, at)
        if found:
            return found
        if at > state["last"]:
            return None
        if _TAG.match(html, at):  # a quote isn't closed
            state["loose"] = True
            continue
        place = at + 1
    return None


def tree(html: str) -> Node:
    """The tree of what is kept; text nodes are strings, with their white space. Dropped elements are opened and closed like
    others, but no element has them as children."""
    root = at = Node("html", None)
    place, state = 0, {"last": html.rfind(">"), "loose": False}
    flat: dict[str, int] = {}  # open elements that were flattened in the dropped one
    while m := _token(html, place, state):
        if not at.dropped and m.start() > place:
            at.children.append(unescape(html[place : m.start()]))
        place = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if at.dropped and flat.get(tag):
                flat[tag] -= 1
                continue
            node = at
            while node and node.tag != tag:
                node = node.parent
            # the end of an inline element doesn't reach over blocks, but it ends what is dropped from its start on
            if node and node.parent and (tag in BLOCK or node.dropped and not node.parent.dropped or not any(n.tag in BLOCK for n in _between(at, node))):
                at = node.parent
            elif tag in BLOCK and not at.dropped:
                at.children.append(Node("hr", at))
            continue
        own = m[3]
        if tag in RAW:  # its text isn't markup
            end = _ENDS[tag].search(html, place)
            close = html.find(">", end.end()) if end else -1
            place = close + 1 if close >= 0 else len(html)
            continue
        if tag in VOID:
            if not at.dropped:
                at.children.append(" " if tag == "br" else Node("hr", at) if tag == "hr" else "")
            continue
        if own.endswith("/") and (at.dropped or tag in ("svg", "math")):
            continue
        node = at  # close what the new element ends, within its list, row or table
        while node.parent and node.tag not in ("table", "ul", "ol", "dl", "select"):
            if node.tag in IMPLIED and tag in IMPLIED[node.tag]:
                at = node.parent
            if node.tag in BLOCK and node.tag not in IMPLIED:
                break
            node = node.parent
        if not at.dropped:
            flat.clear()
        sure, doubtful = _dropped(tag, own)
        dropped = at.dropped or sure
        if at.level < MOST_LEVELS or dropped and at.level < 2 * MOST_LEVELS:
            new = Node(tag, at, dropped, doubtful)
            if not dropped:
                at.children.append(new)
            at = new
        elif dropped:
            flat[tag] = flat.get(tag, 0) + 1
        elif tag in BLOCK:
            at.children.append(Node("hr", at))
    if not at.dropped and place < len(html):
        at.children.append(unescape(html[place:]))
    return root


def _above(node: Node) -> Iterator[Node]:
    while node.parent:
        node = node.parent
        yield node


def _between(low: Node, high: Node) -> Iterator[Node]:
    while low is not high:
        yield low
        low = low.parent


def _reads_like_text(node: Node) -> bool:
    """Of an element whose name leaves doubt: whether it is no list of links, and a paragraph, holds one or ends like a sentence."""
    if node.links >= 0.25 * max(node.size, 1):
        return False
    if any(n.tag in PARAGRAPH and n.size for n in _nodes(node)):
        return True
    words = _text(node).split()
    return len(words) >= 5 and words[-1][-1] in ".!?\u2026\u3002"


def _measure(node: Node, in_link: bool = False) -> None:
    """Text and link sizes of all elements, and the points that paragraphs pass up; elements of doubt that aren't text go."""
    in_link = in_link or node.tag == "a"
    own = commas = 0
    for x in node.children:
        if isinstance(x, str):
            n = len(x.strip())
            own += n
            commas += x.count(",")
        else:
            _measure(x, in_link)
            if x.doubtful and not _reads_like_text(x):
                x.children, x.size, x.links, x.points = [], 0, 0, 0
            if x.tag not in BLOCK:
                commas += x.points  # of an inline element: its commas
            node.size += x.size
            node.links += x.links
    node.size += own
    node.links += own if in_link else 0
    if node.tag not in BLOCK:
        node.points = commas
        return
    text = own + sum(x.size for x in node.children if not isinstance(x, str) and x.tag not in BLOCK)
    if text and (node.tag in PARAGRAPH or node.tag in CONTAINER):
        points = (1 + commas + min(text / 100, 3)) * (1 - node.links / max(node.size, 1))
        # text that stands directly in a container is a paragraph of that container
        up, share = node if node.tag in CONTAINER and node.tag not in PARAGRAPH else node.parent, 1.0
        level = 0
        while up and level < 5:
            if up.tag in BLOCK:
                up.points += points * share
                level += 1
                share = 0.5 if level == 1 else 1 / (3 * level)
            up = up.parent


def _nodes(node: Node) -> Iterator[Node]:
    yield node
    for x in node.children:
        if not isinstance(x, str):
            yield from _nodes(x)


def _text(node: Node) -> str:
    return "".join(x if isinstance(x, str) else _text(x) for x in node.children)


#: Points of elements that are meant to hold the main text.
MEANT = {"article": 25, "main": 15}


def _score(node: Node) -> float:
    return (node.points + MEANT.get(node.tag, 0)) * (1 - node.links / max(node.size, 1))


def _best(root: Node) -> list[Node]:
    found = [n for n in _nodes(root) if n.tag in CONTAINER and n.size]
    if not found:
        return [root]
    best = max(found, key=lambda n: (_score(n), -n.level))
    # where several containers read as well as the best, their common ancestor holds the text
    rivals = [n for n in found if _score(n) >= 0.75 * _score(best)] if best.tag not in MEANT else []
    up = best.parent
    while up and len(rivals) >= 3:
        if sum(any(a is up for a in _above(n)) for n in rivals) >= 3:
            best = up
            break
        up = up.parent
    around = best.parent.children if best.parent else [best]
    least = 0.2 * _score(best)

    def like(n: Node) -> bool:
        if n is best or n.tag == best.tag and n.tag in MEANT:
            return True
        if n.tag in HEADING or n.links < 0.25 * n.size and (n.tag in PARAGRAPH or n.tag in CONTAINER and any(x.tag in PARAGRAPH and x.size for x in _nodes(n))):
            return True
        return n.tag in CONTAINER and n.tag not in PARAGRAPH and _score(n) >= least > 0

    return [n for n in around if not isinstance(n, str) and n.size and like(n)]


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Appends the text of node to the open block; block elements begin and end blocks."""
    block = node.tag in BLOCK
    if block:
        out.append([])
    for x in node.children:
        if isinstance(x, str):
            out[-1].append(x)
        else:
            _blocks(x, out)
    if block:
        out.append([])


def main_text(html: str | None) -> str:
    """The blocks of the main text, joined by empty lines."""
    if not html:
        return ""
    root = tree(html)
    _measure(root)
    out: list[list[str]] = [[]]
    for node in _best(root):
        _blocks(node, out)
    return "\n\n".join(t for parts in out if (t := " ".join("".join(parts).split())))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, url, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([main_text(x.as_py()) for x in b.column(2)], pa.string())], names=["id", "url", "text"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "id long, url string, text string")
