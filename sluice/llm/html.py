"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text nodes, each under the path of open tags from the
root.  Per path, text length and punctuation are summed over its nodes and divided by
their number; both ratios are smoothed over the nodes in page order, fused by their
product, and paths whose nodes reach the page's threshold (half of the mean over its
text, or that of ordinary prose if less) are content.  Content
nodes are the text, with all that stands between them: short paragraphs and headings
are not lost to the threshold.  Before and after them stay the short blocks beside
content in the lowest block that holds all of it, and the title above; <article> and
<main> only say how far up to look for titles.  What says by its tag, role or class that it is a menu, header,
footer, sidebar, notice, advert, form or comment takes part in neither step; names count
for blocks that are no headings, and a high path ratio overrules them.

Pages are independent: one Arrow pass over the html column, nothing shuffled; a task
holds a batch (``common.BYTES_PER_BATCH``) or one page if that is larger, and reading
is linear in the page.

Defined cases: NULL or empty html gives an empty text; plain text without tags is
one block; unclosed, unopened and truncated tags are accepted; repeated rows give equal
results; an empty table stays empty; further columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video "
                "select textarea button title head".split())
# Their content is text up to the end tag, whatever it holds.
OPAQUE = frozenset("script style noscript template iframe textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label "
                   "mark q s samp small span strike strong sub sup time tt u var wbr br img "
                   "ruby rt rp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Blocks that hold running text; what holds an article is the box around them.
TEXT_BLOCKS = HEADINGS | frozenset("p li dt dd ul ol dl blockquote pre table thead tbody tfoot tr "
                                   "figure figcaption caption summary details address".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form dialog menu".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert "
                              "dialog menu menubar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notification alert newsletter subscribe subscription "
    "signup login sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer bottombar topbar toolbar comment comments commentlist discussion "
    "disqus reply replies respond related recommended share sharing social popup modal overlay "
    "widget pagination pager skip".split())
# "with-sidebar" speaks of the layout, not of the element.
LAYOUT_WORDS = frozenset("with has no without is main article content post entry".split())
# A start tag closes an open element of these, up to the nearest stop.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"},
         "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
P_STOPS = frozenset("article main section div td th table body html li dd button aside header "
                    "footer nav blockquote form".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
    r"(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")

# Nodes smoothed over on either side, and the share of the mean that is content.
RADIUS = 1
THRESHOLD = 0.5
# 100 characters with two marks to a node are prose, however long other nodes are.
PROSE = 300.0


class Element:
    """An open or closed element; ``path`` numbers the labels from the root to it and
    ``count`` numbers the content nodes in it."""

    __slots__ = ("tag", "path", "parent", "dead", "depth", "count", "named", "slug", "titled")

    def __init__(self, tag: str, path: int, parent: Element | None, dead: bool):
        self.tag, self.path, self.parent, self.dead = tag, path, parent, dead
        # The nearest element around with a boilerplate name, the id that alone gives it
        # that name, and whether this is in a heading of a box named header.
        self.named: Element | None = None
        self.slug: str | None = None
        self.titled = False
        self.depth = parent.depth + 1 if parent else 0
        self.count = 0


# Element, block and raw text of a text node.
Node = tuple[Element, int, str]


def boilerplate(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element says by its tag, role or state that it is no content."""
    if tag in ("html", "body", "main", "article"):
        return False
    if tag in BOILERPLATE_TAGS or attributes.get("role", "").lower() in BOILERPLATE_ROLES:
        return True
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"


def named(tag: str, names: str) -> set[str]:
    """The boilerplate words in the class or id of a block that is no heading."""
    if tag in INLINE or tag in HEADINGS or tag in ("html", "body", "main", "article"):
        return set()
    hits: set[str] = set()
    for name in names.lower().split():
        parts = [x for x in re.split(r"[-_]+", name) if x]
        if parts and parts[0] not in LAYOUT_WORDS:
            hits |= BOILERPLATE_WORDS.intersection(parts)
    return hits


def nodes(html: str) -> tuple[list[Element], list[Node]]:
    """All elements, parents first, and (element, block, raw text) of every text node
    that is not markup, script or boilerplate by its tag; names are judged later."""
    root = Element("#root", 0, None, False)
    stack, out, elements = [root], [], [root]
    paths: dict[tuple[int, str], int] = {}
    opened: Counter[str] = Counter()
    headers: set[Element] = set()
    block = at = 0

    def text(part: str) -> None:
        if part and not stack[-1].dead:
            out.append((stack[-1], block, part))

    def close(index: int) -> None:
        opened.subtract(e.tag for e in stack[index:])
        del stack[index:]

    n = len(html)
    while at < n:
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            break
        m = _MARKUP.match(html, start)
        if m is None:  # a lone <
            text(html[at:start + 1])
            at = start + 1
            continue
        text(html[at:start])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"].replace("&", "&amp;"))
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag not in INLINE:
                block += 1
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # a stray inline end tag does not close a block
            continue
        if tag not in INLINE:
            block += 1
            for i in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in P_STOPS:
                    break
        if tag in CLOSES and any(opened[t] for t in CLOSES[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    close(i)
                    if tag != "tr":
                        break
                elif stack[i].tag in STOPS[tag]:
                    break
        if tag == "br":
            text(" ")
        if tag in VOID:
            continue
        attributes = {}
        if m["rest"]:
            attributes = {k.lower(): unescape(a or b or c or "")
                          for k, a, b, c in _ATTRIBUTE.findall(m["rest"])}
            if m["rest"].endswith("/") and tag in ("svg", "math"):
                continue
        parent = stack[-1]
        # An article inside a box called, say, "post-header" is still the article.
        alive = tag in ("article", "main") and parent.tag not in BOILERPLATE_TAGS
        dead = (parent.dead and not alive) or tag in RAW or boilerplate(tag, attributes)
        label = ".".join([tag, *attributes.get("class", "").split()])
        path = paths.setdefault((parent.path, label), len(paths) + 1)
        element = Element(tag, path, parent, dead)
        hits = named(tag, attributes.get("class", ""))
        by_id = named(tag, attributes.get("id", "")) if not hits else set()
        box = None if alive else parent.named
        element.titled = parent.titled
        if hits or by_id:
            element.named = element
            element.slug = attributes["id"] if by_id else None
            headers.update({element} if (hits or by_id) == {"header"} else ())
        elif tag in HEADINGS and box in headers:
            element.titled, element.named = True, box.parent.named
        else:
            element.named = box
        if tag in OPAQUE:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        stack.append(element)
        elements.append(element)
        opened[tag] += 1
    return elements, out


def path_ratios(found: list[Node]) -> tuple[np.ndarray, np.ndarray, float]:
    """Length of the text nodes, the fused ratio of their paths and its mean over the text."""
    clean = [unescape(t).strip() for _, _, t in found]
    chars = np.array([len(t) for t in clean], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in clean], float)
    path = np.unique([e.path for e, _, _ in found], return_inverse=True)[1]
    use = (chars > 0).astype(float)
    number = np.maximum(np.bincount(path, use), 1.0)
    text_ratio = (np.bincount(path, chars) / number)[path]
    mark_ratio = (np.bincount(path, marks) / number)[path]

    def smooth(v: np.ndarray) -> np.ndarray:
        padded = np.pad(v, RADIUS, mode="edge")
        kernel = np.exp(-np.arange(-RADIUS, RADIUS + 1) ** 2 / 2.0)
        return np.convolve(padded, kernel / kernel.sum(), "valid")

    fused = smooth(text_ratio) * (1.0 + smooth(mark_ratio))
    by_path = np.bincount(path, fused * use) / number
    return chars, by_path[path], float((fused * chars).sum() / max(chars.sum(), 1.0))


def content_paths(found: list[Node]) -> np.ndarray:
    """Which text nodes lie on content paths, by smoothed and fused ratios."""
    # Threshold a path by the mean of its nodes, against the mean over all text.
    if not found:
        return np.zeros(0, bool)
    _, ratio, mean = path_ratios(found)
    return ratio >= min(THRESHOLD * mean, PROSE)


def slug(text: str) -> str:
    return re.sub(r"[\W_]+", "-", re.sub(r"^[\W\d_]+", "", unescape(text).lower())).strip("-")


def unnamed(found: list[Node]) -> tuple[list[Node], np.ndarray]:
    """Text nodes outside boilerplate names, and which of them lie on content paths.

    A high path ratio overrules a name: that of a box with more than half of the page's
    text whose paths are prose and no less than the mean of the text outside names (of
    three nodes or more, where there is such text); and that of the id of a section whose
    paths are content, on the tag path of other sections with content.  An id made from
    the box's first heading is no name.
    """
    rest = [n for n in found if n[0].named is None]
    if len(rest) == len(found):
        return found, content_paths(found)
    content = content_paths(rest)
    outside = any(raw.strip() for _, _, raw in rest)
    # Own text of a box and that of the boxes in it.
    length: dict[Element, int] = {}
    number: Counter[Element] = Counter()
    heading: dict[Element, tuple[int, str]] = {}
    for e, block, raw in found:
        if e.named is None or not raw.strip():
            continue
        length[e.named] = length.get(e.named, 0) + len(raw.strip())
        number[e.named] += 1
        up = e
        while up is not e.named and up.tag in INLINE:
            up = up.parent
        if up.tag in HEADINGS and heading.setdefault(e.named, (block, ""))[0] == block:
            heading[e.named] = (block, heading[e.named][1] + raw)
    # Children are deeper than their boxes, so every box is complete when it is added.
    for b in sorted(around(list(length)), key=lambda b: -b.depth):
        if (outer := b.parent.named) is not None:
            length[outer] = length.get(outer, 0) + length.get(b, 0)
            number[outer] += number[b]
    half = sum(len(raw.strip()) for _, _, raw in found) / 2.0
    large = {b for b, n in length.items() if n > half and (number[b] >= 3 or not outside)}
    ids = {b for b in length if b.slug is not None}
    if not large and not ids:
        return rest, content
    sections: set[Element] = set()
    for (e, _, raw), on in zip(rest, content, strict=True):
        while on and raw.strip() and e is not None and e not in sections:
            sections.add(e)
            e = e.parent
    paths = {e.path for e in sections if e.tag == "section"}
    made = {b for b in ids if slug(b.slug) and slug(b.slug) == slug(heading.get(b, (0, ""))[1])}
    ids = {b for b in ids if b.path in paths}
    mean = path_ratios(rest)[2] if rest else 0.0
    chars, ratio, _ = path_ratios(found)
    total = dict.fromkeys(length, 0.0)
    for (e, _, _), n, r in zip(found, chars, ratio, strict=True):
        if e.named is not None and n:
            total[e.named] += n * r
    for b in sorted(length, key=lambda b: -b.depth):
        if (outer := b.parent.named) is not None:
            total[outer] += total[b]
    over = made | {b for b in large if total[b] >= max(mean, PROSE) * length[b]}
    over |= {b for b in ids if total[b] >= min(THRESHOLD * mean, PROSE) * length[b]}
    if not over:
        return rest, content
    live: dict[Element | None, bool] = {None: True}
    for b in sorted(length, key=lambda b: b.depth):
        live[b] = b in over and live[b.parent.named]
    found = [n for n in found if live.get(n[0].named, False)]
    return found, content_paths(found)


def around(boxes: Iterable[Element]) -> set[Element]:
    """Named boxes and the named boxes around them."""
    found: set[Element] = set()
    for b in boxes:
        while b is not None and b not in found:
            found.add(b)
            b = b.parent.named
    return found


def selected(elements: list[Element], found: list[Node],
             content: np.ndarray) -> list[bool]:
    """Which text nodes are main text: those on content paths, and what these enclose.

    The part is the lowest block with all content nodes, however these are shared out.
    Between its first and last content node nothing is lost; before and after them stay
    short blocks beside content, but no box that has none, and the headings above.
    """
    on = [bool(c and raw.strip() and not e.titled)
          for c, (e, _, raw) in zip(content, found, strict=True)]
    if not any(on):
        return on
    for (e, _, _), c in zip(found, on, strict=True):
        e.count += c
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.count += e.count
    texts = {e for e, _, raw in found if raw.strip()}
    # The block around an element of running text, or the element.
    box: dict[Element, Element] = {}
    for e in elements:
        runs = e.tag in INLINE or e.tag in TEXT_BLOCKS or (
            e.tag in ("td", "th") and (e in texts or not e.count))
        box[e] = box[e.parent] if runs and e.parent is not None else e
    part = box[max((e for e in elements if e.count == elements[0].count), key=lambda e: e.depth)]
    # A title may stand in another box than the paragraphs of its article.
    scope = part
    while scope is not None and scope.tag not in ("article", "main"):
        scope = scope.parent
    inside: dict[Element, bool] = {}
    scoped: dict[Element, bool] = {}
    title: dict[Element, bool] = {}
    for e in elements:
        up = e.parent
        inside[e] = e is part or (up is not None and inside[up])
        scoped[e] = e is scope or (up is not None and scoped[up])
        title[e] = e.tag in HEADINGS or (up is not None and title[up])
    first = on.index(True)
    last = len(on) - 1 - on[::-1].index(True)
    keep = [first <= i <= last or (inside[e] and box[e].count > 0)
            or (i < first and title[e] and scoped[e]) for i, (e, _, _) in enumerate(found)]
    if not any(k and title[e] for k, (e, _, _) in zip(keep[:first + 1], found, strict=False)):
        above = [block for e, block, raw in found[:first] if title[e] and raw.strip()][-1:]
        keep = [k or block in above for k, (_, block, _) in zip(keep, found, strict=True)]
    return keep


def main_text(html: str | None) -> str:
    """Blocks of the main part in page order, joined by one space."""
    elements, found = nodes(html or "")
    found, content = unnamed(found)
    blocks: dict[int, list[str]] = {}
    keep = selected(elements, found, content)
    for (_, block, raw), kept in zip(found, keep, strict=True):
        if kept:
            blocks.setdefault(block, []).append(raw)
    texts = (" ".join(unescape("".join(b)).split()) for b in blocks.values())
    return " ".join(t for t in texts if t)


def extract(html: Column) -> Column:
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)
    return F.pandas_udf(run, "string")(html)
