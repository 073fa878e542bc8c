"""Main text of HTML pages by tree scoring.

A page is read into a tree of elements and blocks of text. Parts that are never article text
(menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles, what
is hidden) are cut off; a class or id cuts an element only if all words of the name speak of such
a part, and never the element that holds the article. Each remaining block earns points for its
length and its commas, discounted by the share of its text inside links; its container takes
them, and each element above takes half of what the one below it has. The best container,
discounted by its own link density, is kept whole. If it is in an article or main element, that
element is the container, and others beside it are kept likewise; else what stands beside it, and
beside each element above it, is kept unless half of its text or more is links.

Blocks are the stretches of text between block-level tags. Character references are decoded,
white space inside a block becomes one space, blocks are joined in page order by an empty line.
Every step goes through the page or the tree once, so the time grows with the page's length.

Defined results: null, empty or text-free html gives an empty text; plain text without tags
is one block; very long pages are read whole; tags that are never closed, or closed without being
opened, do no harm; a tag with a quote that is never closed ends at its first ``>``; of containers
that tie, the one with more text wins, then the first; repeated rows get equal texts; an empty
table gives an empty table. ``extract`` keeps the other columns; a ``text`` column among them
gives way to the extracted text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_TAG_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "svg", "math")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CUT_TAGS = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe svg math canvas object embed menu dialog".split())
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Names of page parts that are not article text, as whole words of a class or id.
_CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar rail "
    "masthead topbar footer comment comments reply replies disqus discussion respond cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup "
    "popup modal overlay paywall related recommended share sharing social widget pagination pager login".split()
)
#: Of these, parts written by readers: long ones are no reason to take them for the article.
_READERS = frozenset("comment comments reply replies disqus discussion respond".split())
#: Words that say nothing of a part but its place or shape; beside a name of the list above they leave it one.
_NEUTRAL = frozenset(
    "site page global main top bottom left right upper lower sticky fixed primary secondary wrapper wrap container box block area section row col column inner outer bar panel list item items "
    "links link icons buttons button form text title header body content posts post articles stories unit slot zone holder group set js".split()
) - {"content", "post", "body", "text", "title", "main"}
_KEEP_TAGS = frozenset(("html", "body", "article", "main"))
#: A start tag of the first set closes open elements of the second, but not past one of the third.
_CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}


class _Node:
    __slots__ = ("tag", "up", "block", "cut", "inside", "named", "text", "main", "points", "chars", "linked", "place")

    def __init__(self, tag: str, up: "_Node | None", cut: bool, inside: bool, named: int = 0):
        self.tag, self.up, self.cut, self.inside, self.named = tag, up, cut, inside, named
        self.block: _Node = self if up is None or tag not in _INLINE else up.block  # the nearest that is no inline element
        self.text, self.main = 0, False
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.place = 0  # 1: kept, 2: holds the container, 0: neither


def _named_part(value: str, inside: bool) -> int:
    """Whether a class or id names a part that is cut: 1, and 2 for a part written by readers."""
    part = 0
    for name in value.split():
        words = {w for w in re.split(r"[^a-z0-9]+", _CAMEL.sub(" ", name).lower()) if w and not w.isdigit()}
        named = words & _CUT_NAMES or (words & {"header"} if not inside else set())
        if named and words <= _CUT_NAMES | _NEUTRAL | {"header"}:
            part = max(part, 1 if _READERS.isdisjoint(words) else 2)
    return part


def _is_cut(tag: str, attributes: str, inside: bool) -> tuple[bool, int]:
    """Whether the element is cut off for certain; whether its class or id says so (1, and 2 for a part written by readers)."""
    if tag in _CUT_TAGS or tag == "header" and not inside:
        return True, 0
    named = 0
    if not attributes or tag in _KEEP_TAGS:
        return False, named
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            named = max(named, _named_part(value, inside))
        elif name == "role" and value.lower() in _CUT_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, named
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, named
    return False, named


def _without_named(made: list[_Node], found: list[tuple[_Node, str, int]]) -> list[tuple[_Node, str, int]]:
    """The blocks outside of elements cut by class or id. A name does not cut what holds the article.

    That is an element with most of the page's text, a main, or an article longer than all text outside
    of such elements; none if there is an article or main outside, or if readers wrote it.
    """
    if not any(n.named for n in made):
        return found
    outside = {id(n): not n.named for n in made if n.up is None}
    for n in made:  # an element comes after the one it is in
        if n.up is not None:
            outside[id(n)] = outside[id(n.up)] and not n.named
    free = 0
    for block, text, _ in found:
        free += len(text) if outside[id(block)] else 0
        block.text += len(text)
    whole = sum(len(text) for _, text, _ in found)
    article = {}
    for n in reversed(made):
        if n.tag in ("article", "main") and not n.cut:
            article[id(n)] = n.text
            n.main |= n.tag == "main"
        if n.up is not None:
            n.up.text += n.text
            n.up.main |= n.main and not n.cut
            article[id(n.up)] = max(article.get(id(n.up), 0), article.get(id(n), 0))
    apart = any(outside[id(n)] and n.tag in ("article", "main") and n.text for n in made)
    left: dict[int, bool] = {}
    for n in made:
        stays = not n.named or n.named == 1 and not apart and (2 * n.text > whole or n.main and n.text > 0 or article.get(id(n), 0) > free)
        left[id(n)] = stays and (n.up is None or left[id(n.up)])
    return [b for b in found if left[id(b[0])]]


def blocks_of(page: str) -> tuple[list[tuple[_Node, str, int]], list[_Node]]:
    """The page's blocks outside of what is cut off (element, text, characters in links), and its elements, each after the one it is in."""
    root = _Node("", None, False, False)
    stack, out, made = [root], [], [root]
    parts: list[tuple[str, bool]] = []
    links, loose = 0, False
    open_: Counter[str] = Counter()
    unclosed: set[str] = set()

    def end_block() -> None:
        nonlocal parts
        if parts and not stack[-1].cut:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(p for p, of_link in parts if of_link)).split()))
                out.append((stack[-1].block, text, linked))
        parts = []

    def pop_to(n: int) -> None:
        nonlocal links
        for node in stack[n:]:
            links -= node.tag == "a"
            open_[node.tag] -= 1
        del stack[n:]

    def tag_end(at: int) -> int:
        """Where the tag ends; quotes hide a ``>``, until one is met that is never closed."""
        nonlocal loose
        first = page.find(">", at)
        while not loose and first >= 0:
            stop = _TAG_STOP.search(page, at)
            if stop is None:
                loose = True
            elif stop[0] == ">":
                return stop.start()
            else:
                at = page.find(stop[0], stop.end()) + 1
                loose = at == 0
        return first

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append((page[at:], links > 0))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        if m[2] is None:
            end = page.find("-->" if m[0] == "<!--" else ">", m.end())
            at = size if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        end = tag_end(m.end())
        if end < 0:  # no tag ends any more
            parts.append((page[m.start() :], links > 0))
            break
        at, attributes, tag = end + 1, page[m.end() : end], m[2].lower()
        if tag == "br":
            parts.append((" ", links > 0))
            continue
        if tag not in _INLINE:
            end_block()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if tag in _INLINE and stack[k].tag not in _INLINE:
                    break  # an inline end tag closes nothing outside of its block
            continue
        if tag not in _INLINE:
            for k in range(len(stack) - 1, 0, -1) if open_["p"] else ():
                if stack[k].tag == "p":  # a block ends an open paragraph
                    pop_to(k)
                    break
                if stack[k].tag not in _INLINE:
                    break
            if tag in _CLOSES:
                ends, stops = _CLOSES[tag]
                lowest = None
                for k in range(len(stack) - 1, 0, -1) if any(open_[t] for t in ends) else ():
                    if stack[k].tag in stops:
                        break
                    if stack[k].tag in ends:
                        lowest = k
                if lowest:
                    pop_to(lowest)
        if tag in _VOID or attributes.endswith("/") and tag in ("svg", "math", "iframe"):
            continue
        if tag in _RAW:
            closing = _RAW[tag].search(page, at)
            at = closing.end() if closing else size
            continue
        up = stack[-1]
        inside = up.inside or tag in ("article", "main")
        cut, named = _is_cut(tag, attributes, inside)
        node = _Node(tag, up, up.cut or cut, inside, named)
        if tag in _INLINE and (node.cut or named) and not up.cut:
            # A hidden or advert span: its text must not enter the block.
            closing = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if closing is None:
                unclosed.add(tag)
            at = closing.end() if closing else at
            continue
        stack.append(node)
        made.append(node)
        open_[tag] += 1
        links += tag == "a"
    end_block()
    return _without_named(made, out), made


def _share(node: _Node) -> float:
    return 1 - node.linked / node.chars if node.chars else 0.0


#: Elements that are one block of their container.
_LEAVES = frozenset("p pre h1 h2 h3 h4 h5 h6 blockquote li td th dd dt".split())


def main_text(page: str | None) -> str:
    found, made = blocks_of(page or "")
    for block, text, linked in found:
        block.chars += len(text)
        block.linked += linked
        own = block.up if block.tag in _LEAVES and block.up is not None else block
        own.points += (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
    for n in reversed(made):
        if n.up is not None:
            n.up.points += n.points / 2
            n.up.chars += n.chars
            n.up.linked += n.linked
    best = max(made, key=lambda n: (n.points * _share(n), n.chars))
    above, container = best, best
    while above is not None:
        if above.tag in ("article", "main"):
            container = above
        above = above.up
    whole = container.tag in ("article", "main")
    above = container.up
    while above is not None:
        above.place = 2
        above = above.up
    for n in made:
        up = n.up
        if n is container or up is not None and up.place == 1:
            n.place = 1
        elif n.place != 2 and up is not None and (n.tag in ("article", "main") if whole else up.place == 2):
            n.place = 1 if _share(n) > 0.5 else 0
    kept = (text for block, text, linked in found if block.place == 1 or block.place == 2 and not whole and 2 * linked < len(text))
    return "\n\n".join(kept)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` with a text column in place of the html."""
    others = [c for c in pages.columns if c not in (html_column, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h) for h in batch.column(html_column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), texts], [*others, "text"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pages.select(others).dtypes) + ", text string"
    return pages.select(*others, html_column).mapInArrow(run, schema)
