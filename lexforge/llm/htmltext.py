"""Main text of web pages by composite text density.

A page becomes a tree. What the contract names as no part of an article (menus, site headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) is cut by element and by class, id or role. Each node left has C
characters and T tags below it, LC and LT of them inside links. Its composite density is C / T times the logarithm of
(C / LC) (T / LT) to a base that grows where a node's link characters are few and where the body's are many; link-heavy
nodes fall to almost nothing. The densities of a node's children add up to its density sum, and the node of the
largest sum is the core of the main text. The least density on its path to the body is the threshold: the core is widened to
nodes of the path that are denser and add more than links, and no text of that subtree is dropped. What stands beside it and falls below the
threshold is left out if most of it is links; headings and other short text without links stay. A marked article that holds the
core bounds the search: it is not widened beyond, and other articles aren't parts of it.

Parsing takes time in proportion to the page: no tag is looked for twice, and open elements are found by tag.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import map_arrow, release, slices

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>")
_PLAIN_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_WHITE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements without markup inside, which only their own end tag ends
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
DROPPED = frozenset((*_RAW_END, *"noscript template head nav aside form button select option datalist dialog menu".split()))
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: opening one of these closes open ones of the second list, up to the scope's edge or another block
_IMPLIED = {
    **{x: (frozenset(("p",)), frozenset("button table td th caption".split())) for x in BLOCKS - frozenset("td th tr tbody thead tfoot caption li dd dt html body".split())},
    "li": (frozenset(("li", "p")), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset(("dt", "dd", "p")), frozenset("dl table td th".split())),
    "dd": (frozenset(("dt", "dd", "p")), frozenset("dl table td th".split())),
    "tr": (frozenset("tr td th p caption".split()), frozenset(("table",))),
    "td": (frozenset("td th p".split()), frozenset(("table", "tr"))),
    "th": (frozenset("td th p".split()), frozenset(("table", "tr"))),
    "tbody": (frozenset("thead tbody tfoot tr td th p caption".split()), frozenset(("table",))),
    "thead": (frozenset("thead tbody tfoot tr td th p caption".split()), frozenset(("table",))),
    "tfoot": (frozenset("thead tbody tfoot tr td th p caption".split()), frozenset(("table",))),
}
#: a stray inline end tag closes nothing beyond the nearest of these
_SCOPES = BLOCKS - frozenset(("p", "li"))
#: words of class, id or role that mark page furniture; compared with whole parts of names
_FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs "
    "sidebar aside rail widget widgets related recommended recommendations "
    "cookie cookies consent gdpr notice notification alert disclaimer popup modal overlay "
    "comment comments commentlist discussion disqus replies respond reply "
    "share sharing social follow subscribe subscription newsletter signup login search searchbox searchform "
    "reviews responses feedback announcement toc topbar "
    "masthead footer colophon complementary contentinfo".split()
)
#: what else a furniture name may be made of: where the thing stands, whose it is, what holds it; any other part makes the name one of content
_BESIDE = frozenset(
    "left right top bottom upper lower main primary secondary site global page post article user reader author mobile desktop sticky fixed float floating "
    "inner outer slot unit box bar bars banner block blocks wrap wrapper container area region zone panel section list item items button buttons link links icon icons form forms widget count header title inline".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: these mark it only where no article is around
_FURNITURE_OUTSIDE = frozenset("copyright legal skip".split())
_CONTENT = frozenset("article content main post entry story body text page wrapper container layout".split())
#: names that only say what else a page has
_WITH = frozenset("has with no without".split())
_SITE_HEADER = frozenset((("header",), ("site", "header"), ("top", "header"), ("global", "header"), ("main", "header")))
_PART = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "holds_article", "chars", "tags", "link_chars", "link_tags", "density", "total", "best")

    def __init__(self, tag: str, attrs: str, parent):
        self.tag, self.attrs, self.parent, self.kids, self.holds_article = tag, attrs, parent, [], False


class _Open:
    """Open elements: a stack, and where in it each tag, each block and each scope stands."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks, self.scopes = [root], {}, [], [0]

    def push(self, node: Node) -> None:
        i = len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.tag, []).append(i)
        if node.tag in BLOCKS or node.tag == "button":
            self.blocks.append(i)
        if node.tag in _SCOPES:
            self.scopes.append(i)

    def close(self, i: int) -> None:
        """Close the element at place i and all inside it."""
        for node in self.stack[i:]:
            self.at[node.tag].pop()
        del self.stack[i:]
        for places in (self.blocks, self.scopes):
            while places and places[-1] >= i:
                places.pop()

    def end(self, tag: str) -> None:
        places = self.at.get(tag)
        if places and (tag in BLOCKS or places[-1] > self.scopes[-1]):
            self.close(places[-1])

    def imply(self, tag: str) -> None:
        ends, edge = _IMPLIED[tag]
        last = None
        for i in reversed(self.blocks):
            other = self.stack[i].tag
            if other in edge or other not in ends:
                break
            last = i
        if last is not None:
            self.close(last)


def parse(page: str) -> Node:
    """Tree of a page: nodes and strings, character references decoded. Unclosed and stray tags are mended by the usual
    implied ends; a < that starts no tag is text."""
    root = Node("html", "", None)
    open_ = _Open(root)
    body = False
    at, n, last, tag_at = 0, len(page), page.rfind(">"), _TAG

    def text(part: str) -> None:
        if part:
            open_.stack[-1].kids.append(htmllib.unescape(part) if "&" in part else part)

    began = 0  # start of text not yet added
    while at < n:
        at = page.find("<", at)
        if at < 0:
            break
        here = page[at + 1 : at + 2]
        if here in "!?" and here:
            text(page[began:at])
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = began = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at + 9)
                text(page[at + 9 : n if end < 0 else end].replace("&", "&amp;"))
                at = began = n if end < 0 else end + 3
            else:
                end = page.find(">", at)
                at = began = n if end < 0 else end + 1
            continue
        if at > last:
            break
        if not (here.isascii() and here.isalpha() or here == "/" and page[at + 2 : at + 3].isascii() and page[at + 2 : at + 3].isalpha()):
            at += 1
            continue
        m = tag_at.match(page, at)
        if not m:  # a quote that nothing closes: from here on quotes hide no tag's end
            tag_at = _PLAIN_TAG
            m = tag_at.match(page, at)
        text(page[began:at])
        at = began = m.end()
        tag, attrs = m.group(1).lower(), m.group(2)
        if here == "/":
            open_.end(tag)
            continue
        if tag in ("html", "body"):
            if tag == "body" and not body:
                body = True
                open_.close(1)
                node = Node("body", attrs, root)
                root.kids.append(node)
                open_.push(node)
            continue
        if tag in _IMPLIED:
            open_.imply(tag)
        node = Node(tag, attrs, open_.stack[-1])
        node.parent.kids.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            continue
        if tag in _RAW_END:
            e = _RAW_END[tag].search(page, at)
            node.kids.append(page[at : e.start() if e else n])
            at = began = e.end() if e else n
            continue
        open_.push(node)
    text(page[began:])
    return root


def _names(attrs: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}


def _named_so(names: dict[str, str], in_article: bool) -> bool:
    """Whether class, id or role mark page furniture: names of such words alone. related, related-box and site-sidebar are, related-work isn't."""
    words = _FURNITURE if in_article else _FURNITURE | _FURNITURE_OUTSIDE
    for key in ("class", "id", "role"):
        for name in (names.get(key) or "").split():
            parts = tuple(p for p in _PART.split(_CAMEL.sub("-", name).lower()) if p)
            if not parts or _WITH.intersection(parts):
                continue
            if parts in _SITE_HEADER and not in_article:
                return True
            content = len(parts) > 1 and parts[-1] in _CONTENT and parts[0] not in _FURNITURE
            if not content and words.intersection(parts) and (words | _BESIDE).issuperset(parts):
                return True
    return False


def is_furniture(node: Node, in_article: bool) -> bool:
    tag = node.tag
    if tag in DROPPED:
        return True
    if tag == "footer" or tag == "header" and not in_article:
        return True
    if not node.attrs or node.holds_article or tag in ("main", "body") or tag in _HEADINGS:
        return False
    return _named_so(_names(node.attrs), in_article)


def mark_articles(root: Node) -> None:
    """Mark every article or main that isn't named like furniture nor inside such, and all around it: no name drops those."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main"):
            if _named_so(_names(node.attrs), True):
                continue
            up = node
            while up is not None and not up.holds_article:
                up.holds_article = True
                up = up.parent
        elif node.tag in DROPPED or node.tag in ("header", "footer") or node.tag == "section" and node.attrs and _named_so(_names(node.attrs), True):
            continue
        stack.extend(k for k in node.kids if not isinstance(k, str))


def prune(node: Node, in_article: bool = False) -> None:
    stack = [(node, in_article)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.kids = [k for k in node.kids if isinstance(k, str) or not is_furniture(k, inside)]
        stack.extend((k, inside) for k in node.kids if not isinstance(k, str))


def _order(root: Node) -> list[Node]:
    """Nodes, parents before children."""
    out = [root]
    for node in out:
        out.extend(k for k in node.kids if not isinstance(k, str))
    return out


def weigh(body: Node) -> list[Node]:
    """Set densities, sums and each subtree's best node."""
    nodes = _order(body)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for k in node.kids:
            if isinstance(k, str):
                node.chars += len(_WHITE.sub(" ", k).strip())
            else:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if not c:
            node.density = 0.0
        else:
            base = math.log(c / max(1, c - node.link_chars) * lc + share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / lc * t / lt) + 1e-9) / math.log(max(base, 1.0 + 1e-6)) if base > 1 else c / t
        kids = [k for k in node.kids if not isinstance(k, str)]
        node.total = sum(k.density for k in kids) + (node.density if not kids else 0.0) * (node.tag in BLOCKS)
        node.best = node
        for k in kids:
            if k.best.total > node.best.total:
                node.best = k.best
    return nodes


def select(body: Node) -> list:
    """Roots of the main text, in page order: the core of the largest density sum, widened by the path's threshold, and what stands beside it.

    The least density on the path from the core to the body is the threshold. The core is widened to nodes of the path that are
    denser than it and add more than links, but not beyond a marked article; all of that subtree stays. Beside it and
    its ancestors stay parts that reach the threshold or aren't mostly links, unless it is an article or they are.
    """
    path = [body.best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    top = 0
    for i, node in enumerate(path[:-1]):
        new, links = node.chars - path[top].chars, node.link_chars - path[top].link_chars
        marked = node.tag in ("article", "main")
        if 2 * links <= new and (node.density > threshold or marked):
            top = i
        if marked:
            break
    main = path[top]
    if main.tag in ("article", "main"):
        return [main]
    chosen: list = [main]
    for below, up in zip(path[top:], path[top + 1 :], strict=False):
        at = next(i for i, k in enumerate(up.kids) if k is below)
        joins = lambda k: isinstance(k, str) or k.tag not in ("article", "main") and (k.density >= threshold or 2 * k.link_chars <= k.chars)
        chosen = [*filter(joins, up.kids[:at]), *chosen, *filter(joins, up.kids[at + 1 :])]
    return chosen


def blocks(chosen: list) -> list[str]:
    """Text blocks of nodes and strings in page order."""
    out: list[str] = []
    part: list[str] = []

    def flush():
        text = _WHITE.sub(" ", "".join(part)).strip()
        if text:
            out.append(text)
        part.clear()

    stack: list = [(k, False) for k in reversed(chosen)]
    while stack:
        item, leave = stack.pop()
        if isinstance(item, str):
            part.append(item)
            continue
        if item.tag in BLOCKS:
            flush()
        if leave:
            continue
        if item.tag == "br":
            part.append(" ")
            continue
        stack.append((item, True))
        stack.extend((k, False) for k in reversed(item.kids))
    flush()
    return out


def extract(page: str | None) -> str:
    """Main text of a page, blocks joined by newlines; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    mark_articles(root)
    prune(root)
    body = next((k for k in root.kids if isinstance(k, Node) and k.tag == "body"), root)
    weigh(body)
    return "\n".join(blocks(select(body)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column("html")):
            part = batch.slice(a, b - a)
            texts = [extract(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])
    release()


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: (id_col, url, text string, n_chars long).

    A null or empty page has empty text. Null or repeated ids keep a row each; an empty table gives none; other
    columns are ignored. Nothing is cut: very long pages are parsed whole, in time that grows with their length. Of nodes
    with equal density sums the outermost and first is taken.
    """
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = src.schema["id"].dataType.simpleString()
    out = map_arrow(src, _extract, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
