"""Main text of web pages by composite text density.

The page is parsed into a tree, and every node gets a density: characters for each tag, adjusted for the share of
link characters. Text that the page itself declares not to be content (navigation, footers, controls, hidden
elements, adverts and comments by their class) counts as link text, so such elements have density 0. A node's density
sum is the sum over its child blocks, text beside them being one more; the subtree with the largest sum is taken
whole. On its path to the body, a block beside the path stays where its density reaches SHARE of the threshold, which
is the least density on the path up to that place: so sections and headings of an article that is in several
subtrees stay, and sidebars, notices and lists of links go.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.arrow_text import tidy
from brindle.llm.scratch import free_name

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(script|style|textarea|title|noscript|template|iframe|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</\1\s*>|.*)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
#: Of the threshold, what a block beside the path to the body must reach.
SHARE = 0.5
# Fixed sets of HTML element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are no text at all.
_NO_TEXT = frozenset("script style head svg canvas object embed audio video map input".split())
#: Elements that HTML declares not to be main content, or to be controls.
_ASIDE = frozenset("nav footer aside form button select option label legend datalist dialog menu".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table article section div body html main td th blockquote nav aside footer header form".split())
_CONTENT = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of text that stay beside the path if less than half of them is links.
_PLAIN = frozenset("h1 h2 h3 h4 h5 h6 p ul ol dl blockquote pre table figure".split())
#: A class or id token is a mark if one of its words is of the first set and all others are of either.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts sidebar aside menu menus nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager footer masthead topbar comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup popup modal overlay widget widgets toolbar login search skip banner".split()
)
#: Marks that an id in an article stands for too; other ids there are mostly anchors of its sections.
_STRONG = frozenset("ad ads advert adverts advertisement advertising comments commentlist disqus replies respond cookie cookies sidebar".split())
_FILLERS = frozenset("list box wrapper wrap container block section area item inner outer top bottom left right main site page slot unit bar link links post posts form header text content google global primary secondary mobile".split())
_WORD = re.compile(r"[a-z]+|[0-9]+")
_ROLES = frozenset("navigation contentinfo complementary dialog alertdialog alert search menu menubar toolbar banner".split())


class _Node:
    __slots__ = ("tag", "parent", "children", "chars", "links", "tags", "link_tags", "density", "total", "block", "off")

    def __init__(self, tag: str, parent: _Node | None, off: str = ""):
        self.tag, self.parent, self.off = tag, parent, off
        self.children: list[_Node | str] = []
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.block = tag not in _INLINE


@lru_cache(maxsize=1 << 14)
def _marked(value: str, marks: frozenset[str] = _MARKS) -> bool:
    """Whether a token of a class or id attribute marks boilerplate."""
    for token in value.split():
        words = [w for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if not w.isdigit()]
        if any(w in marks for w in words) and all(w in _MARKS or w in _FILLERS for w in words):
            return True
    return False


def _off(tag: str, attributes: str, inside_article: bool) -> str:
    """Why the element isn't content: it is "hidden", a "form", "declared" or "named" so; empty if it may be."""
    if tag in _NO_TEXT:
        return "hidden"
    found: dict[str, str] = {}
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), html.unescape(a or b or c))
        if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.IGNORECASE):
            return "hidden"
    if tag == "form":
        return "form"
    if tag in _ASIDE or (tag == "header" and not inside_article):
        return "declared"
    if tag in _CONTENT or tag in _HEADINGS or tag in ("html", "body"):
        return ""
    if found.get("role", "").strip().lower() in _ROLES:
        return "declared"
    if found.get("role", "").strip().lower() in ("main", "article"):
        return ""
    named = _marked(found.get("class", "")) or _marked(found.get("id", ""), _STRONG if inside_article else _MARKS)
    return "named" if named else ""


def parse(page: str) -> list[_Node]:
    """All nodes that can be seen, parents first; the first is the root."""
    root = _Node("#root", None)
    nodes, node, at = [root], root, 0
    hidden: list[str] = []  # open elements below one that can't be seen
    articles = 0

    def close(target: _Node) -> _Node:
        nonlocal articles, node
        while node is not target:
            articles -= node.tag in _CONTENT
            node = node.parent
        articles -= node.tag in _CONTENT
        return node.parent or root

    for m in _TOKEN.finditer(page):
        if not hidden and m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        raw, slash, tag, attributes = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if hidden:
            if slash:
                if tag in hidden:
                    while hidden.pop() != tag:
                        pass
                elif tag in ("body", "html", *_CONTENT):
                    hidden.clear()  # the hidden element was never closed
                else:
                    continue
                if hidden or tag not in ("body", "html", *_CONTENT):
                    continue
            else:
                if tag not in _VOID and not attributes.endswith("/") and tag not in ("p", "li", "option", "dt", "dd"):
                    hidden.append(tag)
                continue
        if slash:
            up = node
            while up is not root and up.tag != tag:
                if up.tag in _SCOPE and tag in ("p", "li", *_INLINE):
                    up = root
                    break
                up = up.parent
            if up is not root:
                node = close(up)
            continue
        if tag in _VOID:
            if tag not in ("input", "meta", "link", "base"):
                node.tags += 1
            if tag in ("br", "hr", "wbr", "img"):
                node.children.append("\n" if tag != "wbr" else "")
            continue
        ends = _SAME.get(tag, ("p",) if tag not in _INLINE else ())
        up = node
        while ends and up is not root:
            if up.tag in ends:
                node = close(up)
                break
            if up.tag in _SCOPE and up.tag not in ends:
                break
            up = up.parent
        off = _off(tag, attributes, articles > 0)
        if off == "hidden":
            if not attributes.endswith("/"):
                hidden.append(tag)
            continue
        made = _Node(tag, node, off)
        node.children.append(made)
        nodes.append(made)
        if not attributes.endswith("/"):
            node = made
            articles += tag in _CONTENT
    if not hidden and at < len(page):
        node.children.append(page[at:])
    return nodes


def _count(nodes: list[_Node]) -> None:
    """Characters and tags of each subtree, and those of links and of what isn't content."""
    for n in reversed(nodes):
        n.tags += 1
        for c in n.children:
            if isinstance(c, str):
                n.chars += len("".join(c.split()))
            else:
                n.chars += c.chars
                n.tags += c.tags
                n.block = n.block or c.block
    whole = nodes[0].chars
    holds: set[int] = set()  # subtrees around an article
    headed: set[int] = set()  # subtrees around a main heading
    for n in reversed(nodes):
        for found in [holds] * (n.tag in _CONTENT) + [headed] * (n.tag == "h1"):
            up = n.parent
            while up is not None and id(up) not in found:
                found.add(id(up))
                up = up.parent
        if id(n) in holds or (n.off == "form" and (id(n) in headed or 2 * n.chars >= whole)):
            n.off = ""  # it was never closed, or wraps the page
    for n in reversed(nodes):
        for c in n.children:
            if not isinstance(c, str):
                n.links += c.links
                n.link_tags += c.link_tags
        if n.off or n.tag == "a":
            n.links, n.link_tags = n.chars, n.tags


def _density(chars: int, links: int, tags: int, link_tags: int, whole: float) -> float:
    """Composite density; ``whole`` is the share of link characters in the body."""
    if not chars or links >= chars:
        return 0.0
    base = math.log(chars / (chars - links) * links + whole * chars + math.e)
    return chars / tags * max(0.0, math.log(chars / max(1, links) * tags / max(1, link_tags) + 1e-9)) / base


def _measure(nodes: list[_Node], body: _Node) -> None:
    _count(nodes)
    whole = body.links / max(1, body.chars)
    for n in reversed(nodes):
        n.density = _density(n.chars, n.links, max(1, n.tags - 1), n.link_tags, whole)  # of its descendants, or itself
        below = [c for c in n.children if not isinstance(c, str) and c.block]
        if not below or n.off:
            n.total = n.density
            continue
        own = [sum(getattr(c, f) for c in below) for f in ("chars", "links", "tags", "link_tags")]
        n.total = sum(c.density for c in below) + _density(n.chars - own[0], n.links - own[1], max(1, n.tags - 1 - own[2]), n.link_tags - own[3], whole)


def select(nodes: list[_Node]) -> _Node | None:
    """The body with only the main text's subtrees left in it, None if there is no text."""
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    _measure(nodes, body)
    inside, below = {id(body)}, [body]
    for n in nodes:
        if n.parent is not None and id(n.parent) in inside and not n.off:
            inside.add(id(n))
            below.append(n)
    below = [n for n in below if n.chars > n.links and n.block]
    if not below:
        return body if body.chars and not body.off else None
    best = max(below, key=lambda n: n.total)
    threshold, n = best.density, best
    while n is not body:
        up = n.parent
        kept = []
        for c in up.children:
            if c is n or isinstance(c, str):
                kept.append(c)
            elif not c.off and (c.density >= SHARE * threshold or ((c.tag in _PLAIN or not c.block) and 2 * c.links <= c.chars)):
                kept.append(c)
        up.children = kept
        threshold, n = min(threshold, up.density), up
    return body


def blocks(top: _Node) -> list[str]:
    """The texts of all blocks below ``top`` in page order, white space collapsed."""
    out: list[list[str]] = [[]]
    stack: list[_Node | str | None] = [top]
    while stack:
        n = stack.pop()
        if n is None:
            out.append([])
        elif isinstance(n, str):
            out[-1].append(n)
        elif n.off:
            out.append([]) if n.block else None
        elif n.tag in _INLINE:
            stack.extend(reversed(n.children))
        else:
            out.append([])
            stack.append(None)
            stack.extend(reversed(n.children))
    return [t for t in (" ".join(html.unescape("".join(parts)).split()) for parts in out) if t]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    top = select(parse(page))
    return "\n".join(blocks(top)) if top is not None else ""


def extracted(df: DataFrame, text: str = "html", name: str = "extracted") -> DataFrame:
    """``df`` with a struct column: text and n_chars (its code points).

    Null, empty and textless pages give an empty text. Unclosed elements, stray end tags and pages cut off
    anywhere are read as far as they go; pages of any length are read whole. Repeated rows get the same result.
    If ``df`` has a column called ``name``, underscores are put in front. An empty table gives an empty table.
    """
    name = free_name(df, name)
    at = df.columns.index(text)
    schema = df.withColumn(name, F.lit(None).cast("struct<text: string, n_chars: bigint>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = [main_text(p) for p in part.column(at).to_pylist()]
                made = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["text", "n_chars"])
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, name])

    return df.mapInArrow(tidy(run), schema)
