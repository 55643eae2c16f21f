"""Main text of HTML pages by tree scoring.

Tags are read into a tree. Each paragraph passes points for its length and commas to its ancestors,
less at each step up; a container's points are discounted by its link density. The best container is
kept with its siblings: beside an article, those that score nearly as well; beside another container,
all whose text is not mostly links. What is known as furniture (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments) is left out.

Defined results: a null or empty page has an empty text; a page without tags is one block; unclosed
and unmatched tags are closed by the nearest rule and never fail, a tag without its ">" takes the rest
of the page; reading takes time in proportion to the page; nesting is walked without recursion;
repeated rows are read one by one; further columns pass through `extract`, and its results replace
columns of the same names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, small_batches

# every part is possessive and a tag that never ends takes the rest of the page, so reading is linear; quotes hold a value together after "=" alone
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_SPACE = re.compile(r"[\s\x00]+")
# elements of HTML, by what they do to the tree and the text: fixed values
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
DROP = {"script", "style", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "head", "title", "nav", "footer", "aside", "form", "button", "select", "textarea", "input", "svg", "canvas", "object", "embed", "dialog", "menu", "audio", "video", "applet"}
CLOSES_P = BLOCK - {"br", "html", "body", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "option", "optgroup", "legend", "summary"}
SAME = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead", "tfoot"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
CLOSES = {"dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot"}, "tfoot": {"tbody", "thead", "tfoot"}, "thead": {"tbody", "thead", "tfoot"}}
CONTAINER = {"article", "body", "div", "main", "section", "td", "blockquote", "html", "center", "dd", "li", "figure", "pre"}
# words of class, id and role values that name furniture: fixed values
FURNITURE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "cookie", "cookies", "consent", "gdpr", "dialog", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "subscribe", "toc", "toolbar", "widget", "complementary", "contentinfo", "alert", "hidden"}
#: A part of a text that is mostly links.
LINKS = 0.5
OWN = {"article", "post", "entry", "story", "content"}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "parent", "items", "drop", "points", "text", "linked")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.items: list = []  # texts and nodes in page order
        self.points, self.text, self.linked = 0.0, 0, 0


def furniture(tag: str, attrs: str) -> bool:
    """Whether an element is left out by its own name or names given to it."""
    if tag in DROP:
        return True
    if not attrs or tag in ("body", "html", "article", "main"):
        return False
    for name, *value in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(value)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id", "role"):
            words = {w.lower() for w in _NAME.findall(value)}
            if words & OWN:  # an article's own header is text
                words.discard("header")
            if words & FURNITURE:
                return True
    return False


def parse(page: str) -> Node:
    root = node = Node("html", None)
    at, n = 0, len(page)
    opened: Counter[str] = Counter()  # open elements below the root, by tag: what is not open is not looked for

    def leave(to: Node) -> Node:
        up = node
        while up is not to:
            opened[up.tag] -= 1
            up = up.parent
        return to

    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            node.items.append(text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                node.items.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            up = node if opened[tag] else root
            while up.parent is not None and up.tag != tag:
                # an end tag of an inline element does not close a block
                up = None if up.tag in BLOCK and tag not in BLOCK else up.parent
                if up is None:
                    break
            if up is not None and up.parent is not None and up.tag == tag:
                node = leave(up.parent)
            elif tag == "p":
                node.items.append(Node("p", node))
            continue
        if tag == "html" or tag == "body" and opened["body"]:
            continue
        if tag in CLOSES_P and opened["p"]:
            node = leave(closed(node, {"p"}, {"table", "td", "th", "button", "article", "section", "div", "li", "blockquote", "body"}))
        if tag in SAME and any(opened[t] for t in CLOSES.get(tag, {tag})):
            node = leave(closed(node, CLOSES.get(tag, {tag}), SAME[tag]))
        if tag == "body":
            node = leave(root)
        child = Node(tag, node, furniture(tag, m[3]) if tag != "header" else not (opened["article"] or opened["main"]))  # a page's header, not an article's
        node.items.append(child)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and (tag in BLOCK or tag in DROP or not m[3].endswith("/")):
            node = child  # a slash closes nothing but a void element
            opened[tag] += 1
    return root


def closed(node: Node, tags: set[str], stop: set[str]) -> Node:
    """The parent of the nearest open element of these tags, if none of stop lies between."""
    up = node
    while up.parent is not None:
        if up.tag in tags:
            return up.parent
        if up.tag in stop:
            return node
        up = up.parent
    return node


def walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Nodes on entering (True) and leaving (False), without those left out."""
    stack: list[tuple[Node, bool]] = [(root, True)]
    while stack:
        node, entering = stack.pop()
        if node.drop and node is not root:
            continue
        yield node, entering
        if entering:
            stack.append((node, False))
            stack += [(c, True) for c in reversed(node.items) if isinstance(c, Node)]


def score(root: Node) -> list[Node]:
    """Gives each node its text length, linked length and points; returns the candidates."""
    found: list[Node] = []
    for node, entering in walk(root):
        if entering:
            continue
        own = "".join(c for c in node.items if isinstance(c, str))
        kids = [c for c in node.items if isinstance(c, Node) and not c.drop]
        size = len(own.strip())
        node.text = size + sum(c.text for c in kids)
        node.linked = node.text if node.tag == "a" else sum(c.linked for c in kids)
        paragraph = node.tag in ("p", "pre", "blockquote", "h1", "h2", "h3") or node.tag in CONTAINER and size >= 25
        if paragraph:
            whole = node.text - node.linked if node.tag == "p" else size
            points = 1 + own.count(",") + min(whole / 100, 3)
            up, share = (node if node.tag in CONTAINER else node.parent), 1.0
            while up is not None and share > 0.05:
                up.points += points * share
                up, share = up.parent, share / 2
        if node.tag in CONTAINER and node.points:
            found.append(node)
    return found


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below the node, white space made one space."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            run.clear()
            if text:
                out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not x.drop or x is node:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.items)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    candidates = score(root)
    if not candidates:
        return "\n".join(blocks(root))
    rated = {id(c): c.points * (1 - c.linked / max(c.text, 1)) for c in candidates}
    best = max(candidates, key=lambda c: (rated[id(c)], c.text))
    semantic = best
    while semantic is not None and semantic.tag not in ("article", "main"):
        semantic = semantic.parent
    best = semantic or best
    if best.parent is None or best.tag in ("body", "html"):
        return "\n".join(blocks(best))
    least = max(10.0, 0.2 * rated.get(id(best), best.points))
    for c in best.parent.items:
        if not isinstance(c, Node) or c is best:
            continue
        density = c.linked / max(c.text, 1)
        if semantic is None:
            c.drop = c.drop or density > LINKS
        else:
            c.drop = c.drop or not (rated.get(id(c), 0) >= least or c.tag == "p" and c.text > 80 and density < 0.25)
    kept = best.parent.items if semantic is None else [c for c in best.parent.items if isinstance(c, Node)]
    shell = Node("div", None)
    shell.items = list(kept)
    return "\n".join(blocks(shell))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars; nothing is shuffled."""
    small_batches(pages.sparkSession)
    keep = pages.drop(*[c for c in ("text", "n_chars") if c != html_col])
    names = keep.columns
    at = names.index(html_col)
    out = [c for c in names if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column(at).to_pylist()]
            rest = [b.column(i) for i, c in enumerate(names) if c != html_col]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*out, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields if f.name != html_col)
    return keep.mapInArrow(run, f"{schema}, text string, n_chars long" if schema else "text string, n_chars long")


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages").select("page_id", "url", "html"))
