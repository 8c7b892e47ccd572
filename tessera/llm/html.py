"""Main text of web pages by composite text density.

The page becomes a tree.  Each node has a number of characters, tags, link characters and link
tags; its composite density is its characters per tag, adjusted for links: text inside links
lowers it, the more the larger the body's own share of link text.  A node's density sum is the
sum over its children.  The threshold is the smallest density on the path from the body to the
node with the largest density sum.  From the body down, each branch whose density reaches the
threshold has the subtree with its largest density sum marked; the marked subtrees, in page order,
are the main content, so an article split over sibling containers is whole.  An article or main
element on the path reaches the threshold as well; it is the content by itself.

Of the content, blocks that are not part of it are left out: elements made for something else, and
blocks whose class or role says so.  Such words count only where the text agrees: not for a block
around most of the page's unlinked text or around its only article, and words with other meanings
(tags, search, notice) only for blocks of links, below the threshold, or small beside the content.

Parsing and measuring take time in proportion to the page, however broken its tags are.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select option textarea button".split())

#: Elements that never belong to an article.
ASIDE = frozenset("nav footer aside form menu dialog".split())

#: Elements without content.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements whose content is taken as it stands up to the end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())

#: Elements that start and end a block of text.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())

#: An open element that the named start tags end.
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
    "tbody": frozenset(["tr", "td", "th", "tbody", "thead", "tfoot"]), "thead": frozenset(["tr", "td", "th", "tbody", "thead", "tfoot"]), "tfoot": frozenset(["tr", "td", "th", "tbody", "thead", "tfoot"]),
}
SCOPE = frozenset("table td th caption html body article section div main aside nav header footer form ul ol dl".split())
ENDS_P = BLOCK - frozenset(["br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"])
INLINE = frozenset("b i em strong a span u s small big code font tt abbr cite mark q sub sup ins del label time var kbd samp strike".split())

#: Elements that are menus where links make up most of them, outside of articles.
LISTS = frozenset("ul ol dl div section table center".split())

#: Words in class, id, role or aria-label that mark what is not the article; the last ones mean other things too.
TALK = "comments? replies respond disqus"
PLAIN = r"ads? advert\w* sponsor\w* promo\w* sidebar share sharing social cookies? consent gdpr popup modal newsletter subscribe signup login breadcrumbs? pagination pager menu nav\w* footer masthead toolbar copyright contentinfo complementary navigation"
VAGUE = r"banner side widget related recommend\w* notice skip tags? search alert"
#: What an element is marked by; FIXED by its name or because it is hidden.
FREE, VAGUELY, PLAINLY, AS_TALK, FIXED = range(5)
WORDS = [(mark, re.compile(rf"(?:^|[\s_\-])(?:{words.replace(' ', '|')})(?=$|[\s_\-])", re.I)) for mark, words in ((AS_TALK, TALK), (PLAINLY, PLAIN), (VAGUELY, VAGUE))]
WHOLE = frozenset("html body main article".split())
HOLDS = frozenset(["article", "main", "h1"])
#: Elements that frame other blocks; marks on others are weighed against their links.
FRAMES = frozenset("div section ul ol dl header center details fieldset".split())
#: Elements that hold quoted or arranged text of an article: any mark on them needs links.
QUOTED = frozenset("table thead tbody tr td th blockquote pre figure h1 h2 h3 h4 h5 h6".split())

START = re.compile(r"<(?:!--|[!?]|/?([a-zA-Z][a-zA-Z0-9:-]*))")
QUOTES = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([a-zA-Z:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")


class Node:
    __slots__ = ("aside", "characters", "children", "density", "link_characters", "link_tags", "mark", "name", "parent", "sum", "tags")

    def __init__(self, name: str, parent: Node | None, mark: int = FREE) -> None:
        self.name, self.parent, self.mark, self.aside = name, parent, mark, False
        self.children: list[Node | str] = []
        self.characters = self.tags = self.link_characters = self.link_tags = 0
        self.density = self.sum = 0.0


def mark_of(attributes: str) -> int:
    """What the attributes of a start tag say that the element is marked as."""
    out = FREE
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        value = a or b or c
        name = name.lower()
        if hidden or (name == "aria-hidden" and value.lower() == "true"):
            return FIXED
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return FIXED
        if name in ("class", "id", "role", "aria-label"):
            out = max([out, *(mark for mark, words in WORDS if words.search(value))])
    return out


class Tags:
    """The tags of a page, one after another, in time proportional to its length."""

    def __init__(self, page: str) -> None:
        self.page, self.quoted = page, True

    def next(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """(start, end, name or None, is it an end tag?, attributes) of the first tag from ``at`` on."""
        page = self.page
        while (m := START.search(page, at)) is not None:
            start = m.start()
            if m[0] == "<!--":
                end = page.find("-->", m.end())
                return start, len(page) if end < 0 else end + 3, None, False, ""
            end = self.close(m.end(), m[1] is not None)
            if end < 0:
                return None  # nothing behind is a tag either
            return start, end, m[1], m[0].startswith("</"), page[m.end() : end - 1]
        return None

    def close(self, at: int, quoted: bool) -> int:
        """Behind the > that ends a tag, not inside quotes; once quotes do not close, they count for nothing."""
        page, begin = self.page, at
        while self.quoted and quoted:
            m = QUOTES.search(page, at)
            if m is None:
                break
            if m[0] == ">":
                return m.end()
            at = page.find(m[0], m.end()) + 1
            if at == 0:
                break
        else:
            return page.find(">", begin) + 1 or -1
        self.quoted = False
        return page.find(">", begin) + 1 or -1


def parse(page: str) -> Node:
    """The element tree; end tags that are missing or too many are put up with."""
    root = Node("html", None)
    here, at, size, tags = root, 0, len(page), Tags(page)
    opened: dict[str, int] = {}  # open elements by name

    def close(to: Node) -> Node:
        nonlocal here
        while here is not to:
            opened[here.name] -= 1
            here = here.parent
        return here

    while at < size:
        tag = tags.next(at)
        if tag is None:
            here.children.append(page[at:])
            break
        start, end, name, closing, attributes = tag
        if start > at:
            here.children.append(page[at:start])
        at = end
        if name is None:
            continue
        name = name.lower()
        if closing:
            node = here if opened.get(name) else None
            while node is not None and node.name != name:
                if name in INLINE and node.name in SCOPE:
                    node = None  # a stray inline end tag ends no block
                    break
                node = node.parent
            if node is not None and node.parent is not None:
                close(node.parent)
            continue
        if name in ("html", "body"):
            if name == "body" and here.name != "body":
                close(root)
                here = Node("body", root)
                opened["body"] = opened.get("body", 0) + 1
                root.children.append(here)
            continue
        if name in ENDS_P and opened.get("p"):
            node = here
            while node is not None and node.name != "p" and node.name not in SCOPE:
                node = node.parent
            if node is not None and node.name == "p":
                close(node.parent)
        ends = CLOSES.get(name)
        while ends and here.parent is not None and here.name in ends:
            close(here.parent)
        node = Node(name, here, FIXED if name in ASIDE else FREE if name in WHOLE else mark_of(attributes))
        here.children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\s*[^>]*>", re.I).search(page, at)
            if name == "textarea" or name not in SILENT:
                node.children.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif name not in EMPTY and not attributes.rstrip().endswith("/"):
            here = node
            opened[name] = opened.get(name, 0) + 1
    return root


def walk(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    out = [root]
    for node in out:
        out.extend(c for c in node.children if isinstance(c, Node) and c.name not in SILENT)
    return out


def measure(root: Node) -> list[Node]:
    """Fill in counts, densities and density sums; the nodes, parents before children."""
    nodes = walk(root)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.characters += len("".join(c.split()))
            elif c.name not in SILENT:
                node.characters += c.characters
                node.tags += c.tags + 1
                node.link_characters += c.link_characters
                node.link_tags += c.link_tags + (c.name == "a")
        if node.name == "a":
            node.link_characters = node.characters
    share = root.link_characters / root.characters if root.characters else 0.0
    for node in nodes:
        node.density = density(node, share)
    for node in reversed(nodes):
        node.sum = sum(c.density for c in node.children if isinstance(c, Node) and c.name not in SILENT)
    return nodes


def density(node: Node, share: float) -> float:
    """Characters per tag, scaled by a logarithm that falls with the node's link characters and link tags."""
    if node.characters == 0:
        return 0.0
    c, t, lc, lt = node.characters, max(node.tags, 1), node.link_characters, max(node.link_tags, 1)
    plain = max(c - lc, 1)
    base = math.log(c / plain * lc + share * c + math.e)
    value = max(c / max(lc, 1) * t / lt, 1.0 + 1e-9)
    return c / t * math.log(value) / base


def main_nodes(root: Node) -> list[Node]:
    """The subtrees, in page order, that the threshold of the body's path marks; or the article around the largest density sum."""
    nodes = measure(root)
    _set_aside(nodes, root)
    live = _live(nodes)
    if not live:
        return [root]
    top = max(live, key=lambda n: n.sum)
    if top.sum <= 0:
        return [max(live, key=lambda n: n.density) if any(n.density > 0 for n in live) else root]
    path, node = [], top
    while node is not None:
        path.append(node)
        node = node.parent
    threshold = min(n.density for n in path if n.name != "html" or n is top)
    on_path = set(path)
    for n in live:  # words that mean other things too
        if n.mark == VAGUELY and n not in on_path:
            framed = n.name in FRAMES and (n.density < threshold or 4 * n.characters < top.characters)
            n.aside = framed or 3 * n.link_characters >= n.characters
    live = _live(live)
    found = next((n for n in path if n.name in ("article", "main")), None)  # text belongs to the article around it, if there is one
    if found:
        return [found]
    best: dict[Node, Node] = {}  # the largest density sum of each subtree
    for n in reversed(live):
        best[n] = max([n, *(best[c] for c in n.children if isinstance(c, Node) and c in best)], key=lambda x: x.sum)
    barred: set[Node] = set()  # what blocks() leaves out
    marked = {top}
    for n in live:  # parents before children
        if n.parent in barred or n.name == "header" or (n.name in LISTS and 2 * n.link_characters > n.characters):
            barred.add(n)
        elif n.density >= threshold and n.name != "html":
            marked.add(best[n])
    marked = {n for n in marked if n is top or n not in barred}
    out, stack = [], [root]
    while stack:  # marked subtrees that are in no other
        n = stack.pop()
        if n in marked:
            out.append(n)
        else:
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return out


def _set_aside(nodes: list[Node], root: Node) -> None:
    """Which elements are plainly not the article, by their names and marks, where their text agrees."""
    plain = root.characters - root.link_characters
    holds: dict[Node, set[str]] = {}  # of article, main and h1, the elements inside
    for n in reversed(nodes):
        holds[n] = set().union(*({c.name} & HOLDS | holds[c] for c in n.children if isinstance(c, Node) and c in holds))
        links = 2 * n.link_characters >= n.characters
        n.aside = n.mark in (FIXED, AS_TALK) or (n.mark == PLAINLY and (links or n.name not in QUOTED))
        if n.aside and n.mark == PLAINLY and 2 * (n.characters - n.link_characters) > plain:
            n.aside = False  # a mark on the frame around the article ("with-sidebar") does not mean the article
    inside = _inside(nodes)
    if not any(n.name in ("article", "main") and not inside[n] for n in nodes):
        for n in nodes:
            if n.aside and n.name not in ("nav", "footer", "aside", "menu"):
                most = n.mark == FIXED and "h1" in holds[n] and 2 * (n.characters - n.link_characters) > plain
                n.aside = not (holds[n] - {"h1"} or most)


def _inside(nodes: list[Node]) -> dict[Node, bool]:
    """Is each node (parents before children) inside an element that was set aside, or one itself?"""
    out: dict[Node, bool] = {}
    for n in nodes:
        out[n] = n.aside or out.get(n.parent, False)
    return out


def _live(nodes: list[Node]) -> list[Node]:
    inside = _inside(nodes)
    return [n for n in nodes if not inside[n]]


def blocks(node: Node) -> list[str]:
    """The text of a subtree, block by block, without what is not the article."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(part)).split())
        part.clear()
        if text:
            out.append(text)

    article = _in_article(node)
    stack: list[tuple[Node | str | None, bool]] = [(node, article)]
    while stack:
        x, article = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            part.append(x)
        elif x.name in SILENT or (x.aside and x is not node):
            continue
        elif x.name == "header" and not article:
            continue
        elif not article and x is not node and x.name in LISTS and 2 * x.link_characters > x.characters:
            continue  # a menu
        else:
            article = article or x.name == "article"
            if x.name in BLOCK:
                flush()
                stack.append((None, article))
            stack.extend((c, article) for c in reversed(x.children))
    flush()
    return out


def _in_article(node: Node | None) -> bool:
    while node is not None:
        if node.name == "article":
            return True
        node = node.parent
    return False


def main_text(page: str | None) -> str:
    """The main text of a page; empty for null, for an empty page and for one without text."""
    if not page:
        return ""
    return " ".join(b for node in main_nodes(parse(page)) for b in blocks(node))


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            text = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null and empty pages give an empty text; repeated rows are extracted each; pages of any length
    are read whole; of subtrees with equal density sums the first one counts; other columns are not
    read, whatever their names; an empty table gives an empty result.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(extract_batches, f"page_id {kind}, url string, text string, n_chars long")
