"""Main text of web pages by composite text density.

Elements that never hold main text go first, then those named like page furniture; a name that only speaks of a layout
counts for nothing where most of the page's text stands below it. Every node left gets a density: characters
per tag, reduced where characters stand in links. The thinnest node on the path from the body to the node whose
children's densities have the largest sum gives the threshold. Below the body, every branch that is as dense as
that gives its subtree of the largest sum, in page order, with the headings before it. No tag counts as the article by its name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head script style noscript template form nav footer aside menu dialog iframe object button select "
    "textarea input svg canvas audio video map fieldset".split()
)
BLOCK = frozenset(
    "html body address article blockquote br caption center dd details div dl dt fieldset figcaption figure "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# An opening tag of the key ends an open element of the values, up to the nearest of the barriers.
ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr main menu nav ol p pre section table ul".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
HEADS = frozenset(f"h{n}" for n in range(1, 7))
# Elements that are parts of a text and not a text of their own.
PARTS = frozenset("p blockquote pre li ul ol dl dt dd table tbody tr td th".split())

# Parts of class and id names of page furniture.
FURNITURE = frozenset(
    "ad ads advert advertisement adverts advertising adbox banner banners sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside rail footer masthead topbar "
    "comment comments commentary disqus reply replies respond discussion cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup paywall share sharing social related "
    "recommended recommendations widget widgets pagination pager skip toolbar tags login search outbrain taboola".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
# A name that says that an element has or lacks furniture, or whether some is shown, is no furniture.
STATES_BEFORE = frozenset("has no not with without".split())
STATES_AFTER = frozenset("open closed enabled disabled".split())
# Furniture names that layouts use for other things too, and what then stands beside them in one name.
LAYOUT = frozenset("widget widgets sidebar sidebars rail".split())
CONTENT = frozenset(
    "article body container content editor entry grid heading layout main page post story text title wrap wrapper".split()
)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


class Node:
    __slots__ = ("tag", "items", "parent", "dropped", "layout")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.items: list[Node | str] = []
        # Furniture by name, unless most of the text says otherwise: these names.
        self.layout: frozenset[str] = frozenset()


def _names_of(value: str) -> tuple[set[str], bool]:
    """Furniture words of a class or id, and whether one that layouts use stands beside a word for content."""
    found, layout = set(), False
    for name in _CAMEL.sub(r"\1 \2", value).lower().split():
        parts = _NAME.findall(name)
        if parts and parts[-1] in STATES_AFTER:
            continue
        state = next((k for k, part in enumerate(parts) if part in STATES_BEFORE), len(parts))
        words = FURNITURE.intersection(parts[:state])
        found |= words
        layout |= not (LAYOUT.isdisjoint(words) or CONTENT.isdisjoint(parts))
    return found, layout


def _is_furniture(tag: str, attrs: list[tuple[str, str | None]], parent: Node) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header":
        # The header of an article holds its title; another is the page's.
        while parent is not None and parent.tag not in ("article", "main"):
            parent = parent.parent
        return parent is None
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if name in ("class", "id") and value:
            names, layout = _names_of(value)
            if names and not (layout and names <= LAYOUT):
                return True
        elif name == "role" and value and value.strip().lower() in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def _layout_names(tag: str, attrs: list[tuple[str, str | None]]) -> frozenset[str]:
    if tag in ("html", "body", "article", "main"):
        return frozenset()
    return frozenset().union(*(_names_of(value)[0] for name, value in attrs if name in ("class", "id") and value))


class _Tree(HTMLParser):
    """Builds nodes from tag soup: implied ends are closed, stray end tags ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.body: Node | None = None
        self.has_layout = False

    def _close(self, tags: set[str] | frozenset[str], barriers: set[str] | frozenset[str]) -> None:
        node = self.at
        while node is not self.root and node.tag not in barriers:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag == "html" or (tag == "body" and self.body):
            return
        if tag in ENDS_P:
            self._close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in HEADS and self.at.tag in HEADS:
            self.at = self.at.parent
        if tag in ENDS:
            self._close(ENDS[tag], BARRIERS[tag])
        if tag == "body":
            self.at = self.root
        node = Node(tag, self.at, self.at.dropped or _is_furniture(tag, attrs, self.at))
        if attrs and not node.dropped:
            node.layout = _layout_names(tag, attrs)
            self.has_layout = self.has_layout or bool(node.layout)
        self.at.items.append(node)
        if tag == "body":
            self.body = node
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("div", "p", "span", "a", "script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        node = self.at
        while node is not self.root and node.tag != tag:
            if node.tag in ("body", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        if not self.at.dropped:
            self.at.items.append(data)


def weights(body: Node) -> dict[Node, list[int]]:
    """Characters, tags, characters in links and links below every kept node, parents before children."""
    order, todo = [], [(body, False)]
    while todo:
        node, linked = todo.pop()
        linked = linked or node.tag == "a"
        order.append((node, linked))
        todo += [(x, linked) for x in node.items if isinstance(x, Node) and not x.dropped]
    totals: dict[Node, list[int]] = {}
    for node, linked in reversed(order):
        chars = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        sums = [chars, 0, chars if linked else 0, 0]
        for x in node.items:
            if isinstance(x, Node) and not x.dropped:
                below = totals[x]
                sums = [a + b for a, b in zip(sums, below)]
                sums[1] += 1
                sums[3] += x.tag == "a"
        totals[node] = sums
    return {node: totals[node] for node, _ in order}


def drop_layout(body: Node) -> None:
    """Drops nodes named like furniture of a layout, but not those that hold a page's text.

    Where the nodes without such a name hold less than a quarter of the text of the body, those of the names that most of
    the text has, more than half of all, stay if at most a third of theirs stands in links. What is below them is
    judged in the same way.
    """
    totals = weights(body)
    scopes = [body]
    while scopes:
        scope = scopes.pop()
        outermost, todo = [], [scope]
        while todo:
            for x in todo.pop().items:
                if isinstance(x, Node) and not x.dropped:
                    (outermost if x.layout else todo).append(x)
        if not outermost:
            continue
        total = totals[scope][0]
        plain: dict[frozenset[str], int] = {}
        for x in outermost:
            plain[x.layout] = plain.get(x.layout, 0) + totals[x][0] - totals[x][2]
        names = max(plain, key=plain.__getitem__)
        telling = 4 * (total - sum(totals[x][0] for x in outermost)) >= total or 2 * plain[names] <= total
        for x in outermost:
            if telling or x.layout != names or 3 * totals[x][2] > totals[x][0]:
                x.dropped = True
            else:
                scopes.append(x)


def densities(totals: dict[Node, list[int]]) -> dict[Node, tuple[float, float]]:
    """Composite density and the sum of the children's densities, for every node of ``weights``."""
    all_chars, _, all_linked, _ = next(iter(totals.values()))
    share = all_linked / all_chars if all_chars else 0.0

    def density(node: Node) -> float:
        chars, tags, link_chars, link_tags = totals[node]
        if not chars:
            return 0.0
        base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
        ratio = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
        return chars / max(1, tags) * max(0.0, math.log(max(ratio, 1e-9)) / max(base, 1e-9))

    own = {node: density(node) for node in totals}
    return {
        node: (own[node], sum(own[x] for x in node.items if isinstance(x, Node) and not x.dropped))
        for node in totals
    }


def articles(body: Node) -> list[Node | str]:
    """The main text's subtrees, and pieces of text between them, in page order.

    Down from the body, each node at least as dense as the threshold of the body's path gives the node of the
    largest sum in its subtree; nodes below one that is not are not looked at. Headings are too short for the
    threshold: those that stand right before such a subtree, or a node that holds one, come with it. A part of a
    text, like a paragraph, stands for the block around it, or in the body for the paragraphs beside it. Below the body
    what stands between kept nodes of one container, or between its heading and the first of them, comes with
    them, and so do later nodes of the same tag; if at most a third of it stands in links.
    """
    totals = weights(body)
    found = densities(totals)
    if len(found) == 1:
        return [body]
    # Parents come before their children in ``found``; of equal sums the outer and then the first one counts.
    peak: dict[Node, Node] = {}
    for node in reversed(found):
        peak[node] = max(
            [node, *(peak[x] for x in node.items if isinstance(x, Node) and not x.dropped)], key=lambda n: found[n][1]
        )
    threshold, node = found[peak[body]][0], peak[body]
    while node is not body:
        node = node.parent
        threshold = min(threshold, found[node][0])
    # Parts of a text do not stand alone: the block around them is the text.
    whole: dict[Node, Node] = {}
    for node in found:
        part = node.tag not in BLOCK or node.tag in PARTS
        whole[node] = whole[node.parent] if part and node is not body and node.parent is not body else node
    chosen, dense, todo = set(), set(), [body]
    while todo:
        node = todo.pop()
        if found[node][0] < threshold:
            continue
        dense.add(node)
        chosen.add(whole[peak[node]])
        todo += [x for x in node.items if isinstance(x, Node) and not x.dropped]
    holding = set()
    for node in chosen:
        while node not in holding:
            holding.add(node)
            node = node.parent or node
    out: list[Node | str] = []
    walk: list[Node | str] = [body]
    while walk:
        x = walk.pop()
        if isinstance(x, str) or x in chosen or x not in dense:
            out.append(x)
            continue
        kept, following = [], False
        places = [k for k, item in enumerate(x.items) if isinstance(item, Node) and item in holding]
        # What surrounds kept nodes: from the first heading before them, and of their tags behind them.
        first = last = len(x.items)
        if places and x is not body:
            heads = (k for k, item in enumerate(x.items) if isinstance(item, Node) and not item.dropped and item.tag in HEADS | {"hgroup", "header"})
            first, last = min(next(heads, places[0]), places[0]), places[-1]
        tags = {x.items[k].tag for k in places}

        def beside(k: int, item: Node) -> bool:
            chars, _, linked, _ = totals[item]
            return first <= k and (k < last or item.tag in tags) and chars > 0 and 3 * linked <= chars

        paragraphs = any(isinstance(item, Node) and item in chosen and item.tag in PARTS for item in x.items)
        for k, item in reversed(list(enumerate(x.items))):
            if isinstance(item, str):
                # Text between elements counts as one tag without links.
                if len("".join(item.split())) >= threshold or first <= k < last:
                    kept.append(item)
            elif not item.dropped and item.tag in HEADS | {"hgroup", "header"}:
                if following or item in holding or beside(k, item):
                    kept.append(item)
            elif not item.dropped:
                following = item in holding or beside(k, item) or (paragraphs and item.tag in ("p", "blockquote", "pre"))
                if following:
                    kept.append(item)
        walk += kept
    return out


def blocks(nodes: list[Node | str]) -> list[str]:
    """Texts of the blocks of subtrees in page order, white space made single spaces."""
    found: list[str] = []
    parts: list[str] = []

    def finish() -> None:
        text = " ".join("".join(parts).split())
        if text:
            found.append(text)
        parts.clear()

    todo: list[Node | str | None] = []
    for node in reversed(nodes):
        todo += [None, node]
    while todo:
        x = todo.pop()
        if x is None:
            finish()
        elif isinstance(x, str):
            parts.append(x)
        elif not x.dropped:
            if x.tag in BLOCK:
                finish()
                todo.append(None)
            todo += reversed(x.items)
    finish()
    return found


def main_text(html: str | None) -> str:
    """The main text of a page; empty for null, empty and textless pages."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    body = tree.body or tree.root
    if tree.has_layout:
        drop_layout(body)
    return "\n".join(blocks(articles(body)))


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` and its length ``n_chars`` in code points.

    Null and empty pages have an empty text. Rows stand for themselves, so repeated rows give equal
    texts. Columns with the names of results are replaced; an empty table gives no rows.
    """
    results = ("text", "n_chars")
    pages = pages.drop(*(c for c in pages.columns if c.lower() in results and c != html_column))
    carried = [f for f in pages.schema.fields if f.name.lower() != html_column.lower()]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py()) for value in batch.column(html_column)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in carried), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())],
                [*(f.name for f in carried), "text", "n_chars"],
            )

    return pages.mapInArrow(extract, StructType([
        *carried, StructField("text", StringType()), StructField("n_chars", LongType()),
    ]))
