"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf tag path. Per path the text length and the punctuation are summed and divided by
the path's nodes; both ratios are smoothed over the paths in the order of their first appearance, fused by their
product, and compared with a threshold taken from their spread over the page's nodes. The element that holds nearly
all text of the paths above the threshold is the container. Within it a text node is content if the logarithm of its
path's weight over the threshold, plus what else speaks for it (an article or main element, or the container alone) and
minus what speaks against it (the header of the article, a list of links), is not negative. Elements that are marked as
navigation, advert, form, comment and so on are left out of all this, unless they lie around the article or around
most of the content. The work is linear in the size of a page, however deep its tags are nested.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.store import bounded_batches, pieces

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption head html body legend option tbody td tfoot th thead tr".split())
CLOSES = {k: (v, s) for ks, v, s in (
    (("li",), ("li",), ("ul", "ol", "menu", "dir")), (("dt", "dd"), ("dt", "dd"), ("dl",)), (("tr",), ("tr", "td", "th"), ("table",)),
    (("td", "th"), ("td", "th"), ("tr", "table")), (("option",), ("option",), ("select", "datalist")), (("body",), ("head",), ()),
) for k in ks}
DROPPED = frozenset(
    "head nav footer aside script style noscript template iframe svg math button select textarea title menu dialog object embed canvas audio video".split()
)
#: Kinds that may also wrap the whole page; they count as a mark.
WRAPPERS = frozenset(["form"])
#: Words of class and id attributes, and roles, that mark what is not the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|notification\w*|alerts?|popup|modal|newsletter"
    r"|subscribe|sidebar|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|commentlist|disqus|repl(?:y|ies)|respond|share|sharing|social|related"
    r"|recommend\w*|widgets?|toolbar|pagination|pager|login|signup|search)(?=$|[\s_-])",
    re.I,
)
#: Words that mark the head of a page, but also that of an article; within an article or main element they only weigh.
HEADS = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form".split())
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…]")

SHARE = 0.9
SPREAD = 1.5
#: Weights of evidence, as logarithms of odds: a node of an article or main element, or of a container that only the
#: ratios chose; a header within it; a list of links outside an article.
IN_ARTICLE = 12.0
IN_CONTAINER = 7.0
IN_HEAD = 4.0
IN_LINKS = 7.0


class _Node:
    """An element. ``path`` numbers its tag path, ``last`` is the number of its last descendant. The flags tell what it
    or an element around it is: dropped, an article, main, a link, a paragraph, the head of an article; ``blocks``
    counts block elements on the way; ``mark`` is the nearest marked element."""

    __slots__ = ("tag", "parent", "number", "last", "depth", "path", "dropped", "article", "main", "link", "prose", "head", "blocks", "marked", "mark", "off")

    def __init__(self, tag: str, parent: _Node | None, number: int, path: int, dropped: bool, marked: bool = False, head: bool = False):
        self.tag, self.parent, self.number, self.last, self.path, self.marked = tag, parent, number, number, path, marked
        self.depth = parent.depth + 1 if parent else 0
        self.dropped = dropped
        self.article = tag == "article" or parent is not None and parent.article
        self.main = tag == "main" or parent is not None and parent.main
        self.link = tag == "a" or parent is not None and parent.link
        self.prose = tag == "p" or parent is not None and parent.prose
        self.head = head or parent is not None and parent.head
        self.blocks = (parent.blocks if parent else 0) + (tag in BLOCK)
        self.mark = self if marked else parent.mark if parent else None
        self.off = False


class _Tree:
    """The elements in page order, and which of each kind are open."""

    def __init__(self):
        self.paths: dict[tuple[int, str], int] = {}
        self.top = _Node("#", None, 0, 0, False)
        self.nodes = [self.top]
        self.open: dict[str, list[_Node]] = defaultdict(list)

    def push(self, tag: str, label: str, dropped: bool, marked: bool, head: bool) -> None:
        path = self.paths.setdefault((self.top.path, label), len(self.paths) + 1)
        self.top = _Node(tag, self.top, len(self.nodes), path, self.top.dropped or dropped, marked, head)
        self.nodes.append(self.top)
        self.open[tag].append(self.top)

    def close(self, node: _Node) -> None:
        """Closes ``node`` and all that is open in it."""
        while self.top is not node.parent:
            self.open[self.top.tag].pop()
            self.top = self.top.parent

    def nearest(self, tags) -> _Node | None:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), key=lambda x: x.depth, default=None)


def _tag_end(page: str, at: int) -> int:
    """The position of the ``>`` that ends the tag begun at ``at``, past quoted values; -1 if there is none."""
    end = page.find(">", at)
    quote = min((q for q in (page.find('"', at, end), page.find("'", at, end)) if q >= 0), default=-1)
    if end < 0 or quote < 0:
        return end
    i = at
    while True:
        end = page.find(">", i)
        quotes = [q for q in (page.find('="', i, end), page.find("='", i, end)) if q >= 0]
        if end < 0 or not quotes:
            return end
        close = page.find(page[min(quotes) + 1], min(quotes) + 2)
        if close < 0:
            return -1
        i = close + 1


def text_nodes(page: str) -> tuple[list[tuple[str, _Node, int]], list[_Node]]:
    """((raw text, element, block number) of every text node, all elements), in page order. Never fails on broken markup."""
    tree = _Tree()
    at, out, block = 0, [], 0
    size = len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            out.append((page[at:lt], tree.top, block))
        if lt == size:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        closing = page.startswith("/", lt + 1)
        name = _TAG_NAME.match(page, lt + 1 + closing)
        if not name:
            if page[lt + 1 : lt + 2] in ("!", "?") or closing and lt + 2 < size:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                out.append((page[lt], tree.top, block))
                at = lt + 1
            continue
        end = _tag_end(page, name.end())
        if end < 0:
            break  # the page ends within a tag
        tag, at = name[0].lower(), end + 1
        if tag in BLOCK:
            block += 1
        if closing:
            node = tree.nearest((tag,))
            # an inline element isn't closed from within a block of its own
            if node is not None and (tag in BLOCK or tree.top.blocks == node.blocks):
                tree.close(node)
            continue
        if tag == "br":
            out.append((" ", tree.top, block))
        if tag in CLOSES_P:
            node = tree.nearest(("p", "table", "td", "th", "article", "section", "div", "body"))
            if node is not None and node.tag == "p":
                tree.close(node)
        if tag in CLOSES:
            ends, scope = CLOSES[tag]
            edge = tree.nearest(scope)
            edge = -1 if edge is None else edge.depth
            while (node := tree.nearest(ends)) is not None and node.depth > edge:
                tree.close(node)
        if tag in VOID:
            continue
        rest = page[name.end() : end]
        label, dropped, marked, head = tag, tag in DROPPED, tag in WRAPPERS, False
        if rest.strip(" /"):
            given = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(rest)}
            marks = given.get("class", "") + " " + given.get("id", "")
            label += "." + given["class"].split()[0] if given.get("class", "").strip() else ""
            if tag not in ("html", "body", "article", "main"):
                marked |= bool(MARKS.search(marks) or given.get("role", "").lower() in ROLES)
                head = bool(HEADS.search(marks))
            dropped |= "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        if (head or tag == "header") and not (tree.top.article or tree.top.main):
            marked = True
        head = head or tag == "header"
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = size if stop is None else stop.start()
            continue
        if not (rest.endswith("/") and tag in ("svg", "path", "circle", "rect")):
            tree.push(tag, label, dropped, marked, head)
    for node in reversed(tree.nodes[1:]):
        node.parent.last = max(node.parent.last, node.last)
    return out, tree.nodes


def _fused(nodes: list[tuple[str, _Node, int]]) -> dict[int, float]:
    """Of each tag path, the product of its smoothed text and punctuation ratios."""
    length: dict[int, int] = defaultdict(int)
    points: dict[int, int] = defaultdict(int)
    count: dict[int, int] = defaultdict(int)
    for text, node, _ in nodes:
        length[node.path] += len(text)
        points[node.path] += len(_PUNCTUATION.findall(text))
        count[node.path] += 1
    ratios = [(length[p] / n, (points[p] + 1) / n) for p, n in count.items()]
    padded = [ratios[0], *ratios, ratios[-1]] if ratios else []
    smooth = [[(padded[i - 1][k] + 2 * padded[i][k] + padded[i + 1][k]) / 4 for k in (0, 1)] for i in range(1, len(padded) - 1)]
    return {p: a * b for p, (a, b) in zip(count, smooth, strict=True)}


def _threshold(nodes: list[tuple[str, _Node, int]], weights: dict[int, float]) -> float:
    """One and a half standard deviations of the weights of the page's text nodes, but never above all of them. Where
    the weights are of two kinds, near nought and near some value, this is at most three quarters of that value."""
    each = [weights[n.path] for _, n, _ in nodes]
    mean = sum(each) / len(each)
    spread = (sum((w - mean) ** 2 for w in each) / len(each)) ** 0.5
    return min(max(each), max(1e-9, SPREAD * spread))


def _content(nodes: list[tuple[str, _Node, int]]) -> list[tuple[str, _Node]]:
    """The nodes whose path's weight is above the threshold."""
    weights = _fused(nodes)
    limit = _threshold(nodes, weights)
    return [(t, n) for t, n, _ in nodes if weights[n.path] >= limit]


def _lift_marks(nodes: list[tuple[str, _Node, int]], elements: list[_Node]) -> None:
    """Takes the marks off elements around the article, from the outside in. While no article or main element with
    text is outside all marks, that is the outermost marked element with most content, if it holds a main element, or
    an article and at least as much content as is outside all marks, or over half of all content."""
    own: dict[_Node | None, int] = defaultdict(int)  # content whose nearest mark it is
    tags: dict[_Node | None, set[str]] = defaultdict(set)
    for text, node in _content(nodes):
        own[node.mark] += len(text)
    for _, node, _ in nodes:
        tags[node.mark] |= {t for t, there in (("article", node.article), ("main", node.main)) if there}
    marks = [x for x in elements if x.marked]
    held, inside, below = dict(own), {k: set(v) for k, v in tags.items()}, defaultdict(list)
    for x in reversed(marks):  # children before their parents
        above = x.parent.mark
        held[above] = held.get(above, 0) + held.get(x, 0)
        inside.setdefault(above, set()).update(inside.get(x, ()))
        below[above].append(x)
    total, free, found = held.get(None, 0), own[None], set(tags[None])
    heaps: dict[str, list] = {"main": [], "article": [], "any": []}

    def enter(marked: list[_Node]) -> None:
        for x in marked:
            for kind, heap in heaps.items():
                if kind == "any" or kind in inside.get(x, ()):
                    heapq.heappush(heap, (-held.get(x, 0), x.number, x))

    enter(below[None])
    while not found:
        for heap in heaps.values():
            while heap and not heap[0][2].marked:
                heapq.heappop(heap)
        if heaps["main"]:
            lifted = heaps["main"][0][2]
        else:
            fit = [h[0] for k, h in heaps.items() if h and (k == "article" and -h[0][0] >= free or k == "any" and -2 * h[0][0] > total)]
            if not fit:
                return
            lifted = min(fit)[2]
        lifted.marked = False
        free += own[lifted]
        found |= tags[lifted]
        enter(below[lifted])


def _container(nodes: list[tuple[str, _Node, int]], content: list[tuple[str, _Node]], elements: list[_Node]) -> tuple[_Node, bool]:
    """(the element that holds the article, whether it is an article or main element)."""
    held = [0] * len(elements)
    for text, node in content:
        held[node.number] += len(text)
    total = sum(held)
    for x in reversed(elements[1:]):
        held[x.parent.number] += held[x.number]
    named = [x for x in elements if x.tag in ("article", "main") and held[x.number] >= 0.5 * total]
    if named:
        return min(named, key=lambda x: x.depth), True
    node = max((x for x in elements if held[x.number] >= SHARE * total), key=lambda x: x.depth)
    while (node.tag not in BLOCK or node.tag == "p") and node.parent is not None:
        node = node.parent
    return node, False


def main_text(page: str | None) -> str:
    """The blocks of the article, each with single spaces, joined by two line feeds; empty if there is none."""
    found, elements = text_nodes(page or "")
    nodes = [x for x in found if not x[1].dropped and not x[0].isspace()]
    if not nodes:
        return ""
    if any(x.marked for x in elements):
        _lift_marks(nodes, elements)
    for x in elements:
        x.off = x.dropped or x.marked or x.parent is not None and x.parent.off
    nodes = [x for x in nodes if not x[1].off]
    if not nodes:
        return ""
    weights = _fused(nodes)
    limit = _threshold(nodes, weights)
    article, named = _container(nodes, [(t, n) for t, n, _ in nodes if weights[n.path] >= limit], elements)

    def speaks(node: _Node) -> bool:
        evidence = math.log(weights[node.path] / limit) + (IN_ARTICLE if named else IN_CONTAINER)
        evidence -= IN_HEAD * node.head + IN_LINKS * (not named and node.link and not node.prose)
        return evidence >= 0

    blocks: dict[int, list[str]] = defaultdict(list)
    kept: set[int] = set()
    for text, node, block in found:
        if article.number <= node.number <= article.last and not node.off:
            blocks[block].append(text)
            if not text.isspace() and speaks(node):
                kept.add(block)
    lines = (" ".join(html.unescape("".join(parts)).split()) for block, parts in blocks.items() if block in kept)
    return "\n\n".join(x for x in lines if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "html", 4 << 20):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html; other columns are ignored): page_id, url, text, n_chars.

    Null and empty html, and pages without an article, have the empty text. Null page_id and url stay null, repeated
    rows are extracted each, an empty table gives an empty result.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
