"""Main-text extraction from HTML.

The standard-library parser streams its events into *lines*, one for each block element's text, with
the tags met in it.  The ratio of text to tags of each line is smoothed with a Gaussian over its neighbours and
the lines are split by a threshold into two clusters, or are one if they hardly differ.  The content region is every
``article`` and ``main`` element that holds text; if no line of the upper cluster is in one, also the lowest element that holds all lines of that
cluster.  The main text is every line of the region, short ones too, except those inside elements that are never article text (navigation, forms,
scripts...) or stand beside it.

Names of class, id and role are evidence only.  A container with a name such as sidebar, ad or comments stands beside the article unless it holds an
article element or, on a page without one, half of the upper cluster's text.  Names of paragraphs, headings, list items, cells and
inline elements inside an article say nothing, nor do those of inline elements inside a paragraph anywhere; elsewhere a paragraph so named goes if its line is not in the upper cluster.

Elements are nodes that know their parent and the lines between their tags, so work grows with the page's length, however deep it is nested.

Defined cases: null or empty html, and pages without text, give the empty text; an unfinished tag at the end is markup and
goes; unclosed elements end with their parent; white space is what Python's ``split`` takes for it, no-break spaces too; very long pages are one document in memory; of equal
ratios all are in one cluster; repeated rows are extracted each; an empty table gives no rows; other columns pass through, a column named like the text is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Never article text, wherever they stand.
SKIP = frozenset("head title script style noscript template iframe object svg canvas math nav footer aside form button select textarea menu dialog audio video map".split())
ROOTS = frozenset(("article", "main"))
#: Parts of a text, never the element that holds all of it.
PARTS = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption table tbody thead tfoot tr td th caption".split())
#: Parts that are text themselves: their names say nothing inside an article.
TEXTS = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 pre blockquote figcaption caption td th".split())
#: Words of class, id and role that mark parts beside the article.
BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|masthead|topbar|toolbar|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|widget|pagination|pager|skip|legal|copyright|complementary|contentinfo|navigation)(?:$|[\s_-])",
    re.I,
)
_TAIL = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
SIGMA = 1.0
_KERNEL = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-2, 3)]
#: Lines of one kind differ by less than this factor in text for each tag.
ALIKE = 3.0
#: Characters for each tag from which a line is plain text, whatever its neighbours are; lists of links have about half.
PLAIN = 10.0
#: A p that opens ends these; a list item, cell or definition ends its like.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class _Node:
    __slots__ = ("tag", "parent", "depth", "rooted", "silent", "named", "begin", "end")

    def __init__(self, tag: str, parent: _Node | None, begin: int):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.rooted = tag in ROOTS or bool(parent and parent.rooted)  # in an article or main, or one itself
        self.silent = bool(parent and parent.silent)  # never article text
        self.named = False
        self.begin = self.end = begin  # lines between its tags


class _Lines(HTMLParser):
    """Collects (text, tags, innermost open element) of each line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = _Node("", None, 0)
        self.open: list[_Node] = [self.top]
        self.at: dict[str, list[int]] = {}  # places in open of each tag
        self.blocks: list[int] = []
        self.in_part = 0  # open text parts
        self.nodes: list[_Node] = []  # articles and named containers
        self.parts: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, _Node]] = []

    def _line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.open[-1]))
            self.parts = []
        self.tags = 0

    def _pop(self, at: int) -> None:
        """Close the element at a place, and those in it."""
        while len(self.open) > at:
            node = self.open.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
            self.in_part -= node.tag in PARTS
            node.end = len(self.lines)

    def _last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else -1

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._line()
            if tag != "hr":
                if tag not in ("option", "optgroup") and (p := self._last("p")) >= 0:
                    self._pop(p)
                for own in _ENDS.get(tag, ()):
                    if (k := self._last(own)) >= max(1, len(self.open) - 3):
                        self._pop(k)
        elif tag == "br":
            self.parts.append("\n")
        self.tags += 1
        if tag in VOID:
            return
        parent = self.open[-1]
        node = _Node(tag, parent, len(self.lines))
        node.silent = node.silent or tag in SKIP or (tag == "header" and not parent.rooted)
        if not node.silent and attrs and tag not in ("html", "body", *ROOTS) and any(v and BESIDE.search(v) for k, v in attrs if k in ("class", "id", "role")):
            if tag not in BLOCK:
                node.silent = not self.in_part
            elif tag not in TEXTS or not parent.rooted:
                node.named = True
        if node.named or tag in ROOTS:
            self.nodes.append(node)
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.in_part += tag in PARTS
        self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._line()
        self.tags += 1
        at = self._last(tag)
        # an inline element never ends blocks opened inside it
        if at >= 0 and (tag in BLOCK or not self.blocks or self.blocks[-1] < at):
            self._pop(at)

    def handle_data(self, data):
        if not self.open[-1].silent:
            self.parts.append(data)

    def unknown_decl(self, data):
        pass

    def finish(self) -> None:
        self._line()
        self._pop(1)
        self.top.end = len(self.lines)


def parsed(html: str) -> _Lines:
    parser = _Lines()
    html = _TAIL.sub("", html)
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # a malformed declaration: read it as text-free markup
        parser = _Lines()
        parser.feed(re.sub(r"<!(?!--)[^>]*>?", "", html))
        parser.close()
    parser.finish()
    return parser


def smoothed(values: list[float]) -> list[float]:
    out, reach = [], len(_KERNEL) // 2
    for i in range(len(values)):
        near = [(values[i + k], _KERNEL[k + reach]) for k in range(-reach, reach + 1) if 0 <= i + k < len(values)]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def threshold(values: list[float]) -> float:
    """Between two clusters of the values (two-means in one dimension)."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        a, b = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not a or not b:
            break
        new = (sum(a) / len(a), sum(b) / len(b))
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def text_from(ratios: list[float]) -> float:
    """The least ratio of the upper cluster.  Ratios are compared by their factors, and all are one cluster if the means differ by less than ``ALIKE``."""
    logs = [math.log(r) for r in ratios]
    cut = threshold(logs)
    low, high = [v for v in logs if v < cut], [v for v in logs if v >= cut]
    if not low or not high or sum(high) / len(high) - sum(low) / len(low) < math.log(ALIKE):
        return min(ratios)
    return min(r for r, v in zip(ratios, logs, strict=True) if v >= cut)


def _upper(lines: list[tuple[str, int, _Node]]) -> list[bool]:
    """Is a line in the upper cluster?"""
    own = [len(text) / (1 + tags) for text, tags, _ in lines]
    ratio = smoothed(own)
    cut, own_cut = text_from(ratio), min(PLAIN, text_from(own))
    # a line of markup beside text is smoothed into the upper cluster and says nothing about the region
    out = [r >= cut and o >= own_cut for r, o in zip(ratio, own, strict=True)]
    return out if any(out) else [r >= cut for r in ratio]


def _beside(page: _Lines) -> list[bool]:
    """Does a line stand in an element beside the article?"""
    lines, gone = page.lines, [0] * (len(page.lines) + 1)
    named = [n for n in page.nodes if n.named and n.end > n.begin]
    if named:
        upper, size, articles = _upper(lines), [0], [0] * (len(lines) + 1)
        for (text, _, _), up in zip(lines, upper, strict=True):
            size.append(size[-1] + len(text) * up)
        roots = [n for n in page.nodes if n.tag in ROOTS and n.end > n.begin]
        for n in roots:
            articles[n.begin] += 1
        before = [0]
        for x in articles:
            before.append(before[-1] + x)
        for n in named:
            if n.tag in TEXTS:
                beside = not any(upper[n.begin : n.end])
            elif roots:  # an article that begins in it is no part of a page beside the article
                beside = n.rooted or before[n.end] == before[n.begin]
            else:
                beside = 2 * (size[n.end] - size[n.begin]) < size[-1]
            if beside:
                gone[n.begin] += 1
                gone[n.end] -= 1
    out, depth = [], 0
    for k in range(len(lines)):
        depth += gone[k]
        out.append(depth > 0)
    return [False] * len(lines) if all(out) else out


def _shared(a: _Node, b: _Node) -> _Node:
    """The lowest element that holds both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def main_text(html: str | None) -> str:
    page = parsed(html or "")
    beside = _beside(page)
    lines = [(k, x) for k, (x, gone) in enumerate(zip(page.lines, beside, strict=True)) if not gone]
    if not lines:
        return ""
    upper = [(k, x[2]) for (k, x), up in zip(lines, _upper([x for _, x in lines]), strict=True) if up]
    keep = [n.rooted for _, (_, _, n) in lines]
    if not any(n.rooted for _, n in upper):
        region = upper[0][1]
        for _, n in (upper[0], upper[-1]):
            region = _shared(region, n)
        region = _holding(region, upper[0][0], upper[-1][0])
        while region.parent and (region.tag not in BLOCK or region.tag in PARTS):
            region = region.parent
        whole = region if region.tag in BLOCK and region.tag not in PARTS else page.top
        keep = [k or whole.begin <= at < whole.end for k, (at, _) in zip(keep, lines, strict=True)]
    return "\n\n".join(text for k, (_, (text, _, _)) in zip(keep, lines, strict=True) if k)


def _holding(node: _Node, first: int, last: int) -> _Node:
    """The lowest element from ``node`` up that holds the lines first to last."""
    while node.parent and not (node.begin <= first and last < node.end):
        node = node.parent
    return node


def extract(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """All columns of ``pages`` and the string column ``into``."""
    wanted = [c for c in pages.columns if c != into]
    keep = [c for c in wanted if c != html_col]
    d = pages.select(*keep, F.col(html_col).cast("string").alias(common.free_name(pages, "__html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x.as_py()) for x in b.column(len(keep))], pa.large_string() if b.nbytes > 1 << 30 else pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], texts], names=[*keep, into])

    from pyspark.sql import types as T

    return d.mapInArrow(run, T.StructType([*(d.schema[c] for c in keep), T.StructField(into, T.StringType())]))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
