"""Main text of web pages: the article without menus, headers, footers, sidebars, notices, adverts, forms and comments.

The standard library's parser streams its events into lines: the text between two block tags, with the number of tags in
it, its characters in links, and the container that it stands in. Each line's ratio of text outside links to tags is smoothed over its
neighbours by a Gaussian, and a threshold that splits the smoothed ratios in two clusters marks the dense lines.

1. The region: weights (characters of dense lines) are added up along the tree of containers; from the root down, the
   child that holds MOST of the weight is entered, unless an <h1> would be left outside. The region is where no single child
   does, or an <article> or <main> that was entered: what is in it belongs together. On a page that has such elements only
   what is in them counts (in those with dense lines, if any); without them the ratios decide alone.
2. In the region every line stays, however short, but those of a container that is nothing but links, and those marked
   weakly as boilerplate (a part of a class name or id, such as `promo` in `promo-box`, or any mark on a paragraph or list
   item) without a dense line. An ordered list within an article stays, though it be all links (references). Marked lines count as dense by their own ratio, not by their neighbours'.
3. What HTML itself says to be no article text never counts and never stays: script, style, nav, aside, footer, form and
   their like, a header outside of an article, hidden elements, and containers whose role, or whose whole class name or id,
   is that of boilerplate (`class="comments"`). Within an article, names of controls (`class="search"`, `id="form"`) are weak
   marks: such a container stays if it has a dense line.

Text: character references decoded, white space inside a block turned into one space, ends trimmed, blocks in page order,
one line feed between them. Defined results: a null or empty html, or one without content, gives an empty text; a page
without a dense line keeps all lines but marked ones; markup that the end of the page cuts off is dropped; repeated rows
each give a row; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vigilake.llm.common import table

#: Width of the smoothing, in lines.
SIGMA = 1.0
#: A container is entered if it holds this share of the dense text of the one around it; one is nothing but links from this share of its characters on.
MOST, LINKED = 0.9, 0.9

# fixed values: HTML element names by role
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("aside button canvas datalist dialog footer form head iframe map menu nav noscript object option script select style svg template textarea title".split())
_CONTAINER = frozenset("article body center details div fieldset main ol section table ul".split())
_BLOCK = _CONTAINER | _DROP | frozenset("address blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr legend li ol p pre summary tbody td tfoot th thead tr ul".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Of the names below, those of controls and links: prose in a container of such a name is article text after all, if it stands in the article.
_CONTROLS = frozenset("breadcrumb breadcrumbs form header login masthead menu nav navbar navigation search share sharing skip social toolbar widget".split())
_HINTS = frozenset(
    """ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus
    disclaimer footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay popup promo
    promotion related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget""".split()
)


@dataclass(slots=True)
class Line:
    """A block's text, its tags, characters in links, container, the number of the weakly marked element around it (0: none), whether it is an <h1>, and the number of the outermost <article> or <main> around it (0: none)."""

    text: str
    tags: int
    linked: int
    container: int
    marked: int
    title: bool
    article: int


@dataclass(slots=True)
class _Open:
    tag: str
    dropped: bool
    container: int
    marked: int
    article: int


class _Lines(HTMLParser):
    """Collects the lines that are not boilerplate by HTML itself, and the tree of containers (parents[i] is that of container i)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents = [0]
        self.whole = {0: False}  # containers that are not looked into any further
        self.stack = [_Open("", False, 0, 0, 0)]
        self.open: Counter[str] = Counter()  # names in the stack
        self.ordered: set[int] = set()  # containers that are ordered lists in an article
        self.parts: list[str] = []
        self.tags = self.linked = self.marks = self.articles = 0
        self.link = False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.stack[-1].container, self.stack[-1].marked, self.stack[-1].tag == "h1", self.stack[-1].article))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self.flush()
            if self.stack[-1].tag in ("p", "li", "dt", "dd") and self.stack[-1].tag in (tag, "p"):
                self.open[self.stack.pop().tag] -= 1  # its end tag may be left out
        self.tags += 1
        if tag == "a":
            self.link = True
        elif tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        top = self.stack[-1]
        drop, weak = tag in _DROP or (tag == "header" and not top.article), False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                drop = True
            elif name == "role" and value:
                drop |= not _ROLES.isdisjoint(value.lower().split())
            elif name in ("class", "id") and value and tag not in ("html", "body", "main"):
                names = value.lower().split()
                whole = not _HINTS.isdisjoint(names)
                drop |= whole and tag in _CONTAINER and not (top.article and _CONTROLS.issuperset(_HINTS.intersection(names)))
                weak |= whole or not _HINTS.isdisjoint(re.split(r"[^a-z0-9]+", value.lower()))
        if tag in _BLOCK or drop or weak:
            container, marked, article = top.container, top.marked, top.article
            if not drop and not top.dropped:
                if tag in _CONTAINER:
                    self.parents.append(container)
                    container = len(self.parents) - 1
                    self.whole[container] = tag in ("article", "main")
                    if tag == "ol" and article and not weak:
                        self.ordered.add(container)
                    if self.whole[container] and not article:
                        self.articles += 1
                        article = self.articles
                if weak and not marked:
                    self.marks += 1
                    marked = self.marks
            if drop and tag not in _BLOCK and not top.dropped:
                self.parts.append(" ")
            self.stack.append(_Open(tag, top.dropped or drop, container, marked, article))
            self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if tag in _BLOCK:
            self.flush()
        if self.open[tag]:  # every element is closed once, so that stray end tags cost nothing
            while (last := self.stack.pop().tag) != tag:
                self.open[last] -= 1
            self.open[tag] -= 1

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].dropped:
            self.parts.append(data)
            if self.link:
                self.linked += len(data)

    def finish(self) -> list[Line]:
        rest = self.rawdata
        if rest and self.cdata_elem is None and not re.match(r"<[a-zA-Z!/?]", rest):
            self.handle_data(unescape(rest))
        self.flush()
        return self.lines


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    inside = np.convolve(np.ones(len(ratio)), weight)[reach:-reach]
    return np.convolve(ratio, weight)[reach:-reach] / inside


def split_threshold(x: np.ndarray) -> float:
    """The value half-way between the means of the two clusters that it makes."""
    t = float(x.mean())
    for _ in range(50):
        low, high = x[x < t], x[x >= t]
        new = (low.mean() + high.mean()) / 2 if len(low) and len(high) else t
        if abs(new - t) < 1e-9:
            break
        t = float(new)
    return t


def _sums(values: list[int], of: list[int], parents: list[int]) -> list[int]:
    """For each container the sum of the values that stand in it or below it."""
    out = [0] * len(parents)
    for v, c in zip(values, of, strict=True):
        out[c] += v
    for c in range(len(parents) - 1, 0, -1):  # a container's number is above its parent's
        out[parents[c]] += out[c]
    return out


def dense_lines(lines: list[Line]) -> np.ndarray:
    ratio = np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    # as square roots, so that one very long paragraph does not make all others look thin
    smooth = np.sqrt(smoothed(ratio))
    marked = np.array([x.marked > 0 for x in lines])
    return np.where(marked, np.sqrt(ratio), smooth) >= max(split_threshold(smooth), 1e-9)


def region_of(weight: list[int], titles: list[int], parents: list[int], whole: dict[int, bool]) -> int:
    """The container that holds most of the dense text but no child of which does."""
    children = defaultdict(list)
    for c in range(1, len(parents)):
        children[parents[c]].append(c)
    at = 0
    while not whole[at] and (inner := max(children[at], key=weight.__getitem__, default=None)) is not None and weight[inner] >= MOST * weight[at] and titles[inner] == titles[at]:
        at = inner
    return at


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    parents, of = parser.parents, [x.container for x in lines]
    dense = dense_lines(lines)
    if articles := {x.article for x in lines if x.article}:
        articles = {x.article for x, d in zip(lines, dense, strict=True) if d and x.article} or articles
    counts = [not articles or x.article in articles for x in lines]
    sizes = [len(x.text) for x in lines]
    heavy = any(d and c for d, c in zip(dense, counts, strict=True))
    weight = _sums([n * bool(c and (d or not heavy)) for n, d, c in zip(sizes, dense, counts, strict=True)], of, parents)
    at = region_of(weight, _sums([x.title and c for x, c in zip(lines, counts, strict=True)], of, parents), parents, parser.whole)
    inside = [c == at for c in range(len(parents))]
    for c in range(at + 1, len(parents)):
        inside[c] = inside[parents[c]]
    # menus: containers of several lines of nothing but links
    total, linked, several = _sums(sizes, of, parents), _sums([x.linked for x in lines], of, parents), _sums([1] * len(lines), of, parents)
    menu = [c != at and c not in parser.ordered and several[c] > 1 and linked[c] >= LINKED * total[c] for c in range(len(parents))]
    for c in range(at + 1, len(parents)):
        menu[c] |= inside[c] and c != at and menu[parents[c]]
    good = {x.marked for x, d in zip(lines, dense, strict=True) if d}
    return "\n".join(x.text for x, c in zip(lines, counts, strict=True) if c and inside[x.container] and not menu[x.container] and (not x.marked or x.marked in good))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [main_text(x.as_py()) for x in part.column(2)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_extract": op8_html_extract}
#: The given pages have one plain <article> each: its blocks, read by pattern.
ORACLE_SQL = {
    "op8_html_extract": r"""
WITH b AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?(?:p|h1)>') AS blocks FROM pages),
x AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(blocks, lambda t: trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&copy;', chr(169)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda t: t <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM x
""",
}
