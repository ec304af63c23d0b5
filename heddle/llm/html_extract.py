"""Main text of web pages: text-to-tag ratios of parser events, smoothed and thresholded.

One streaming pass of the standard library's HTMLParser cuts a page into lines at block elements. A
line keeps its text, the tags seen in it and its chain of containers. Lines inside elements that are
boilerplate by their meaning (nav, aside, footer, form, roles such as banner, hidden parts, scripts, styles)
never count as text. A line's ratio is its characters outside links to its tags; ratios are smoothed by a
Gaussian, and lines over the ratios' standard deviation form the content cluster.

Class and id names (menus, sidebars, notices, adverts, reader comments) only weigh: lines inside parts so
named count DOUBT of their characters. If the cluster then holds more of other text, the doubtful lines go;
if not, the names don't tell on this page, and none of them counts. The length of a text never matters.

The cluster selects a region: the article and main elements that hold the cluster's text, a main alone if it
holds most, with the page's titles (h1) if they have none; where such elements don't hold most of it, the lowest
container of the whole cluster and of the titles. All lines of the region are returned, the short ones too, but
for lines of nothing but links that lie outside article and main before the first or after the last of the cluster.

Edge cases: null or empty html, and pages without text, give ""; a page whose only text is in parts named as
boilerplate gives that text; a head that isn't closed ends at the first tag or text that can't be in one; other
unclosed elements end where their parent does; very long pages are parsed in one pass; repeated rows each give a
row; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import common

SIGMA = 1.0
#: Share of the content cluster's text that article and main elements must hold to be the region.
MOST = 0.6
#: What a character in a part that is named like boilerplate counts.
DOUBT = 0.05

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article body div main section td html".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "nav footer aside form button select textarea script style noscript template iframe svg canvas object audio video map head title dialog menu annotation annotation-xml".split()
)
ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar form note status tooltip".split())
#: Parts of class and id names that hint at boilerplate, unless a layout is said to have them or not.
MARKS = re.compile(
    r"(?:^|[\s_-])(?<!has[_-])(?<!with[_-])(?<!no[_-])(?<!without[_-])"
    r"(?:ad|ads|adv|advert\w*|adsense|adsby\w*|banner\w*|billboard|breadcrumbs?|comments?|commentlist|colophon|consent|cookies?|copyright|discussion|disqus|disclaimer|foot|footer\w*|gdpr|legal"
    r"|login|\w*menus?|menubar|modal|(?:top|side|main|sub|site|global|foot)?nav|navbar|navigation|newsletter|notices?|noticebox|notification|alert|overlay|pagination|pager|popup|privacy|promo\w*|rail"
    r"|recommend\w*|related|replies|respond|responses?|search\w*|share\w*|sharing|sidebar\w*|sidebox|signup|skip|social\w*|sponsor\w*|subscribe|subscription|taboola|outbrain|taglist|toolbar|topbar|warning|widget\w*)"
    r"(?=$|[\s_-])",
    re.I,
)
#: Outside an article these hint at the page's own header; inside, the article's.
HEADS = re.compile(r"(?:^|[\s_-])(?<!has[_-])(?<!with[_-])(?<!no[_-])(?:header\w*|masthead)(?=$|[\s_-])", re.I)
#: What a head may hold.
IN_HEAD = frozenset("head base basefont bgsound link meta title noscript noframes script style template".split())
#: An end tag closes what is open inside it, but not beyond these.
FENCES = frozenset("article aside body footer header html main nav section table".split())
#: Start tags of these end an open p.
ENDS_P = BLOCKS - {"html", "body", "tbody", "td", "tfoot", "th", "thead", "tr", "caption"}


def _boilerplate(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate by its meaning, and whether by its names.

    inside: within an article or main element, where a header holds the article's own title.
    """
    if tag in SKIPPED or tag == "header" and not inside:
        return True, False
    doubt = False
    for k, v in attrs:
        v = v or ""
        if k in ("class", "id"):
            if tag in ("html", "body", "article", "main"):
                if tag == "article" and "comment" in v.lower():
                    return True, False
            elif MARKS.search(v) or not inside and HEADS.search(v):
                doubt = True
        elif tag in ("html", "body"):
            continue
        elif k == "role":
            if v.lower() in ROLES:
                return True, False
        elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none", v, re.I):
            return True, False
    return False, doubt


class Line(NamedTuple):
    text: str
    plain: int  # characters outside links, without space
    tags: int
    container: int
    title: bool  # in an h1
    doubt: bool  # in a part named like boilerplate


class _Lines(HTMLParser):
    """Cuts a page into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links = 0  # open
        self.plain = 0
        self.open: list[tuple[str, bool, bool, int]] = []  # tag, begins a skipped part, begins a doubtful part, container
        self.parents = [-1]  # of containers
        self.kinds = [""]  # their tags
        self.skip = self.doubt = self.inside = 0
        self.seen_article = False
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            title = bool(text) and any(x[0] == "h1" for x in self.open)
            self.lines.append(Line(text, self.plain, self.tags, self.open[-1][3] if self.open else 0, title, self.doubt > 0))
        self.text, self.tags, self.plain = [], 0, 0

    def pop(self) -> None:
        tag, skips, doubts, _ = self.open.pop()
        self.skip -= skips
        self.doubt -= doubts
        self.inside -= tag in ("article", "main")
        self.links -= tag == "a"

    def end_head(self) -> None:
        at = next((i for i, x in enumerate(self.open) if x[0] == "head"), None)
        while at is not None and len(self.open) > at:
            self.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self.end_head()
        if tag in BLOCKS:
            self.end_line()
            if tag in ENDS_P:
                self.end("p", FENCES)
            if tag in ("li", "dt", "dd", "tr", "td", "th"):
                self.end(tag, FENCES | {"ul", "ol", "dl", "tr", "td", "th"} - {tag})
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        bad, doubt = _boilerplate(tag, attrs, self.inside > 0)
        if tag in ("article", "main") and not bad and not self.seen_article:
            while (self.skip or self.doubt) and self.open:  # menus that were never closed end here
                self.pop()
            self.seen_article = True
        at = self.open[-1][3] if self.open else 0
        if tag in CONTAINERS:
            self.parents.append(at)
            self.kinds.append(tag)
            at = len(self.parents) - 1
        self.open.append((tag, bad, doubt, at))
        self.skip += bad
        self.doubt += doubt
        self.inside += tag in ("article", "main")
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def end(self, tag: str, fences: frozenset | set) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self.pop()
                return
            if self.open[i][0] in fences:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        self.end(tag, frozenset(("body", "html")) if tag in FENCES else FENCES)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self.end_head()
        if not self.skip:
            self.text.append(data)
            if not self.links:
                self.plain += len(data) - sum(map(str.isspace, data))


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """x under a Gaussian window, the ends weighted by what is there."""
    reach = int(np.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return (np.convolve(x, kernel, "full") / np.convolve(np.ones(len(x)), kernel, "full"))[reach : reach + len(x)]


def cluster(lines: list[Line]) -> np.ndarray:
    """Which lines have a smoothed ratio of text to tags over the ratios' standard deviation."""
    size = np.array([x.plain * (DOUBT if x.doubt else 1) for x in lines], dtype=float)
    ratios = smooth(size / np.maximum([x.tags for x in lines], 1))
    return (ratios >= ratios.std()) & (size > 0)


def _lowest(parents: list[int], at: list[int]) -> int:
    """The lowest container around all of at."""
    low = at[0]
    for c in at[1:]:
        while c != low:
            if c > low:
                c = parents[c]
            else:
                low = parents[low]
    return low


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines
    if any(x.doubt for x in lines):
        # do the names tell? not if most of what stands out is in parts so named
        held = [0.0, 0.0]
        for x, here in zip(lines, cluster(lines), strict=True):
            if here:
                held[x.doubt] += x.plain * (DOUBT if x.doubt else 1)
        if held[0] >= held[1] and held[0]:
            lines = [x for x in lines if not x.doubt]
        else:
            lines = [x._replace(doubt=False) for x in lines]
    if not any(x.text for x in lines):
        return ""
    content = cluster(lines)
    if not content.any():
        content = np.array([bool(x.text) for x in lines])
    # containers are numbered as they open: a child's number is larger than its parent's
    top = [-1] * len(parser.parents)  # the outermost article or main around each
    for c, parent in enumerate(parser.parents):
        top[c] = top[parent] if parent >= 0 and top[parent] >= 0 else c if parser.kinds[c] in ("article", "main") else -1
    held: dict[int, float] = defaultdict(float)
    for i in np.flatnonzero(content):
        held[top[lines[i].container]] += len(lines[i].text)
    whole = sum(held.values())
    titles = [i for i, x in enumerate(lines) if x.title]
    if whole - held.pop(-1, 0.0) >= MOST * whole:
        mains = [c for c, v in held.items() if parser.kinds[c] == "main" and v >= MOST * whole]
        tops = set(mains or held)
        own = any(top[lines[i].container] in tops for i in titles)
        inside = [top[x.container] in tops or x.title and not own for x in lines]
    else:
        region = _lowest(parser.parents, [lines[i].container for i in (*np.flatnonzero(content), *titles)])
        under = [c == region for c in range(len(parser.parents))]
        for c, parent in enumerate(parser.parents):
            under[c] |= parent >= 0 and under[parent]
        inside = [under[x.container] for x in lines]
    first, last = np.flatnonzero(content)[[0, -1]]
    return "\n\n".join(
        x.text for i, (x, here) in enumerate(zip(lines, inside, strict=True))
        if x.text and here and (x.plain or first <= i <= last or top[x.container] >= 0)
    )


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    d = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return common.map_arrow(d, run, "page_id long, url string, text string, n_chars long")
