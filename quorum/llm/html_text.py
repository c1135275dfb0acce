"""Main text of HTML pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser is fed in pieces and its events build lines: a line ends where a block element begins or
ends, and counts its characters and its tags. Navigation, headers of the page, footers, asides, dialogs, scripts and the like are
markup by their element: they add tags to lines and no text, and an inline one (a button, say) does not end the line around it. The ratio
of characters to tags is smoothed over neighbouring lines, and the lines are split into content and the rest where two clusters of the
smoothed ratios part. The content region is the innermost element that holds all clustered content, but not a list or table, what is
in one, one of several sibling sections or articles, or a mere part of an article; all its lines that are not markup are the text, short ones too.

Class and id names only hint. A name counts if it consists of words for boilerplate ("sidebar", "related-posts") and of neutral ones
beside them, so "has-sidebar" and "related-work" do not. A hinted element is markup unless it holds the articles of the page, or half of
the page's text where no other article lies elsewhere: there the clusters decide. Comments are markup wherever there is other text, forms
unless they hold the article. A page that would have no text is read again without hints, and then with containers whose end tag is
missing (navigation, headers, footers, asides, menus) as plain blocks; in any reading such a one ends where an article begins.

Scale: one narrow pass over whole pages, no shuffle; memory is bounded by one page and its lines.

Cases: a null or empty page has an empty text; unclosed and stray tags end with the element around them; pages of any length
are read whole; rows with repeated or null ids are each returned; an empty table gives no rows; other columns are
ignored, and carried ones may have any name (if one is called ``text``, the result gets underscores at its end).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import col, fresh, slices

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MARKUP = frozenset("nav footer aside button select textarea label datalist script style noscript template svg iframe object dialog menu head title".split())
#: Containers that may lack their end tag; one that does ends where an article or the main part begins.
CONTAINERS = frozenset("nav header footer aside menu".split())
#: Elements that an open element of the same kind ends before it begins; a paragraph ends before any block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article main section div body nav aside header footer form".split())
LISTS = frozenset("ul ol dl table".split())
REGIONS = frozenset("article main section div body".split())
#: Words of names for boilerplate, and such as may stand beside them in one name.
COMMENTS = frozenset("comment comments respond disqus".split())
BOILERPLATE = COMMENTS | frozenset(
    """ad ads advert adverts advertisement advertisements advertising aside banner banners breadcrumb breadcrumbs consent cookie cookies footer gdpr login masthead menu menus modal nav navbar
    navigation newsletter notice notices pager pagination popup popups promo promos promotion related share sharing side sidebar sidebars signin signup skip social sponsor sponsored sponsors
    subscribe subscription toolbar widget widgets""".split()
)
NEUTRAL = frozenset(
    """area article articles bar blog block bottom box btn button buttons col column container count entry form global group header heading holder icon icons inner item items label leaderboard left
    link links list lists main media module native network networks outer page panel placeholder post posts primary region reply right row secondary section site slot stories tertiary thread
    title top unit wrap wrapper zone""".split()
)
HEADERS = frozenset(["header", "site-header", "global-header", "siteheader"])
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^-_a-zA-Z0-9]+")


def hint(names: str) -> str | None:
    """What class and id names say of an element: comments, boilerplate, header or nothing."""
    for name in names.split():
        if name.lower() in HEADERS:
            return "header"
        parts = [x.lower() for x in PARTS.findall(name)]
        own = BOILERPLATE.intersection(parts)
        if own and all(x in BOILERPLATE or x in NEUTRAL for x in parts):
            return "comments" if own & COMMENTS else "boilerplate"
    return None


class Lines(HTMLParser):
    """Collects lines (text, tags, markup, path); a path is the numbers of the open block elements."""

    def __init__(self, hints: bool = True, lacking: frozenset[int] = frozenset(), soft: bool = False):
        super().__init__(convert_charrefs=True)
        self.hints, self.lacking, self.soft = hints, lacking, soft
        self.containers = 0  # begun so far; each has the number of its start tag
        self.begun: list[tuple[int, int]] = []  # container, element
        self.ended: set[int] = set()  # elements that their own end tag ended
        self.open: list[tuple[str, bool, int]] = []  # tag, whether markup from here on, number
        self.held: Counter = Counter()  # open elements by tag
        self.lines: list[tuple[str, int, bool, tuple[int, ...]]] = []
        self.names: dict[int, str] = {}
        self.hinted: dict[int, str] = {}  # elements that only their names (or a form) make suspect
        self.parts: list[str] = []
        self.tags = self.made = 0

    def _end_line(self):
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            self.lines.append((text, self.tags, bool(self.open) and self.open[-1][1], tuple(n for _, _, n in self.open)))
        self.parts, self.tags = [], 0

    def _is_markup(self, tag: str, attrs: dict) -> bool:
        if tag in MARKUP or attrs.get("role", "") in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
            return True
        return tag == "header" and not (self.held["article"] or self.held["main"])

    def _hint(self, tag: str, attrs: dict) -> str | None:
        if not self.hints or tag in ("html", "body", "article", "main"):
            return None
        found = "form" if tag == "form" else hint(f"{attrs.get('class', '')} {attrs.get('id', '')}")
        return None if found == "header" and (self.held["article"] or self.held["main"]) else found

    def _cut(self, k: int):
        self.held.subtract(t for t, _, _ in self.open[k:])
        del self.open[k:]

    def _close(self, names: set[str]):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in names:
                self._end_line()
                return self._cut(k)
            if self.open[k][0] in SCOPES:
                return None

    def _push(self, tag: str, markup: bool):
        self.made += 1
        if tag in CONTAINERS:
            self.begun.append((self.containers, self.made))
            markup = markup and not (self.soft and self.containers in self.lacking and not (self.open and self.open[-1][1]))
        self.names[self.made] = tag
        self.held[tag] += 1
        self.open.append((tag, markup, self.made))

    def without_end(self) -> frozenset[int]:
        """The containers that no end tag of their own has ended."""
        return frozenset(n for n, e in self.begun if e not in self.ended)

    def handle_starttag(self, tag: str, attrs: list):
        self.containers += tag in CONTAINERS
        if tag in ("article", "main") and self.open and self.open[-1][1]:
            place = {e: n for n, e in self.begun}
            at = next(k for k, (_, markup, _) in enumerate(self.open) if markup)
            if place.get(self.open[at][2]) in self.lacking:
                self._end_line()
                self._cut(at)
        inside = bool(self.open) and self.open[-1][1]
        if inside:  # every element counts, so that the markup ends with its own end tag
            self.tags += 1
            if tag not in VOID:
                self._push(tag, True)
            return
        attributes = {k: v or "" for k, v in attrs}
        if tag in BLOCKS:
            self._end_line()
            if tag not in ("html", "body", "head"):
                self._close({"p"})
            self._close(CLOSES.get(tag, set()))
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        found = self._hint(tag, attributes)
        if tag in BLOCKS:
            self._push(tag, self._is_markup(tag, attributes))
            if found:
                self.hinted[self.made] = found
        elif found or self._is_markup(tag, attributes):
            self._push(tag, True)

    def handle_endtag(self, tag: str):
        self.tags += 1
        if not self.held[tag]:
            return
        k = next(k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag)
        blocks = any(t in BLOCKS for t, _, _ in self.open[k:])
        if blocks and (k == 0 or not self.open[k - 1][1]):
            self._end_line()
        self.ended.add(self.open[k][2])
        self._cut(k)

    def handle_data(self, data: str):
        if not self.open or not self.open[-1][1]:
            self.parts.append(data)


def marked(parser: Lines) -> list[bool]:
    """For each line whether it is markup, by its elements or by hints that hold."""
    hinted, lines = parser.hinted, parser.lines
    if not hinted:
        return [markup for _, _, markup, _ in lines]
    total = articles = 0
    size, in_article, holds = Counter(), Counter(), set()
    of_article, around, own = Counter(), {}, Counter()  # text by its innermost article; the article around a hinted element, and text of that in it
    for text, _, markup, path in lines:
        if not text or markup:
            continue
        n, last = len(text), max((i for i, e in enumerate(path) if parser.names[e] in ("article", "main")), default=-1)
        total, articles = total + n, articles + n * (last >= 0)
        for i, e in enumerate(path):
            if e in hinted:
                size[e] += n
                in_article[e] += n * (last >= 0)
                holds.update([e] if last > i else [])
                around[e] = next((a for a in reversed(path[:i]) if parser.names[a] in ("article", "main")), None)
                own[e] += n * (last >= 0 and path[last] == around[e])
        if last >= 0:
            of_article[path[last]] += n

    def is_markup(e: int) -> bool:
        kind, elsewhere = hinted[e], articles - in_article[e]
        if kind == "comments":
            return total > size[e]
        if e in holds and not elsewhere:
            return False
        apart = elsewhere - (of_article[around[e]] - own[e] if around[e] else 0)  # what the article around it says besides is not elsewhere
        return kind == "form" or 2 * size[e] < total or (4 * apart >= size[e] if around[e] else apart > 0)

    drop = {e for e in hinted if is_markup(e)}
    return [markup or not drop.isdisjoint(path) for _, _, markup, path in lines]


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at both ends the kernel is cut and weighed anew."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[reach:-reach] / np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]


def threshold(values: np.ndarray) -> float:
    """Where two clusters of one-dimensional values part (two means, from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values <= cut], values[values > cut]
        if not len(above):
            return low
        new = float(below.mean()) if len(below) else low, float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_region(lines: list, markup: list[bool], content: np.ndarray, names: dict[int, str]) -> int | None:
    """The innermost element that holds all clustered content, not (in) a list or table, one of sibling sections or articles, or a part of an article."""
    common = lines[content[0]][3]
    for k in content[1:]:
        path = lines[k][3]
        size = next((i for i, (a, b) in enumerate(zip(common, path, strict=False)) if a != b), min(len(common), len(path)))
        common = common[:size]
    region = None
    for i, n in enumerate(common):
        if names[n] in LISTS:
            break
        if names[n] in ("section", "article") and any(
            text and not out and len(path) > i and path[i] != n and names[path[i]] == names[n] and path[:i] == common[:i] for (text, _, _, path), out in zip(lines, markup, strict=True)
        ):
            break
        if names[n] in REGIONS and (region is None or names[region] != "article" or names[n] == "article"):
            region = n
    return region


def _read(html: str, piece: int, hints: bool, lacking: frozenset[int] = frozenset(), soft: bool = False) -> Lines:
    parser = Lines(hints, lacking, soft)
    for k in range(0, len(html), piece):
        parser.feed(html[k : k + piece])
    parser.close()
    parser._end_line()
    return parser


def main_text(html: str | None, sigma: float = 1.0, piece: int = 1 << 16) -> str:
    """The blocks of the main content, joined by line feeds."""
    if not html:
        return ""
    first = _read(html, piece, True)
    lacking = first.without_end()
    if lacking:
        first = _read(html, piece, True, lacking)
    return _content(first, sigma) or _content(_read(html, piece, False, lacking), sigma) or (_content(_read(html, piece, False, lacking, True), sigma) if lacking else "")


def _content(parser: Lines, sigma: float) -> str:
    lines, markup = parser.lines, marked(parser)
    ratios = np.array([0.0 if out else len(text) / max(tags, 1) for (text, tags, _, _), out in zip(lines, markup, strict=True)])
    if not len(ratios) or not ratios.any():
        return ""
    smooth = smoothed(ratios, sigma)
    content = (smooth >= threshold(smooth)) & (ratios > 0)
    if not content.any():
        content = ratios > 0
    region = content_region(lines, markup, np.flatnonzero(content), parser.names)
    return "\n".join(text for (text, _, _, path), out in zip(lines, markup, strict=True) if text and not out and (region is None or region in path))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """The id column, the carried ones and ``text`` of every page."""
    front = [id_col, *carry]
    rows = pages.select(*(col(c).alias(f"c{k}") for k, c in enumerate(front)), col(html_col).alias("html"))

    plain = [*rows.columns[:-1], "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "html"):
            texts = [main_text(h) for h in some.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(texts, pa.string())], names=plain)

    return rows.mapInArrow(run, T.StructType(rows.schema.fields[:-1]).add("text", "string")).toDF(*front, *fresh(front, "text"))
