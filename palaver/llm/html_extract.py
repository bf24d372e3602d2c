"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines, one for each block of its markup.  Pages are laid out by host and
URL path, so that a page's neighbours in that order are the pages with the nearest paths on its
host; pages of equal lines count as one there, however many they are.  A page's lines are aligned
with those of the nearer neighbour by a longest common subsequence; aligned lines are the site's
furniture and are deleted.  A neighbour that shares all of a page's lines says nothing of
furniture, so the one on the other side is taken; if that one does too, the lines that are
common on the host are deleted.

Differencing alone cannot give right results: a host may have a single page, adverts may differ
on each page, and an article may rightly share a passage with its neighbour.  So what the markup
says outright is a check beside it: scripts, styles, forms and blocks that name themselves navigation,
header, footer, sidebar, notice, advert or comments go, inside an article only by a whole known name; and where a page marks its article, lines outside it go, and a shared line inside it is
restored unless it is common, that is on more than half of the host's different pages and on ``FEW`` or more.

Scale: the pages are parsed once, their lines are written to the shared folder and compared by hashes: one range shuffle of the
hashes, which spreads a host with a third of all pages over many tasks, and one aggregation that
counts lines by host.  Where a range ends, the nearest different page beyond it is looked up from
the ends of all ranges, which the driver holds (four pages a range).  Only the lines' verdicts are joined to the texts.

Edge cases: null or empty html gives an empty text; a null or odd URL counts as host '' with the
URL as path; repeated rows are copies of each other; markup that is never closed ends with the page.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import discard, store

#: A line on fewer different pages of a host is not common there.
FEW = 3

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table"
    " tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select textarea option iframe svg canvas"
    " object audio video menu".split()
)
# Words by which blocks name themselves as furniture, in class, id or role.
FURNITURE = frozenset(
    "ad ads adsense advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments complementary"
    " consent contentinfo cookie cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation"
    " newsletter notice overlay pager pagination popup promo promoted promotion related respond search share sharing"
    " sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
# Whole names of blocks that are furniture inside an article too: a word that can be nothing else there, or one with its box.
_PLAIN = (
    "ad ads adsense advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo"
    " disqus footer masthead nav navbar navigation newsletter pager pagination promo sharing sidebar signup sponsored toolbar topbar"
).split()
_BOXED = "consent cookie cookies gdpr menu modal popup promoted related respond search share skip social sponsor subscribe subscription widget".split()
_BOXES = "articles banner bar block box button buttons container content form icons item link links list notice panel posts section slot stories unit widget wrapper".split()
INSIDE = frozenset([*_PLAIN, *(f"{a}-{b}" for a in (*_PLAIN, *_BOXED) for b in _BOXES), "post-footer", "post-navigation", "entry-footer"])
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Zones of a line.
ARTICLE, LOOSE, OUTSIDE = 0, 1, 2


def _is_furniture(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            if in_article and (tag == "p" or tag in _HEADING or (name == "id" and tag == "section" and value != "comments")):
                continue  # a heading's or section's id may be made from its title, and an article's own wording may be a notice
            for token in value.split():
                words = _WORD.findall(_CAMEL.sub("-", token).lower())
                if "-".join(words) in INSIDE if in_article else words and {words[0], words[-1]} & FURNITURE:
                    return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
    return False


class _Lines(HTMLParser):
    """Collects (zone, text) lines in page order."""

    def __init__(self, link_items: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.link_items = link_items
        self.lines: list[tuple[str, bool, bool]] = []  # text, in an article, in a main element
        self.open: list[tuple[str, bool]] = []  # name, whether it drops what it holds
        self.dropping = self.articles = self.mains = self.headings = 0
        self.parts: list[str] = []
        self.plain = False  # whether the line has text outside links

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            item = any(name == "li" for name, _ in self.open[-4:])
            if text and (self.plain or self.articles or self.link_items or not item):
                self.lines.append((text, self.articles > 0, self.mains > 0))
            self.parts, self.plain = [], False

    def _count(self, name: str, drops: bool, by: int) -> None:
        self.dropping += by * drops
        self.articles += by * (name == "article")
        self.mains += by * (name == "main")

    def _close_to(self, at: int) -> None:
        while len(self.open) > at:
            self._count(*self.open.pop(), -1)

    def _find(self, name: str, within: frozenset[str] = frozenset()) -> int | None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                return k
            if self.open[k][0] in within:
                return None
        return None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID:
            if tag == "hr":
                self._end_line()
            elif tag in ("br", "wbr"):
                self.parts.append(" " if tag == "br" else "")
            return
        if tag in BLOCK:
            self._end_line()
            if (k := self._find("p", frozenset(("table", "td", "th", "article", "main")))) is not None:
                self._close_to(k)  # a block ends an open paragraph
            if tag in ("li", "option", "tr", "td", "th", "dt", "dd"):
                k = self._find(tag, frozenset(("ul", "ol", "table", "dl", "select")))
                if k is not None:
                    self._close_to(k)
        if tag == "article" and not self.articles and self.dropping:
            self._close_to(0)  # what drops was never closed
        drops = tag in DROPPED or (tag == "header" and not self.articles) or (
            tag not in ("html", "body", "article", "main") and _is_furniture(tag, attrs, self.articles > 0)
        ) or (tag == "article" and self.articles > 0 and _is_furniture(tag, attrs, True)) or (tag == "dialog" and not self.articles)
        self.open.append((tag, drops))
        self._count(tag, drops, 1)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing but void elements

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_line()
        elif tag == "br":
            self.parts.append(" ")
        k = self._find(tag, frozenset(("article", "main", "body")) if tag not in ("article", "main", "body", "html") else frozenset())
        if k is not None:
            self._close_to(k)

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.parts.append(data)
            if not self.plain and not data.isspace():
                self.plain = not any(name == "a" for name, _ in self.open[-6:])


def page_lines(html: str | None, link_items: bool = False) -> list[tuple[str, int]]:
    """The text lines of a page, without blocks that drop out by their own markup, and their zones.

    Unless ``link_items``, list items that are all link are left out where no article is marked.
    """
    if not html:
        return []
    parser = _Lines(link_items)
    parser.feed(html)
    parser.close()
    parser._end_line()
    level = 1 if any(x[1] for x in parser.lines) else 2 if any(x[2] for x in parser.lines) else 0
    return [(x[0], LOOSE if not level else ARTICLE if x[level] else OUTSIDE) for x in parser.lines]


def aligned(a: list, b: list) -> list[bool]:
    """For each line of ``a``, whether a longest common subsequence with ``b`` holds it."""
    out = [False] * len(a)
    lo, ha, hb = 0, len(a), len(b)
    while lo < ha and lo < hb and a[lo] == b[lo]:
        out[lo] = True
        lo += 1
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
        out[ha] = True
    common = set(a[lo:ha]) & set(b[lo:hb])
    rows = [i for i in range(lo, ha) if a[i] in common]
    cols = [j for j in range(lo, hb) if b[j] in common]
    if not rows:
        return out
    lines_a, lines_b = [a[i] for i in rows], [b[j] for j in cols]
    for i in _subsequence(lines_a, lines_b):
        out[rows[i]] = True
    return out


#: Cells of an alignment's table whose bit rows are kept at once; a larger one is divided.
TABLE_CELLS = 1 << 26


def _masks(b: list) -> dict:
    masks: dict = {}
    for k, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << k
    return masks


def _subsequence(a: list, b: list) -> list[int]:
    """The places in ``a`` of a longest common subsequence with ``b``.

    Python integers as bit vectors: one row of the table for each line of ``a``, in which a zero bit is a column where
    the length grows.  A large table is divided at the middle row (after Hirschberg), so memory stays in proportion to the lines.
    """
    if not a or not b:
        return []
    masks, full = _masks(b), (1 << len(b)) - 1
    if len(a) * len(b) > TABLE_CELLS and len(a) > 1:
        middle = len(a) // 2

        def lengths(some: list, masks: dict) -> np.ndarray:
            state = full
            for x in some:
                hit = state & masks.get(x, 0)
                state = ((state + hit) | (state - hit)) & full
            grows = np.unpackbits(np.frombuffer(state.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)] == 0
            return np.r_[0, np.cumsum(grows)]

        left, right = lengths(a[:middle], masks), lengths(a[middle:][::-1], _masks(b[::-1]))
        cut = int((left + right[::-1]).argmax())
        del left, right, masks
        return _subsequence(a[:middle], b[:cut]) + [middle + i for i in _subsequence(a[middle:], b[cut:])]
    state, states = full, []
    for x in a:
        states.append(state)
        hit = state & masks.get(x, 0)
        state = ((state + hit) | (state - hit)) & full
    out, k = [], len(b)
    for i in range(len(a) - 1, -1, -1):
        before, own = states[i], masks.get(a[i], 0)
        below = (1 << k) - 1
        hit = before & own
        after = ((before + hit) | (before - hit)) & full
        if (~after & below).bit_count() > (~before & below).bit_count():
            out.append(i)
            k = (own & below).bit_length() - 1
            while (~before & ((1 << k) - 1)).bit_count() != (~after & below).bit_count() - 1:
                k = (own & ((1 << k) - 1)).bit_length() - 1
    return out[::-1]


def _path_nearness(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def verdicts(path: str, lines: list[int], near: list[tuple[str, list[int]]], common: set[int]) -> tuple[list[bool], list[bool]]:
    """For each line (as a hash) whether it goes outside a marked article, and whether inside one."""
    shared, known = [False] * len(lines), not near
    for _, other in sorted(near, key=lambda x: -_path_nearness(path, x[0])):
        found = aligned(lines, other)
        if not all(found):
            shared, known = found, True
            break
    often = [x in common for x in lines]
    return (shared, [a and b for a, b in zip(shared, often, strict=True)]) if known else (often, often)


_PAGE = "struct<path:string,content:long,hashes:array<long>>"


def _beyond(ends: list) -> list[tuple]:
    """For each range of a host its nearest pages in other ranges that differ from its first and its last."""
    hosts: dict = defaultdict(list)
    for row in sorted(ends, key=lambda r: r["part"]):
        hosts[row["host"]].append(row)
    page = lambda x: (x["path"], x["content"], x["hashes"])
    out = []
    for host, rows in hosts.items():
        for k, row in enumerate(rows):
            found = []
            for end, others, inner in (("first", reversed(rows[:k]), "before"), ("last", rows[k + 1 :], "after")):
                own, far = row[end]["content"], "last" if end == "first" else "first"
                seen = (x for other in others for x in (other[far], other[far][inner]) if x is not None)
                found.append(next((page(x) for x in seen if x["content"] != own), None))
            out.append((host, row["part"], *found))
    return out


def neighbours(light: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nearest pages of other content before and after each row by path: structs ``before`` and ``after``.

    ``light`` has distinct ``host``, ``path``, ``content`` and with them ``hashes``.  Also returns the stored table that is read.
    """
    spark = light.sparkSession
    laid = store(light.repartitionByRange("host", "path", "content").withColumn("part", F.spark_partition_id()), "html_ranges")
    up = Window.partitionBy("part", "host").orderBy("path", "content")
    down = Window.partitionBy("part", "host").orderBy(F.desc("path"), F.desc("content"))
    near, page = laid, F.struct("path", "content", "hashes")
    for name, w in (("before", up), ("after", down)):
        last = F.when(F.lag("content").over(w) != F.col("content"), F.lag(page).over(w))
        near = near.withColumn(name, last)
        near = near.withColumn(name, F.last(name, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = F.struct("path", "content")
    ends = near.groupBy("host", "part").agg(
        F.min_by(F.struct("path", "content", "hashes", "after"), place).alias("first"),
        F.max_by(F.struct("path", "content", "hashes", "before"), place).alias("last"),
    )
    split = laid.select("host", "part").distinct().groupBy("host").count().filter("count > 1").select("host")
    beyond = spark.createDataFrame(_beyond(ends.join(split, "host").collect()), f"host string, part int, earlier {_PAGE}, later {_PAGE}")
    near = near.join(F.broadcast(beyond), ["host", "part"], "left")
    return near.withColumns({"before": F.coalesce("before", "earlier"), "after": F.coalesce("after", "later")}).drop("earlier", "later", "part"), laid


def common_lines(light: DataFrame) -> DataFrame:
    """``host`` and ``common``: hashes of the lines on most of its different pages (at most twice a page's lines)."""
    pages = light.dropDuplicates(["host", "content"])
    n = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    lines = pages.select("host", F.explode(F.array_distinct("hashes")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    often = lines.filter(F.col("n") >= FEW).join(n, "host").filter("2 * n > n_pages")
    return often.groupBy("host").agg(F.collect_list("line").alias("common"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page; needs ``page_id``, ``url``, ``html``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    parsed_schema = T.StructType(
        [
            pages.schema["page_id"],
            pages.schema["url"],
            T.StructField("host", T.StringType()),
            T.StructField("path", T.StringType()),
            T.StructField("lines", T.ArrayType(T.StringType())),
            T.StructField("zones", T.ArrayType(T.ByteType())),
        ]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .words import slices

        for whole in batches:
            for start, stop in slices(whole.column("html")):
                batch = whole.slice(start, stop - start)
                pages_lines = [page_lines(h, link_items=True) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k) for k in range(4)]
                    + [
                        pa.array([[t for t, _ in x] for x in pages_lines], pa.list_(pa.string())),
                        pa.array([[z for _, z in x] for x in pages_lines], pa.list_(pa.int8())),
                    ],
                    names=parsed_schema.names,
                )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for r in batch.to_pylist():
                near = [(x["path"], x["hashes"]) for x in (r["before"], r["after"]) if x is not None]
                loose, marked = verdicts(r["path"], r["hashes"], near, set(r["common"] or ()))
                if any(loose):
                    for column, value in zip(out, (r["host"], r["path"], r["content"], loose, marked), strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.bool_()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["host", "path", "content", "loose", "marked"])

    raw = pages.select("page_id", "url", host.alias("host"), path.alias("path"), "html")
    parsed = store(raw.mapInArrow(parse, parsed_schema).withColumn("content", F.xxhash64("lines")), "html_pages", "zstd")
    hashes = F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes")
    light = parsed.filter(F.size("lines") > 0).select("host", "path", "content", hashes).dropDuplicates(["host", "path", "content"])
    light = store(light, "html_lines")
    near, laid = neighbours(light)
    common = store(common_lines(light), "html_common")
    judged = near.join(common, "host", "left").select("host", "path", "content", "hashes", "before", "after", "common")
    judged = store(judged.mapInArrow(judge, "host string, path string, content long, loose array<boolean>, marked array<boolean>"), "html_verdicts")
    for table in (light, laid, common):
        discard(table)

    def stays(line: Column, i: Column) -> Column:
        zone, goes = F.get("zones", i), F.when(F.get("zones", i) == ARTICLE, F.get("marked", i)).otherwise(F.get("loose", i))
        return (zone != OUTSIDE) & ~F.coalesce(goes, F.lit(False))

    texts = parsed.join(judged, ["host", "path", "content"], "left")
    texts = texts.select("page_id", "url", F.array_join(F.filter("lines", stays), "\n\n").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
