"""Main text of web pages, from the standard library's parser events.

A line is what stands between the boundaries of block elements. Its ratio is its characters to its tags; links' and form
controls' characters do not count. The ratios are smoothed with a Gaussian, and a threshold between the two clusters of
smoothed ratios, where these are SPREAD times apart, tells content lines from the rest. Content lines with at most GAP others
between them are one cluster. From the page's body the search for the region goes into the box that holds the content, as
long as what it leaves out is little and of other clusters; it ends at an article or main element. Of that, or of another
box, every line belongs that no menu, header, footer, sidebar, notice, advert, form or comment section contains, short ones
included; where the body itself is the region, the lines around its clusters that are not links.

Names in class, id and role bar an element like elements of that kind, but not as modifiers (has-sidebar, comments-open), and
not where the element holds a main element, or where a name that content has, too, is of an element of content lines, or most content lines' text while it holds an article or no region without it
has content.

Edge cases: null, empty and broken markup give what text can be found, or an empty one; unknown declarations, and comments,
declarations and tags that never end, are no text; very long pages are parsed as a
stream of events; repeated rows give equal rows; columns besides the three are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm.common import map_arrow, table

#: Elements that end a line, that have no content, that hold no main text, and that are a page's regions.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("applet aside audio button canvas datalist dialog footer form head header iframe input label math menu nav noframes noscript object option script select style svg template textarea title video".split())
REGIONS = frozenset("article main".split())
BOXES = frozenset("article body div main section td".split())
#: Words in class, id and role names of what is no main text.
NAMES = frozenset("ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies discussion disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion reactions related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Those of them that also name content; the ratio decides on these.
DOUBTFUL = frozenset("header reactions related search share sharing social".split())
#: Words that make a name one of a state or layout instead of a kind of element.
MODIFIERS = frozenset("closed disabled enabled has hidden hide is no not off on open show with without".split())
#: Elements whose start ends an open p element.
_ENDS_P = BLOCKS - frozenset("body caption head html option tbody td tfoot th thead title tr".split())
_SUBSET_END, _UNENDED = re.compile(r"\]\s*>"), re.compile("<[!?/A-Za-z]")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SIGMA, RADIUS = 1.0, 3
#: The means of two clusters of ratios are this many times apart; lines within a cluster of content; share of a box's content
#: that may be left out.
SPREAD, GAP, LEFT_OUT = 2.0, 2, 0.25
KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]


class Line:
    __slots__ = ("parts", "tags", "linked", "box", "region", "barred", "named")

    def __init__(self, box: int, region: int, barred: bool, named: int):
        self.parts, self.tags, self.linked, self.box, self.region, self.barred, self.named = [], 0, 0, box, region, barred, named


def named(attrs: list[tuple[str, str | None]]) -> int:
    """Whether class, id or role name a kind of element that holds no main text: 0 no, 1 maybe, 2 yes."""
    found = 0
    for k, v in attrs:
        if k in ("class", "id", "role") and v:
            for token in v.split():
                words = [w.lower() for w in _WORD.findall(token)]
                names = NAMES.intersection(words)
                if names and MODIFIERS.isdisjoint(words):
                    found = max(found, 1 if names <= DOUBTFUL else 2)
    return found


class Lines(HTMLParser):
    """Feed markup; lines holds what stood between block boundaries."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, bool, int, int, int]] = []  # element, barred, its box, its region, the named one it is in (0: none)
        self.boxes, self.links, self.body = 0, 0, -1
        self.parents, self.regions = [0], [False]  # of every box: the box it is in, whether it is an article or main element
        #: Of every named element: the named one around it, the regions begun in it, whether a main element was.
        self.around, self.articles, self.mains = [0], [0], [False]
        self.firm = [False]  # and whether its name leaves no doubt
        self.within = [0]  # of every box: the named element it is in
        self.line = Line(0, 0, False, 0)

    def cut(self) -> None:
        if self.line.parts:
            self.lines.append(self.line)
        _, barred, box, region, name = self.stack[-1] if self.stack else ("", False, 0, 0, 0)
        self.line = Line(box, region, barred, name)

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self.close_to("p", BOXES | frozenset(("table", "button")))
        elif tag in ("td", "th", "tr"):
            self.close_to("td" if tag != "tr" else "tr", frozenset(("table",)))
        if tag == "li":
            self.close_to("li", frozenset(("ul", "ol", "menu")))
        if tag in VOID:
            if tag in BLOCKS:
                self.cut()
            else:
                self.line.tags += 1
                if tag == "br":
                    self.line.parts.append(" ")
            return
        _, barred, box, region, name = self.stack[-1] if self.stack else ("", False, 0, 0, 0)
        if not barred:
            barred = tag in NEVER or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
            if not barred and tag not in ("html", "body") and (kind := named(attrs)):
                self.firm.append(kind == 2)
                self.around.append(name)
                self.articles.append(0)
                self.mains.append(False)
                name = len(self.around) - 1
        if tag in BOXES:
            self.boxes += 1
            self.parents.append(box)
            if tag == "body" and self.body < 0:
                self.body = self.boxes
            self.regions.append(tag in REGIONS)
            box = self.boxes
            self.within.append(name)
            if tag in REGIONS:
                region = self.boxes
                if not barred:
                    self.articles[name] += 1
                    self.mains[name] |= tag == "main"
        self.stack.append((tag, barred, box, region, name))
        if tag in BLOCKS or barred != self.line.barred or name != self.line.named:
            self.cut()
        self.line.tags += 1
        self.links += tag == "a"

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                break
            if self.stack[k][0] in BOXES and tag not in BLOCKS:  # an inline element's end does not reach out of a box
                return
        else:
            return
        self.drop(k)

    def close_to(self, tag: str, within: frozenset) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.drop(k)
                return
            if self.stack[k][0] in within:
                return

    def drop(self, k: int) -> None:
        gone = self.stack[k:]
        del self.stack[k:]
        self.line.tags += 1
        self.links -= sum(x[0] == "a" for x in gone)
        if any(x[0] in BLOCKS or x[1] or x[4] for x in gone):
            self.cut()

    def parse_marked_section(self, i, report=1):
        """<![...]: a comment up to the next >, whatever it is called."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def parse_html_declaration(self, i):
        """A document type ends after its internal subset."""
        raw = self.rawdata
        if raw[i : i + 9].lower() == "<!doctype":
            end, subset = raw.find(">", i), raw.find("[", i)
            if 0 <= subset < end and (closed := _SUBSET_END.search(raw, subset)):
                return closed.end()
        return super().parse_html_declaration(i)

    def finish(self) -> None:
        """The end of the page: what is left of a comment, declaration or tag that never ended is no text."""
        if self.cdata_elem is None and _UNENDED.match(self.rawdata):
            self.rawdata = ""
        self.close()
        self.cut()

    def handle_data(self, data):
        self.line.parts.append(data)
        if self.links:
            self.line.linked += len(data)


def smoothed(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - RADIUS), min(len(values), i + RADIUS + 1)
        weights = KERNEL[lo - i + RADIUS : hi - i + RADIUS]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi], strict=True)) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Between the means of the values on either side of it; below all where these are not SPREAD times apart."""
    t = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v <= t], [v for v in values if v > t]
        if not low or not high:
            return min(values) - 1 if not high else t
        a, b = sum(low) / len(low), sum(high) / len(high)
        if abs((a + b) / 2 - t) < 1e-9:
            break
        t = (a + b) / 2
    return t if b >= SPREAD * a else min(values) - 1


def ratios_of(lines: list[tuple[str, Line]]) -> list[float]:
    return smoothed([0.0 if x.barred else max(0, len(t) - x.linked) / max(1, x.tags) for t, x in lines])


def bar_named(parser: Lines, lines: list[tuple[str, Line]]) -> None:
    """Bars the lines of named elements, but of those that hold the page's content."""
    around, n = parser.around, len(parser.around)
    if n == 1:
        return
    ratios = ratios_of(lines)
    cut = threshold(ratios)
    every, held, inner = [0] * n, [0] * n, [0] * n  # all text, content text of each named element, and in regions that begin in it; 0: of the page
    for (t, x), r in zip(lines, ratios, strict=True):
        every[x.named] += 0 if x.barred else len(t)
        if not x.barred and r > cut and 2 * x.linked < len(t) + 1:
            held[x.named] += len(t)
            if x.region:
                inner[parser.within[x.region]] += len(t)
    articles, mains = list(parser.articles), list(parser.mains)
    for k in range(n - 1, 0, -1):  # what is inside comes after what is around
        up = around[k]
        every[up], held[up], inner[up], articles[up], mains[up] = every[up] + every[k], held[up] + held[k], inner[up] + inner[k], articles[up] + articles[k], mains[up] or mains[k]
    barred = [False] * n
    for k in range(1, n):
        content = 2 * held[k] > held[0] and (articles[k] > 0 or inner[0] == inner[k])
        doubtful = not parser.firm[k] and 2 * held[k] > every[k]
        barred[k] = barred[around[k]] or not (mains[k] or content or doubtful)
    for _, x in lines:
        x.barred = x.barred or barred[x.named]


def clusters(content: list[bool]) -> list[int]:
    """For every line the number of its cluster of content lines, 0 for others."""
    out, number, last = [0] * len(content), 0, -GAP - 2
    for i, c in enumerate(content):
        if c:
            number += i - last > GAP + 1
            out[i], last = number, i
    return out


def region(parser: Lines, lines: list[tuple[str, Line]], content: list[bool]) -> int:
    """The box that is the region; 0: the page."""
    cluster = clusters(content)
    parents, held = parser.parents, [0] * len(parser.parents)
    groups: list[set[int]] = [set() for _ in parents]
    own: list[set[int]] = [set() for _ in parents]
    for (t, x), c, k in zip(lines, content, cluster, strict=True):
        if c:
            held[x.box] += len(t) + 1
            groups[x.box].add(k)
            own[x.box].add(k)
    for k in range(len(parents) - 1, 0, -1):
        held[parents[k]] += held[k]
        groups[parents[k]] |= groups[k]
    inner: list[list[int]] = [[] for _ in parents]
    for k in range(1, len(parents)):
        inner[parents[k]].append(k)
    box = 0
    while not parser.regions[box]:
        best = max(inner[box], key=lambda k: (held[k], parser.regions[k], -k), default=0)
        if not best or not held[best]:
            break
        if held[best] < held[box]:
            others = own[box].union(*(groups[k] for k in inner[box] if k != best))
            prior = parser.regions[best] or any(parser.regions[k] and 2 * held[k] > held[box] for k in inner[best])
            if held[box] - held[best] > (0.5 if prior else LEFT_OUT) * held[box] or not prior and others & groups[best]:
                break
        box = best
    return box


def within(box: int, outer: int, parents: list[int]) -> bool:
    while box > outer:  # a box's number is greater than its parent's
        box = parents[box]
    return box == outer


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.finish()
    lines = [(" ".join("".join(x.parts).split()), x) for x in parser.lines]
    lines = [(t, x) for t, x in lines if t]
    if not lines:
        return ""
    bar_named(parser, lines)
    ratios = ratios_of(lines)
    cut = threshold(ratios)
    content = [r > cut and not x.barred and 2 * x.linked < len(t) + 1 for (t, x), r in zip(lines, ratios, strict=True)]
    if not any(content):
        return ""
    box, parents = region(parser, lines, content), parser.parents
    inside = [not x.barred and within(x.box, box, parents) for _, x in lines]
    if parser.regions[box]:
        return "\n\n".join(t for (t, _), y in zip(lines, inside, strict=True) if y)
    texts = [y and 2 * x.linked < len(t) + 1 for (t, x), y in zip(lines, inside, strict=True)]
    first, last = content.index(True), len(content) - 1 - content[::-1].index(True)
    if box == 0 or parser.body == box:  # nothing but the page is around: as far as texts reach without a break
        while first and texts[first - 1]:
            first -= 1
        while last + 1 < len(texts) and texts[last + 1]:
            last += 1
    else:
        first, last = 0, len(lines) - 1
    return "\n\n".join(t for (t, _), y in zip(lines[first : last + 1], texts[first : last + 1], strict=True) if y)


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x) for x in b.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    return map_arrow(df.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")), run, "page_id long, url string, text string")


def op2_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
