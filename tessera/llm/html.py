"""Main text of web pages by the distribution of line blocks.

Markup is stripped into lines, one for each block element. A line counts with the length of its text outside links, and
with nothing in menus, headers, footers, side columns, notices, adverts, forms and comments, or outside a page's
article elements if it has some. The counts are summed over sliding windows of lines; where the sum surges over a threshold text
begins, where it dives to zero text ends, and what counts between the two points is kept.

Class names and roles often stand on wrappers of the whole page too (with-sidebar, has-header). A mark therefore does not hold for an element
with most of the page's text, and one of LOUD only if there is other text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read, small_batches

#: Elements whose whole content is no text; elements that start a line; elements and words of class or id that mark what is around the text.
RAW = frozenset("script style title textarea".split())
SILENT = RAW | frozenset("noscript template iframe svg select option button object canvas audio video map".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AROUND = frozenset("nav footer aside form menu dialog head header".split())
NEVER = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations subscribe subscription newsletter signup "
    "popup modal overlay widget toolbar pagination pager login search skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
WRAPPERS = frozenset("form header head search banner".split())
#: Marks of what is beside the text even where there is much of it; words that begin a class name of an article that is not the page's own.
LOUD = MARKS - frozenset("sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social widget toolbar pagination pager login signup search skip".split())
TEASERS = frozenset("comment reply teaser card related promo ad advert sponsored recommended".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""",
    re.S | re.I,
)
EDGE = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*+>", re.I) for t in SILENT}
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORD = re.compile(r"[a-z0-9]+")
#: Lines of a window; the sum over which a window surges.
WINDOW, SURGE = 3, 86


#: Kinds of marks: of layout, which wrappers of the text carry as well; of what is beside the text; by an element's name.
LAYOUT, BESIDE, NAMED = 1, 2, 3


def marked(tag: str, attributes: str) -> int:
    """The kind of an element's mark, 0 if it has none."""
    if tag in AROUND:
        return LAYOUT if tag in WRAPPERS else NAMED
    if not attributes or tag in NEVER and tag != "article":
        return 0
    found = 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if tag == "article":
            if name == "class" and not TEASERS.isdisjoint(w.partition("-")[0].partition("_")[0] for w in value.split()):
                return BESIDE
        elif name == "role" and value in ROLES:
            found = max(found, LAYOUT if value in WRAPPERS else BESIDE)
        elif name in ("class", "id"):
            words = MARKS.intersection(WORD.findall(value))
            if words:
                found = max(found, LAYOUT if LOUD.isdisjoint(words) else BESIDE)
    return found


class Line:
    __slots__ = ("pieces", "linked", "mark", "article")

    def __init__(self, mark: int, article: int):
        self.pieces: list[str] = []
        self.linked, self.mark, self.article = 0, mark, article

    def text(self) -> str:
        return " ".join(unescape("".join(self.pieces)).split())


class Silence:
    """Where the silent elements of a page end."""

    def __init__(self, html: str):
        self.html, self.ends = html, {}

    def end(self, tag: str, m: re.Match[str]) -> int:
        """The end of the element whose start tag is `m`; of an element without an end tag only the tag is silent, but for RAW ones."""
        if tag in RAW:
            found = next((e for e in EDGE[tag].finditer(self.html, m.end()) if e[1]), None)
            return found.end() if found else len(self.html)
        if tag in ("svg", "math") and m[0].endswith("/>"):
            return m.end()
        if tag not in self.ends:
            opened, ends = [], {}
            for e in EDGE[tag].finditer(self.html):
                if not e[1] and not (tag in ("svg", "math") and e[0].endswith("/>")):
                    opened.append(e.start())
                elif e[1] and opened:
                    ends[opened.pop()] = e.end()
            self.ends[tag] = ends
        return max(self.ends[tag].get(m.start(), 0), m.end())


def lines_of(html: str) -> tuple[list[Line], list[tuple[int, int]]]:
    """The page's lines, and its marked elements: the marked element around each and the kind of its mark; number 0 is the page.

    mark: the innermost marked element around a line; article: the number of the outermost article or main element around it, 0 if none.
    """
    stack: list[tuple[str, int, int]] = []
    out, marks = [Line(0, 0)], [(0, 0)]
    in_link, articles, at = False, 0, 0

    def start(line: Line) -> None:
        if out[-1].pieces:
            out.append(line)
        else:
            out[-1] = line

    silence = Silence(html)
    while m := TOKEN.search(html, at):
        if m.start() > at:
            piece = html[at : m.start()]
            out[-1].pieces.append(piece)
            if in_link:
                out[-1].linked += len(piece.strip())
        at = m.end()
        tag = (m[2] or m[4] or "").lower()
        if tag in SILENT and not m[1]:
            at = silence.end(tag, m)
            continue
        if not m[2]:
            continue
        if tag == "a":
            in_link = not m[1]
            continue
        if tag == "br":
            out[-1].pieces.append(" ")
            continue
        closing = bool(m[1])
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            if tag in BLOCKS and stack and stack[-1][0] == "p":
                stack.pop()
            above, article = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
            mark, kind = above, marked(tag, m[3])
            if tag in HEADINGS and article and stack[-1][0] == "header":
                mark = stack[-2][1] if len(stack) > 1 else 0  # the heading of an article stands in the article's own header
            if kind:
                marks.append((mark, kind))
                mark = len(marks) - 1
            if tag in ("article", "main") and not article and not kind:
                articles += 1
                article = articles
            if tag in BLOCKS or mark != above:
                stack.append((tag, mark, article))
        mark, article = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
        if tag in BLOCKS or mark != out[-1].mark:
            start(Line(mark, article))
            in_link = in_link and tag not in BLOCKS
    if at < len(html):
        out[-1].pieces.append(html[at:])
    return out, marks


def around(held: list[int], marks: list[tuple[int, int]], beside: int, named: bool) -> list[bool]:
    """For each marked element whether text in it is left out: its mark or one around it holds.

    held: the weight of the lines whose innermost marked element it is; beside: above 0 if most of the page's text has no weight;
    named: whether a mark by an element's name may be overruled.
    """
    inner = held[:]
    for k in range(len(marks) - 1, 0, -1):
        inner[marks[k][0]] += inner[k]
    total, out = inner[0], [False]
    for k in range(1, len(marks)):
        parent, kind = marks[k]
        if kind == LAYOUT:
            holds = 2 * inner[k] <= total
        else:
            holds = inner[k] < total or not total or beside > 0 or kind == NAMED and not named
        out.append(out[parent] or holds)
    return out


def main_text(html: str) -> str:
    found, marks = lines_of(html)
    lines = [(x, t) for x in found if (t := x.text())]
    free = [0 if 2 * x.linked > len(t) else len(t) - x.linked for x, t in lines]
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    for x, t in lines:
        size[x.article] = size.get(x.article, 0) + len(t)
        linked[x.article] = linked.get(x.article, 0) + x.linked
    # articles of links are teasers, unless there are no others
    articles = {k for k in size if k and 2 * linked[k] <= size[k]} or size.keys() - {0}
    counts: list[int] = []
    for known in (True, False) if articles else (False,):
        weight = [len(t) if x.article in articles else 0 for x, t in lines] if known else free
        held = [0] * len(marks)
        for (x, _), w in zip(lines, weight):
            held[x.mark] += w
        inside = sum(f for f, w in zip(free, weight) if w)
        out = around(held, marks, max(0, sum(free) - 2 * inside) if known else 0, known)
        counts = [0 if out[x.mark] else w for (x, _), w in zip(lines, weight)]
        if any(counts):
            break
    sums = [sum(counts[k : k + WINDOW]) for k in range(len(counts))]
    surge = 0 if known else min(SURGE, max(sums, default=0) / 2)
    spans, k = [], 0
    while k < len(sums):
        if counts[k] and sums[k] > surge:
            end = k
            while end < len(sums) and sums[end]:
                end += 1
            spans.append((k, end))
            k = end
        else:
            k += 1
    return "\n\n".join(lines[k][1] for a, b in spans for k in range(a, b) if counts[k])


def extract(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """`pages` with `out_col`, the main text of the whole html in place of `html_col`.

    A null or empty page, or one without text, gives an empty text. Blocks stand in page order with an empty
    line between. All other columns stay (a column named `out_col` is replaced); repeated rows each give a row.
    """
    names = [c for c in pages.columns if c not in (html_col, out_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(v.as_py() or "") for v in batch.column(len(names))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*names, out_col])

    kept = pages.select(*names, F.col(html_col).alias(out_col))
    return small_batches(kept).mapInArrow(run, kept.schema)


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
