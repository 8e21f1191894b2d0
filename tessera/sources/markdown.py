"""HTML to Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.sources.shared import small_batches

_SILENT = frozenset(("script", "style", "template", "noscript", "head"))
_BREAKS = frozenset(("p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "nav", "footer", "header", "aside", "blockquote", "form"))


class _Writer(HTMLParser):
    """Writes headings, paragraphs, list items, links, emphasis and code; everything else as its text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent, self.links = 0, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SILENT:
            self.silent += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append(f"\n\n{'#' * int(tag[1])} ")
        elif tag in _BREAKS:
            self.out.append("\n\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in _BREAKS:
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(re.sub(r"\s+", " ", data))


def markdown(html: str) -> str:
    w = _Writer()
    w.feed(html)
    w.close()
    text = re.sub(r" *\n *", "\n", "".join(w.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def to_markdown(df: DataFrame, column: str) -> DataFrame:
    """`df` with the HTML of `column` as Markdown; null stays null."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            columns[at] = pa.array([None if v is None else markdown(v) for v in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return small_batches(df).mapInArrow(run, df.schema)
