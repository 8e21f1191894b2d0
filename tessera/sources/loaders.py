"""Files as documents: doc_id, content, title, source, format, records, record_count.

Files are listed and read by Spark. Their sizes are a filter on the listing, so what is too large is never read; what is rejected has a reason.
"""

from __future__ import annotations

import csv
import io
import json
import re
import warnings
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.markdown import markdown
from tessera.sources.shared import materialize

#: Bytes and characters of a file, bytes that a container may expand to, and how often its packed size.
MOST_BYTES, MOST_CHARS, MOST_EXPANDED, MOST_RATIO = 10 * 1024 * 1024, 10_000_000, 100 * 1024 * 1024, 1000
RECORDS, CONTAINERS, UNREAD = ("json", "jsonl", "csv"), ("docx",), ("doc", "pdf", "ppt", "pptx", "xls", "xlsx", "zip", "epub")


def path_parts(path: Column) -> tuple[Column, Column]:
    """Title and lower-case extension of a path."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.regexp_replace(name, "\\.[^.]*$", ""), F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1))


def file_id(path: Column) -> Column:
    return F.sha1(F.concat(F.lit("file:"), path))


def json_records(text: str) -> list[str]:
    """The elements of an array, or the value itself, each as JSON."""
    value = json.loads(text)
    return [json.dumps(v, ensure_ascii=False) for v in (value if isinstance(value, list) else [value])]


def line_records(text: str) -> list[str]:
    return [json.dumps(json.loads(line), ensure_ascii=False) for line in text.splitlines() if line.strip()]


def csv_records(text: str) -> list[str]:
    """The rows of a CSV text as lines `name: value`, by its own header; cells beyond the header have no name and are left out, missing ones are empty."""
    rows = csv.DictReader(io.StringIO(text, newline=""))
    return ["\n".join(f"{k}: {v or ''}" for k, v in row.items() if k is not None) for row in rows]


READERS: dict[str, Callable[[str], list[str]]] = {"json": json_records, "jsonl": line_records, "csv": csv_records}


def docx_text(content: bytes) -> str:
    """A Word file's paragraphs as Markdown; one that expands too far raises before it is unpacked."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = z.infolist()
        if sum(i.file_size for i in infos) > MOST_EXPANDED or any(i.file_size > MOST_RATIO * max(1, i.compress_size) for i in infos):
            raise ValueError("expands too far")
        root = ElementTree.fromstring(z.read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    out = []
    for p in root.iter(f"{w}p"):
        style = p.find(f"{w}pPr/{w}pStyle")
        level = re.fullmatch(r"[Hh]eading ?([1-6])", style.get(f"{w}val", "")) if style is not None else None
        text = "".join(t.text or "" for t in p.iter(f"{w}t"))
        if text.strip():
            out.append(f"{'#' * int(level[1])} {text}" if level else text)
    return "\n\n".join(out)


#: Readers that a user adds: extension to a function of the file's text.
Reader = Callable[[str], str]


def parsed(kind: str, content: bytes, most_chars: int = MOST_CHARS, readers: dict[str, Reader] | None = None) -> tuple[str | None, str | None, list[str] | None, str | None]:
    """Text, format and records of a file of an extension, and why it has none: a broken file is named, the others go on."""
    readers = readers or {}
    records, form = None, "txt"
    try:
        if kind in CONTAINERS and kind not in readers:
            text, form = docx_text(content), "md"
        else:
            text = content.decode("utf-8-sig", "replace")
            if len(text) > most_chars:
                return None, None, None, "text too long"
            if kind in readers:
                text = readers[kind](text)
            elif kind in READERS:
                records, form = READERS[kind](text), kind
                text = "\n\n".join(records)
            elif kind in ("html", "htm"):
                text, form = markdown(text), "md"
            elif kind in ("md", "markdown"):
                form = "md"
    except Exception as e:
        reason = str(e)[:200] or type(e).__name__
        return None, None, None, reason if reason == "expands too far" else f"broken: {reason}"
    return (None, None, None, "text too long") if len(text) > most_chars else (text, form, records, None)


def load(spark: SparkSession, path: str, *, most_bytes: int = MOST_BYTES, most_chars: int = MOST_CHARS, readers: dict[str, Reader] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents, and rejected files (path, reason): too large, of a kind that is not read, too long as text, or broken.

    Text, Markdown, JSON, JSON lines, CSV, HTML and Word files, by extension; `readers` adds or replaces some, unknown extensions count as text. Each file is read by itself: CSV by its own
    header, JSON records in one form. HTML and Word become Markdown.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    title, ext = path_parts(F.col("path"))
    unread = F.when(F.col("length") > most_bytes, "too large").when(ext.isin(*(set(UNREAD) - set(readers or {}))), "format not read")
    rejected = listed.select("path", unread.alias("reason")).where("reason IS NOT NULL")
    rows = listed.where(F.col("length") <= most_bytes).select("path", title.alias("title"), ext.alias("ext"), "content").where(~F.col("ext").isin(*(set(UNREAD) - set(readers or {}))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, t, kind, content in zip(*(c.to_pylist() for c in batch.columns)):
                text, form, records, reason = parsed(kind, content, most_chars, readers)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([t]), pa.array([text], pa.string()), pa.array([form], pa.string()), pa.array([records], pa.list_(pa.string())), pa.array([reason], pa.string())], names=["path", "title", "text", "format", "records", "reason"])

    read = rows.mapInArrow(run, "path string, title string, text string, format string, records array<string>, reason string")
    good = read.where("reason IS NULL")
    docs = good.select(file_id(F.col("path")).alias("doc_id"), F.col("text").alias("content"), "title", F.col("path").alias("source"), "format", "records", F.when(F.col("records").isNotNull(), F.size("records")).alias("record_count"))
    return docs, rejected.unionByName(read.where("reason IS NOT NULL").select("path", "reason"))


def documents(spark: SparkSession, path: str, *, strict: bool = False, **limits: int) -> DataFrame:
    """The documents of a folder, by load(). If files are rejected it warns with their number and reasons, or raises if `strict`; load() lists them all."""
    read, rejected = load(spark, path, **limits)
    bad = rejected.groupBy("reason").agg(F.count("*").alias("n"), F.min("path").alias("path")).orderBy("reason").limit(20).collect()
    if bad:
        message = "files not read: " + "; ".join(f"{r.n} {r.reason}, as {r.path}" for r in bad)
        if strict:
            raise ValueError(message)
        warnings.warn(message, stacklevel=2)
    return read


def trace_lines(spark: SparkSession, path: str, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Events (pos, event VARIANT) of JSON lines, and bad lines (pos, value); blank lines are left out. If `strict` a bad line raises with its number.

    pos counts lines within a file; it comes from reading each file whole, for a line's number needs all lines before it.
    """
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "value"))
    lines = whole.where("trim(value) <> ''").select((F.col("pos") + 1).alias("pos"), "value", F.try_parse_json("value").alias("event"))
    bad = lines.where("event IS NULL").select("pos", "value")
    if strict and (first := bad.orderBy("pos").limit(1).collect()):
        raise ValueError(f"line {first[0].pos} is no JSON")
    return lines.where("event IS NOT NULL").select("pos", "event"), bad


#: Lines and levels of a frontmatter.
MOST_LINES, MOST_LEVELS = 4096, 32
_FIELD = re.compile(r"(name|description):[ \t]*(.*)$")
#: What comes before a line's value; a value that is an anchor or alias, or a list or map in brackets that holds one.
_BEFORE = re.compile(r"\s*(?:- +)*(?:[^\s\"'\[{#][^:#]*:(?=\s|$)\s*)?(?:- +)*")
_LINKED = re.compile(r"[&*][A-Za-z0-9_]|[\[{](?:.*[\s\[{,:])?[&*][A-Za-z0-9_]")


def frontmatter(text: str) -> tuple[dict[str, str], str]:
    """name and description between the first line `---` and the next such line, and the text after it; {} and the whole text where there is none.

    Fields stand at the left edge; a value goes on over indented lines. Too many lines or levels, and anchors or aliases, raise: none of them is needed here. A sign & or * amid a
    value, or in a block of text behind | or >, is text.
    """
    lines = text.replace("\r\n", "\n").split("\n")
    if lines[0] != "---" or "---" not in lines[1:]:
        return {}, text
    end = lines.index("---", 1)
    head = lines[1:end]
    if len(head) > MOST_LINES:
        raise ValueError("frontmatter has too many lines")
    found: dict[str, list[str]] = {}
    field = ""
    levels, block = [0], None
    for line in head:
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        while levels[-1] > indent:
            levels.pop()
        if indent > levels[-1]:
            levels.append(indent)
        if len(levels) > MOST_LEVELS:
            raise ValueError("frontmatter is nested too deep")
        value = line[_BEFORE.match(line).end() :]
        if block is None or indent <= block:
            block = indent if re.fullmatch(r"[|>][+-]?\d?\s*", value) else None
            if _LINKED.match(value):
                raise ValueError("frontmatter has anchors or aliases")
        m = _FIELD.match(line) if not indent else None
        if m:
            field = m[1]
            found[field] = [m[2].strip()]
        elif indent and field:
            found[field].append(line.strip())
        else:
            field = ""
    clean = {k: " ".join(x for x in v if x and x not in ("|", ">", "|-", ">-")) for k, v in found.items()}
    return {k: v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v for k, v in clean.items()}, "\n".join(lines[end + 1 :])


def skills(spark: SparkSession, path: str) -> DataFrame:
    """name, description, path, body, reason of SKILL.md files with a frontmatter that names them, by name; a name that stands twice raises when the plan runs.

    A file whose frontmatter cannot be read comes with the reason and no name; in any other row the reason is null.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "SKILL.md").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    fields, body = frontmatter(content.decode("utf-8-sig", "replace"))
                except ValueError as e:
                    rows.append((None, None, p, None, str(e)))
                    continue
                if fields.get("name"):
                    rows.append((fields["name"], fields.get("description", ""), p, body, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 5)], names=["name", "description", "path", "body", "reason"])

    found = materialize(raw.select("path", "content").mapInArrow(run, "name string, description string, path string, body string, reason string"), "skills")
    broken = found.where("name IS NULL")
    found = found.where("name IS NOT NULL")
    n = found.groupBy("name").agg(F.count("*").alias("n"))
    checked = found.join(n, "name").withColumn("name", F.when(F.col("n") == 1, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("skill name stands twice: "), F.col("name"))).cast("string")))
    return checked.drop("n").select(*found.columns).unionByName(broken).orderBy("name")


def skill_catalog(found: DataFrame) -> str:
    """A line for each skill, by name: what a model is told before it asks for a body."""
    found = found.where("name IS NOT NULL")
    one = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col("description"))
    return found.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", one.alias("t")))), lambda s: s["t"]), "\n").alias("c")).first().c
