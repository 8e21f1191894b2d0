"""Queries: loading, chunking, scalar parsers, and batch runs of the streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chunking, packing
from tessera.plans import adapters as ad
from tessera.plans.registry import Registry
from tessera.sources.markdown import to_markdown
from tessera.sources.shared import shared_dir
from tessera.streaming import feeds

registry = Registry()
query = registry.query
QUERIES, SQL = registry.queries, registry.sql


@query()
def html_load(spark: SparkSession, d: str) -> DataFrame:
    """Every page as Markdown."""
    return to_markdown(ad.read(spark, d, "pages").select("page_id", "html"), "html").withColumnRenamed("html", "content")


def _as_documents(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(F.col("id").cast("string").alias("doc_id"), "content", F.lit("").alias("title"), F.lit(kind).alias("format"), F.lit(None).cast("array<string>").alias("records"))


@query()
def markdown_split(spark: SparkSession, d: str) -> DataFrame:
    pages = to_markdown(ad.read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("content")), "content")
    return chunking.chunked(_as_documents(pages, "md")).drop("metadata")


def _weight(x: str) -> str:
    """Four for a wide character, one for any other, in SQL."""
    return f"(length({x}) + 3 * length(regexp_replace({x}, '[^\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\u8c48-\ufaff]', '', 'g')))"


# a budget of 128 tokens is a weight of 512, an overlap of 16 one of 64; the documents have no wide characters, so sentences over the budget are cut at 512 characters
@query(f"""SELECT doc_id, CAST(i - 1 AS INT) AS idx, '' AS heading_path, regexp_replace(array_to_string(pieces[r[i].a + 1 : r[i].b], chr(10)), '^\\s+|\\s+$', '', 'g') AS content FROM (
  SELECT *, unnest(range(1, len(r) + 1)) AS i FROM (
    SELECT doc_id, pieces, list_append(f.done, {{'a': f.n - len(f.held) + 1, 'b': f.n}}) AS r FROM (
      SELECT doc_id, pieces, list_reduce(list_transform(pieces, lambda p: CAST({_weight("p")} + 1 AS BIGINT)), lambda s, w: CASE WHEN len(s.held) > 1 AND s.total + w - s.held[1] - 1 > 512
        THEN {{'total': s.total + w, 'n': s.n + 1, 'held': list_append(list_filter(s.held, lambda h: h = s.total OR (s.total - h - 1 <= 64 AND s.total + w - h - 1 <= 512)), s.total + w), 'done': list_append(s.done, {{'a': s.n - len(s.held) + 1, 'b': s.n}})}}
        ELSE {{'total': s.total + w, 'n': s.n + 1, 'held': list_append(s.held, s.total + w), 'done': s.done}} END,
        {{'total': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'held': [CAST(0 AS BIGINT)], 'done': CAST([] AS STRUCT(a BIGINT, b BIGINT)[])}}) AS f FROM (
          SELECT CAST(doc_id AS VARCHAR) AS doc_id, flatten(list_transform(units, lambda u: CASE WHEN {_weight("u")} <= 512 THEN [u] ELSE flatten(list_transform(regexp_extract_all(u, '(?s)[^。！？.!?\n]*[。！？.!?\n]|[^。！？.!?\n]+'),
            lambda t: CASE WHEN {_weight("t")} <= 512 THEN [t] ELSE regexp_extract_all(t, '(?s).{{1,512}}') END)) END)) AS pieces
          FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> '') AS units FROM documents) WHERE len(units) > 0))))""")
def pack_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every line of a document is a unit; lines are packed to 128 tokens with 16 repeated."""
    docs = ad.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "\n", "\n\n").alias("content"))
    return packing.text_chunks(_as_documents(docs, "txt"), most=128, overlap=16)


@query("SELECT CAST(event_id AS VARCHAR) AS doc_id, CAST(i - 1 AS INT) AS idx, ([props, event_type, CAST(user_id AS VARCHAR)])[i] AS content FROM events, (SELECT unnest([1, 2, 3]) AS i) WHERE trim(([props, event_type, CAST(user_id AS VARCHAR)])[i]) <> ''")
def record_split(spark: SparkSession, d: str) -> DataFrame:
    """A chunk for each record of a JSON document: each event is one, of three records."""
    records = F.array("props", "event_type", F.col("user_id").cast("string"))
    docs = ad.read(spark, d, "events").select(F.col("event_id").cast("string").alias("doc_id"), F.array_join(records, "\n\n").alias("content"), F.lit("").alias("title"), F.lit("jsonl").alias("format"), records.alias("records"))
    return packing.text_chunks(docs).select("doc_id", "idx", "content")


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, content FROM (SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(text, '. ', chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS content FROM documents) WHERE content <> ''""")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs of each document, here its sentences, in one chunk without a bound."""
    docs = ad.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.replace("text", F.lit(". "), F.lit("\n\n")).alias("content"))
    return packing.text_chunks(_as_documents(docs, "txt"), most=1 << 40, overlap=0).select("doc_id", "content")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    prose = F.concat(F.lit("Here is the result:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    return ad.read(spark, d, "events").select("event_id", F.try_variant_get(tx.json_in_prose(prose), "$.k", "bigint").alias("k"))


@query("SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split('- ' || replace(text, '. ', chr(10) || '2) '), chr(10)), lambda x: trim(regexp_replace(x, '^[ \\t]*([-*•]|[0-9]+[.)])[ \\t]*', ''))), lambda x: x <> ''), '|') AS lines FROM conversations")
def bullet_parse(spark: SparkSession, d: str) -> DataFrame:
    listed = F.concat(F.lit("- "), F.replace("text", F.lit(". "), F.lit("\n2) ")))
    return ad.read(spark, d, "conversations").select("conv_id", "turn", F.array_join(tx.bullet_lines(listed), "|").alias("lines"))


@query("""SELECT user_id, array_to_string(CASE WHEN len(q) > 0 THEN q ELSE ['none'] END, '|') AS queries FROM (
  SELECT user_id, (list_transform(list_sort(list_distinct(list_transform(l, lambda x: {'i': list_position(l, x), 'v': x}))), lambda s: s.v))[1:8] AS q FROM (SELECT user_id, list(event_type ORDER BY event_id) AS l FROM events GROUP BY user_id))""")
def query_sanitize(spark: SparkSession, d: str) -> DataFrame:
    # the first event of each value: a user's list holds distinct values only, however many events there are
    first = ad.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    held = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("s"))
    return held.select("user_id", F.array_join(tx.query_list(F.transform("s", lambda s: s["event_type"]), F.lit("none")), "|").alias("queries"))


@query("SELECT conv_id, turn, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS text FROM conversations")
def external_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return ad.read(spark, d, "conversations").select("conv_id", "turn", tx.sanitized(F.col("text")).alias("text"))


def _workspace(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream; the pattern makes a single file a folder's listing too."""
    table = ad.read(spark, d, "events")
    return feeds.file_feed(spark, f"{d}/events.parque[t]", table.schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(stream: DataFrame, spark: SparkSession) -> DataFrame:
    at = _workspace(spark)
    feeds.append_log(stream, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("SELECT window_start, event_type, n_events FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of the event stream: the windows that the watermark has closed."""
    out = _drained(feeds.windowed_counts(_event_stream(spark, d), "ts", "1 hour", "10 minutes", "event_type"), spark)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The stream with every event sent twice, each taken once."""
    twice = _event_stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _drained(feeds.once(twice, "event_id", "ts", "1 hour").select("event_id", "user_id", "event_type"), spark)
