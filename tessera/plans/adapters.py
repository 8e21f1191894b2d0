"""The shared tables as the engine's own: scoped items, vectors, messages, memories, traces, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.scope import scoped


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as keyword items: id, content and a scope of language and source."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), "lang", "source")
    return scoped(docs, base="rag", sc_user=F.col("lang"), sc_agent=F.col("source"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "vec_id", "embedding", F.col("label").cast("string").alias("md_label"))
    return scoped(rows, base="memory", sc_user=F.col("md_label"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector as a query."""
    return read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("seq"), "role", F.col("text").alias("content"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 600 + F.col("turn") * 30).alias("created_at")
    )
    return scoped(rows, base="conversation", sc_session=F.col("conv_id"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as memories: one supersedes the next older one of its user and type where its value is lower."""
    e = read(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat_ws(" ", "event_type", "props").alias("content"),
        F.col("event_type").alias("type"),
        (F.pmod(F.col("event_id") * 37, F.lit(100)) / 100.0).alias("importance"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("updated_at"),
        F.when(F.col("event_id") % 5 == 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 2 DAY")).alias("last_accessed_at"),
        F.when(F.col("event_id") % 7 == 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 3 DAY")).alias("invalid_at"),
        F.when(F.col("event_id") % 7 == 0, (F.col("event_id") + 1).cast("string")).alias("superseded_by"),
        F.col("user_id").cast("string").alias("user"),
    )
    return scoped(rows, base="memory", sc_user=F.col("user"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trace events: the user is the run, one in 97 stands outside any."""
    e = read(spark, sf_dir, "events")
    kind = F.create_map(*(F.lit(x) for pair in {"signup": "llm", "view": "tool", "click": "retrieval", "purchase": "index_sync", "error": "custom"}.items() for x in pair))
    return e.select(
        F.when(F.col("event_id") % 97 != 0, F.concat(F.lit("run-"), F.col("user_id").cast("string"))).alias("run_id"),
        F.col("event_id").alias("pos"),
        kind[F.col("event_type")].alias("type"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "view", F.element_at(F.array(*map(F.lit, ("ok", "error", "blocked", "partial"))), (F.col("event_id") % 4 + 1).cast("int"))).alias("status"),
        F.when(F.col("event_type") == "signup", F.when(F.col("event_id") % 5 == 0, "length").otherwise("stop")).alias("finish_reason"),
        F.when(F.col("event_type") == "click", F.col("event_id") % 6).alias("hits"),
        F.when(F.col("event_type") == "purchase", F.col("event_id") % 3).alias("pending"),
        F.when(F.col("event_type") == "purchase", F.col("event_id") % 11 != 0).alias("converged"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of documents as chunks: chunk_id, doc_id, idx, heading_path, content."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", "source", F.posexplode(F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t\\r]"))).alias("idx", "content"))
    return rows.select(F.concat_ws("-", "doc_id", "idx").alias("chunk_id"), "doc_id", "idx", F.concat_ws(" > ", "source", "lang").alias("heading_path"), "content")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools of context candidates: the vectors of a label in blocks of twenty, scored by their first component."""
    v = read(spark, sf_dir, "embeddings")
    block = F.concat_ws("-", "label", F.floor(F.col("vec_id") / 200).cast("string"))
    return v.select(block.alias("query_id"), F.col("vec_id").cast("int").alias("pos"), F.floor((F.col("embedding")[0].cast("double") + 1) * 1000).alias("milli"), "embedding").select("query_id", "pos", (F.col("milli") / 1000.0).alias("score"), "embedding")


#: The adapters as common table expressions for SQL.
CTE = {
    "items": "items AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS content, lang, source FROM documents)",
    "messages": "messages AS (SELECT conv_id, turn AS seq, role, text AS content, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 600 + turn * 30) AS created_at FROM conversations)",
    "memories": """memories AS (SELECT CAST(event_id AS VARCHAR) AS id, event_id, event_type AS type, ((event_id * 37) % 100) / 100.0::DOUBLE AS importance, ts AS created_at,
      CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY END AS updated_at, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 2 DAY END AS last_accessed_at,
      CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 3 DAY END AS invalid_at, CASE WHEN event_id % 7 = 0 THEN CAST(event_id + 1 AS VARCHAR) END AS superseded_by, CAST(user_id AS VARCHAR) AS user FROM events)""",
    "traces": """traces AS (SELECT CASE WHEN event_id % 97 <> 0 THEN 'run-' || user_id END AS run_id, event_id AS pos,
      CASE event_type WHEN 'signup' THEN 'llm' WHEN 'view' THEN 'tool' WHEN 'click' THEN 'retrieval' WHEN 'purchase' THEN 'index_sync' ELSE 'custom' END AS type,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, value AS latency_ms, CASE WHEN event_type = 'view' THEN (['ok','error','blocked','partial'])[event_id % 4 + 1] END AS status,
      CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'length' ELSE 'stop' END END AS finish_reason, CASE WHEN event_type = 'click' THEN event_id % 6 END AS hits,
      CASE WHEN event_type = 'purchase' THEN event_id % 3 END AS pending, CASE WHEN event_type = 'purchase' THEN event_id % 11 <> 0 END AS converged FROM events),
    steps AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) - 1 AS step FROM traces),
    findings AS (SELECT run_id, step, unnest(list_filter([
        CASE WHEN type = 'tool' AND status = 'error' THEN {'code': 'tool_error', 'severity': 'error'} END, CASE WHEN type = 'tool' AND status = 'blocked' THEN {'code': 'tool_blocked', 'severity': 'warning'} END,
        CASE WHEN type = 'tool' AND status = 'partial' THEN {'code': 'tool_partial', 'severity': 'warning'} END, CASE WHEN type = 'llm' AND finish_reason = 'length' THEN {'code': 'llm_truncated', 'severity': 'warning'} END,
        CASE WHEN type = 'retrieval' AND hits = 0 THEN {'code': 'empty_retrieval', 'severity': 'warning'} END, CASE WHEN type = 'index_sync' AND pending > 0 THEN {'code': 'index_sync_pending', 'severity': 'warning'} END,
        CASE WHEN type = 'index_sync' AND NOT converged THEN {'code': 'index_not_converged', 'severity': 'error'} END, CASE WHEN type = 'custom' THEN {'code': 'unknown_event', 'severity': 'info'} END], lambda x: x IS NOT NULL), recursive := true) FROM steps)""",
    "chunks": """chunk_lists AS (SELECT doc_id, lang, source, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r]')) AS l FROM documents),
    chunks AS (SELECT doc_id || '-' || (i - 1) AS chunk_id, doc_id, CAST(i - 1 AS INT) AS idx, concat_ws(' > ', source, lang) AS heading_path, l[i] AS content FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM chunk_lists))""",
    "candidates": """candidates AS (SELECT label || '-' || CAST(vec_id // 200 AS VARCHAR) AS query_id, CAST(vec_id AS INT) AS pos, floor((CAST(embedding[1] AS DOUBLE) + 1) * 1000) / 1000.0 AS score, embedding FROM embeddings)""",
    "terms": f"""doc_terms AS (SELECT doc_id, regexp_extract_all(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{{L}}\\p{{N}}]+') AS terms FROM documents),
    postings AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM doc_terms) GROUP BY ALL),
    stats AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avg_dl FROM doc_terms),
    asked AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    scores AS (SELECT query_id, doc_id, sum(qtf * greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score
      FROM postings JOIN asked USING (term) JOIN dfs USING (term), stats GROUP BY ALL)""",
}


def sql(body: str, *names: str) -> str:
    return ("WITH " + ",\n".join(CTE[n] for n in names) + "\n" if names else "") + body.strip()
