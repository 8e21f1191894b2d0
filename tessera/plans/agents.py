"""Queries: memory, sessions, context, traces, index maintenance, tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import budget as bd
from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.operators import context, memory, search, sessions, sync, tables, tools, traces
from tessera.operators.scope import child_agent, scoped
from tessera.plans import adapters as ad
from tessera.plans.registry import Registry

registry = Registry()
query = registry.query
QUERIES, SQL = registry.queries, registry.sql

NOW = "2024-02-15 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


# ---- memory


def _memory_hits(spark: SparkSession, d: str) -> DataFrame:
    """For each user, the memories by an id-derived score, best first, twenty of them."""
    m = ad.memories(spark, d)
    return search.ranked(m.select(F.col("user").alias("query_id"), "id", (F.pmod(F.col("id").cast("long") * 53, F.lit(997)) / 997.0).alias("score")), 20, F.desc("score"), F.col("id"))


MEMORY_HITS = """hits AS (SELECT * FROM (SELECT user AS query_id, id, ((event_id * 53) % 997) / 997.0::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY user ORDER BY (event_id * 53) % 997 DESC, id) AS INT) AS rank FROM memories) WHERE rank <= 20)"""
BLEND = (
    "SELECT * FROM (WITH " + ad.CTE["memories"] + ", " + MEMORY_HITS + """,
valid AS (SELECT h.query_id, h.id, h.rank AS hit_rank, h.score, importance, coalesce({anchor}) AS anchor, min(h.score) OVER w AS lo, max(h.score) OVER w AS hi
  FROM hits h JOIN memories m USING (id) WHERE invalid_at IS NULL WINDOW w AS (PARTITION BY h.query_id)),
parts AS (SELECT *, CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END AS relevance, pow(0.5::DOUBLE, greatest(epoch_us(TIMESTAMP '2024-02-15') - epoch_us(anchor), 0) / 3.6e9::DOUBLE / 720) AS recency FROM valid),
total AS (SELECT *, 0.6::DOUBLE * relevance + 0.2::DOUBLE * recency + 0.2::DOUBLE * importance AS s FROM parts)
SELECT query_id, id, floor(relevance * 1e6 + 0.5) / 1e6 AS relevance, floor(recency * 1e6 + 0.5) / 1e6 AS recency, importance, floor(s * 1e6 + 0.5) / 1e6 AS score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY floor(s * 1e9 + 0.5) / 1e9 DESC, hit_rank) AS INT) AS rank FROM total) WHERE rank <= 5)"""
)


def _blend(spark: SparkSession, d: str, by_access: bool) -> DataFrame:
    out = memory.blended(_memory_hits(spark, d), ad.memories(spark, d), now(), by_access=by_access)
    return out.withColumns({c: vx.rounded(F.col(c)) for c in ("relevance", "recency", "score")})


@query(BLEND.format(anchor="updated_at, created_at"))
def memory_blend(spark: SparkSession, d: str) -> DataFrame:
    return _blend(spark, d, False)


@query(BLEND.format(anchor="last_accessed_at, updated_at, created_at"))
def memory_last_access_anchor(spark: SparkSession, d: str) -> DataFrame:
    return _blend(spark, d, True)


@query("SELECT query_id, id FROM (WITH " + ad.CTE["memories"] + ", " + MEMORY_HITS + " SELECT h.query_id, h.id FROM hits h JOIN memories m USING (id) WHERE invalid_at IS NOT NULL)")
def memory_dangling_hits(spark: SparkSession, d: str) -> DataFrame:
    return memory.dangling(_memory_hits(spark, d), ad.memories(spark, d)).select("query_id", "id")


@query("SELECT id, floor(pow(0.5::DOUBLE, greatest(epoch_us(TIMESTAMP '2024-02-15') - epoch_us(coalesce(updated_at, created_at)), 0) / 3.6e9::DOUBLE / 720) * 1e6 + 0.5) / 1e6 AS recency FROM memories", "memories")
def recency_decay(spark: SparkSession, d: str) -> DataFrame:
    m = ad.memories(spark, d)
    return m.select("id", vx.rounded(vx.recency(F.coalesce("updated_at", "created_at"), now(), memory.HALF_LIFE_HOURS)).alias("recency"))


@query("SELECT id FROM memories WHERE importance < 0.2", "memories")
def forget_importance(spark: SparkSession, d: str) -> DataFrame:
    return memory.forget_unimportant(ad.memories(spark, d), 0.2).select("id")


@query("SELECT id FROM memories WHERE created_at < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY", "memories")
def forget_age(spark: SparkSession, d: str) -> DataFrame:
    return memory.forget_older(ad.memories(spark, d), now(), 30).select("id")


@query("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY user ORDER BY importance DESC, created_at DESC, id DESC) AS n FROM memories) WHERE n > 10", "memories")
def forget_capacity(spark: SparkSession, d: str) -> DataFrame:
    return memory.forget_beyond(ad.memories(spark, d), 10, "user").select("id")


@query("""SELECT id, CASE WHEN superseded_by IN (SELECT id FROM memories) THEN superseded_by ELSE coalesce(superseded_by, id) END AS final, CASE WHEN superseded_by IS NULL THEN 0 ELSE 1 END AS steps FROM memories""", "memories")
def supersede_chain(spark: SparkSession, d: str) -> DataFrame:
    return memory.superseded_chain(ad.memories(spark, d)).select("id", "final", "steps")


@query("""SELECT user, floor(sum(s) / sum(n) * 1e10 + 0.5) / 1e10 AS importance, arg_min(type, lpad(CAST(1000000 - n AS VARCHAR), 8, '0') || type) AS type, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT user, type, count(*) AS n, sum(importance) AS s FROM memories GROUP BY ALL) GROUP BY user""", "memories")
def consolidate_attrs(spark: SparkSession, d: str) -> DataFrame:
    return memory.consolidated_attributes(ad.memories(spark, d), "user").withColumn("importance", vx.rounded(F.col("importance"), 10))


@query("SELECT id, CASE WHEN event_id % 10 = 1 THEN 'm-' || id ELSE superseded_by END AS superseded_by, (event_id % 10 = 1 OR invalid_at IS NOT NULL) AS invalid FROM memories", "memories")
def memory_invalidate(spark: SparkSession, d: str) -> DataFrame:
    m = ad.memories(spark, d)
    gone = m.where("CAST(id AS BIGINT) % 10 = 1").select("id", F.concat(F.lit("m-"), "id").alias("by"))
    return memory.invalidated(m, gone, now()).select("id", "superseded_by", F.col("invalid_at").isNotNull().alias("invalid"))


@query("""SELECT id, invalid_at IS NOT NULL OR event_id % 20 IN (2, 3) AS invalid FROM memories UNION ALL SELECT 'new-' || id, false FROM memories WHERE event_id % 20 IN (1, 2)""", "memories")
def memory_smart_write(spark: SparkSession, d: str) -> DataFrame:
    m = ad.memories(spark, d)
    op = F.element_at(F.array(*map(F.lit, ("ADD", "UPDATE", "DELETE", "NOOP"))), (F.col("id").cast("long") % 20).cast("int"))
    decisions = m.where("CAST(id AS BIGINT) % 20 BETWEEN 1 AND 4").select(op.alias("op"), F.concat(F.lit("new-"), "id").alias("new"), F.col("id").alias("target"), "content", "importance")
    out = memory.smart_write(m, decisions.withColumnRenamed("new", "id"), now())
    return out.select("id", F.col("invalid_at").isNotNull().alias("invalid"))


@query("SELECT type, count(*) AS n FROM memories GROUP BY type UNION ALL SELECT NULL, count(*) FROM memories", "memories")
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    return memory.statistics(ad.memories(spark, d))


@query("""SELECT event_id, CASE WHEN op = 'NOOP' THEN 'NOOP' WHEN op IN ('UPDATE', 'DELETE') AND i BETWEEN 1 AND 5 THEN op ELSE 'ADD' END AS op, CASE WHEN op IN ('UPDATE', 'DELETE') AND i BETWEEN 1 AND 5 THEN i ELSE 0 END AS index FROM (
  SELECT event_id, (['ADD', 'UPDATE', 'DELETE', 'NOOP', 'odd'])[event_id % 5 + 1] AS op, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 8 AS INT) END AS i FROM events)""")
def reconcile_parse(spark: SparkSession, d: str) -> DataFrame:
    e = ad.read(spark, d, "events")
    op = F.element_at(F.array(*map(F.lit, ("ADD", "UPDATE", "DELETE", "NOOP", "odd"))), (F.col("event_id") % 5 + 1).cast("int"))
    index = F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 8).cast("string")).otherwise("true")
    parsed, place = memory.parsed_decision(op, index, F.lit(5))
    return e.select("event_id", parsed.alias("op"), F.coalesce(place, F.lit(0)).alias("index"))


@query("SELECT o_custkey AS key, o_orderstatus AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def kv_latest(spark: SparkSession, d: str) -> DataFrame:
    o = ad.read(spark, d, "orders")
    return tables.latest(o, ("o_custkey",), F.col("o_orderkey")).select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("value"))


@query("SELECT lang AS id, count(*) AS n_rows FROM (SELECT DISTINCT lang, source FROM documents WHERE lang <> 'es') GROUP BY lang HAVING count(*) > 1")
def kv_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    t = scoped(ad.read(spark, d, "documents").select(F.col("lang").alias("id"), "source").distinct(), sc_user=F.col("source"))
    return tables.ambiguous(t, "id", F.col("id") != "es")


@query("SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def checkpoint_latest(spark: SparkSession, d: str) -> DataFrame:
    return tables.latest(ad.read(spark, d, "events"), ("user_id",), F.col("event_id")).select("user_id", "event_type")


# ---- sessions


@query("SELECT conv_id, seq, role, content FROM messages", "messages")
def session_load(spark: SparkSession, d: str) -> DataFrame:
    return sessions.loaded(ad.messages(spark, d), ("sc_session",)).select("conv_id", "seq", "role", "content")


@query("""SELECT 'base' AS dimension, 'conversation' AS value, count(*) AS message_count, min(created_at) AS first_at, max(created_at) AS last_at FROM messages
UNION ALL SELECT 'sc_session', CAST(conv_id AS VARCHAR), count(*), min(created_at), max(created_at) FROM messages GROUP BY conv_id""", "messages")
def session_list_scopes(spark: SparkSession, d: str) -> DataFrame:
    out = sessions.scope_summaries(ad.messages(spark, d))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")})


@query("SELECT conv_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS n FROM messages) WHERE n <= 3", "messages")
def session_prune_last(spark: SparkSession, d: str) -> DataFrame:
    return sessions.pruned(ad.messages(spark, d), ("sc_session",), keep_last=3).select("conv_id", "seq")


@query("SELECT conv_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS n FROM messages WHERE created_at >= TIMESTAMP '2024-01-01 06:00:00') WHERE n <= 2", "messages")
def session_prune_before(spark: SparkSession, d: str) -> DataFrame:
    return sessions.pruned(ad.messages(spark, d), ("sc_session",), before=F.lit("2024-01-01 06:00:00").cast("timestamp"), keep_last=2).select("conv_id", "seq")


TOKENS = "CAST((length(content) + 3) // 4 AS BIGINT)"


def _with_tokens(spark: SparkSession, d: str) -> DataFrame:
    return ad.messages(spark, d).withColumn("tokens", tx.token_count(F.col("content")))


@query(f"""SELECT conv_id, seq, CASE WHEN total > 400 AND n > 2 AND back > 2 THEN 'old' ELSE 'recent' END AS part FROM (
  SELECT conv_id, seq, sum({TOKENS}) OVER (PARTITION BY conv_id) AS total, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS back FROM messages)""", "messages")
def compact_split(spark: SparkSession, d: str) -> DataFrame:
    return sessions.compaction_split(_with_tokens(spark, d), ("sc_session",), trigger=400, keep_recent=2).select("conv_id", "seq", "part")


@query("SELECT conv_id, seq, sha256(string_agg(role || chr(31) || content, chr(30)) OVER (PARTITION BY conv_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS digest FROM messages", "messages")
def history_digest(spark: SparkSession, d: str) -> DataFrame:
    return sessions.prefix_digests(ad.messages(spark, d), ("sc_session",)).select("conv_id", "seq", "digest")


@query(f"""SELECT conv_id, seq, unit, CASE WHEN total <= 300 THEN 'recent' WHEN place <= 1 THEN 'head' WHEN unit > last - 2 THEN 'recent' ELSE 'middle' END AS part FROM (
  SELECT *, max(unit) OVER (PARTITION BY conv_id) AS last FROM (SELECT conv_id, seq, CAST(sum(CASE WHEN seq % 3 = 2 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY seq) AS BIGINT) AS unit,
    sum({TOKENS}) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS place FROM messages))""", "messages")
def reduce_units(spark: SparkSession, d: str) -> DataFrame:
    m = _with_tokens(spark, d).withColumn("role", F.when(F.col("seq") % 3 == 2, "tool").otherwise(F.col("role")))
    return sessions.reduced(m, ("sc_session",), budget=300).select("conv_id", "seq", "unit", "part")


def _policy_events(spark: SparkSession, d: str) -> DataFrame:
    return ad.traces(spark, d).where("run_id IS NOT NULL")


@query("""SELECT run_id, pos, llm_calls, tool_calls, tokens_used FROM (SELECT run_id, pos, CAST(sum(CASE WHEN type = 'llm' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS llm_calls, CAST(sum(CASE WHEN type = 'tool' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS tool_calls,
  CAST(sum(coalesce(tokens, 0)) OVER w AS BIGINT) AS tokens_used FROM traces WHERE run_id IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) WHERE llm_calls > 5 OR tool_calls > 5 OR tokens_used > 1000""", "traces")
def policy_running_limits(spark: SparkSession, d: str) -> DataFrame:
    counted = sessions.running_counters(_policy_events(spark, d), "run_id", "pos")
    return sessions.over_limits(counted, llm_calls=5, tool_calls=5, tokens=1000).select("run_id", "pos", "llm_calls", "tool_calls", "tokens_used")


@query("""SELECT user_id, CASE WHEN n >= 2 THEN n ELSE 0 END AS n_parallel FROM (SELECT user_id, count(*) FILTER (WHERE b = 0 AND event_type IN ('view', 'click')) AS n FROM (
  SELECT *, sum(CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS b FROM events) GROUP BY user_id)""")
def parallel_run_length(spark: SparkSession, d: str) -> DataFrame:
    calls = ad.read(spark, d, "events").withColumn("eligible", F.col("event_type").isin("view", "click"))
    return sessions.parallel_run(calls, "user_id", "event_id")


@query("""SELECT session, turn, i, CASE WHEN n > 1 OR call_id = '' THEN call_id || '#t' || turn || '-' || i ELSE call_id END AS unique_id FROM (
  SELECT *, row_number() OVER (PARTITION BY session, call_id ORDER BY turn, event_id) AS n, row_number() OVER (PARTITION BY session, turn ORDER BY event_id) - 1 AS i FROM (
    SELECT user_id AS session, event_id // 100 AS turn, event_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS call_id FROM events))""")
def call_id_unique(spark: SparkSession, d: str) -> DataFrame:
    calls = ad.read(spark, d, "events").select(F.col("user_id").alias("session"), F.floor(F.col("event_id") / 100).alias("turn"), "event_id", F.when(F.col("event_id") % 9 == 0, "").otherwise(F.col("event_type")).alias("call_id"))
    out = sessions.unique_call_ids(calls, "turn", "event_id")
    i = F.row_number().over(W.partitionBy("session", "turn").orderBy("event_id")) - 1
    return out.select("session", "turn", i.cast("long").alias("i"), "unique_id")


@query("SELECT event_id AS call_id FROM events WHERE event_type = 'purchase' AND event_id % 3 <> 0")
def pending_calls(spark: SparkSession, d: str) -> DataFrame:
    calls = ad.read(spark, d, "events").select(F.col("event_id").alias("call_id"), (F.col("event_type") == "purchase").alias("needs_approval"))
    return sessions.pending(calls, calls.where("call_id % 3 = 0")).select("call_id")


@query("SELECT user_id AS stream, event_type AS call_index, min(event_id) AS id, string_agg(props, '' ORDER BY event_id) AS arguments FROM events GROUP BY ALL")
def stream_deltas(spark: SparkSession, d: str) -> DataFrame:
    chunks = ad.read(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_type").alias("call_index"), F.col("event_id").alias("chunk_no"), F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.col("props").alias("arguments"))
    return sessions.assembled_deltas(chunks).select("stream", "call_index", "id", "arguments")


# ---- context


@query("""SELECT query_id, place, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM (
  SELECT source AS query_id, text AS content, doc_id AS pos, length(text) % 7 AS score, row_number() OVER (PARTITION BY source, text ORDER BY length(text) % 7 DESC, doc_id) AS n, min(doc_id) OVER (PARTITION BY source, text) AS first FROM documents) WHERE n = 1)""")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.read(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("text").alias("content"), F.col("doc_id").alias("pos"), (F.char_length("text").cast("long") % 7).alias("score"))
    return context.exact_dedup(rows).select("query_id", F.col("place").cast("long").alias("place"), "pos", "score")


def _unrolled_mmr(k: int) -> str:
    """Greedy choice as k steps, each a pair of common table expressions."""
    dot = lambda a, b: f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
    out = ["SELECT * FROM (WITH " + ad.CTE["candidates"]]
    out.append("c0 AS (SELECT query_id, pos, embedding, CASE WHEN hi = lo THEN 1.0::DOUBLE WHEN lo < 0 THEN (score - lo) / (hi - lo) ELSE score / hi END AS rel, CAST(NULL AS DOUBLE) AS sim FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM candidates))")
    for n in range(1, k + 1):
        out.append(f"p{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 0.7::DOUBLE * rel - (1 - 0.7::DOUBLE) * coalesce(sim, 0) DESC, pos) AS o FROM c{n - 1} WHERE coalesce(sim, -2) < 0.95) WHERE o = 1)")
        out.append(f"c{n} AS (SELECT c.query_id, c.pos, c.embedding, c.rel, greatest(c.sim, {dot('c.embedding', 'p.embedding')}) AS sim FROM c{n - 1} c JOIN p{n} p ON p.query_id = c.query_id AND p.pos <> c.pos WHERE coalesce(c.sim, -2) < 0.95)")
    picks = " UNION ALL ".join(f"SELECT query_id, {n} AS pick, pos FROM p{n}" for n in range(1, k + 1))
    return ", ".join(out) + " " + picks + ")"


@query(_unrolled_mmr(4))
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    return context.mmr(ad.candidates(spark, d), k=4)


def _budget_rows(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("memory", "rag", "history", "tool"))), (F.col("turn") % 4 + 1).cast("int"))
    return ad.read(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), kind.alias("source"), F.col("turn").alias("pos"), tx.token_count(F.col("text")).alias("tokens"), F.col("text").alias("content"))


BUDGET = f"""rows AS (SELECT conv_id AS query_id, (['memory', 'rag', 'history', 'tool'])[turn % 4 + 1] AS source, turn AS pos, CAST((length(text) + 3) // 4 AS BIGINT) AS tokens FROM conversations),
ratios AS (SELECT unnest(['memory', 'rag', 'history', 'tool']) AS source, unnest([2, 4, 3, 1]::DOUBLE[]) AS ratio),
quotas AS (SELECT query_id, source, CAST(floor(500 * ratio / sum(ratio) OVER (PARTITION BY query_id)) AS BIGINT) AS quota FROM (SELECT DISTINCT query_id, source FROM rows) JOIN ratios USING (source)),
r1 AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id, source ORDER BY pos ROWS UNBOUNDED PRECEDING) <= quota AS taken FROM rows JOIN quotas USING (query_id, source)),
state AS (SELECT *, 500 - sum(CASE WHEN taken THEN tokens ELSE 0 END) OVER (PARTITION BY query_id) AS idle, sum(CASE WHEN taken THEN 0 ELSE tokens END) OVER (PARTITION BY query_id, source) AS want, sum(CASE WHEN taken THEN 0 ELSE tokens END) OVER (PARTITION BY query_id) AS want_all FROM r1)"""


def _ratios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("memory", 2.0), ("rag", 4.0), ("history", 3.0), ("tool", 1.0)], "source string, ratio double")


@query("SELECT * FROM (WITH " + BUDGET + " SELECT query_id, source, quota FROM quotas)")
def context_quotas(spark: SparkSession, d: str) -> DataFrame:
    return context.quotas(_budget_rows(spark, d).select("query_id", "source").distinct().join(_ratios(spark), "source"), 500).select("query_id", "source", "quota")


@query("SELECT * FROM (WITH " + BUDGET + """ SELECT query_id, source, pos, tokens, 1 AS round FROM state WHERE taken UNION ALL
SELECT query_id, source, pos, tokens, CASE WHEN sum(tokens) OVER (PARTITION BY query_id, source ORDER BY pos ROWS UNBOUNDED PRECEDING) <= floor(idle * want / want_all) THEN 2 ELSE 0 END FROM state WHERE NOT taken)""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return context.allocated(_budget_rows(spark, d), _ratios(spark), 500).withColumn("round", F.coalesce("round", F.lit(0)))


@query("""SELECT query_id, string_agg(t, chr(10) || chr(10) ORDER BY place) AS context FROM (SELECT conv_id AS query_id, CAST(place AS INT) AS place, '## ' || (['memory', 'rag', 'history', 'tool'])[place] || chr(10) || string_agg(text, chr(10) ORDER BY turn) AS t
  FROM (SELECT *, turn % 4 + 1 AS place FROM conversations) GROUP BY conv_id, place) GROUP BY query_id""")
def sections_render(spark: SparkSession, d: str) -> DataFrame:
    return context.sections(_budget_rows(spark, d))


@query("""SELECT o_orderkey, CAST(greatest(least(w // 10, floor(w * 0.5), coalesce(m, floor(w * 0.5))), 0) AS BIGINT) AS reserve,
  CAST(greatest(w - greatest(least(w // 10, floor(w * 0.5), coalesce(m, floor(w * 0.5))), 0) - floor(w * 0.02), 0) AS BIGINT) AS spendable FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS w, CASE WHEN o_orderkey % 3 = 0 THEN 4096 END AS m FROM orders)""")
def window_budget(spark: SparkSession, d: str) -> DataFrame:
    o = ad.read(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("w"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(4096).cast("long")).alias("m"))
    o = o.withColumn("reserve", bd.output_reserve(F.col("w"), F.floor(F.col("w") / 10), F.col("m")))
    return o.select("o_orderkey", "reserve", bd.spendable(F.col("w"), F.col("reserve")).alias("spendable"))


@query("SELECT event_id, CAST(coalesce(k, 0) + event_id % 50 + 7 AS BIGINT) AS prompt, CAST(coalesce(k, 0) + event_id % 50 + 7 + event_id % 20 AS BIGINT) AS total FROM (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events)")
def usage_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = ad.read(spark, d, "events")
    k = F.when(F.col("event_id") % 4 != 0, F.get_json_object("props", "$.k").cast("long"))
    prompt, total = bd.total_tokens(k, F.col("event_id") % 20, F.col("event_id") % 50, F.lit(7))
    return e.select("event_id", prompt.cast("long").alias("prompt"), total.cast("long").alias("total"))


# ---- traces


@query("SELECT run_id, pos, step FROM steps", "traces")
def trace_steps(spark: SparkSession, d: str) -> DataFrame:
    return traces.steps(ad.traces(spark, d)).select("run_id", "pos", F.col("step").cast("long").alias("step"))


@query("SELECT run_id, step, code, severity FROM findings", "traces")
def trace_findings(spark: SparkSession, d: str) -> DataFrame:
    return traces.findings(traces.steps(ad.traces(spark, d))).withColumn("step", F.col("step").cast("long"))


@query("""SELECT run_id, steps, llm_calls, tool_calls, tokens, floor(latency_ms * 1e3 + 0.5) / 1e3 AS latency_ms, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM (
  SELECT run_id, count(*) AS steps, count(*) FILTER (WHERE type = 'llm') AS llm_calls, count(*) FILTER (WHERE type = 'tool') AS tool_calls, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens, sum(latency_ms) AS latency_ms FROM traces GROUP BY run_id)
LEFT JOIN (SELECT run_id AS r, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM findings GROUP BY run_id) ON run_id IS NOT DISTINCT FROM r""", "traces")
def trace_run_stats(spark: SparkSession, d: str) -> DataFrame:
    t = ad.traces(spark, d)
    return traces.run_stats(t, traces.findings(traces.steps(t))).withColumn("latency_ms", vx.rounded(F.col("latency_ms"), 3))


@query("SELECT type, count(*) AS events, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens, floor(sum(latency_ms) * 1e3 + 0.5) / 1e3 AS latency_ms FROM traces GROUP BY GROUPING SETS ((type), ())", "traces")
def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    return traces.summary(ad.traces(spark, d)).withColumn("latency_ms", vx.rounded(F.col("latency_ms"), 3))


@query("SELECT *, row_number() OVER (ORDER BY run_id IS NULL, first_pos) - 1 AS place FROM (SELECT run_id, min(pos) AS first_pos, count(*) AS n_events FROM traces GROUP BY run_id)", "traces")
def trace_run_order(spark: SparkSession, d: str) -> DataFrame:
    return traces.run_order(ad.traces(spark, d))


@query("""SELECT run_id, coalesce(step, -1) AS step, gap, at_step FROM (WITH shown AS (SELECT s.run_id, s.step, s.step < 12 OR s.step > max(s.step) OVER (PARTITION BY s.run_id) - 8 OR f.step IS NOT NULL AS shown FROM steps s
  LEFT JOIN (SELECT DISTINCT run_id, step FROM findings) f ON f.run_id IS NOT DISTINCT FROM s.run_id AND f.step = s.step),
grouped AS (SELECT *, sum(CASE WHEN shown THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS g FROM shown)
SELECT run_id, step, 0 AS gap, step AS at_step FROM grouped WHERE shown UNION ALL SELECT run_id, NULL, count(*), min(step) FROM grouped WHERE NOT shown GROUP BY run_id, g)""", "traces")
def trace_elide(spark: SparkSession, d: str) -> DataFrame:
    s = traces.steps(ad.traces(spark, d))
    out = traces.elided(s, traces.findings(s))
    return out.select("run_id", F.coalesce("step", F.lit(-1)).cast("long").alias("step"), "gap", F.col("at").cast("long").alias("at_step"))


@query("SELECT run_id, pos FROM traces WHERE run_id = (SELECT arg_max(run_id, p) FROM (SELECT run_id, min(pos) AS p FROM traces WHERE run_id IS NOT NULL GROUP BY run_id))", "traces")
def trace_pick_last(spark: SparkSession, d: str) -> DataFrame:
    return traces.last_run(ad.traces(spark, d)).select("run_id", "pos")


@query("SELECT run_id, count(*) FILTER (WHERE severity = 'error') > 0 AS needs_doctor FROM findings GROUP BY run_id", "traces")
def trace_doctor(spark: SparkSession, d: str) -> DataFrame:
    t = ad.traces(spark, d)
    found = traces.findings(traces.steps(t))
    flagged = traces.needs_doctor(traces.run_stats(t, found))
    with_any = found.select(F.col("run_id").alias("r")).distinct()
    return flagged.join(with_any, flagged["run_id"].eqNullSafe(with_any["r"]), "left_semi").select("run_id", "needs_doctor")


EVENT_LINE = """'[' || type || ']' || CASE type WHEN 'llm' THEN ' ' || concat_ws(' ', tokens || ' tokens', 'finish=' || finish_reason) WHEN 'tool' THEN coalesce(' status=' || status, '')
  WHEN 'retrieval' THEN coalesce(' ' || hits || ' hits', '') WHEN 'index_sync' THEN ' ' || concat_ws(' ', 'pending=' || pending, 'converged=' || converged) ELSE '' END"""
ELIDED = """shown AS (SELECT s.*, s.step < 12 OR s.step > max(s.step) OVER (PARTITION BY s.run_id) - 8 OR f.step IS NOT NULL AS shown FROM steps s
  LEFT JOIN (SELECT DISTINCT run_id, step FROM findings) f ON f.run_id IS NOT DISTINCT FROM s.run_id AND f.step = s.step),
grouped AS (SELECT *, sum(CASE WHEN shown THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS g FROM shown),
listed AS (SELECT run_id, step AS spot, step || ' ' || """ + EVENT_LINE + """ AS l FROM grouped WHERE shown UNION ALL SELECT run_id, min(step), '… ' || count(*) || ' steps …' FROM grouped WHERE NOT shown GROUP BY run_id, g),
totals AS (SELECT run_id AS r, count(*) || ' steps, ' || count(*) FILTER (WHERE type = 'llm') || ' llm, ' || count(*) FILTER (WHERE type = 'tool') || ' tool, ' || CAST(sum(coalesce(tokens, 0)) AS BIGINT) || ' tokens, ' AS t FROM traces GROUP BY run_id),
issues AS (SELECT run_id AS ir, count(*) FILTER (WHERE severity = 'error') AS e, count(*) FILTER (WHERE severity = 'warning') AS w FROM findings GROUP BY run_id)"""


@query("SELECT * FROM (WITH " + ad.CTE["traces"] + ", " + ELIDED + """ SELECT run_id, left(any_value(t) || any_value(coalesce(e, 0)) || ' errors, ' || any_value(coalesce(w, 0)) || ' warnings' || chr(10) || string_agg(l, chr(10) ORDER BY spot), 20000) AS timeline
  FROM listed JOIN totals ON r IS NOT DISTINCT FROM run_id LEFT JOIN issues ON ir IS NOT DISTINCT FROM run_id GROUP BY run_id)""")
def trace_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Every run: its totals, its first and last steps, those with findings, and counts for the gaps."""
    return traces.rendered(ad.traces(spark, d))


# ---- index maintenance


def _source_and_book(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as source; in the book every fifth is missing, every seventh has an old hash, every eleventh is pending, and some are long gone."""
    docs = ad.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha1("text").alias("content_hash"), "lang")
    source = scoped(docs, base="rag", sc_user=F.col("lang"))
    at = F.lit("2024-01-01").cast("timestamp")
    book = source.where("id % 5 <> 0").withColumn("content_hash", F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("content_hash"))).withColumn("updated_at", at).withColumn("pending_since", F.when(F.col("id") % 11 == 0, at))
    gone = book.where("id % 13 = 0").withColumn("id", -F.col("id") - 1)
    return source, book.unionByName(gone).drop("lang")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0")
def sync_changed(spark: SparkSession, d: str) -> DataFrame:
    source, book = _source_and_book(spark, d)
    return sync.changed(source, book).select("id")


@query("SELECT -doc_id - 1 AS id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 13 = 0")
def sync_stale(spark: SparkSession, d: str) -> DataFrame:
    return sync.stale(*_source_and_book(spark, d)).select("id")


@query("SELECT doc_id AS id, sha1(text) AS content_hash, false AS pending FROM documents")
def sync_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return sync.reconciled(*_source_and_book(spark, d), now()).select("id", "content_hash", F.col("pending_since").isNotNull().alias("pending"))


@query("SELECT doc_id AS id, 'missing' AS side FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT -doc_id - 1, 'extra' FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 13 = 0")
def verify_divergence(spark: SparkSession, d: str) -> DataFrame:
    return sync.divergence(*_source_and_book(spark, d)).select("id", "side")


@query("SELECT doc_id, doc_id % 3 = 0 AS skipped FROM documents")
def ingest_skip(spark: SparkSession, d: str) -> DataFrame:
    docs = ad.read(spark, d, "documents").select("doc_id", F.sha1("text").alias("fingerprint"))
    hashes = docs.where("doc_id % 3 <> 2").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("fingerprint")).otherwise("old").alias("content_hash"))
    return sync.ingest_plan(docs, hashes).select("doc_id", "skipped")


# ---- tools


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return ad.read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("origin"), F.concat(F.lit("tool-"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_name").alias("description"), F.col("p_type").alias("schema"))


@query("SELECT 'tool-' || p_partkey AS name FROM part WHERE p_brand <> 'Brand#1' AND p_partkey <> 3 AND (p_brand IN ('Brand#2', 'Brand#3') OR p_partkey IN (3, 10, 11))")
def permission_gate(spark: SparkSession, d: str) -> DataFrame:
    allowed = tools.permitted(F.col("name"), F.col("origin"), deny_names=("tool-3",), deny_origins=("Brand#1",), allow_names=("tool-3", "tool-10", "tool-11"), allow_origins=("Brand#2", "Brand#3"))
    return _registry(spark, d).where(allowed).select("name")


@query("SELECT o_orderkey AS request_id, i AS place, name FROM (SELECT o_orderkey, i, (list_distinct_in_order)[i + 1] AS name FROM (SELECT o_orderkey, unnest(range(len(l))) AS i, l AS list_distinct_in_order FROM (SELECT o_orderkey, CASE WHEN o_custkey = o_orderkey THEN ['tool-' || o_custkey] ELSE ['tool-' || o_custkey, 'tool-' || o_orderkey] END AS l FROM orders))) WHERE name IN (SELECT 'tool-' || p_partkey FROM part)")
def tool_subset(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("tool-"), F.col(c).cast("string"))
    wanted = ad.read(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.array(name("o_custkey"), name("o_orderkey"), name("o_custkey")).alias("names"))
    return tools.selected(_registry(spark, d), wanted).withColumn("place", F.col("place").cast("long"))


@query("""SELECT query_id, place, name FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, rank, name) AS INT) AS place, name FROM (
  SELECT s_suppkey AS query_id, 0 AS tier, 0 AS rank, 'tool-0' AS name FROM supplier UNION ALL
  SELECT s_suppkey, 1, r, 'tool-' || (s_suppkey * r) FROM supplier, (SELECT unnest([1, 2, 3]) AS r) WHERE s_suppkey % 4 <> 0 AND s_suppkey * r IN (SELECT p_partkey FROM part WHERE p_partkey <> 0)))""")
def tool_retrieval_fallback(spark: SparkSession, d: str) -> DataFrame:
    s = ad.read(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"))
    hits = s.where("query_id % 4 <> 0").withColumn("rank", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("name", F.concat(F.lit("tool-"), (F.col("query_id") * F.col("rank")).cast("string")))
    return tools.retrieved(hits, _registry(spark, d), s, always=("tool-0",), fallback="always")


@query("SELECT 'tool-' || p_partkey AS name, sha256('tool-' || p_partkey || chr(0) || p_name || chr(0) || p_type) AS pin FROM part")
def definition_pin(spark: SparkSession, d: str) -> DataFrame:
    return _registry(spark, d).select("name", tools.pin(F.col("name"), F.col("description"), F.col("schema")).alias("pin"))


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '_' || n END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def name_dedup(spark: SparkSession, d: str) -> DataFrame:
    return tools.unique_names(ad.read(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), "p_partkey").select("p_partkey", "unique_name")


@query("SELECT p_brand AS origin, string_agg('- tool-' || p_partkey || ': ' || p_name, chr(10) ORDER BY 'tool-' || p_partkey) AS catalog FROM part GROUP BY p_brand")
def tool_catalog(spark: SparkSession, d: str) -> DataFrame:
    return tools.catalog(_registry(spark, d), "origin")


@query("SELECT 'tool-' || p_partkey AS name, 'tool-' || p_partkey || ': ' || p_name || ' ' || p_type || ' ' || p_brand AS text FROM part")
def tool_index_text(spark: SparkSession, d: str) -> DataFrame:
    return _registry(spark, d).select("name", tools.index_text(F.col("name"), F.col("description"), F.array("schema", "origin")).alias("text"))


@query("SELECT doc_id AS subject, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'quality' END AS guard FROM labels")
def guardrail_first_trip(spark: SparkSession, d: str) -> DataFrame:
    checks = F.array(F.struct(F.lit(0).alias("place"), F.lit("toxic").alias("guard"), (F.col("toxic") == 0).alias("passed")), F.struct(F.lit(1).alias("place"), F.lit("quality").alias("guard"), (F.col("quality") == 1).alias("passed")))
    rows = ad.read(spark, d, "labels").select(F.col("doc_id").alias("subject"), F.explode(checks).alias("c")).select("subject", "c.*")
    return tools.first_trip(rows)


@query("SELECT doc_id, substr(regexp_replace(substr(text, 1, 80), '[^A-Za-z0-9_-]', '_', 'g'), 1, 64) AS name FROM documents")
def tool_names(spark: SparkSession, d: str) -> DataFrame:
    """Names made from the first line of each text, as a registry would from a free title."""
    return ad.read(spark, d, "documents").select("doc_id", tx.tool_name(F.col("text")).alias("name"))


@query("SELECT doc_id, CASE WHEN source = 'src0' THEN '[external content from ' || source || ']' || chr(10) || text || chr(10) || '[end of external content]' ELSE text END AS text FROM documents")
def external_wrap(spark: SparkSession, d: str) -> DataFrame:
    return ad.read(spark, d, "documents").select("doc_id", tx.wrapped_external(F.col("text"), F.col("source") == "src0", F.col("source")).alias("text"))


@query("SELECT DISTINCT source, source || '::helper' AS child FROM documents")
def child_scope(spark: SparkSession, d: str) -> DataFrame:
    docs = ad.read(spark, d, "documents").select("source").distinct()
    return docs.select("source", child_agent(F.col("source"), "helper").alias("child"))


@query("""SELECT conv_id || '-' || seq AS id, role || ': ' || content AS content, sha1(conv_id || chr(30) || seq) AS message_id FROM messages""", "messages")
def conversation_feed(spark: SparkSession, d: str) -> DataFrame:
    m = ad.messages(spark, d)
    return m.select(F.concat_ws("-", "conv_id", "seq").alias("id"), F.concat_ws(": ", "role", "content").alias("content"), tx.joined_digest(F.col("conv_id"), F.col("seq")).alias("message_id"))


@query("""SELECT event_id, CASE WHEN code IN (408, 429) OR code >= 500 OR event_type = 'view' THEN true ELSE false END AS retryable FROM (SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 400 + event_id % 150 END AS code FROM events)""")
def error_classify(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("event_id") % 2 == 0, 400 + F.col("event_id") % 150)
    slow = F.when(F.col("event_type") == "view", "ReadTimeout").otherwise("ValueError")
    return ad.read(spark, d, "events").select("event_id", tools.retryable(code, slow).alias("retryable"))
