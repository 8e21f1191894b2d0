"""Queries: variants of search, parsers of model output, small state operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import budget as bd
from tessera.functions import parsing
from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.operators import memory, ports, search, sessions, tables, tools, traces
from tessera.plans import adapters as ad
from tessera.plans.registry import Registry
from tessera.sources import loaders
from tessera.streaming import exporters

registry = Registry()
query = registry.query
QUERIES, SQL = registry.queries, registry.sql

KNN20 = """near AS (SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id, q.embedding AS qe, c.embedding AS ce,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), CAST(c.vec_id AS VARCHAR)) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0) WHERE rank <= 20)"""


@query("WITH " + KNN20 + """ SELECT query_id, CAST(vec_id AS VARCHAR) AS id, floor(s * 1e6 + 0.5) / 1e6 AS rerank_score, n AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s, rank) AS INT) AS n FROM (
  SELECT *, CAST(ce[1] AS DOUBLE) AS s FROM near)) WHERE n <= 5""")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """A pool of twenty neighbours in the order of another score: here the smallest first component."""
    hits = search.nearest(ad.vectors(spark, d), ad.vector_queries(spark, d), top_k=search.POOL)
    first = ad.vectors(spark, d).select("id", F.col("embedding")[0].cast("double").alias("x"))
    out = search.reranked(hits.join(first, "id"), -F.col("x"))
    return out.select("query_id", "id", vx.rounded(-F.col("rerank_score")).alias("rerank_score"), "rank")


@query("WITH " + KNN20 + """, votes AS (SELECT query_id // 500 AS query_id, query_id AS variant, rank, CAST(vec_id AS VARCHAR) AS key FROM near WHERE rank <= 10),
fused AS (SELECT query_id, key, sum(1.0::DOUBLE / (60 + rank)) AS score, min(variant * 1000 + rank) AS seen FROM votes GROUP BY ALL)
SELECT query_id, key, floor(score * 1e6 + 0.5) / 1e6 AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e12 + 0.5) / 1e12 DESC, seen) AS INT) AS rank FROM fused) WHERE rank <= 5""")
def rrf_multi_query(spark: SparkSession, d: str) -> DataFrame:
    """Ten neighbouring queries as variants of one, their lists fused."""
    hits = search.nearest(ad.vectors(spark, d), ad.vector_queries(spark, d), top_k=10)
    votes = hits.select(F.floor(F.col("query_id") / 500).alias("query_id"), F.col("query_id").alias("variant"), "rank", "id")
    return search.multi_query(votes).select("query_id", "key", vx.rounded(F.col("score")).alias("score"), "rank")


@query("""WITH docs AS (SELECT conv_id || '-' || turn AS id, regexp_extract_all(translate(lower(role || ': ' || text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}]+') AS terms FROM conversations),
p AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM docs) GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len(terms)) AS a FROM docs), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT r_regionkey AS query_id, unnest(['user', 'the', 'de'] || string_split(lower(r_name), ' ')) AS term FROM region),
s AS (SELECT query_id, id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM p JOIN q USING (term) JOIN f USING (term), st GROUP BY ALL)
SELECT query_id, id, rank, floor(score * 1e6 + 0.5) / 1e6 AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9 + 0.5) / 1e9 DESC, id) AS INT) AS rank FROM s) WHERE rank <= 5""")
def conversation_search(spark: SparkSession, d: str) -> DataFrame:
    """Messages as `role: text`, searched by words."""
    feed = ad.messages(spark, d).select(F.concat_ws("-", "conv_id", "seq").alias("id"), F.concat_ws(": ", "role", "content").alias("content"))
    asked = ad.read(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), F.concat_ws(" ", F.lit("user the de"), F.lower("r_name")).alias("query"))
    return search.bm25(feed, asked).withColumn("score", vx.rounded(F.col("score")))


@query("SELECT event_id, CAST(user_id + event_id * 2 AS DOUBLE) AS value FROM events")
def calc_eval(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("user_id").cast("string"), F.lit(" + "), F.col("event_id").cast("string"), F.lit(" * sqrt(4)"))
    return ad.read(spark, d, "events").select("event_id", parsing.calculated(text).alias("value"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN '{\"args\": ' || props || ', \"tool\": \"' || event_type || '\"}' END AS directive FROM events")
def tool_directives(spark: SparkSession, d: str) -> DataFrame:
    call = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.concat(F.lit('{"tool": "'), F.col("event_type"), F.lit('", "args": '), F.col("props"), F.lit("}")))
    return ad.read(spark, d, "events").select("event_id", parsing.tool_directive(F.concat(F.lit("I will {first} use: "), call, F.lit(" now"))).alias("directive"))


@query("SELECT event_id, CAST(1 + event_id % 3 AS INT) AS n_steps, event_type AS first FROM events")
def plan_parse(spark: SparkSession, d: str) -> DataFrame:
    listed = F.concat(F.lit('Plan: ["'), F.array_join(F.array_repeat("event_type", (1 + F.col("event_id") % 3).cast("int")), '", "'), F.lit('"]'))
    lines = F.concat(F.lit("My plan\n1. "), F.array_join(F.array_repeat("event_type", (1 + F.col("event_id") % 3).cast("int")), "\n2) "))
    steps = parsing.plan_steps(F.when(F.col("event_id") % 2 == 0, listed).otherwise(lines))
    return ad.read(spark, d, "events").select("event_id", F.size(steps).alias("n_steps"), steps[0].alias("first"))


@query("SELECT event_id, event_type = 'purchase' AS passed FROM events")
def pass_signal(spark: SparkSession, d: str) -> DataFrame:
    critique = F.when(F.col("event_type") == "purchase", "All fine: PASS.").when(F.col("event_type") == "view", "PASSED?")
    return ad.read(spark, d, "events").select("event_id", parsing.passes(critique, "PASS").alias("passed"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 5 AS INT) ELSE 0 END AS v FROM events")
def state_version(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"v": '), (F.col("event_id") % 5).cast("string"), F.lit("}"))).when(F.col("event_id") % 3 == 0, F.lit("{}")).otherwise("no json")
    return ad.read(spark, d, "events").select("event_id", F.coalesce(parsing.state_version(state), F.lit(0)).alias("v"))


@query("SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_type IN ('click', 'view')) AS answer FROM events GROUP BY user_id")
def latest_answer(spark: SparkSession, d: str) -> DataFrame:
    steps = ad.read(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("type"), F.col("event_type").alias("text"))
    return sessions.latest_answer(steps, "user_id", "event_id", ("click", "view"))


@query("SELECT run_id, pos FROM (SELECT run_id, pos, row_number() OVER (PARTITION BY run_id ORDER BY pos DESC) AS n FROM traces) WHERE n <= 8", "traces")
def ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    """The last eight events of each run."""
    return traces.newest(ad.traces(spark, d), 8).select("run_id", "pos")


@query("SELECT event_type AS exporter, count(*) FILTER (WHERE event_id % 3 = 0) AS failures, count(*) AS attempts FROM events GROUP BY event_type")
def export_failures(spark: SparkSession, d: str) -> DataFrame:
    """A log of exports, a third of them failed."""
    return exporters.failure_counts(ad.read(spark, d, "events").select(F.col("event_type").alias("exporter"), (F.col("event_id") % 3 != 0).alias("ok")))


@query("SELECT event_id, type_name, truncated FROM (SELECT event_id, event_type AS type_name, event_type = 'signup' AND event_id % 5 = 0 AS truncated FROM events)")
def truncation_flag(spark: SparkSession, d: str) -> DataFrame:
    t = ad.traces(spark, d).select(F.col("pos").alias("event_id"), F.coalesce(F.col("finish_reason").isin(*traces.CUT_REASONS), F.lit(False)).alias("truncated"))
    return ad.read(spark, d, "events").select("event_id", F.col("event_type").alias("type_name")).join(t, "event_id")


@query("SELECT event_id AS call_id, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 END AS approved FROM events WHERE event_type = 'purchase'")
def decision_injection(spark: SparkSession, d: str) -> DataFrame:
    """Decisions reach the pending calls that they name, and no others."""
    calls = ad.read(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("call_id"))
    decisions = ad.read(spark, d, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("call_id"), (F.col("event_id") % 2 == 0).alias("approved"))
    return sessions.injected(calls, decisions)


@query("SELECT session, row_number() OVER (PARTITION BY session ORDER BY seen, name) - 1 AS place, name FROM (SELECT o_custkey AS session, 'tool-' || o_orderstatus AS name, min(o_orderkey) AS seen FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)")
def discovered_tools(spark: SparkSession, d: str) -> DataFrame:
    """Tools that a session has found, each once and in that order, without the one that is there from the start."""
    found = ad.read(spark, d, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("at"), F.concat(F.lit("tool-"), "o_orderstatus").alias("name"))
    present = found.select("session").distinct().withColumn("name", F.lit("tool-P"))
    return sessions.discovered(found, present).withColumn("place", F.col("place").cast("long"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 9999 END, CASE WHEN o_custkey = 3 THEN 777 END, CASE WHEN o_custkey % 2 = 0 AND n_nationkey IS NOT NULL THEN 1000 + n_nationkey END, -1) AS context_window,
  coalesce(CASE WHEN o_custkey = 3 THEN 77 END, CASE WHEN o_custkey % 2 = 0 AND n_nationkey IS NOT NULL THEN 10 + n_nationkey END, -1) AS max_output FROM orders LEFT JOIN nation ON n_nationkey = o_custkey""")
def model_limits(spark: SparkSession, d: str) -> DataFrame:
    """A limit that is given, else the profile's of the default model, else the catalogue's, else none."""
    n = ad.read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("model"))
    catalogue = n.where("k % 2 = 0").select("model", (F.lit(1000) + F.col("k")).alias("context_window"), (F.lit(10) + F.col("k")).alias("max_output"))
    profiles = n.select("model", F.lit(777).alias("context_window"), F.lit(77).alias("max_output"))
    calls = ad.read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("model"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(9999)).alias("context_window"), F.lit(None).cast("int").alias("max_output"))
    out = tools.resolved_limits(calls, profiles, catalogue, "m3")
    return out.select("o_orderkey", F.coalesce("context_window", F.lit(-1)).alias("context_window"), F.coalesce("max_output", F.lit(-1)).alias("max_output"))


@query("SELECT id, CASE WHEN event_id % 6 = 0 THEN 'changed' ELSE type END AS content, event_id % 6 = 0 AS fresh FROM memories", "memories")
def memory_update(spark: SparkSession, d: str) -> DataFrame:
    """An update keeps the exact scope and sets the time."""
    at = F.lit("2024-03-01").cast("timestamp")
    m = ad.memories(spark, d).withColumn("content", F.col("type"))
    new = m.where("CAST(id AS BIGINT) % 6 = 0").withColumn("content", F.lit("changed")).withColumn("updated_at", at)
    return tables.upsert(m, new).select("id", "content", (F.col("updated_at").eqNullSafe(at)).alias("fresh"))


@query("SELECT id, event_id % 4 = 0 OR (event_id % 5 = 0 AND false) AS touched FROM memories", "memories")
def memory_touch(spark: SparkSession, d: str) -> DataFrame:
    m = ad.memories(spark, d)
    at = F.lit("2024-03-01").cast("timestamp")
    return tables.touched(m, m.where("CAST(id AS BIGINT) % 4 = 0"), "last_accessed_at", at).select("id", F.col("last_accessed_at").eqNullSafe(at).alias("touched"))


@query("SELECT user, id FROM (SELECT user, id, row_number() OVER (PARTITION BY user ORDER BY created_at DESC, id) AS n FROM memories WHERE invalid_at IS NULL) WHERE n <= 5", "memories")
def summary_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The five newest valid memories of each user."""
    return memory.summary_candidates(ad.memories(spark, d), owner="user").select("user", "id")


@query("""SELECT conv_id, string_agg(upper(role) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS trajectory FROM conversations GROUP BY conv_id""")
def trajectory_render(spark: SparkSession, d: str) -> DataFrame:
    return sessions.trajectory(ad.read(spark, d, "conversations").withColumn("label", F.upper("role")), "conv_id", "turn")


@query("SELECT o_orderkey, CAST(floor(w * 0.5) AS BIGINT) AS max_tokens, CAST(floor(w * 0.4 * 0.5) AS BIGINT) AS rag_budget FROM (SELECT o_orderkey, floor(o_totalprice) AS w FROM orders)")
def context_config(spark: SparkSession, d: str) -> DataFrame:
    """Limits derived from a window: half of it, and of that a share for retrieval."""
    most, rag = bd.context_limits(F.floor("o_totalprice"), 0.4)
    return ad.read(spark, d, "orders").select("o_orderkey", most.alias("max_tokens"), rag.alias("rag_budget"))


@query("""SELECT conv_id, left(text, 2000) AS text, length(text) > 2000 AS truncated FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)""")
def bounded_join(spark: SparkSession, d: str) -> DataFrame:
    """The text of a result, cut at a bound."""
    return tools.joined_text(ad.read(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", 2000)


@query("SELECT conv_id, max(turn) AS cached_until FROM conversations WHERE turn < 3 GROUP BY conv_id")
def prefix_cache(spark: SparkSession, d: str) -> DataFrame:
    """Summaries cached over a session's first messages are found again by the digest of the prefix."""
    m = ad.messages(spark, d)
    cached = sessions.prefix_digests(m.where("seq < 3"), ("sc_session",)).select("sc_session", "digest")
    return sessions.cached_prefix(m, cached, ("sc_session",)).select(F.col("sc_session").cast("long").alias("conv_id"), "cached_until")


@query("""SELECT page_id, regexp_replace(name, '\\.[^.]*$', '') AS title, lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS ext, sha1('file:' || url) AS doc_id FROM (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS name FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.HTML' WHEN 1 THEN '.tar.gz' ELSE '' END AS url FROM pages))""")
def path_titles(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".HTML").when(F.col("page_id") % 3 == 1, ".tar.gz").otherwise(""))
    title, ext = loaders.path_parts(url)
    return ad.read(spark, d, "pages").select("page_id", title.alias("title"), ext.alias("ext"), loaders.file_id(url).alias("doc_id"))


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(replace(text, chr(10), ' '), 1, 120) || '…' ELSE replace(text, chr(10), ' ') END AS line FROM documents")
def event_summary_line(spark: SparkSession, d: str) -> DataFrame:
    return ad.read(spark, d, "documents").select("doc_id", tx.one_line(F.col("text")).alias("line"))


@query("""SELECT item_id AS query_id, CAST(i - 1 AS INT) AS variant, q[i] AS query FROM (SELECT item_id, q, unnest(range(1, len(q) + 1)) AS i FROM (
  SELECT item_id, list_filter([text, CASE WHEN a <> text THEN a END, CASE WHEN b <> text AND b <> a THEN b END], lambda x: x IS NOT NULL AND trim(x) <> '') AS q FROM (
    SELECT item_id, text, array_to_string(list_filter(w, lambda x: length(x) > 4), ' ') AS a, array_to_string(list_sort(list_distinct(w)), ' ') AS b FROM (
      SELECT item_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark))))""")
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    return ports.variants(ad.text_queries(spark, d), ports.offline_rewritings(F.col("query")))


@query("SELECT user_id, event_id, CAST((n - 1) // 256 AS INT) AS batch, CAST((n - 1) % 256 AS INT) AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def reconcile_batches(spark: SparkSession, d: str) -> DataFrame:
    """Index writes in batches of 256 for each user."""
    return ports.batches_of(ad.read(spark, d, "events").select("user_id", "event_id"), 256, "user_id", "event_id")
