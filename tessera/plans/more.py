"""Queries: whole operations (retrieve, ingest, context), items of equal ids in several scopes, JSON texts, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import budget as bd
from tessera.functions import jsontext as js
from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.operators import chunking, context, ingest, memory, ports, rag, scope, search, sessions, sync, tables, tools, traces
from tessera.plans import adapters as ad
from tessera.plans.agents import now
from tessera.plans.documents import _event_stream, _workspace
from tessera.plans.registry import Registry
from tessera.plans.retrieval import HYBRID
from tessera.streaming import state

registry = Registry()
query = registry.query
QUERIES, SQL = registry.queries, registry.sql

# ---- equal ids in several scopes


@query("""SELECT CAST(doc_id // 2 AS VARCHAR) AS id, CASE doc_id % 2 WHEN 0 THEN 'alice' ELSE 'bob' END AS sc_user, query_id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9 + 0.5) / 1e9 DESC, CAST(doc_id // 2 AS VARCHAR), doc_id % 2) AS rank FROM scores) WHERE rank <= 5""", "terms")
def bm25_two_owners(spark: SparkSession, d: str) -> DataFrame:
    """Two documents share each id and differ in their owner: they stay two."""
    docs = ad.read(spark, d, "documents").select(F.floor(F.col("doc_id") / 2).cast("string").alias("id"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, "alice").otherwise("bob").alias("o"))
    hits = search.bm25(scope.scoped(docs, base="rag", sc_user=F.col("o")).drop("o"), ad.text_queries(spark, d))
    return hits.select("id", "sc_user", "query_id", vx.rounded(F.col("score")).alias("score"))


@query("""SELECT query_id, CAST(vec_id // 2 AS VARCHAR) AS id, CASE vec_id % 2 WHEN 0 THEN 'alice' ELSE 'bob' END AS sc_user FROM (SELECT q.vec_id AS query_id, c.vec_id,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), CAST(c.vec_id // 2 AS VARCHAR), c.vec_id % 2) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0) WHERE rank <= 5""")
def knn_two_owners(spark: SparkSession, d: str) -> DataFrame:
    v = ad.read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).cast("string").alias("id"), "embedding", F.when(F.col("vec_id") % 2 == 0, "alice").otherwise("bob").alias("o"))
    return search.nearest(scope.scoped(v, base="memory", sc_user=F.col("o")).drop("o"), ad.vector_queries(spark, d)).select("query_id", "id", "sc_user")


TWO = "two AS (SELECT CAST(event_id // 2 AS VARCHAR) AS id, CASE event_id % 2 WHEN 0 THEN 'alice' ELSE 'bob' END AS sc_user, event_id, importance, created_at, invalid_at FROM memories)"


def _two_owners(spark: SparkSession, d: str) -> DataFrame:
    m = ad.memories(spark, d)
    number = m["id"].cast("long")
    return m.withColumn("sc_user", F.when(number % 2 == 0, "alice").otherwise("bob")).withColumn("id", F.floor(number / 2).cast("string"))


@query("SELECT * FROM (WITH " + ad.CTE["memories"] + ", " + TWO + " SELECT id, sc_user, invalid_at IS NOT NULL OR event_id % 20 = 2 AS invalid FROM two)")
def memory_invalidate_two_owners(spark: SparkSession, d: str) -> DataFrame:
    m = _two_owners(spark, d)
    gone = m.where("sc_user = 'alice' AND CAST(id AS BIGINT) % 10 = 1").select("id", *scope.DIMENSIONS, F.lit("new").alias("by"))
    return memory.invalidated(m, gone, now()).select("id", "sc_user", F.col("invalid_at").isNotNull().alias("invalid"))


@query("SELECT * FROM (WITH " + ad.CTE["memories"] + ", " + TWO + " SELECT id, sc_user FROM two WHERE event_id % 2 = 1 AND (event_id // 2) % 5 = 0)")
def memory_delete_many(spark: SparkSession, d: str) -> DataFrame:
    """Ids of two owners, taken out of one owner's range; of some only the book still knows."""
    m = _two_owners(spark, d)
    book = m.select("id", *scope.DIMENSIONS, F.sha1("content").alias("content_hash"), now().alias("updated_at"), F.lit(None).cast("timestamp").alias("pending_since"))
    ids = m.where("CAST(id AS BIGINT) % 5 = 0").select("id")
    return memory.delete_many(m.where("CAST(id AS BIGINT) % 10 <> 0"), book, ids, scope.in_range({"sc_user": "bob"}))[2].select("id", "sc_user")


@query("SELECT DISTINCT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 3 = 0 AND (event_id % 2 = 0 OR event_id % 5 = 0)")
def memory_covered_ids(spark: SparkSession, d: str) -> DataFrame:
    """Requested ids that are held as memories, or in the book as indexed or pending."""
    m = ad.memories(spark, d)
    number = F.col("id").cast("long")
    book = m.where(number % 5 == 0).select("id", F.when(number % 2 == 0, "h").alias("content_hash"), F.when(number % 2 == 1, now()).alias("pending_since"))
    return memory.covered_ids(m.where(number % 3 == 0), m.where(number % 2 == 0), book)


@query("SELECT CAST(event_id AS VARCHAR) AS id, CAST(max(event_id) OVER (PARTITION BY user_id) AS VARCHAR) AS final, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS steps FROM events")
def supersede_long_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each memory of a user is superseded by the user's next one: chains as long as a user has events."""
    from pyspark.sql import Window as W

    after = F.lead("event_id").over(W.partitionBy("user_id").orderBy("event_id"))
    m = ad.read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), after.cast("string").alias("superseded_by"))
    return memory.superseded_chain(m)


@query("SELECT doc_id AS id, lang AS sc_user FROM documents WHERE doc_id % 6 = 0 OR (lang = 'de' AND doc_id % 6 = 1)")
def sync_pending_above(spark: SparkSession, d: str) -> DataFrame:
    """Entries that are pending in a scope above make the rows below due: some for all owners, some for one owner only."""
    docs = ad.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha1("text").alias("content_hash"), "lang")
    source = scope.scoped(docs, base="rag", sc_user=F.col("lang")).drop("lang")
    none, at = F.lit(None).cast("timestamp"), F.lit("2024-01-01").cast("timestamp")
    known = source.withColumn("updated_at", at).withColumn("pending_since", none)
    above = source.where("id % 6 = 0").withColumn("sc_user", F.lit("")).withColumn("updated_at", at).withColumn("pending_since", at)
    other = source.where("id % 6 = 1").withColumn("sc_user", F.lit("de")).withColumn("updated_at", at).withColumn("pending_since", at)
    return sync.changed(source, known.unionByName(above).unionByName(other.join(known.select("id", "sc_user"), ["id", "sc_user"], "left_anti"))).select("id", "sc_user").unionByName(
        sync.changed(source.where("sc_user = 'de' AND id % 6 = 1"), other).select("id", "sc_user")
    ).distinct()


@query("SELECT DISTINCT 'rag' AS base, lang AS sc_user FROM documents WHERE lang <> 'fr' OR doc_id % 11 = 0")
def sync_tracked_or_pending(spark: SparkSession, d: str) -> DataFrame:
    docs = ad.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    book = scope.scoped(docs, base="rag", sc_user=F.col("lang")).withColumn("content_hash", F.when(F.col("lang") != "fr", "h")).withColumn("pending_since", F.when((F.col("lang") == "fr") & (F.col("id") % 11 == 0), now()))
    return sync.tracked_or_pending(book).select("base", "sc_user")


# ---- retrieval and ingest as a whole

RETRIEVE = (
    "SELECT * FROM (WITH " + ad.CTE["terms"] + ", " + ad.CTE["chunks"] + ", " + HYBRID.format(where="").partition("SELECT query_id, key AS id")[0]
    + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e12 + 0.5) / 1e12 DESC, seen) AS place FROM fused) WHERE place <= 5)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INT) AS rank, floor(score * 1e6 + 0.5) / 1e6 AS score, chunk_id AS id, doc_id, content FROM top JOIN chunks ON chunk_id = key || '-0')"""
)


def _retrieved(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and documents as the two indexes of first chunks; documents without text are orphans."""
    first = lambda df: df.withColumn("id", F.concat("id", F.lit("-0"))).drop(*scope.DIMENSIONS)
    texts = ad.text_queries(spark, d)
    asked = texts.join(ad.read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")
    return rag.retrieve(first(ad.vectors(spark, d)), first(ad.items(spark, d)), ad.chunks(spark, d), asked)


@query(RETRIEVE)
def rag_retrieve(spark: SparkSession, d: str) -> DataFrame:
    out = _retrieved(spark, d)
    return out.select("query_id", "rank", vx.rounded(F.col("score")).alias("score"), "id", "doc_id", "content")


@query("SELECT q AS query_id, count(id) AS n_sources, CASE WHEN count(id) = 0 THEN 'No relevant information was found in the knowledge base.' END AS answer FROM (SELECT item_id AS q FROM benchmark) LEFT JOIN (" + RETRIEVE + ") ON q = query_id GROUP BY q")
def rag_ask(spark: SparkSession, d: str) -> DataFrame:
    """What a model is asked with: sources for each question, or the fixed answer."""
    out = rag.ask(ad.text_queries(spark, d), _retrieved(spark, d))
    return out.select("query_id", F.size("sources").cast("long").alias("n_sources"), "answer")


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = scope.scoped(ad.chunks(spark, d), base="rag")
    hashes = ad.read(spark, d, "documents").select("doc_id", F.sha1("text").alias("content_hash"))
    return chunks, scope.scoped(hashes, base="rag")


def _replaced(spark: SparkSession, d: str):
    """Every third document is unchanged, every fifth has lost its text, the others have lost their chunks from the third on."""
    chunks, hashes = _stored(spark, d)
    docs = hashes.withColumn("fingerprint", F.when(F.col("doc_id") % 3 == 0, F.col("content_hash")).otherwise("new")).drop("content_hash")
    new = chunks.where("doc_id % 5 <> 0 AND idx < 2").withColumn("content", F.concat(F.lit("new "), "content"))
    return ingest.replaced(chunks, hashes, docs, new)


INGEST = "SELECT doc_id, doc_id % 3 = 0 AS skipped, count(idx) AS n, count(idx) FILTER (WHERE idx < 2) AS two FROM documents LEFT JOIN chunks USING (doc_id) GROUP BY doc_id"


@query("SELECT * FROM (WITH " + ad.CTE["chunks"] + " SELECT doc_id, skipped, CASE WHEN skipped OR doc_id % 5 = 0 THEN 0 ELSE two END AS n_chunks, CASE WHEN skipped THEN 0 WHEN doc_id % 5 = 0 THEN n ELSE n - two END AS n_removed FROM (" + INGEST + "))")
def ingest_replace(spark: SparkSession, d: str) -> DataFrame:
    return _replaced(spark, d)[2].select("doc_id", "skipped", "n_chunks", "n_removed")


@query("SELECT chunk_id, CASE WHEN doc_id % 3 = 0 THEN content ELSE 'new ' || content END AS content FROM chunks WHERE doc_id % 3 = 0 OR (doc_id % 5 <> 0 AND idx < 2)", "chunks")
def ingest_replace_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _replaced(spark, d)[0].select("chunk_id", "content")


@query("SELECT * FROM (WITH " + ad.CTE["chunks"] + " SELECT doc_id, CASE WHEN skipped THEN sha1(text) ELSE 'new' END AS content_hash FROM (" + INGEST + ") JOIN documents USING (doc_id) WHERE skipped OR (doc_id % 5 <> 0 AND two > 0))")
def ingest_replace_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _replaced(spark, d)[1].select("doc_id", "content_hash")


@query("SELECT * FROM (WITH " + ad.CTE["chunks"] + " SELECT doc_id, count(idx) AS n_chunks FROM documents LEFT JOIN chunks USING (doc_id) WHERE doc_id % 7 = 0 GROUP BY doc_id)")
def delete_document(spark: SparkSession, d: str) -> DataFrame:
    """What was taken out by document, of chunks and hashes."""
    chunks, hashes = _stored(spark, d)
    ids = hashes.where("doc_id % 7 = 0").select("doc_id").unionByName(hashes.select((-F.col("doc_id") - 1).alias("doc_id")))
    return ingest.deleted(chunks, hashes, ids, scope.in_range({"base": "rag"}))[2].select("doc_id", "n_chunks")


@query("SELECT chunk_id AS id, sha1(content) AS content_hash, false AS pending FROM chunks", "chunks")
def rebuild_index(spark: SparkSession, d: str) -> DataFrame:
    return ingest.rebuilt(_stored(spark, d)[0], now()).select("id", "content_hash", F.col("pending_since").isNotNull().alias("pending"))


@query("SELECT doc_id AS id, doc_id % 4 = 0 AND lang = 'en' AS pending FROM documents")
def index_drop_failed(spark: SparkSession, d: str) -> DataFrame:
    """An index that could not be written keeps its rows, and the book waits for them."""
    docs = ad.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    book = scope.scoped(docs, base="rag", sc_user=F.col("lang")).withColumn("pending_since", F.lit(None).cast("timestamp"))
    out = ingest.dropped(book, book, book.where("id % 4 = 0"), scope.in_range({"sc_user": "en"}), failed=True, now=now())[1]
    return out.select("id", F.col("pending_since").isNotNull().alias("pending"))


@query("SELECT doc_id AS id FROM documents WHERE NOT (doc_id % 4 = 0 AND lang = 'en')")
def index_drop(spark: SparkSession, d: str) -> DataFrame:
    docs = ad.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    book = scope.scoped(docs, base="rag", sc_user=F.col("lang"))
    return ingest.dropped(book, book, book.where("id % 4 = 0"), scope.in_range({"sc_user": "en"}))[0].select("id")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS content FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 <> 0")
def hybrid_replace(spark: SparkSession, d: str) -> DataFrame:
    """New rows for every third id; of the old rows those of every fourth id that have no successor go."""
    t = scope.scoped(ad.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("content")), base="rag")
    return tables.replace(t, t.where("id % 4 = 0"), t.where("id % 3 = 0").withColumn("content", F.lit("new"))).select("id", "content")


@query("SELECT doc_id, source AS md_source, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS VARCHAR) ELSE '' END AS md_size FROM documents")
def meta_materialise(spark: SparkSession, d: str) -> DataFrame:
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("size"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string")), F.lit("other"), F.lit("x"))
    return tables.materialised_metadata(ad.read(spark, d, "documents").withColumn("metadata", meta), ("source", "size")).select("doc_id", "md_source", "md_size")


@query("SELECT CAST(event_id AS VARCHAR) AS doc_id, 'chosen' AS source, 'txt' AS format, event_type AS author FROM events")
def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A chunk's metadata is its document's, but for source and format."""
    docs = ad.read(spark, d, "events").select(
        F.col("event_id").alias("doc_id"), F.col("event_type").alias("content"), F.lit("").alias("title"), F.lit("txt").alias("format"), F.lit(None).cast("array<string>").alias("records"), F.lit("chosen").alias("source"),
        F.create_map(F.lit("author"), F.col("event_type"), F.lit("source"), F.lit("other")).alias("metadata"),
    )
    return chunking.chunked(docs).select("doc_id", F.col("metadata")["source"].alias("source"), F.col("metadata")["format"].alias("format"), F.col("metadata")["author"].alias("author"))


@query("SELECT doc_id, concat_ws(' > ', CASE WHEN doc_id % 2 = 0 THEN source END, CASE WHEN doc_id % 3 <> 0 THEN lang END) AS heading_path FROM documents")
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    part = lambda c, keep: F.when(keep, F.col(c)).otherwise("")
    return ad.read(spark, d, "documents").select("doc_id", tx.heading_path(part("source", F.col("doc_id") % 2 == 0), part("lang", F.col("doc_id") % 3 != 0)).alias("heading_path"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '…' ELSE text END AS text FROM documents")
def short_repr(spark: SparkSession, d: str) -> DataFrame:
    return ad.read(spark, d, "documents").select("doc_id", tx.short_repr(F.col("text")).alias("text"))


@query("SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'passage on ' || text ELSE text END AS embed_text FROM benchmark")
def hyde_texts(spark: SparkSession, d: str) -> DataFrame:
    written = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("passage on "), F.col("query"))).otherwise(" ")
    return ports.hyde(ad.text_queries(spark, d), written).select("query_id", "embed_text")


# ---- context


@query("""SELECT o_orderkey, spare AS spendable, CAST(floor(spare * 0.3) AS BIGINT) AS rag_budget, greatest(w - 1000 - 200, 0) AS trajectory_whole, CAST(greatest(spare - floor(spare * 0.3), 0) AS BIGINT) AS trajectory_apart FROM (
  SELECT o_orderkey, w, greatest(w - 1000 - 300 - 200, 0) AS spare FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 5000 AS w FROM orders))""")
def window_split(spark: SparkSession, d: str) -> DataFrame:
    w = F.floor("o_totalprice").cast("long") % 5000
    out = bd.window_split(w, F.lit(1000), F.lit(300), F.lit(200), F.lit(0.3))
    return ad.read(spark, d, "orders").select("o_orderkey", out.alias("s")).select("o_orderkey", "s.*")


@query("SELECT event_id, user_id AS prompt_tokens, 0 AS completion_tokens, user_id + 3 AS total_tokens FROM events")
def usage_renamed(spark: SparkSession, d: str) -> DataFrame:
    usage = F.struct(F.col("user_id").alias("promptTokenCount"), F.lit(None).cast("long").alias("candidatesTokenCount"), (F.col("user_id") + 3).alias("totalTokenCount"))
    return ad.read(spark, d, "events").select("event_id", bd.renamed_usage(usage).alias("u")).select("event_id", "u.*")


BLOCK = """rows AS (SELECT conv_id AS query_id, (['memory', 'rag', 'history', 'tool'])[turn % 4 + 1] AS source, turn AS pos, turn || ' ' || text AS content FROM conversations),
sized AS (SELECT *, CAST((length(content) + 1 + 3) // 4 AS BIGINT) AS tokens FROM rows),
ratios AS (SELECT unnest(['memory', 'rag', 'history', 'tool']) AS source, unnest([2, 4, 3, 1]::DOUBLE[]) AS ratio),
limits AS (SELECT conv_id AS query_id, CAST(greatest(800 - 160 - (length('about ' || conv_id) + 3) // 4 - (SELECT CAST(sum((length('## ' || source) + 1 + 3) // 4) AS BIGINT) + count(*) - 1 FROM ratios), 0) AS BIGINT) AS budget FROM (SELECT DISTINCT conv_id FROM conversations)),
quotas AS (SELECT query_id, source, CAST(floor(budget * ratio / sum(ratio) OVER (PARTITION BY query_id)) AS BIGINT) AS quota FROM (SELECT DISTINCT query_id, source FROM rows) JOIN ratios USING (source) JOIN limits USING (query_id)),
r1 AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id, source ORDER BY pos ROWS UNBOUNDED PRECEDING) <= quota AS taken FROM sized JOIN quotas USING (query_id, source)),
state AS (SELECT *, (SELECT sum(quota) FROM quotas q WHERE q.query_id = r1.query_id) - sum(CASE WHEN taken THEN tokens ELSE 0 END) OVER (PARTITION BY query_id) AS idle, sum(CASE WHEN taken THEN 0 ELSE tokens END) OVER (PARTITION BY query_id, source) AS want, sum(CASE WHEN taken THEN 0 ELSE tokens END) OVER (PARTITION BY query_id) AS want_all FROM r1),
kept AS (SELECT query_id, source, pos, content FROM state WHERE taken UNION ALL SELECT query_id, source, pos, content FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id, source ORDER BY pos ROWS UNBOUNDED PRECEDING) <= floor(idle * want / want_all) AS more FROM state WHERE NOT taken) WHERE more),
parts AS (SELECT query_id, list_position(['memory', 'rag', 'history', 'tool'], source) AS place, '## ' || source || chr(10) || string_agg(content, chr(10) ORDER BY pos) AS t FROM kept GROUP BY query_id, source)"""


@query("WITH " + BLOCK + " SELECT query_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY place), '') AS context FROM limits LEFT JOIN parts USING (query_id) GROUP BY query_id")
def context_build_block(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's turns as candidates of four sources, the earliest best, within 800 tokens."""
    c = ad.read(spark, d, "conversations")
    queries = c.select(F.col("conv_id").alias("query_id"), F.concat(F.lit("about "), F.col("conv_id").cast("string")).alias("query")).distinct()
    kind = F.element_at(F.array(*map(F.lit, ("memory", "rag", "history", "tool"))), (F.col("turn") % 4 + 1).cast("int"))
    rows = c.select(F.col("conv_id").alias("query_id"), kind.alias("source"), F.col("turn").alias("pos"), (10_000.0 - F.col("turn")).alias("score"), F.concat_ws(" ", F.col("turn").cast("string"), "text").alias("content"), F.lit(None).cast("array<double>").alias("embedding"))
    ratios = spark.createDataFrame([("memory", 2.0), ("rag", 4.0), ("history", 3.0), ("tool", 1.0)], "source string, ratio double")
    return context.build_block(queries, rows, ratios, max_tokens=800)


# ---- sessions and tools


@query("SELECT conv_id, greatest(count(*) - 3, 0) AS deleted FROM conversations GROUP BY conv_id")
def session_prune_counts(spark: SparkSession, d: str) -> DataFrame:
    return sessions.pruned_counts(ad.messages(spark, d), ("conv_id",), keep_last=3)


@query("SELECT event_id, epoch_us(ts) - CASE WHEN event_id % 2 = 0 THEN 7200000000 ELSE 0 END AS us FROM events")
def utc_times(spark: SparkSession, d: str) -> DataFrame:
    """Times in texts, every second one with a zone two hours ahead."""
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return ad.read(spark, d, "events").select("event_id", F.unix_micros(vx.utc(F.when(F.col("event_id") % 2 == 0, F.concat(text, F.lit("+02:00"))).otherwise(text))).alias("us"))


@query("SELECT event_id, round_even(event_id / 8.0::DOUBLE, 4) AS shown FROM events")
def score_components(spark: SparkSession, d: str) -> DataFrame:
    return ad.read(spark, d, "events").select("event_id", vx.component(F.col("event_id") / F.lit(8.0)).alias("shown"))


@query("SELECT user, sc_app, content FROM (SELECT CAST(user_id AS VARCHAR) AS user, event_type AS sc_app, props AS content, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND sc_app <> 'view'")
def checkpoint_scopes(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each exact scope, and none of a scope that is cleared."""
    rows = ad.read(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("user"), "event_type", F.col("props").alias("content"))
    kept = tables.latest(scope.scoped(rows, sc_user=F.col("user"), sc_app=F.col("event_type")), scope.DIMENSIONS, F.col("event_id"))
    return tables.cleared(kept, scope.in_range({"sc_app": "view"})).select("user", "sc_app", "content")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0")
def conversation_clear(spark: SparkSession, d: str) -> DataFrame:
    """The log without some conversations; its index loses them in the same step."""
    m = ad.messages(spark, d)
    log, index = sessions.cleared(m, m.select("conv_id", "seq"), F.col("conv_id") % 3 == 0)
    return log.join(index, ["conv_id", "seq"], "left_semi").select("conv_id", F.col("seq").alias("turn"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '[{\"type\":\"text\",\"text\":\"' || role || '\"}]' ELSE text END AS content, turn % 2 = 0 AS multimodal FROM conversations")
def session_record(spark: SparkSession, d: str) -> DataFrame:
    parts = F.when(F.col("seq") % 2 == 0, F.array(F.struct(F.lit("text").alias("type"), F.col("role").alias("text"))))
    out = sessions.recorded(ad.messages(spark, d).withColumn("parts", parts))
    return out.select("conv_id", F.col("seq").alias("turn"), "content", "multimodal")


@query("""SELECT conv_id, CAST(seq AS BIGINT) AS seq, content FROM (
  SELECT conv_id, seq, text AS content FROM (SELECT conv_id, turn AS seq, text, sum(CAST((length(text) + 3) // 4 AS BIGINT)) OVER w AS total, count(*) OVER w AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WINDOW w AS (PARTITION BY conv_id)) WHERE NOT (total > 400 AND n > 2 AND back > 2)
  UNION ALL SELECT conv_id, -1, left('summary of ' || conv_id, 12) FROM (SELECT conv_id, sum(CAST((length(text) + 3) // 4 AS BIGINT)) AS total, count(*) AS n FROM conversations GROUP BY conv_id) WHERE total > 400 AND n > 2)""")
def history_compact(spark: SparkSession, d: str) -> DataFrame:
    """A summary of up to three tokens in place of a session's old messages."""
    m = ad.messages(spark, d).withColumn("tokens", tx.token_count(F.col("content")))
    summaries = m.select("conv_id").distinct().withColumn("summary", F.concat(F.lit("summary of "), F.col("conv_id").cast("string")))
    return sessions.compacted(m, summaries, ("conv_id",), most=3, trigger=400, keep_recent=2).select("conv_id", F.col("seq").cast("long").alias("seq"), "content")


@query("""SELECT conv_id, CAST(sum(t) AS BIGINT) AS mandatory FROM (SELECT conv_id, turn, CAST((length(text) + 3) // 4 AS BIGINT) AS t, sum(CAST((length(text) + 3) // 4 AS BIGINT)) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations)
WHERE total > 150 AND (a <= 1 OR b <= 2) GROUP BY conv_id HAVING sum(t) > 150""")
def reduce_too_large(spark: SparkSession, d: str) -> DataFrame:
    """Sessions whose first and last messages alone are over the budget."""
    m = ad.messages(spark, d).withColumn("tokens", tx.token_count(F.col("content")))
    return sessions.too_large(sessions.reduced(m, ("conv_id",), budget=150), ("conv_id",), 150).where("mandatory > 150").select("conv_id", "mandatory")


@query("SELECT event_id AS call_id, props AS result, CASE WHEN event_id % 4 <> 0 THEN event_type END AS tool_name FROM events")
def tool_result_names(spark: SparkSession, d: str) -> DataFrame:
    e = ad.read(spark, d, "events")
    calls = e.where("event_id % 4 <> 0").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("name"))
    return sessions.named_results(e.select(F.col("event_id").alias("call_id"), F.col("props").alias("result")), calls)


@query("SELECT event_id AS call_id, event_id % 4 = 0 AS approved FROM events WHERE event_id % 2 = 0 AND event_type = 'click'")
def child_decisions(spark: SparkSession, d: str) -> DataFrame:
    e = ad.read(spark, d, "events")
    decided = e.select(F.col("event_id").alias("call_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 4 == 0).alias("approved"))
    return sessions.child_decisions(decided, e.where("event_type = 'click'").select(F.col("event_id").alias("call_id")))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'given' WHEN event_type = 'view' THEN 'model' ELSE 'provider' END AS capability FROM events")
def capability_resolve(spark: SparkSession, d: str) -> DataFrame:
    out = tools.resolved_capability(F.when(F.col("event_id") % 5 == 0, "given"), F.when(F.col("event_type") == "view", "model"), F.lit("provider"))
    return ad.read(spark, d, "events").select("event_id", out.alias("capability"))


@query("SELECT doc_id, left(text, 200) AS text, CASE WHEN length(text) > 200 THEN 'partial' ELSE 'ok' END AS status FROM documents")
def output_cut(spark: SparkSession, d: str) -> DataFrame:
    text, status = tools.cut_output(F.col("text"), 200)
    return ad.read(spark, d, "documents").select("doc_id", text.alias("text"), status.alias("status"))


@query("""SELECT event_id AS key, event_id % 3 <> 1 AS is_json, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'raw ' || event_type ELSE '{"a":' || user_id || '}' END AS value FROM events""")
def kv_codec(spark: SparkSession, d: str) -> DataFrame:
    """Stored values are JSON; what is none comes back as it is."""
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("raw "), "event_type")).otherwise(F.concat(F.lit('{"a": '), F.col("user_id").cast("string"), F.lit("}")))
    return tables.with_decoded(ad.read(spark, d, "events").select(F.col("event_id").alias("key"), raw.alias("value"))).select("key", "is_json", "value")


def _tool_hits(spark: SparkSession, d: str, fallback: str) -> DataFrame:
    s = ad.read(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"))
    hits = s.where("query_id % 4 <> 0").select("query_id", F.lit(1).alias("rank"), F.concat(F.lit("tool-"), F.col("query_id").cast("string")).alias("name"))
    registry = ad.read(spark, d, "nation").select(F.concat(F.lit("tool-"), F.col("n_nationkey").cast("string")).alias("name"))
    return tools.retrieved(hits, registry, s, always=("tool-0",), fallback=fallback).select("query_id", "name")


FOUND = "SELECT s_suppkey AS query_id, 'tool-0' AS name FROM supplier {0} UNION ALL SELECT s_suppkey, 'tool-' || s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey IN (SELECT n_nationkey FROM nation)"
NONE = "(s_suppkey % 4 = 0 OR s_suppkey NOT IN (SELECT n_nationkey FROM nation))"


@query(FOUND.format("") + " UNION ALL SELECT s_suppkey, 'tool-' || n_nationkey FROM supplier, nation WHERE n_nationkey <> 0 AND " + NONE)
def tool_fallback_all(spark: SparkSession, d: str) -> DataFrame:
    return _tool_hits(spark, d, "all")


@query(FOUND.format("WHERE NOT " + NONE))
def tool_fallback_none(spark: SparkSession, d: str) -> DataFrame:
    return _tool_hits(spark, d, "none")


# ---- JSON texts


@query("SELECT event_id, '{\"event\": \"' || event_type || '\", \"n\": ' || user_id || '}' AS found FROM events")
def json_first_value(spark: SparkSession, d: str) -> DataFrame:
    """A fenced block goes first; without one the first bracket that can be read."""
    value = F.concat(F.lit('{"n": '), F.col("user_id").cast("string"), F.lit(', "event": "'), "event_type", F.lit('"}'))
    fenced = F.concat(F.lit("Not [this]:\n```json\n"), value, F.lit("\n```\nnor {that}"))
    bare = F.concat(F.lit("so {x} it is "), value, F.lit(" or [1]"))
    return ad.read(spark, d, "events").select("event_id", js.first_json(F.when(F.col("event_id") % 2 == 0, fenced).otherwise(bare)).alias("found"))


@query("SELECT event_id, i - 1 AS place, ([event_type, 'fact ' || user_id])[i] AS fact FROM events, (SELECT unnest([1, 2]) AS i)")
def fact_lists(spark: SparkSession, d: str) -> DataFrame:
    listed = F.concat(F.lit('["'), "event_type", F.lit('", 7, null, {"fact": "fact '), F.col("user_id").cast("string"), F.lit('"}, {"other": "x"}, " "]'))
    out = ad.read(spark, d, "events").select("event_id", F.posexplode(js.fact_list(listed)).alias("place", "fact"))
    return out.withColumn("place", F.col("place").cast("long"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"truncated\": true}' ELSE '{\"a\": \"' || event_type || '\"}' END AS copy FROM events")
def json_bounded_copy(spark: SparkSession, d: str) -> DataFrame:
    wide = F.concat(F.lit('{"a": ["'), F.array_join(F.array_repeat("event_type", 20), '", "'), F.lit('"]}'))
    fine = F.concat(F.lit('{"_private": 1, "a": "'), "event_type", F.lit('"}'))
    return ad.read(spark, d, "events").select("event_id", js.bounded_copy(F.when(F.col("event_id") % 2 == 0, wide).otherwise(fine), 60).alias("copy"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'n: missing' ELSE 'n: not integer|tags[1]: not string' END AS problems FROM events")
def schema_problems(spark: SparkSession, d: str) -> DataFrame:
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}}
    call = F.when(F.col("event_id") % 3 == 0, '{"n": 1, "tags": ["a"]}').when(F.col("event_id") % 3 == 1, '{"tags": []}').otherwise('{"n": true, "tags": ["a", 2]}')
    return ad.read(spark, d, "events").select("event_id", F.array_join(js.schema_problems(call, schema), "|").alias("problems"))


@query("""SELECT event_id, '{"api_key": "***", "note": "' || event_type || ' at /home/***/x", "run_id": "' || repeat('0', 40) || '", "steps": [{"auth": "***", "n": ' || user_id || '}, "***"]}' AS clean FROM events""")
def clean_json(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('{"api_key": "abc", "note": "'), "event_type", F.lit(' at /home/ann/x", "run_id": "' + "0" * 40 + '", "steps": [{"auth": "x", "n": '), F.col("user_id").cast("string"), F.lit('}, "sk-abcdefghijklmnop"]}'))
    return ad.read(spark, d, "events").select("event_id", js.clean_json(raw).alias("clean"))


@query("SELECT event_id, CASE WHEN event_id % 20 < 12 THEN event_id % 20 ELSE -1 END AS step FROM events")
def diagnosis_clamp(spark: SparkSession, d: str) -> DataFrame:
    return ad.read(spark, d, "events").select("event_id", F.coalesce(js.clamped_step(F.col("event_id") % 20, F.lit(12)), F.lit(-1)).alias("step"))


@query("""SELECT event_id, 'user /home/***/x *** ' || event_type || ' *** and ***' AS text FROM events""")
def redact_defaults(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("user /home/ann/x sk-abcdefghijklmnop "), "event_type", F.lit(" Bearer abc.def and " + "f" * 40))
    return ad.read(spark, d, "events").select("event_id", tx.masked(text).alias("text"))


# ---- traces and state


@query("SELECT run_id, pos, CAST(epoch_us(ts) - CAST(round_even(latency_ms * 1000, 0) AS BIGINT) AS BIGINT) AS start_us, CAST(epoch_us(ts) AS BIGINT) AS end_us FROM traces JOIN (SELECT event_id, ts FROM events) ON event_id = pos", "traces")
def trace_spans(spark: SparkSession, d: str) -> DataFrame:
    at = ad.read(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("ts").cast("timestamp").alias("at"))
    out = traces.spans(ad.traces(spark, d).join(at, "pos"))
    return out.select("run_id", "pos", F.unix_micros("span_start").alias("start_us"), F.unix_micros("span_end").alias("end_us"))


@query("SELECT run_id, count(*) FILTER (WHERE type = 'llm') AS llm_calls, count(*) FILTER (WHERE type = 'tool') AS tool_calls, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens_used FROM traces WHERE run_id IS NOT NULL GROUP BY run_id", "traces")
def stream_run_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each run, kept as state of the stream; here after its last batch."""
    kinds = {"signup": "llm", "view": "tool", "click": "retrieval", "purchase": "index_sync", "error": "custom"}
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    events = _event_stream(spark, d).select(
        F.when(F.col("event_id") % 97 != 0, F.concat(F.lit("run-"), F.col("user_id").cast("string"))).alias("run_id"), kind[F.col("event_type")].alias("type"), F.get_json_object("props", "$.k").cast("long").alias("tokens")
    )
    return _updates(state.run_counters(events), spark, "run_id")


@query("SELECT conv_id AS session, count(*) - 2 AS n_summed, string_agg(turn, ' ' ORDER BY turn) FILTER (WHERE turn < n - 2) AS summary FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id HAVING count(*) > 2 AND min(turn) = 0 AND max(turn) = count(*) - 1")
def stream_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries that grow as messages come; here the numbers of the messages taken in stand for a model's words."""
    from tessera.streaming import feeds

    table = ad.read(spark, d, "conversations")
    stream = feeds.file_feed(spark, f"{d}/conversations.parque[t]", table.schema)
    rows = stream.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("turn").cast("string").alias("content"))
    out = _updates(state.running_summaries(rows, lambda old, new: " ".join([*([old] if old else []), *new]), keep_recent=2), spark, "session")
    out = out.withColumn("session", F.col("session").cast("long"))
    whole = table.groupBy(F.col("conv_id").alias("session")).agg(F.count("*").alias("n"), F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    return out.join(whole.where("n > 2 AND lo = 0 AND hi = n - 1"), "session", "left_semi").where("n_summed > 0")


def _updates(stream: DataFrame, spark: SparkSession, key: str) -> DataFrame:
    """The last update of each key, of all batches that there are."""
    at = _workspace(spark)

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/n={n}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{at}/out")
    return tables.latest(found, (key,), F.col("_batch")).select(*stream.columns)
