"""Queries: scopes, text, vectors, keyword search, fusion, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.operators import rag, scope, search, tables
from tessera.plans import adapters as ad
from tessera.plans.registry import Registry

registry = Registry()
query = registry.query
QUERIES, SQL = registry.queries, registry.sql


@query("SELECT id FROM items WHERE lang = 'en' AND source = 'src1'", "items")
def scope_range(spark: SparkSession, d: str) -> DataFrame:
    return ad.items(spark, d).where(scope.in_range({"sc_user": "en", "sc_agent": "src1"})).select("id")


@query("SELECT id FROM items WHERE lang = 'en' AND source = ''", "items")
def scope_exact(spark: SparkSession, d: str) -> DataFrame:
    return ad.items(spark, d).where(scope.exactly({"base": "rag", "sc_user": "en"})).select("id")


@query("SELECT id FROM items WHERE (lang IN ('', 'de')) AND source IN ('', 'src0')", "items")
def scope_ancestor(spark: SparkSession, d: str) -> DataFrame:
    return ad.items(spark, d).where(scope.ancestor_of({"base": "rag", "sc_user": "de", "sc_agent": "src0"})).select("id")


@query("SELECT DISTINCT 'rag' AS base, lang AS sc_user, source AS sc_agent, '' AS sc_session, '' AS sc_app FROM items", "items")
def scope_footprints(spark: SparkSession, d: str) -> DataFrame:
    return scope.footprints(ad.items(spark, d))


@query("SELECT vec_id FROM embeddings WHERE label = 3")
def meta_filter_eq(spark: SparkSession, d: str) -> DataFrame:
    return ad.vectors(spark, d).where(scope.metadata_is("label", 3, ("label",))).select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE label IN (1, 4)")
def meta_filter_in(spark: SparkSession, d: str) -> DataFrame:
    return ad.vectors(spark, d).where(scope.metadata_in("label", [1, 4], ("label",))).select("vec_id")


@query("SELECT doc_id, CAST((length(text) + 3) // 4 AS BIGINT) AS tokens FROM documents")
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return ad.read(spark, d, "documents").select("doc_id", tx.token_count(F.col("text")).alias("tokens"))


@query("SELECT conv_id, turn, CAST((length(text) + 3) // 4 + CASE WHEN turn % 3 = 0 THEN 800 ELSE 0 END AS BIGINT) AS tokens FROM conversations")
def token_count_parts(spark: SparkSession, d: str) -> DataFrame:
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    parts = F.when(F.col("turn") % 3 == 0, F.array(text, image)).otherwise(F.array(text))
    return ad.read(spark, d, "conversations").select("conv_id", "turn", tx.part_tokens(parts).cast("long").alias("tokens"))


@query("SELECT chunk_id, sha1(content) AS digest FROM chunks", "chunks")
def chunk_digest(spark: SparkSession, d: str) -> DataFrame:
    return ad.chunks(spark, d).select("chunk_id", tx.content_digest(F.col("content")).alias("digest"))


@query("SELECT doc_id, sha1(text || chr(30) || lang || chr(30) || source || chr(30) || 'txt' || chr(30) || '512|64') AS fingerprint FROM documents")
def doc_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return ad.read(spark, d, "documents").select("doc_id", tx.joined_digest(F.col("text"), F.col("lang"), F.col("source"), F.lit("txt"), F.lit("512|64")).alias("fingerprint"))


@query("""SELECT item_id, i, floor(b / sqrt(list_sum(list_transform(raw, lambda x: x * x))) * 1e6 + 0.5) / 1e6 AS x FROM (
  SELECT item_id, raw, unnest(range(8)) AS i, unnest(raw) AS b FROM (
    SELECT item_id, list_transform(range(8), lambda i: CAST(CAST('0x' || substr(sha256(text), CAST(i * 2 + 1 AS BIGINT), 2) AS INT) AS DOUBLE) - 128) AS raw FROM benchmark))""")
def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    e = ad.read(spark, d, "benchmark").select("item_id", F.posexplode(vx.hashed_embedding(F.col("text"), 8)).alias("i", "x"))
    return e.select("item_id", F.col("i").cast("long").alias("i"), vx.rounded(F.col("x")).alias("x"))


@query("SELECT chunk_id, heading_path || chr(10) || content AS content FROM chunks", "chunks")
def heading_contextualize(spark: SparkSession, d: str) -> DataFrame:
    return ad.chunks(spark, d).select("chunk_id", tx.with_heading(F.col("heading_path"), F.col("content")).alias("content"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[0-9]{13,16}', '***', 'g'), '[A-Za-z0-9._]+@[a-z0-9.]+', '***', 'g'), '[0-9a-f]{32,}', '***', 'g') AS text FROM documents""")
def redact_values(spark: SparkSession, d: str) -> DataFrame:
    return ad.read(spark, d, "documents").select("doc_id", tx.masked(F.col("text"), ("[0-9]{13,16}", "[A-Za-z0-9._]+@[a-z0-9.]+", "[0-9a-f]{32,}")).alias("text"))


@query("""SELECT event_id, name, CASE WHEN name IN ('api_key', 'token') THEN '***' ELSE value END AS value FROM (
  SELECT event_id, unnest(['run_id', 'api_key', 'token', 'note']) AS name, unnest([CAST(user_id AS VARCHAR), props, event_type, event_type]) AS value FROM events)""")
def redact_keys(spark: SparkSession, d: str) -> DataFrame:
    values = F.create_map(F.lit("run_id"), F.col("user_id").cast("string"), F.lit("api_key"), F.col("props"), F.lit("token"), F.col("event_type"), F.lit("note"), F.col("event_type"))
    return ad.read(spark, d, "events").select("event_id", F.explode(tx.redacted(values)).alias("name", "value"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '…(+' || (length(text) - 100) || ')' ELSE text END AS text FROM documents")
def truncate_value(spark: SparkSession, d: str) -> DataFrame:
    return ad.read(spark, d, "documents").select("doc_id", tx.clip(F.col("text"), 100).alias("text"))


KNN = """SELECT query_id, id, rank, floor(distance * 1e6 + 0.5) / 1e6 AS distance, floor(1 / (1 + distance) * 1e6 + 0.5) / 1e6 AS score FROM (
  SELECT q.vec_id AS query_id, CAST(c.vec_id AS VARCHAR) AS id, list_distance(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, CAST(c.vec_id AS VARCHAR)) AS INT) AS rank
  FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 {where}) WHERE rank <= 5"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Without the scope of the items, their ids being distinct here."""
    return df.withColumns({n: vx.rounded(F.col(n)) for n in names}).drop(*scope.DIMENSIONS)


@query(KNN.format(where=""))
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.nearest(ad.vectors(spark, d), ad.vector_queries(spark, d)), "distance", "score")


@query(KNN.format(where="AND c.label IN (1, 2)"))
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.nearest(ad.vectors(spark, d), ad.vector_queries(spark, d), where=scope.metadata_in("label", [1, 2], ("label",))), "distance", "score")


@query("SELECT a.vec_id, floor(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) * 1e6 + 0.5) / 1e6 AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = ad.read(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", vx.rounded(vx.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


@query("SELECT term, CAST(doc_id AS VARCHAR) AS id, CAST(dl AS INT) AS dl, tf FROM postings", "terms")
def keyword_postings(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(ad.items(spark, d)).select("term", "id", "dl", "tf")


@query("SELECT n_docs, floor(avg_dl * 1e6 + 0.5) / 1e6 AS avg_dl FROM stats", "terms")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.corpus_stats(ad.items(spark, d)), "avg_dl")


BM25 = """SELECT query_id, id, rank, floor(score * 1e6 + 0.5) / 1e6 AS score FROM (
  SELECT query_id, CAST(doc_id AS VARCHAR) AS id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9 + 0.5) / 1e9 DESC, CAST(doc_id AS VARCHAR)) AS INT) AS rank FROM scores {where})
WHERE rank <= {k}"""


@query(BM25.format(where="", k=5), "terms")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.bm25(ad.items(spark, d), ad.text_queries(spark, d)), "score")


@query(BM25.format(where="JOIN documents USING (doc_id) WHERE lang = 'fr'", k=5), "terms")
def bm25_scoped(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.bm25(ad.items(spark, d), ad.text_queries(spark, d), where=scope.in_range({"sc_user": "fr"})), "score")


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists for each label: by the first and by the second component, twenty places each."""
    v = ad.read(spark, d, "embeddings")
    one = lambda n: search.ranked(v.select(F.col("label").alias("query_id"), F.col("vec_id").cast("string").alias("key"), F.col("embedding")[n].alias("score")), 20, F.desc("score"), F.col("key")).withColumn("list_no", F.lit(n))
    return one(0).unionByName(one(1))


LISTS = """lists AS (SELECT label AS query_id, CAST(vec_id AS VARCHAR) AS key, n AS list_no, CAST(embedding[n + 1] AS FLOAT) AS score,
  CAST(row_number() OVER (PARTITION BY label, n ORDER BY embedding[n + 1] DESC, CAST(vec_id AS VARCHAR)) AS INT) AS rank FROM embeddings, (SELECT unnest([0, 1]) AS n)),
pool AS (SELECT * FROM lists WHERE rank <= 20)"""


@query(f"""WITH {LISTS}, fused AS (SELECT query_id, key, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list_no * 1000 + rank) AS seen FROM pool GROUP BY ALL)
SELECT query_id, key, floor(score * 1e6 + 0.5) / 1e6 AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e12 + 0.5) / 1e12 DESC, seen) AS INT) AS rank FROM fused) WHERE rank <= 5""")
def rrf_two_way(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.rrf(_lists(spark, d)).select("query_id", "key", "score", "rank"), "score")


@query(f"""WITH {LISTS}, normed AS (SELECT *, min(score::DOUBLE) OVER w AS lo, max(score::DOUBLE) OVER w AS hi FROM pool WINDOW w AS (PARTITION BY query_id, list_no)),
fused AS (SELECT query_id, key, sum(CASE list_no WHEN 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * CASE WHEN hi = lo THEN 1.0 ELSE (score::DOUBLE - lo) / (hi - lo) END) AS score, min(list_no * 1000 + rank) AS seen FROM normed GROUP BY ALL)
SELECT query_id, key, floor(score * 1e6 + 0.5) / 1e6 AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e12 + 0.5) / 1e12 DESC, seen) AS INT) AS rank FROM fused) WHERE rank <= 5""")
def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    lists = _lists(spark, d).withColumn("score", F.col("score").cast("double"))
    return _rounded(search.weighted_fusion(lists, {0: 0.7, 1: 0.3}).select("query_id", "key", "score", "rank"), "score")


@query(f"""WITH {LISTS}, hits AS (SELECT *, CASE WHEN list_no = 1 THEN key END AS embedding FROM pool)
SELECT query_id, key, arg_min(list_no, (CASE WHEN list_no = 1 THEN 0 ELSE 1 END) * 100000 + list_no * 1000 + rank) AS source FROM hits GROUP BY ALL""")
def rrf_carrier(spark: SparkSession, d: str) -> DataFrame:
    hits = _lists(spark, d).select("query_id", "key", "list_no", "rank", F.col("key").alias("id"), F.lit("").alias("content"), F.col("list_no").alias("source"), F.when(F.col("list_no") == 1, F.array(F.lit(1.0))).alias("embedding"))
    return search.carriers(hits).select("query_id", "key", "hit.source")


@query(f"""WITH {LISTS} SELECT query_id, key, name, arg_max(value, list_no * 1000 + rank) AS value FROM (
  SELECT query_id, key, list_no, rank, unnest(['list', CASE list_no WHEN 0 THEN 'distance' ELSE 'bm25' END]) AS name, unnest([CAST(list_no AS VARCHAR), CAST(rank AS VARCHAR)]) AS value FROM pool) GROUP BY ALL""")
def rrf_metadata(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("list_no") == 0, "distance").otherwise("bm25")
    return search.merged_metadata(_lists(spark, d).withColumn("metadata", F.create_map(F.lit("list"), F.col("list_no").cast("string"), own, F.col("rank").cast("string"))))


HYBRID = """dense AS (SELECT * FROM (SELECT item_id AS query_id, CAST(vec_id AS VARCHAR) AS key, 0 AS list_no, row_number() OVER (PARTITION BY item_id ORDER BY list_distance(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), CAST(vec_id AS VARCHAR)) AS rank
  FROM (SELECT item_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id) q, embeddings c) WHERE rank <= 20),
sparse AS (SELECT * FROM (SELECT query_id, CAST(doc_id AS VARCHAR) AS key, 1 AS list_no, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9 + 0.5) / 1e9 DESC, CAST(doc_id AS VARCHAR)) AS rank FROM scores {where}) WHERE rank <= 20),
fused AS (SELECT query_id, key, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list_no * 1000 + rank) AS seen FROM (SELECT * FROM dense UNION ALL SELECT * FROM sparse) GROUP BY ALL)
SELECT query_id, key AS id, floor(score * 1e6 + 0.5) / 1e6 AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e12 + 0.5) / 1e12 DESC, seen) AS INT) AS rank FROM fused) WHERE rank <= 5"""


def _hybrid(spark: SparkSession, d: str, where=None) -> DataFrame:
    texts = ad.text_queries(spark, d)
    asked = texts.select("query_id").join(ad.read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "query_id")
    dense = search.nearest(ad.vectors(spark, d), asked, top_k=search.POOL)
    sparse = search.bm25(ad.items(spark, d), texts, top_k=search.POOL, where=where)
    own = lambda df: df.drop(*scope.DIMENSIONS)  # the vectors' owners are not those of the texts
    return search.hybrid(own(dense), own(sparse)).select("query_id", "id", vx.rounded(F.col("score")).alias("score"), "rank")


@query("SELECT * FROM (" + "WITH " + ad.CTE["terms"] + ", " + HYBRID.format(where="") + ")")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text, with the vector of its number as its embedding, against all vectors and all documents."""
    return _hybrid(spark, d)


@query("SELECT * FROM (" + "WITH " + ad.CTE["terms"] + ", " + HYBRID.format(where="JOIN documents USING (doc_id) WHERE lang = 'en'") + ")")
def hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, scope.in_range({"sc_user": "en"}))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """For each source its ten longest chunks as hits; each fifth points to a chunk that is gone."""
    c = ad.chunks(spark, d)
    hits = search.ranked(c.select(F.substring_index("heading_path", " > ", 1).alias("query_id"), F.col("chunk_id").alias("id"), "doc_id", "idx", F.char_length("content").alias("n")), 10, F.desc("n"), F.col("id"))
    return hits.withColumn("id", F.when(F.col("rank") % 5 == 0, F.concat("id", F.lit("-gone"))).otherwise(F.col("id")))


HITS = """hits AS (SELECT query_id, CASE WHEN rank % 5 = 0 THEN id || '-gone' ELSE id END AS id, doc_id, idx, rank FROM (
  SELECT string_split(heading_path, ' > ')[1] AS query_id, chunk_id AS id, doc_id, idx, CAST(row_number() OVER (PARTITION BY string_split(heading_path, ' > ')[1] ORDER BY length(content) DESC, chunk_id) AS INT) AS rank FROM chunks) WHERE rank <= 10)"""


def hits_sql(body: str) -> str:
    return "WITH " + ad.CTE["chunks"] + ", " + HITS + " " + body


@query(hits_sql("SELECT query_id, rank, id, content FROM hits JOIN chunks ON chunk_id = id"))
def hydrate_hits(spark: SparkSession, d: str) -> DataFrame:
    return rag.hydrated(_hits(spark, d).select("query_id", "rank", "id"), ad.chunks(spark, d).select("chunk_id", "content"))


@query(hits_sql("SELECT query_id, rank, id FROM hits WHERE id NOT IN (SELECT chunk_id FROM chunks)"))
def orphan_hits(spark: SparkSession, d: str) -> DataFrame:
    return rag.orphans(_hits(spark, d).select("query_id", "rank", "id"), ad.chunks(spark, d))


NEAR = """owned AS (SELECT query_id, doc_id, w AS idx, min(rank) AS rank FROM (SELECT query_id, doc_id, rank, unnest(range(idx - 1, idx + 2)) AS w FROM hits) GROUP BY ALL)"""


@query(hits_sql(", " + NEAR + " SELECT query_id, rank, doc_id, CAST(idx AS INT) AS idx FROM owned JOIN chunks USING (doc_id, idx)"))
def neighbor_first_use(spark: SparkSession, d: str) -> DataFrame:
    return rag.neighbours(_hits(spark, d), ad.chunks(spark, d), 1).select("query_id", "rank", "doc_id", "idx")


@query(hits_sql(", " + NEAR + " SELECT query_id, rank, doc_id, string_agg(content, chr(10) ORDER BY idx) AS content, CAST(min(idx) AS INT) AS lo, CAST(max(idx) AS INT) AS hi FROM owned JOIN chunks USING (doc_id, idx) GROUP BY ALL"))
def neighbor_window(spark: SparkSession, d: str) -> DataFrame:
    return rag.expanded(_hits(spark, d), ad.chunks(spark, d), 1)


@query(hits_sql("SELECT query_id, string_agg('[Source ' || rank || ': untrusted data]' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM hits JOIN chunks ON chunk_id = id GROUP BY query_id"))
def ask_context(spark: SparkSession, d: str) -> DataFrame:
    return rag.context_block(rag.hydrated(_hits(spark, d).select("query_id", "rank", "id"), ad.chunks(spark, d)))


@query(hits_sql("SELECT query_id, string_agg('[' || rank || ']' || heading_path, ' ' ORDER BY rank) AS footer FROM hits JOIN chunks ON chunk_id = id GROUP BY query_id"))
def source_footers(spark: SparkSession, d: str) -> DataFrame:
    return rag.source_footer(rag.hydrated(_hits(spark, d).select("query_id", "rank", "id"), ad.chunks(spark, d)))


@query("SELECT chunk_id, doc_id, idx FROM chunks WHERE idx BETWEEN 1 AND 2", "chunks")
def index_range(spark: SparkSession, d: str) -> DataFrame:
    return rag.index_range(ad.chunks(spark, d), 1, 2).select("chunk_id", "doc_id", "idx")


@query("SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id", "chunks")
def list_docs(spark: SparkSession, d: str) -> DataFrame:
    return rag.chunk_counts(ad.chunks(spark, d))


@query("SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks FROM chunks", "chunks")
def ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    return rag.ingest_totals(ad.chunks(spark, d))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'new ' || lang ELSE lang END AS content FROM documents WHERE doc_id % 10 <> 7""")
def table_upsert_delete(spark: SparkSession, d: str) -> DataFrame:
    docs = ad.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("content"))
    table = scope.scoped(docs, base="rag")
    new = table.where("id % 4 = 0").withColumn("content", F.concat(F.lit("new "), F.col("content")))
    return tables.delete_in_range(tables.upsert(table, new), table.where("id % 10 = 7").select("id"), scope.in_range({"base": "rag"})).select("id", "content")
