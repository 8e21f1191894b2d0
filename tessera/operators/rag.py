"""From hits to context: hydration, orphans, neighbouring chunks, prompts and footers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.operators.scope import DIMENSIONS


def chunk_key(hits: DataFrame, chunks: DataFrame) -> list[str]:
    """The columns on which hits meet chunks: the id and the scope columns that both have."""
    return ["id", *(c for c in DIMENSIONS if c in hits.columns and c in chunks.columns)]


def hydrated(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunk; a hit whose chunk is gone, or is another owner's, falls out."""
    return hits.join(chunks.withColumnRenamed("chunk_id", "id"), chunk_key(hits, chunks))


def orphans(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits without a chunk: index entries to take out."""
    key = chunk_key(hits, chunks)
    return hits.join(chunks.withColumnRenamed("chunk_id", "id").select(*key), key, "left_anti")


def retrieve(vectors: DataFrame, texts: DataFrame, chunks: DataFrame, queries: DataFrame, *, top_k: int = search.TOP_K, pool: int = search.POOL, window: int = 0, vectors_where: Column | None = None, texts_where: Column | None = None, metric: str = "l2") -> DataFrame:
    """query_id, rank, score, id, doc_id, content, lo, hi: hybrid search of `queries` (query_id, query, embedding), hits joined to their chunks, orphans dropped.

    `vectors` and `texts` are the two indexes, keyed like `chunks` (chunk_id, doc_id, idx, content). With a window each hit's content grows by the chunks
    around it, each given to the best hit that reaches it; a hit that keeps none is dropped. Ranks count what is left, without gaps.
    """
    search.checked_sizes(top_k, pool)
    dense = search.nearest(vectors, queries.select("query_id", F.col("embedding").alias("query")), top_k=pool, where=vectors_where, metric=metric)
    sparse = search.bm25(texts, queries.select("query_id", "query"), top_k=pool, where=texts_where)
    hits = hydrated(search.hybrid(dense, sparse, top_k=top_k, pool=pool), chunks)
    if window:
        near = expanded(hits, chunks, window)
        hits = hits.drop("content", "doc_id").join(near, ["query_id", "rank"])
    else:
        hits = hits.withColumns({"lo": F.col("idx"), "hi": F.col("idx")})
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return hits.select("query_id", place.alias("rank"), "score", "id", "doc_id", "content", "lo", "hi")


#: Fixed value: the answer where nothing was found.
NO_HITS = "No relevant information was found in the knowledge base."


def ask(queries: DataFrame, hits: DataFrame, *, no_hits: str = NO_HITS) -> DataFrame:
    """query_id, context, sources, answer: what a model is asked with, and the sources in order (n, id, doc_id, content).

    Where a query has no hits the answer is fixed, its context is null and it has no sources; elsewhere the answer is the model's to give, so null.
    """
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("n"), "id", "doc_id", "content"))).alias("sources"))
    told = queries.select("query_id").join(listed, "query_id", "left").join(context_block(hits), "query_id", "left")
    empty = F.array().cast(listed.schema["sources"].dataType)
    return told.select("query_id", "context", F.coalesce("sources", empty).alias("sources"), F.when(F.col("sources").isNull(), F.lit(no_hits)).alias("answer"))


def neighbours(hits: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """query_id, rank, doc_id, idx, content of every chunk within `window` places of a hit, each with the best-ranked hit that reaches it.

    `hits` has query_id, rank, doc_id, idx. The places around a hit are few and become rows, so the join is on equal keys.
    """
    wanted = hits.select("query_id", "rank", "doc_id", F.explode(F.sequence(F.col("idx") - window, F.col("idx") + window)).alias("idx"))
    first = F.row_number().over(W.partitionBy("query_id", "doc_id", "idx").orderBy("rank"))
    owned = wanted.withColumn("_n", first).where("_n = 1").drop("_n")
    return owned.join(chunks.select("doc_id", "idx", "content"), ["doc_id", "idx"])


def expanded(hits: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """query_id, rank, doc_id, content, lo, hi: each hit's own neighbourhood as one text; a hit whose chunks all went to better hits is dropped."""
    near = neighbours(hits, chunks, window)
    ordered = F.array_sort(F.collect_list(F.struct("idx", "content")))
    return near.groupBy("query_id", "rank", "doc_id").agg(ordered.alias("c"), F.min("idx").alias("lo"), F.max("idx").alias("hi")).select("query_id", "rank", "doc_id", F.array_join(F.transform("c", lambda c: c["content"]), "\n").alias("content"), "lo", "hi")


def context_block(hits: DataFrame) -> DataFrame:
    """query_id, context: the hits as numbered sources, marked as data that is not to be trusted."""
    one = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": untrusted data]\n"), F.col("content"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("t")))), lambda s: s["t"]), "\n\n").alias("context"))


def source_footer(hits: DataFrame) -> DataFrame:
    """query_id, footer: [n] and the heading, or the first 20 characters of the content."""
    name = F.when(F.coalesce("heading_path", F.lit("")) != "", F.col("heading_path")).otherwise(F.substring("content", 1, 20))
    one = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]"), name)
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("t")))), lambda s: s["t"]), " ").alias("footer"))


def index_range(chunks: DataFrame, lo: int, hi: int) -> DataFrame:
    return chunks.where(F.col("idx").between(lo, hi))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


def ingest_totals(chunks: DataFrame) -> DataFrame:
    """documents and chunks of the table, from the counts by document."""
    return chunk_counts(chunks).agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"))
