"""Queries over kept indexes: built from the shared tables change by change, then searched."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as vx
from tessera.operators import pruned, scope, segment
from tessera.operators.keyword_index import KeywordIndex
from tessera.plans import adapters as ad
from tessera.plans.registry import Registry
from tessera.plans.retrieval import BM25, KNN
from tessera.sources.shared import shared_dir
from tessera.sources.versioned import VersionedStore

registry = Registry()
query, QUERIES, SQL = registry.query, registry.queries, registry.sql


def _store(spark: SparkSession) -> VersionedStore:
    return VersionedStore(spark, f"{shared_dir(spark)}/tessera/index-{uuid.uuid4().hex}")


def _hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", "id", "rank", vx.rounded(F.col("score")).alias("score"))


@query(BM25.format(where="", k=5), "terms")
def keyword_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """All documents under a first text, the German ones deleted, and all again under their own text."""
    index = KeywordIndex(_store(spark), "kw")
    items = ad.items(spark, d)
    index.upsert(items.withColumn("content", F.concat_ws(" ", "sc_agent", "sc_user")))
    index.delete(items.select("id"), scope.in_range({"sc_user": "de"}))
    index.upsert(items)
    return _hits(index.search(ad.text_queries(spark, d)))


#: The adapters' terms, over the documents that are not French.
LEFT = {"documents": "(SELECT * FROM documents WHERE lang IS DISTINCT FROM 'fr')"}


@query("WITH " + ad.CTE["terms"].replace("FROM documents", f"FROM {LEFT['documents']}") + "\n" + BM25.format(where="", k=5))
def keyword_index_after_delete(spark: SparkSession, d: str) -> DataFrame:
    """The French documents deleted and the index compacted: counts and lengths are those of the others."""
    index = KeywordIndex(_store(spark), "kw")
    items = ad.items(spark, d)
    index.upsert(items)
    index.delete(items.select("id"), scope.in_range({"sc_user": "fr"}))
    index.compact()
    return _hits(index.search(ad.text_queries(spark, d)))


@query(KNN.format(where=""))
def knn_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors by an index of pivots and rings."""
    found = pruned.nearest(pruned.built(ad.vectors(spark, d)), ad.vector_queries(spark, d)).hits
    return found.select("query_id", "id", "rank", *(vx.rounded(F.col(c)).alias(c) for c in ("distance", "score")))


#: Words of the messages run together: texts without spaces, of which the vocabulary is to be found again.
LETTERS = "\\p{L}+"


@query("""WITH r AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+')) AS run FROM conversations), c AS (SELECT run, count(*) AS n FROM r GROUP BY run),
p AS (SELECT substr(run, i, k) AS piece, n FROM (SELECT run, n, unnest(range(1, length(run) + 1)) AS i FROM c), (SELECT unnest(range(1, 5)) AS k) WHERE i + k - 1 <= length(run))
SELECT piece, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY piece HAVING sum(n) >= 2 OR length(piece) = 1""")
def segment_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Substrings of up to four letters of all words of the messages: what a vocabulary starts from."""
    return segment.substrings(segment.runs(ad.read(spark, d, "conversations"), "text", LETTERS), longest=4, least=2)


def segmented_terms(spark: SparkSession, d: str) -> DataFrame:
    """The messages' texts without their spaces, cut by a vocabulary that is learned from them."""
    texts = ad.read(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "\\s+", "").alias("content"))
    terms = segment.segmenter(segment.learned(texts, pattern=LETTERS), pattern=r"[^\W\d_]+")
    return texts.select("conv_id", "turn", F.array_join(terms(F.col("content")), " ").alias("terms"))


QUERIES["segmented_terms"] = segmented_terms
