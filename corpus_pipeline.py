"""A training corpus from the documents: quality, near-duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir); `run` writes what a stage returns and reads it back for the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, classifier, mixing, neardup, pii
from tessera.llm.common import free_name, materialize, read

#: Documents whose score is below this are rejected.
LEAST_QUALITY = 0.5


#: Keys up to which a join that takes documents out broadcasts them.
BROADCAST_KEYS = 200_000
#: What a row is known by within a stage: its doc_id, which may be null, and a hash of its text.
KEY = ("doc_id", "_text")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's hash."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))


def matched(docs: DataFrame, keys: DataFrame, prefix: str, how: str) -> DataFrame:
    """`docs` joined to `keys`, whose columns are KEY behind a prefix, with no name of its own that a column of `docs` could have."""
    own = free_name(docs.columns, "_text")
    names = {k: free_name([*docs.columns, own], f"_{prefix}_{k}") for k in range(len(KEY))}
    keys = keys.select(*(F.col(f"_{prefix}_{k}").alias(n) for k, n in names.items()))
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    same = (F.col(names[1]) == F.col(own)) & F.col(names[0]).eqNullSafe(F.col("doc_id"))
    return docs.withColumn(own, F.xxhash64("text")).join(F.broadcast(keys) if few else keys, same, how).select(*docs.columns)


def without(docs: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows of `docs` whose key is not among `keys`: another text under the same doc_id stays."""
    gone = materialize(keys.select(*(F.col(c).alias(f"_gone_{k}") for k, c in enumerate(KEY))).distinct(), name)
    return matched(docs, gone, "gone", "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier does not reject: a null or empty text has a score like any other; an empty table stays empty. All columns stay, whatever their names."""
    scores = classifier.classify(keyed(docs), read(spark, sf_dir, "labels"), carried=("_text",))
    return without(docs, scores.where(F.col("score") < LEAST_QUALITY), "pipeline-rejected")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id, rows without one last; of repeated rows one.

    A null or empty text, or one without words, is no one's copy and stays as often as it is there. All columns stay, whatever their names; an empty table stays empty.
    """
    rows = keyed(docs).select(F.struct(F.col("doc_id").isNull().alias("none"), *KEY).alias("id"), "text")
    found = materialize(neardup.near_duplicates(rows, id_col="id").select("id.*", "kept", "n_shingles"), "pipeline-copies")
    left = without(docs, found.where("NOT kept"), "pipeline-gone")
    # a text without words is no one's copy, so its repeated rows stay
    again = found.where("kept AND n_shingles > 0").groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY)
    again = materialize(again, "pipeline-again")
    if not again.limit(1).count():
        return left
    repeated = matched(docs, again.select(*(F.col(c).alias(f"_again_{k}") for k, c in enumerate(KEY))), "again", "left_semi")
    single = repeated.groupBy(F.col("doc_id").alias("_0"), F.xxhash64("text").alias("_1")).agg(F.first(F.struct(*docs.columns)).alias("_row"))
    return without(left, again, "pipeline-single").unionByName(single.select("_row.*"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates in place of personal data; n_chars follows the text. A null or empty text stays as it is, equal rows get equal texts, an empty table stays empty."""
    done = pii.pseudonymize(docs, key=pii.DEMO_KEY)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them; null, empty and repeated texts are documents like others, null is a source too. An empty table stays empty."""
    return mixing.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's tokens and of the text that they decode to: a row for each row, repeated ones too; null counts as empty. An empty table stays empty."""
    return bpe.round_trip(docs, vocab=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("pii_surrogates", private_data),
    ("source_mixture", mixture),
    ("byte_bpe", tokens),
]

#: SQL can express neither the classifier nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
