"""Derived indexes: what changed, what is stale, what is pending, what differs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.scope import DIMENSIONS, footprints
from tessera.operators.tables import ITEM_KEY, delete_exact, upsert


def pending_above(source: DataFrame, book: DataFrame) -> DataFrame:
    """The source rows for whose id the book has a pending entry in their scope or in one that contains it: each dimension is '' or equal."""
    waiting = book.where("pending_since IS NOT NULL").select(F.col("id").alias("_id"), *(F.col(d).alias(f"_{d}") for d in DIMENSIONS)).distinct()
    met = F.col("id") == F.col("_id")
    for d in DIMENSIONS:
        met = met & ((F.col(f"_{d}") == "") | (F.col(f"_{d}") == F.col(d)))
    return source.join(waiting, met, "left_semi")


def changed(source: DataFrame, book: DataFrame, *, force: bool = False) -> DataFrame:
    """Source rows (with content_hash) to index: new ones, those with another hash than the book's, and those that are pending there or in a scope above."""
    if force:
        return source
    known = book.select(*ITEM_KEY, F.col("content_hash").alias("_known"))
    waiting = pending_above(source, book).select(*ITEM_KEY).distinct().withColumn("_pending", F.lit(True))
    met = source.join(known, list(ITEM_KEY), "left").join(waiting, list(ITEM_KEY), "left")
    due = F.col("_known").isNull() | (F.col("_known") != F.col("content_hash")) | F.col("_pending").isNotNull()
    return met.where(due).select(*source.columns)


def stale(source: DataFrame, book: DataFrame) -> DataFrame:
    """Book entries without a source row."""
    return book.join(source.select(*ITEM_KEY), list(ITEM_KEY), "left_anti")


def marked_pending(book: DataFrame, rows: DataFrame, now: F.Column) -> DataFrame:
    hit = rows.select(*ITEM_KEY).distinct().withColumn("_hit", F.lit(True))
    return book.join(hit, list(ITEM_KEY), "left").withColumn("pending_since", F.when(F.col("_hit"), F.coalesce("pending_since", now)).otherwise(F.col("pending_since"))).select(*book.columns)


def reconciled(source: DataFrame, book: DataFrame, now: F.Column) -> DataFrame:
    """The book after all is indexed again: stale entries gone, every source row with its hash and not pending."""
    fresh = source.select(*ITEM_KEY, "content_hash", now.alias("updated_at"), F.lit(None).cast("timestamp").alias("pending_since"))
    return upsert(delete_exact(book, stale(source, book)), fresh.select(*book.columns))


def divergence(source: DataFrame, index: DataFrame) -> DataFrame:
    """key columns and side: 'missing' from the index, or 'extra' in it."""
    a = source.select(*ITEM_KEY).distinct().withColumn("_s", F.lit(True))
    b = index.select(*ITEM_KEY).distinct().withColumn("_i", F.lit(True))
    both = a.join(b, list(ITEM_KEY), "full_outer")
    return both.where("_s IS NULL OR _i IS NULL").select(*ITEM_KEY, F.when(F.col("_i").isNull(), "missing").otherwise("extra").alias("side"))


def ingest_plan(documents: DataFrame, hashes: DataFrame) -> DataFrame:
    """documents (doc_id, fingerprint) with skipped: whether the stored fingerprint is the same."""
    known = hashes.select("doc_id", F.col("content_hash").alias("known"))
    return documents.join(known, "doc_id", "left").withColumn("skipped", F.col("known").eqNullSafe(F.col("fingerprint")) & F.col("known").isNotNull()).drop("known")


def tracked_or_pending(book: DataFrame) -> DataFrame:
    """The exact scopes that hold an index entry or a pending one."""
    return footprints(book.where("content_hash IS NOT NULL")).union(footprints(book.where("pending_since IS NOT NULL"))).distinct()
