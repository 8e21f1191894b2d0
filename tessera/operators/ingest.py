"""Documents in and out of the source tables: replace, delete, rebuild.

The tables are chunks (chunk_id, doc_id, scope, idx, content, ...), hashes (doc_id, scope, content_hash) and the index's book. All functions return whole new tables; a
VersionedStore commits them together, so readers see all of a change or nothing of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import content_digest
from tessera.operators.scope import DIMENSIONS
from tessera.operators.tables import upsert
from tessera.sources.shared import materialize


def doc_key(*tables: DataFrame) -> list[str]:
    return ["doc_id", *(d for d in DIMENSIONS if all(d in t.columns for t in tables))]


def replaced(chunks: DataFrame, hashes: DataFrame, documents: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks, hashes and a report after `documents` (doc_id, scope, fingerprint) have the chunks `new`.

    A document whose fingerprint is the stored one is left as it is. Of the others the chunks that are not among the new ones go; one without any new chunk
    is deleted with its hash. report: doc_id, scope, skipped, n_chunks, n_removed.
    """
    key = doc_key(chunks, hashes, documents, new)
    scope = key[1:]
    known = hashes.select(*key, F.col("content_hash").alias("known"))
    met = documents.join(known, key, "left").withColumn("skipped", F.col("known").isNotNull() & F.col("known").eqNullSafe(F.col("fingerprint")))
    plan = materialize(met.select(*key, "fingerprint", "skipped"), "ingest-plan")
    due = plan.where("NOT skipped").select(*key, "fingerprint")
    coming = materialize(new.join(due.select(*key), key, "left_semi"), "ingest-chunks")
    place = ["chunk_id", *scope]
    gone = chunks.join(due.select(*key), key, "left_semi").join(coming.select(*place), place, "left_anti")
    gone = materialize(gone.select(*place, "doc_id"), "ingest-gone")
    counts = coming.groupBy(*key).agg(F.count("*").alias("n_chunks"))
    removed = gone.groupBy(*key).agg(F.count("*").alias("n_removed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = plan.join(counts, key, "left").join(removed, key, "left").select(*key, "skipped", zero("n_chunks"), zero("n_removed"))
    left = chunks.join(gone.select(*place), place, "left_anti").select(*chunks.columns)
    kept = upsert(left, coming.select(*chunks.columns), tuple(place))
    fresh = due.join(counts, key).select(*key, F.col("fingerprint").alias("content_hash"))
    stored = hashes.join(due.select(*key), key, "left_anti").select(*hashes.columns).unionByName(fresh.select(*hashes.columns))
    return kept, stored, report


def deleted(chunks: DataFrame, hashes: DataFrame, doc_ids: DataFrame, scope: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks and hashes without the documents within a scope, and doc_id, scope, n_chunks of each that was there."""
    key = doc_key(chunks, hashes)
    wanted = doc_ids.select("doc_id").distinct()
    hit = chunks.where(scope).join(wanted, "doc_id", "left_semi").groupBy(*key).agg(F.count("*").alias("n_chunks"))
    hashed = hashes.where(scope).join(wanted, "doc_id", "left_semi").select(*key, F.lit(0).cast("long").alias("n_chunks"))
    counts = materialize(hit.unionByName(hashed).groupBy(*key).agg(F.sum("n_chunks").alias("n_chunks")), "ingest-deleted")
    out = [t.join(counts.select(*key), key, "left_anti").select(*t.columns) for t in (chunks, hashes)]
    return out[0], out[1], counts


def rebuilt(chunks: DataFrame, now: Column) -> DataFrame:
    """The index's book after every chunk has been indexed again: one row for each, with its digest, nothing pending."""
    scope = [d for d in DIMENSIONS if d in chunks.columns]
    return chunks.select(F.col("chunk_id").alias("id"), *scope, content_digest(F.col("content")).alias("content_hash"), now.alias("updated_at"), F.lit(None).cast("timestamp").alias("pending_since"))


def dropped(index: DataFrame, book: DataFrame, ids: DataFrame, scope: Column, *, failed: bool = False, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The index and its book without the ids within a scope. If the index could not be written (`failed`), it stays and the entries are pending."""
    wanted = ids.select("id").distinct()
    if failed:
        if now is None:
            raise ValueError("entries become pending at a time")
        hit = wanted.withColumn("_hit", F.lit(True))
        marked = book.join(hit, "id", "left").withColumn("pending_since", F.when(F.col("_hit") & scope, F.coalesce("pending_since", now)).otherwise(F.col("pending_since")))
        return index, marked.select(*book.columns)
    without = lambda t: t.join(wanted.withColumn("_hit", F.lit(True)), "id", "left").where(~F.coalesce(F.col("_hit") & scope, F.lit(False))).select(*t.columns)
    return without(index), without(book)
