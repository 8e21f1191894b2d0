"""Long-term memory: blended scores, forgetting, supersession, consolidation, smart writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vectors as vx
from tessera.operators.scope import DIMENSIONS
from tessera.operators.search import ranked
from tessera.operators.tables import delete_exact, key_of
from tessera.sources.shared import materialize

#: relevance, recency, importance
WEIGHTS = (0.6, 0.2, 0.2)
HALF_LIFE_HOURS = 24.0 * 30


def blended(hits: DataFrame, memories: DataFrame, now: Column, *, top_k: int = 5, weights: tuple[float, float, float] = WEIGHTS, half_life_hours: float = HALF_LIFE_HOURS, by_access: bool = False) -> DataFrame:
    """query_id, key, relevance, recency, importance, score, rank of the valid memories among hits (query_id, key, rank, score).

    The key is the id with the scope columns that both tables have.

    Relevance is min-max of the hit's score over those of its query that are left. The age counts from the update (or creation), or from
    the last access if by_access. Ties keep the hits' order.
    """
    key = key_of(hits, memories)
    valid = memories.where("invalid_at IS NULL").select(*key, "importance", "created_at", "updated_at", "last_accessed_at")
    left = hits.select("query_id", *key, F.col("rank").alias("hit_rank"), F.col("score").alias("hit_score")).join(valid, key)
    w = W.partitionBy("query_id")
    anchor = F.coalesce(*(F.col(c) for c in (("last_accessed_at",) if by_access else ()) + ("updated_at", "created_at")))
    parts = left.withColumns({
        "relevance": vx.min_max(F.col("hit_score"), F.min("hit_score").over(w), F.max("hit_score").over(w)),
        "recency": vx.recency(anchor, now, half_life_hours),
    })
    score = weights[0] * F.col("relevance") + weights[1] * F.col("recency") + weights[2] * F.col("importance")
    return ranked(parts.withColumn("score", score), top_k, vx.rounded(F.col("score"), 9).desc(), F.col("hit_rank")).select("query_id", *key, "relevance", "recency", "importance", "score", "rank")


def dangling(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """Hits whose memory is gone or no longer valid."""
    key = key_of(hits, memories)
    return hits.join(memories.where("invalid_at IS NULL").select(*key), key, "left_anti")


def forget_unimportant(memories: DataFrame, least: float) -> DataFrame:
    """Keys to forget: less important than `least`."""
    return memories.where(F.col("importance") < least).select(*key_of(memories))


def forget_older(memories: DataFrame, now: Column, days: float) -> DataFrame:
    """Keys to forget: created strictly before `days` ago."""
    return memories.where(F.unix_micros("created_at") < F.unix_micros(now.cast("timestamp")) - F.lit(int(days * 86_400_000_000))).select(*key_of(memories))


def forget_beyond(memories: DataFrame, most: int, owner: str) -> DataFrame:
    """Keys to forget: all but the `most` of an owner that rank highest by importance and then youth."""
    place = F.row_number().over(W.partitionBy(owner).orderBy(F.desc("importance"), F.desc("created_at"), F.desc("id")))
    return memories.withColumn("_n", place).where(F.col("_n") > most).select(*key_of(memories))


def invalidated(memories: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """Memories with the keys of `pairs` (key, by) marked as superseded; the rows stay. Scope columns that both tables have must agree."""
    key = key_of(memories, pairs)
    marked = memories.join(pairs.groupBy(*key).agg(F.min("by").alias("by")), key, "left")
    hit = F.col("by").isNotNull()
    return marked.withColumn("invalid_at", F.when(hit, now).otherwise(F.col("invalid_at"))).withColumn("superseded_by", F.when(hit, F.col("by")).otherwise(F.col("superseded_by"))).select(*memories.columns)


def superseded_chain(memories: DataFrame) -> DataFrame:
    """key, final, steps: where following superseded_by within the scope ends; final and steps are null where it goes in a circle.

    Every round joins each memory to where it has come so far, so a chain of n links takes log2(n) rounds; a row that is not done after as
    many as the table could need goes in a circle. The end is a memory that nothing supersedes, or an id that is not there.
    """
    key = key_of(memories)
    scope = key[1:]
    none = F.col("superseded_by").isNull()
    link = memories.select(*key, F.coalesce("superseded_by", "id").alias("final"), F.when(none, 0).otherwise(1).cast("long").alias("steps"), none.alias("done"))
    link = materialize(link, "memory-chain")
    rounds = max(1, link.count()).bit_length() + 1
    for _ in range(rounds):
        if not link.where("NOT done").limit(1).count():
            break
        onward = link.select(*scope, F.col("id").alias("final"), F.col("final").alias("further"), F.col("steps").alias("more"), F.col("done").alias("there"))
        moved = link.where("NOT done").join(onward, ["final", *scope], "left")
        moved = moved.select(*key, F.coalesce("further", "final").alias("final"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("there", F.lit(True)).alias("done"))
        link = materialize(link.where("done").unionByName(moved), "memory-chain")
    return link.select(*key, F.when(F.col("done"), F.col("final")).alias("final"), F.when(F.col("done"), F.col("steps")).alias("steps"))


def consolidated_attributes(memories: DataFrame, group: str) -> DataFrame:
    """group, importance (mean), type (most frequent, ties to the smaller), n."""
    kinds = memories.groupBy(group, "type").agg(F.count("*").alias("n"), F.sum("importance").alias("s"))
    best = F.min_by("type", F.struct((-F.col("n")).alias("o"), F.col("type").alias("t")))
    return kinds.groupBy(group).agg((F.sum("s") / F.sum("n")).alias("importance"), best.alias("type"), F.sum("n").alias("n"))


def consolidate(memories: DataFrame, merged: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Memories with `merged` rows added and their `sources` (id, by, content, updated_at) superseded.

    A source that has changed since it was read, or is no longer valid, makes its whole merge void.
    """
    key = key_of(memories, sources)
    current = memories.select(*key, F.col("content").alias("c"), F.col("updated_at").alias("u"), F.col("invalid_at").alias("i"))
    seen = sources.join(current, key, "left")
    same = F.col("c").eqNullSafe(F.col("content")) & F.col("u").eqNullSafe(F.col("updated_at")) & F.col("i").isNull()
    merge = ["by", *key[1:]]
    void = seen.where(~F.coalesce(same, F.lit(False))).select(*merge).distinct()
    fine = sources.join(void, merge, "left_anti")
    added = merged.join(void.withColumnRenamed("by", "id"), ["id", *key[1:]], "left_anti")
    return invalidated(memories, fine, now).unionByName(added.select(*memories.columns))


def smart_write(memories: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Memories after decisions (op, id, target, content, importance): ADD and UPDATE bring a new row, UPDATE and DELETE supersede the target, NOOP does nothing.

    Scope columns of the decisions hold for the new row and for the target."""
    new = decisions.where(F.col("op").isin("ADD", "UPDATE"))
    known = {c: F.col(c) for c in ("id", "content", "importance", *DIMENSIONS) if c in decisions.columns} | {"created_at": now, "updated_at": now}
    added = new.select(*((known[c] if c in known else F.lit(None).cast(memories.schema[c].dataType)).cast(memories.schema[c].dataType).alias(c) for c in memories.columns))
    scope = key_of(memories, decisions)[1:]
    gone = decisions.where(F.col("op").isin("UPDATE", "DELETE")).select(F.col("target").alias("id"), *scope, F.coalesce("id", F.lit("")).alias("by"))
    return invalidated(memories, gone, now).unionByName(added)


def parsed_decision(op: Column, index: Column, n: Column) -> tuple[Column, Column]:
    """The operation and the index (from 1), or ADD without index where either makes no sense."""
    number = F.when(index.rlike("^[0-9]+$"), index.try_cast("int"))
    fine = op.isin("UPDATE", "DELETE") & number.between(1, n)
    return F.when(op == "NOOP", F.lit("NOOP")).when(F.coalesce(fine, F.lit(False)), op).otherwise(F.lit("ADD")), F.when(fine, number)


def statistics(memories: DataFrame) -> DataFrame:
    """type (null for the total) and n."""
    return memories.rollup("type").agg(F.count("*").alias("n"))


def delete_many(memories: DataFrame, book: DataFrame, ids: DataFrame, scope: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The memories and the index's book without the ids within a scope, and the keys that were there: those of either table.

    A key that only the book still holds, as its memory went before, is taken out too.
    """
    wanted = ids.select("id").distinct()
    held = [t.where(scope).join(wanted, "id", "left_semi").select(*key_of(t)) for t in (memories, book)]
    keys = materialize(held[0].unionByName(held[1]).distinct(), "memory-deleted")
    return delete_exact(memories, keys), delete_exact(book, keys), keys


def covered_ids(requested: DataFrame, memories: DataFrame, book: DataFrame) -> DataFrame:
    """The requested ids that the memories hold, or the book as indexed or pending."""
    known = memories.select("id").unionByName(book.where("content_hash IS NOT NULL OR pending_since IS NOT NULL").select("id"))
    return requested.select("id").intersect(known)


def summary_candidates(memories: DataFrame, *, top_k: int = 5, owner: str = "query_id", hits: DataFrame | None = None) -> DataFrame:
    """The valid memories to sum up: those of the hits (query_id, key, rank), or else the newest of each owner."""
    valid = memories.where("invalid_at IS NULL")
    if hits is None:
        key = key_of(memories)
        newest = F.row_number().over(W.partitionBy(owner).orderBy(F.desc("created_at"), *key))
        return valid.withColumn("rank", newest).where(F.col("rank") <= top_k)
    key = key_of(memories, hits)
    return hits.where(F.col("rank") <= top_k).select("query_id", *key, "rank").join(valid.drop("query_id", "rank"), key)
