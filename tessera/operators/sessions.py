"""Session logs: scopes, pruning, compaction, reduction; checkpoints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.scope import DIMENSIONS


def scope_summary(messages: DataFrame, dimension: str) -> DataFrame:
    """value, message_count, first_at, last_at by the values of a dimension that are set."""
    return messages.where(F.col(dimension) != "").groupBy(F.col(dimension).alias("value")).agg(F.count("*").alias("message_count"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def scope_summaries(messages: DataFrame) -> DataFrame:
    """dimension, value, message_count, first_at, last_at: all dimensions in one pass."""
    one = F.explode(F.map_from_arrays(F.array(*map(F.lit, DIMENSIONS)), F.array(*DIMENSIONS))).alias("dimension", "value")
    return messages.select("created_at", one).where("value <> ''").groupBy("dimension", "value").agg(F.count("*").alias("message_count"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def loaded(messages: DataFrame, session: tuple[str, ...], scope: Column | None = None) -> DataFrame:
    """The messages of a scope (all without one), each session's together and in its order; sessions are dealt out over the tasks, so there is no global sort."""
    kept = messages if scope is None else messages.where(scope)
    return kept.repartition(*session).sortWithinPartitions(*session, "seq")


def pruned(messages: DataFrame, session: tuple[str, ...], *, before: Column | None = None, keep_last: int | None = None) -> DataFrame:
    """Messages that pruning leaves: those not before the time, and of them the newest of each session."""
    if before is None and keep_last is None:
        raise ValueError("pruning needs a time or a number")
    left = messages if before is None else messages.where(~(F.col("created_at") < before))
    if keep_last is None:
        return left
    newest = F.row_number().over(W.partitionBy(*session).orderBy(F.desc("seq")))
    return left.withColumn("_n", newest).where(F.col("_n") <= keep_last).drop("_n")


def pruned_counts(messages: DataFrame, session: tuple[str, ...], *, before: Column | None = None, keep_last: int | None = None) -> DataFrame:
    """The session and deleted: how many of its messages pruned() takes out."""
    left = pruned(messages, session, before=before, keep_last=keep_last).groupBy(*session).agg(F.count("*").alias("_left"))
    whole = messages.groupBy(*session).agg(F.count("*").alias("_all"))
    return whole.join(left, list(session), "left").select(*session, (F.col("_all") - F.coalesce("_left", F.lit(0))).alias("deleted"))


def compaction_split(messages: DataFrame, session: tuple[str, ...], *, trigger: int = 2000, keep_recent: int = 4) -> DataFrame:
    """`messages` (with tokens) with `part`: 'old' for what a summary replaces, 'recent' for what stays.

    A session is compacted if its tokens exceed the trigger and it has more messages than are kept.
    """
    w = W.partitionBy(*session)
    from_end = F.row_number().over(w.orderBy(F.desc("seq")))
    due = (F.sum("tokens").over(w) > trigger) & (F.count("*").over(w) > keep_recent)
    return messages.withColumn("part", F.when(due & (from_end > keep_recent), "old").otherwise("recent"))


def prefix_digests(messages: DataFrame, session: tuple[str, ...]) -> DataFrame:
    """`messages` with `digest`, sha256 of the session up to the message: a cached summary fits if its digest is one of them.

    A session's rows come to one task in order, which carries the hash on from row to row: the work is linear, and no row's past is held.
    """
    at = [messages.columns.index(c) for c in (*session, "role", "content")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, hashlib.sha256()
        for batch in batches:
            out = []
            for row in zip(*(batch.column(k).to_pylist() for k in at)):
                *key, role, content = row
                if key != own:
                    own, held = key, hashlib.sha256()
                else:
                    held.update(b"\x1e")
                held.update(f"{role or ''}\x1f{content or ''}".encode())
                out.append(held.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "digest"])

    ordered = messages.repartition(*session).sortWithinPartitions(*session, "seq")
    return ordered.mapInArrow(run, T.StructType([*messages.schema, T.StructField("digest", T.StringType())]))


def cached_prefix(messages: DataFrame, cached: DataFrame, session: tuple[str, ...]) -> DataFrame:
    """The session and cached_until: the last message up to which a cached summary (session, digest) covers it."""
    found = prefix_digests(messages, session).select(*session, "seq", "digest")
    return found.join(cached.select(*session, "digest").distinct(), [*session, "digest"]).groupBy(*session).agg(F.max("seq").alias("cached_until"))


def units(messages: DataFrame, session: tuple[str, ...]) -> DataFrame:
    """`messages` with `unit`: a tool result belongs to the unit of the call before it."""
    starts = F.when(F.col("role") == "tool", 0).otherwise(1)
    return messages.withColumn("unit", F.sum(starts).over(W.partitionBy(*session).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))


def reduced(messages: DataFrame, session: tuple[str, ...], *, budget: int, head: int = 1, keep_units: int = 2) -> DataFrame:
    """`messages` (with tokens) with `part`: 'head', 'middle' (to be summed up) or 'recent'; within the budget all is recent."""
    w = W.partitionBy(*session)
    numbered = units(messages, session).withColumn("_at", F.row_number().over(w.orderBy("seq")))
    marked = numbered.withColumn("_last", F.max("unit").over(w)).withColumn("_all", F.sum("tokens").over(w))
    recent = F.col("unit") > F.col("_last") - keep_units
    part = F.when(F.col("_all") <= budget, "recent").when(F.col("_at") <= head, "head").when(recent, "recent").otherwise("middle")
    return marked.withColumn("part", part).drop("_at", "_last", "_all")


def too_large(parts: DataFrame, session: tuple[str, ...], budget: int) -> DataFrame:
    """session, mandatory: the sessions of `reduced` whose head and recent messages alone exceed the budget; a caller must not go on with them."""
    kept = parts.where("part <> 'middle'").groupBy(*session).agg(F.sum("tokens").alias("mandatory"))
    return kept.where(F.col("mandatory") > budget)


def fitted_summary(summary: Column, room: Column) -> Column:
    """A summary cut to the room that the other parts leave, four characters a token; null where there is none."""
    return F.when(room > 0, F.left(summary, (room * 4).cast("int")))


def compacted(messages: DataFrame, summaries: DataFrame, session: tuple[str, ...], *, most: int = 1000, trigger: int = 2000, keep_recent: int = 4) -> DataFrame:
    """The history to send: a summary (session, summary) in place of the old messages, cut to `most` tokens, then the recent ones. seq -1: the summary.

    A session whose summary is missing keeps all its messages.
    """
    parts = compaction_split(messages, session, trigger=trigger, keep_recent=keep_recent)
    due = parts.where("part = 'old'").select(*session).distinct().join(summaries.where("summary IS NOT NULL"), list(session))
    left = parts.where("part = 'old'").join(due.select(*session), list(session), "left_anti").unionByName(parts.where("part = 'recent'"))
    head = due.select(*session, F.lit(-1).cast(messages.schema["seq"].dataType).alias("seq"), F.lit("system").alias("role"), fitted_summary(F.col("summary"), F.lit(most)).alias("content"))
    return head.unionByName(left.select(*session, "seq", "role", "content"))


def recorded(rows: DataFrame, *, naive_zone: str = "UTC") -> DataFrame:
    """Messages as the log keeps them: content as text, the parts of a multimodal one as JSON with its flag, the time as UTC.

    `rows` has content or parts (array of structs), and created_at, a timestamp or a text of one; a time without a zone counts as of `naive_zone`.
    """
    kind = rows.schema["created_at"].dataType.simpleString()
    at = F.col("created_at")
    if kind == "timestamp_ntz":
        at = F.to_utc_timestamp(at.cast("timestamp"), naive_zone)
    if "parts" in rows.columns:
        flag = F.col("parts").isNotNull()
        rows = rows.withColumn("content", F.when(flag, F.to_json("parts")).otherwise(F.col("content"))).withColumn("multimodal", flag).drop("parts")
    else:
        rows = rows.withColumn("multimodal", F.lit(False))
    return rows.withColumn("created_at", at.cast("timestamp"))


def cleared(messages: DataFrame, index: DataFrame, scope: Column) -> tuple[DataFrame, DataFrame]:
    """The message log and its index without a scope's rows; a store commits both as one version."""
    keep = ~F.coalesce(scope, F.lit(False))
    return messages.where(keep), index.where(keep)


def injected(calls: DataFrame, decisions: DataFrame | bool | None) -> DataFrame:
    """Pending `calls` with approved: a bool decides all of them, a table (call_id, approved) those that it names, None none."""
    if isinstance(decisions, DataFrame):
        return calls.drop("approved").join(decisions.select("call_id", "approved"), "call_id", "left")
    return calls.withColumn("approved", F.lit(decisions).cast("boolean"))


def child_decisions(decided: DataFrame, pending_ids: DataFrame) -> DataFrame:
    """call_id, approved: the decisions that a child run may see, those of its own pending calls that are decided."""
    return decided.where("approved IS NOT NULL").join(pending_ids.select("call_id"), "call_id", "left_semi").select("call_id", "approved")


def named_results(results: DataFrame, calls: DataFrame) -> DataFrame:
    """Tool results with the name of the call that they answer; null where no call has their id."""
    return results.join(calls.select("call_id", F.col("name").alias("tool_name")), "call_id", "left")


def discovered(found: DataFrame, present: DataFrame, allowed: Column | None = None) -> DataFrame:
    """session, place (from 0), name: the tools that a session has found (session, at, name), each where it was first seen, without those already present (session, name)."""
    first = (found if allowed is None else found.where(allowed)).groupBy("session", "name").agg(F.min("at").alias("at"))
    new = first.join(present.select("session", "name"), ["session", "name"], "left_anti")
    return new.select("session", (F.row_number().over(W.partitionBy("session").orderBy("at", "name")) - 1).alias("place"), "name")


def latest_answer(steps: DataFrame, run: str, order: str, kinds: tuple[str, ...] = ("draft", "refine")) -> DataFrame:
    """run, answer: the text of the last step of these kinds."""
    fine = F.col("type").isin(*kinds)
    return steps.groupBy(run).agg(F.max_by("text", F.when(fine, F.col(order))).alias("answer"))


def trajectory(steps: DataFrame, run: str, order: str) -> DataFrame:
    """run, trajectory: the steps as blocks of a label and a text."""
    one = F.concat(F.col("label"), F.lit("\n"), F.coalesce("text", F.lit("")))
    held = steps.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(order, one.alias("t")))).alias("s"))
    return held.select(run, F.array_join(F.transform("s", lambda s: s["t"]), "\n\n").alias("trajectory"))


def running_counters(events: DataFrame, run: str, order: str) -> DataFrame:
    """`events` with llm_calls, tool_calls and tokens_used so far in the run."""
    w = W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumns({
        "llm_calls": F.sum(F.when(F.col("type") == "llm", 1).otherwise(0)).over(w),
        "tool_calls": F.sum(F.when(F.col("type") == "tool", 1).otherwise(0)).over(w),
        "tokens_used": F.sum(F.coalesce("tokens", F.lit(0))).over(w),
    })


def over_limits(counted: DataFrame, *, llm_calls: int | None = None, tool_calls: int | None = None, tokens: int | None = None) -> DataFrame:
    """The steps at which a limit stops the run: a call beyond its number, tokens beyond their sum."""
    stop = F.lit(False)
    for column, most in (("llm_calls", llm_calls), ("tool_calls", tool_calls), ("tokens_used", tokens)):
        if most is not None:
            stop = stop | (F.col(column) > most)
    return counted.where(stop)


def parallel_run(calls: DataFrame, turn: str, order: str) -> DataFrame:
    """turn, n_parallel: how many calls from the first on may run at once; fewer than two run one by one (0)."""
    broken = F.sum(F.when(F.col("eligible"), 0).otherwise(1)).over(W.partitionBy(turn).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    n = F.count_if((F.col("_b") == 0) & F.col("eligible"))
    return calls.withColumn("_b", broken).groupBy(turn).agg(F.when(n >= 2, n).otherwise(0).alias("n_parallel"))


def unique_call_ids(calls: DataFrame, turn: str, order: str) -> DataFrame:
    """`calls` with call_id made unique: one that is blank or stands before in the session gets #t{turn}-{i}."""
    nth = F.row_number().over(W.partitionBy("session", "call_id").orderBy(turn, order))
    i = F.row_number().over(W.partitionBy("session", turn).orderBy(order)) - 1
    new = F.concat(F.col("call_id"), F.lit("#t"), F.col(turn).cast("string"), F.lit("-"), F.col("_i").cast("string"))
    return calls.withColumn("_n", nth).withColumn("_i", i).withColumn("unique_id", F.when((F.col("_n") > 1) | (F.trim("call_id") == ""), new).otherwise(F.col("call_id"))).drop("_n", "_i")


def pending(calls: DataFrame, decisions: DataFrame) -> DataFrame:
    """Calls that need approval and have no decision."""
    return calls.where("needs_approval").join(decisions.select("call_id"), "call_id", "left_anti")


def assembled_deltas(chunks: DataFrame) -> DataFrame:
    """stream, call_index, id, name, arguments: the fragments of a stream put together."""
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", F.coalesce(c, F.lit("")).alias("t")))), lambda s: s["t"]), "")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("chunk_no")))
    return chunks.groupBy("stream", "call_index").agg(first("id").alias("id"), first("name").alias("name"), ordered("arguments").alias("arguments"))
