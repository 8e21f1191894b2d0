"""Execution traces: runs, steps, findings, summaries, elision.

Events have run_id (null for events outside a run), pos (file order), type and the fields that their type has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import one_line
from tessera.sources.shared import materialize

#: Finish reasons of a cut answer, and the types of event that are known.
CUT_REASONS = ("length", "max_tokens", "MAX_TOKENS")
TYPES = ("run_start", "run_end", "llm", "tool", "retrieval", "memory", "compaction", "rag", "index_sync", "guardrail", "approval", "error", "stream")


def steps(events: DataFrame) -> DataFrame:
    """`events` with step, the ordinal within the run by pos, from 0."""
    return events.withColumn("step", F.row_number().over(W.partitionBy("run_id").orderBy("pos")) - 1)


def run_order(events: DataFrame) -> DataFrame:
    """run_id, first_pos, n_events, place: runs numbered from 0 in the order in which they begin, events without run last.

    Runs are dealt out by ranges of their first position and numbered within each; the ranges' sizes, one number for each task, give the offsets.
    """
    runs = events.groupBy("run_id").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_events"))
    dealt = runs.where("run_id IS NOT NULL").repartitionByRange("first_pos", "run_id").withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "trace-runs")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each task
    within = F.row_number().over(W.partitionBy("_range").orderBy("first_pos", "run_id")) - 1
    placed = dealt.withColumn("_within", within).join(F.broadcast(before), "_range").select("run_id", "first_pos", "n_events", (F.col("_before") + F.col("_within")).alias("place"))
    total = dealt.agg(F.count("*").alias("_total"))
    outside = runs.where("run_id IS NULL").crossJoin(F.broadcast(total)).select("run_id", "first_pos", "n_events", F.col("_total").alias("place"))  # one row at most on each side
    return placed.unionByName(outside)


def findings(numbered: DataFrame) -> DataFrame:
    """run_id, step, code, severity: what the rules find in the steps. Fields that a table lacks count as null."""

    def has(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in numbered.columns else F.lit(None).cast(kind)

    status, kind = has("status", "string"), F.col("type")
    rules = (
        ("tool_error", "error", (kind == "tool") & (status == "error")),
        ("tool_blocked", "warning", (kind == "tool") & (status == "blocked")),
        ("tool_partial", "warning", (kind == "tool") & (status == "partial")),
        ("llm_truncated", "warning", (kind == "llm") & has("finish_reason", "string").isin(*CUT_REASONS)),
        ("empty_retrieval", "warning", (kind == "retrieval") & (has("hits", "long") == 0)),
        ("compaction_degraded", "warning", (kind == "compaction") & has("degraded", "boolean")),
        ("rag_degraded", "warning", (kind == "rag") & has("degraded", "boolean")),
        ("index_sync_pending", "warning", (kind == "index_sync") & (has("pending", "long") > 0)),
        ("index_not_converged", "error", (kind == "index_sync") & ~has("converged", "boolean")),
        ("unknown_event", "info", ~kind.isin(*TYPES)),
    )
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, c in rules)), lambda x: x.isNotNull())
    return numbered.select("run_id", "step", F.explode(found).alias("f")).select("run_id", "step", "f.code", "f.severity")


def run_stats(events: DataFrame, found: DataFrame) -> DataFrame:
    """run_id, steps, llm_calls, tool_calls, tokens, latency_ms, errors, warnings."""
    base = events.groupBy("run_id").agg(
        F.count("*").alias("steps"),
        F.count_if(F.col("type") == "llm").alias("llm_calls"),
        F.count_if(F.col("type") == "tool").alias("tool_calls"),
        F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"),
        F.sum(F.coalesce("latency_ms", F.lit(0.0))).alias("latency_ms"),
    )
    issues = found.groupBy(F.col("run_id").alias("r")).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return base.join(issues, base["run_id"].eqNullSafe(issues["r"]), "left").select(*base.columns, zero("errors"), zero("warnings"))


def summary(events: DataFrame) -> DataFrame:
    """type (null for all), events, tokens, latency_ms."""
    return events.rollup("type").agg(F.count("*").alias("events"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.sum(F.coalesce("latency_ms", F.lit(0.0))).alias("latency_ms"))


def elided(numbered: DataFrame, found: DataFrame, *, head: int = 12, tail: int = 8) -> DataFrame:
    """run_id, step (null for a gap), gap (steps left out there), at: the first and last steps of a run and those with findings."""
    w = W.partitionBy("run_id")
    flagged = found.select(F.col("run_id").alias("r"), F.col("step").alias("s")).distinct().withColumn("flag", F.lit(True))
    rows = numbered.select("run_id", "step").withColumn("_end", F.max("step").over(w))
    rows = rows.join(flagged, rows["run_id"].eqNullSafe(flagged["r"]) & (rows["step"] == flagged["s"]), "left")
    shown = (F.col("step") < head) | (F.col("step") > F.col("_end") - tail) | F.coalesce("flag", F.lit(False))
    marked = rows.withColumn("shown", shown)
    group = F.sum(F.when(F.col("shown"), 1).otherwise(0)).over(w.orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    marked = marked.withColumn("_g", group)
    gaps = marked.where("NOT shown").groupBy("run_id", "_g").agg(F.count("*").alias("gap"), F.min("step").alias("at"))
    return marked.where("shown").select("run_id", "step", F.lit(0).cast("long").alias("gap"), F.col("step").alias("at")).unionByName(gaps.select("run_id", F.lit(None).cast("int").alias("step"), "gap", "at"))


def last_run(events: DataFrame) -> DataFrame:
    """The events of the run that began last."""
    last = events.where("run_id IS NOT NULL").groupBy("run_id").agg(F.min("pos").alias("p")).agg(F.max_by("run_id", F.struct("p", "run_id")).alias("run_id"))
    return events.join(F.broadcast(last), "run_id")


def picked_run(events: DataFrame, run_id: str | None = None) -> DataFrame:
    """The events of a run: the one of that id, or the one that began last; a run that is not there raises."""
    if run_id is None:
        return last_run(events)
    own = events.where(F.col("run_id") == run_id)
    if not own.limit(1).count():
        raise LookupError(f"no run {run_id}")
    return own


def event_line(events: DataFrame) -> Column:
    """What happened in a step, by its type; fields that a table lacks are left out."""

    def text(name: str, before: str = "", after: str = "") -> Column:
        if name not in events.columns:
            return F.lit(None).cast("string")
        value = F.col(name).cast("string")
        return F.when(value.isNotNull(), F.concat(F.lit(before), value, F.lit(after)))

    by_type = {
        "llm": (text("tokens", "", " tokens"), text("finish_reason", "finish=")),
        "tool": (text("name"), text("status", "status=")),
        "retrieval": (text("hits", "", " hits"),),
        "index_sync": (text("pending", "pending="), text("converged", "converged=")),
        "compaction": (text("degraded", "degraded="),),
        "rag": (text("degraded", "degraded="),),
        "guardrail": (text("name"), text("status", "status=")),
        "error": (text("message"),),
    }
    out = F.lit("")
    for kind, parts in by_type.items():
        out = F.when(F.col("type") == kind, F.concat_ws(" ", *parts)).otherwise(out)
    return one_line(F.concat_ws(" ", F.concat(F.lit("["), F.col("type"), F.lit("]")), F.nullif(out, F.lit(""))))


def rendered(events: DataFrame, *, head: int = 12, tail: int = 8, most_chars: int = 20_000) -> DataFrame:
    """run_id, timeline: a line of totals, then the run's steps, those in the middle without findings as a count, cut hard at `most_chars`."""
    numbered = steps(events)
    found = findings(numbered)
    stats = run_stats(events, found)
    total = F.concat(F.col("steps").cast("string"), F.lit(" steps, "), F.col("llm_calls").cast("string"), F.lit(" llm, "), F.col("tool_calls").cast("string"), F.lit(" tool, "), F.col("tokens").cast("string"), F.lit(" tokens, "), F.col("errors").cast("string"), F.lit(" errors, "), F.col("warnings").cast("string"), F.lit(" warnings"))
    top = stats.select(F.col("run_id").alias("_run"), total.alias("_total"))
    body = timeline(numbered, elided(numbered, found, head=head, tail=tail), event_line(numbered))
    met = body.join(top, body["run_id"].eqNullSafe(top["_run"]))
    return met.select("run_id", F.left(F.concat("_total", F.lit("\n"), "timeline"), F.lit(most_chars)).alias("timeline"))


def newest(events: DataFrame, n: int = 2048, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """What a ring buffer of n events holds of each run."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("pos")))
    return events.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def spans(events: DataFrame) -> DataFrame:
    """`events` (with at, the time of their end, and latency_ms) with span_start and span_end."""
    start = F.timestamp_micros(F.unix_micros("at") - F.round(F.coalesce("latency_ms", F.lit(0.0)) * 1000).cast("long"))
    return events.withColumn("span_start", start).withColumn("span_end", F.col("at"))


def line(kind: Column, name: Column, status: Column, text: Column) -> Column:
    """A step on one line."""
    return F.concat_ws(" ", F.concat(F.lit("["), kind, F.lit("]")), name, F.when(status != "ok", F.concat(F.lit("("), status, F.lit(")"))), one_line(text))


def needs_doctor(stats: DataFrame, *, warnings_too: bool = False) -> DataFrame:
    hit = F.col("errors") + F.col("warnings") > 0 if warnings_too else F.col("errors") > 0
    return stats.withColumn("needs_doctor", hit)


def timeline(numbered: DataFrame, shown: DataFrame, text: Column) -> DataFrame:
    """run_id, timeline: the shown steps of a run line by line, gaps as a count."""
    rows = shown.join(numbered.select(F.col("run_id").alias("r"), F.col("step").alias("s"), text.alias("t")), shown["run_id"].eqNullSafe(F.col("r")) & (F.col("step") == F.col("s")), "left")
    one = F.when(F.col("step").isNull(), F.concat(F.lit("… "), F.col("gap").cast("string"), F.lit(" steps …"))).otherwise(F.concat(F.col("step").cast("string"), F.lit(" "), F.col("t")))
    return rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("at", one.alias("l")))).alias("x")).select("run_id", F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias("timeline"))
