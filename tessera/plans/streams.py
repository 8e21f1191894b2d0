"""Queries: streams that get their events in three parts, out of order, and go on from their checkpoint after each.

A part is a third of the time; every tenth event comes with the part after its own, so it is in time or behind the watermark, which is two days behind the latest event so far. What is dropped and
what closes when follows from the watermark before and after each part, and so does the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.scope import scoped
from tessera.plans import adapters as ad
from tessera.plans.documents import _workspace
from tessera.plans.registry import Registry
from tessera.sources.versioned import VersionedStore
from tessera.streaming import deltas, feeds, timed

registry = Registry()
query = registry.query
QUERIES, SQL = registry.queries, registry.sql

PARTS, DELAY_US, HOUR_US = 3, 2 * 86_400_000_000, 3_600_000_000

_DEALT = f"""bounds AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
dealt AS (SELECT *, least({PARTS - 1}, (t - lo) * {PARTS} // (hi - lo + 1) + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END) AS part FROM (SELECT event_id, user_id, event_type, props, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL), bounds),
marks AS (SELECT k, (SELECT max(t) // 1000 * 1000 - {DELAY_US} FROM dealt WHERE part < k) AS mark FROM (SELECT unnest(range({PARTS + 1})) AS k))"""


def _steps(in_time: str, ends: str, group: str, step: str = "0") -> str:
    """SQL of a stateful stream: the rows left open by the part before and those of this part that are in time, a user's in groups, and when each group ends."""
    out, columns = [], "user_id, event_type, props, t"
    for k in range(PARTS):
        mark = f"(SELECT mark FROM marks WHERE k = {k})"
        rows = f"SELECT {columns} FROM dealt WHERE part = {k} AND coalesce({in_time} > {mark}, true)"
        if k:
            rows += f" UNION ALL SELECT {columns} FROM s{k - 1} WHERE NOT coalesce(ends <= {mark}, false)"
        out.append(f"g{k} AS (SELECT *, {group} AS g FROM (SELECT *, {step} AS step FROM ({rows}))), s{k} AS (SELECT *, {ends} AS ends FROM g{k})")
    return ", ".join(out)


def _closed(columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns} FROM s{k} WHERE ends <= (SELECT mark FROM marks WHERE k = {k + 1}) GROUP BY user_id, g, ends" for k in range(PARTS))


def _in_parts(spark: SparkSession, d: str, run: Callable[[DataFrame, str], object]) -> str:
    """Deals the events out and has `run` take a stream of them after each part; gives the folder it works in."""
    events = ad.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL")
    t = F.unix_micros("ts")
    lo, hi = events.agg(F.min(t), F.max(t)).first()
    part = F.least(F.lit(PARTS - 1), F.floor((t - F.lit(lo)) * PARTS / F.lit((hi or 0) - (lo or 0) + 1)) + F.when(F.col("event_id") % 10 == 3, 1).otherwise(0))
    at = _workspace(spark)
    for k in range(PARTS):
        events.where(part == k).write.mode("append").parquet(f"{at}/in")
        run(feeds.file_feed(spark, f"{at}/in", events.schema), at)
    return at


def _logged(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    schemas = []

    def run(events: DataFrame, at: str) -> None:
        out = make(events)
        schemas.append(out.schema)
        feeds.append_log(out, f"{at}/out", f"{at}/checkpoint").awaitTermination()

    at = _in_parts(spark, d, run)
    return spark.read.schema(schemas[-1]).parquet(f"{at}/out")


@query(f"""WITH {_DEALT} SELECT start_us, event_type, count(*) AS n_events FROM (
  SELECT event_type, part, (t // {8 * HOUR_US} - j) * {8 * HOUR_US} AS start_us FROM dealt, (SELECT unnest([0, 1, 2]) AS j)) JOIN marks ON k = part
  WHERE coalesce(start_us + {24 * HOUR_US} > mark, true) AND start_us + {24 * HOUR_US} <= (SELECT mark FROM marks WHERE k = {PARTS}) GROUP BY ALL""")
def stream_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a day every eight hours, from late events too as far as their windows are open."""
    out = _logged(spark, d, lambda events: feeds.windowed_counts(events, "ts", "24 hours", "2 days", "event_type", slide="8 hours"))
    return out.select(F.unix_micros("window_start").alias("start_us"), "event_type", "n_events")


_END = "max(t) OVER (PARTITION BY user_id, g)"
_PAUSE = f"CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < {6 * HOUR_US} THEN 0 ELSE 1 END"


@query(f"WITH {_DEALT}, {_steps(f't + {6 * HOUR_US}', f'{_END} + {6 * HOUR_US}', 'sum(step) OVER (PARTITION BY user_id ORDER BY t)', _PAUSE)} {_closed('user_id, min(t) AS start_us, ends AS end_us, count(*) AS n_events')}")
def stream_user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users with pauses under six hours; a late event can still join two open ones."""
    out = _logged(spark, d, lambda events: feeds.sessions(events, "ts", "6 hours", "2 days", "user_id"))
    return out.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n_events")


_COUNTERS = """CAST(user_id AS VARCHAR) || '-' || CAST(g AS VARCHAR) AS run_id, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'signup') AS llm_calls, count(*) FILTER (WHERE event_type = 'view') AS tool_calls,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens_used, min(t) // 1000 AS first_ms, max(t) // 1000 AS last_ms"""


@query(f"WITH {_DEALT}, {_steps('t', f'{_END} // 1000 * 1000 + {24 * HOUR_US}', f't // {24 * HOUR_US}')} {_closed(_COUNTERS)}")
def stream_closed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each run, here a user's day, given out a day after its last event and then forgotten by the stream."""
    kind = F.when(F.col("event_type") == "signup", "llm").when(F.col("event_type") == "view", "tool").otherwise("custom")
    run = F.concat_ws("-", "user_id", F.floor(F.unix_micros("ts") / (24 * HOUR_US)))
    columns = (run.alias("run_id"), kind.alias("type"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), "ts")
    return _logged(timed.timed_session(spark), d, lambda events: timed.closed_runs(events.select(*columns), idle_ms=24 * 3_600_000, late="2 days"))


@query("SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, event_type AS content FROM events WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def outbox_deltas(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each user, by batches of changes that each write their own rows only; an error deletes the user."""

    def run(events: DataFrame, at: str) -> None:
        items = events.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"), (F.col("event_type") == "error").alias("deleted"))
        deltas.apply(scoped(items), VersionedStore(spark, f"{at}/store"), "items", f"{at}/checkpoint", fan=2).awaitTermination()

    at = _in_parts(spark, d, run)
    return deltas.read(VersionedStore(spark, f"{at}/store"), "items").select("id", "seq", "content")
