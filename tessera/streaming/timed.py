"""State with timers: what is idle leaves the state by itself, as the watermark passes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed_session(spark: SparkSession) -> SparkSession:
    """A session beside the given one whose streams keep state in RocksDB, which timers need; its state is on disk and not in the executors' heaps."""
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


#: Slices of the runs by a hash; a slice's open runs are one value of the state, so that its rows are added up as frames and not run by run.
SLICES = 512
COUNTERS = ("n_events", "llm_calls", "tool_calls", "tokens_used", "first_ms", "last_ms")
HOW = dict(zip(COUNTERS, ("sum", "sum", "sum", "sum", "min", "max")))


class RunCounters(StatefulProcessor):
    """Counters of the runs of a slice, each until it has been idle for `idle_ms`; then they are given out and the run is forgotten. One timer stands for the run that is due next."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "due long, run_id array<string>, " + ", ".join(f"{c} array<long>" for c in COUNTERS))

    def _held(self) -> tuple[int | None, pd.DataFrame | None]:
        if not self.open.exists():
            return None, None
        due, *columns = self.open.get()
        return due, pd.DataFrame(dict(zip(("run_id", *COUNTERS), columns)))

    def _hold(self, runs: pd.DataFrame) -> int | None:
        """Keeps these runs as the open ones; gives the time at which the first of them is due."""
        if runs.empty:
            self.open.clear()
            return None
        due = int(runs["last_ms"].min()) + self.idle_ms
        self.open.update((due, *(runs[c].tolist() for c in ("run_id", *COUNTERS))))
        return due

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, held = self._held()
        sums = lambda f: f.groupby("run_id", as_index=False, sort=False).agg(HOW)
        parts = [sums(f[["run_id", *COUNTERS]]) for f in rows]
        due = self._hold(sums(pd.concat(parts if held is None else [held, *parts])))
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, runs = self._held()
        closed = runs["last_ms"] + self.idle_ms <= timerValues.getCurrentWatermarkInMs()
        due = self._hold(runs[~closed])
        if due is not None:
            self.handle.registerTimer(due)
        yield runs[closed]

    def close(self) -> None:
        pass


def closed_runs(events: DataFrame, *, idle_ms: int, late: str, slices: int = SLICES) -> DataFrame:
    """run_id, n_events, llm_calls, tool_calls, tokens_used, first_ms, last_ms of each run, once the watermark is `idle_ms` past its last event.

    `events` is a stream of a `timed_session`: run_id, type, tokens, ts. Events without run or time are left out, those behind the watermark (`late` behind the latest) are dropped and counted by
    Spark. A run that goes on after it was closed is given out again, with its new events only. State: six numbers for each run that is open, in `slices` values. Output mode: append.
    """
    one = lambda kind: F.coalesce(F.col("type") == kind, F.lit(False)).cast("long")
    ms = F.unix_millis("ts")
    counters = (F.lit(1).cast("long"), one("llm"), one("tool"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)), ms, ms)
    kept = events.where("run_id IS NOT NULL AND ts IS NOT NULL").select(F.pmod(F.xxhash64("run_id"), F.lit(slices)).cast("int").alias("slice"), "run_id", "ts", *(c.alias(n) for n, c in zip(COUNTERS, counters)))
    schema = "run_id string, " + ", ".join(f"{c} long" for c in COUNTERS)
    return kept.withWatermark("ts", late).groupBy("slice").transformWithStateInPandas(RunCounters(idle_ms), schema, "Append", "eventtime")
