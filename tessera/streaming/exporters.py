"""Trace events to several sinks at once: a sink that fails loses its own copy only, and its failures are counted."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import traces
from tessera.sources.versioned import Transaction, VersionedStore


class TraceExporter(Protocol):
    """Takes a batch of events; the batch's number tells a repetition from a new one."""

    def __call__(self, events: DataFrame, batch: int) -> None: ...


def json_lines(path: str) -> TraceExporter:
    """JSON lines, a folder for each batch: a batch that is written again replaces itself."""
    return lambda events, batch: events.write.mode("overwrite").json(f"{path}/batch={batch}")


def table(path: str) -> TraceExporter:
    """A Parquet table, a folder for each batch."""
    return lambda events, batch: events.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def span_table(path: str) -> TraceExporter:
    """Spans with start and end, as a collector of traces takes them."""
    return lambda events, batch: traces.spans(events).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def ring(store: VersionedStore, name: str, n: int = 2048) -> TraceExporter:
    """The newest n events of each run, as a version of a store."""

    def write(events: DataFrame, batch: int) -> None:
        def change(t: Transaction) -> None:
            held = t.read(name).unionByName(events).dropDuplicates(["run_id", "pos"]) if t.names(name) else events
            t.write(name, traces.newest(held, n))

        store.update(change)

    return write


class Fanout:
    """Sinks by name. failures: how many batches each has lost, and lost_events how many events."""

    def __init__(self, sinks: dict[str, TraceExporter]):
        self.sinks, self.failures, self.lost_events = sinks, Counter(), Counter()
        self.last_errors: dict[str, str] = {}

    def export(self, events: DataFrame, batch: int = 0) -> None:
        for name, sink in self.sinks.items():
            try:
                sink(events, batch)
            except Exception as e:  # whatever a sink raises is its own loss
                self.failures[name] += 1
                self.lost_events[name] += events.count()
                self.last_errors[name] = str(e)[:500]

    def counters(self, like: DataFrame) -> DataFrame:
        """exporter, failures, lost_events of every sink; `like` is any frame of the session."""
        rows = [(n, self.failures[n], self.lost_events[n]) for n in self.sinks]
        return like.sparkSession.createDataFrame(rows, "exporter string, failures long, lost_events long")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Every batch of a stream to every sink, for all that is there now."""
        return stream.writeStream.foreachBatch(self.export).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failure_counts(attempts: DataFrame) -> DataFrame:
    """exporter, failures, attempts of a log of exports (exporter, ok)."""
    return attempts.groupBy("exporter").agg(F.count_if(~F.coalesce("ok", F.lit(False))).alias("failures"), F.count("*").alias("attempts"))
