"""What streams report of their batches, gathered by a listener: rows read, rows dropped behind the watermark, state, observed columns, failures."""

from __future__ import annotations

import json
import threading
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "query string, run string, batch long, input_rows long, dropped_rows long, state_rows long, watermark string, observed string, error string"


class StreamMetrics(StreamingQueryListener):
    """One row for each batch of each query of the session, by `with StreamMetrics(spark) as metrics`.

    Reports are numbers, not data; at most `most` that have not been saved are held, and `lost` counts those beyond it. Events arrive behind the batches: `wait` blocks until a query's end has been seen.
    `observed` is a JSON object of what `observe()` counted on the stream's frames, by name. A query that fails adds a row without batch that has the error.
    """

    def __init__(self, spark: SparkSession, most: int = 100_000):
        self.spark, self.most, self.lost = spark, most, 0
        self._rows: OrderedDict[tuple[str, int | None], tuple] = OrderedDict()
        self._names: dict[str, str] = {}
        self._ended: set[str] = set()
        self._changed = threading.Condition()

    def __enter__(self) -> StreamMetrics:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)

    def _keep(self, key: tuple[str, int | None], row: tuple) -> None:
        with self._changed:
            self._rows[key] = row
            if len(self._rows) > self.most:
                self._rows.popitem(last=False)
                self.lost += 1

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        operators = p.stateOperators
        observed = {name: row.asDict(recursive=True) for name, row in (p.observedMetrics or {}).items()}
        row = (p.name or str(p.id), str(p.runId), p.batchId, p.numInputRows, sum(o.numRowsDroppedByWatermark for o in operators), sum(o.numRowsTotal for o in operators), p.eventTime.get("watermark"), json.dumps(observed, default=str, sort_keys=True), None)
        self._keep((str(p.runId), p.batchId), row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        if event.exception:
            self._keep((run, None), (self._names.get(run, str(event.id)), run, None, None, None, None, None, None, event.exception[:2000]))
        with self._changed:
            self._ended.add(run)
            self._changed.notify_all()

    def wait(self, run: object, seconds: float = 30) -> bool:
        """Whether the end of a run of a query has been seen within so many seconds."""
        with self._changed:
            return self._changed.wait_for(lambda: str(run) in self._ended, seconds)

    def table(self) -> DataFrame:
        """The rows that are held."""
        with self._changed:
            rows = list(self._rows.values())
        return self.spark.createDataFrame(rows, SCHEMA)

    def save(self, path: str) -> int:
        """Appends the rows that are held to a Parquet table and lets go of them; gives their number. They are kept if writing fails."""
        with self._changed:
            rows = dict(self._rows)
        if rows:
            self.spark.createDataFrame(list(rows.values()), SCHEMA).coalesce(1).write.mode("append").parquet(path)
        with self._changed:
            for key, row in rows.items():
                if self._rows.get(key) is row:
                    del self._rows[key]
        return len(rows)
