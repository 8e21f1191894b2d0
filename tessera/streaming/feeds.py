"""Append-only feeds as streams: session log, traces, index outbox; with watermarks where events carry time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.operators.tables import ITEM_KEY, upsert
from tessera.sources.shared import materialize
from tessera.sources.versioned import VersionedStore


def file_feed(spark: SparkSession, path: str, schema: StructType, *, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as they come."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def once(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each event once, among those that come within `late` of each other."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *by: str, slide: str | None = None) -> DataFrame:
    """Events and their value by window and columns; a window is final once the watermark has passed it."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n_events"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), *by, "n_events", "value")


def sessions(events: DataFrame, time: str, gap: str, late: str, by: str) -> DataFrame:
    """Runs of events of a key with pauses under `gap`."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n_events")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The feed as a Parquet table, for all that is there now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Parts of an outbox's table; a batch writes those that it touches.
BUCKETS = 32


def apply_outbox(stream: DataFrame, store: VersionedStore, table: str, checkpoint: str, *, buckets: int = BUCKETS) -> StreamingQuery:
    """Upserts each batch of changed items (key, content_hash, ...) into the store's table, which stands in `buckets` parts by a hash of the key.

    Only parts with changed rows are written again. A batch that is run again after a failure finds its rows already there with the same digest, so it changes nothing.
    """
    bucket = F.pmod(F.xxhash64(*ITEM_KEY), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, _: int) -> None:
        last = batch.groupBy(*ITEM_KEY).agg(F.max_by(F.struct(*batch.columns), "seq").alias("r")).select("r.*").drop("seq").withColumn("_bucket", bucket)
        last = materialize(last, "outbox")
        held = store.tables() if store.current() else {}
        changed = {}
        for r in last.select("_bucket").distinct().collect():  # one row for each part at most
            name, own = f"{table}/{r._bucket:03d}", last.where(F.col("_bucket") == r._bucket).drop("_bucket")
            if name not in held:
                changed[name] = own
                continue
            old = batch.sparkSession.read.parquet(held[name])
            new = own.join(old.select(*ITEM_KEY, "content_hash"), [*ITEM_KEY, "content_hash"], "left_anti")
            if new.limit(1).count():
                changed[name] = upsert(old, new)
        if changed:
            store.commit(changed)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
