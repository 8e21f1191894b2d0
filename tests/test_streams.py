"""Streams over several batches: deltas, timers, late rows, metrics."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.tables import ITEM_KEY
from tessera.sources.versioned import VersionedStore
from tessera.streaming import deltas, feeds, metrics, timed

DIMENSIONS = ITEM_KEY[1:]
ITEMS = ", ".join(["id string", *(f"{c} string" for c in DIMENSIONS), "seq long, content string, deleted boolean"])


def test_deltas_read_as_the_latest_rows(spark, tmp_path):
    rng, store, expected, seq = random.Random(3), VersionedStore(spark, f"file://{tmp_path}/s"), {}, 0
    for batch in range(11):
        rows = []
        for _ in range(rng.randrange(1, 12)):
            seq += 1
            key = (str(rng.randrange(25)), *(rng.choice(["x", None]) if c == DIMENSIONS[0] else None for c in DIMENSIONS))
            gone = rng.random() < 0.3
            rows.append((*key, seq, f"c{seq}", gone or None))
            expected[key] = None if gone else f"c{seq}"
        rng.shuffle(rows)
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        deltas.apply(feeds.file_feed(spark, f"{tmp_path}/feed", spark.createDataFrame([], ITEMS).schema), store, "t", f"{tmp_path}/cp", fan=3).awaitTermination()
        found = deltas.read(store, "t").collect()
        assert {tuple(r[c] for c in ITEM_KEY): r.content for r in found} == {k: v for k, v in expected.items() if v is not None}
        assert len(found) == len({tuple(r[c] for c in ITEM_KEY) for r in found})
    held = store.begin().names("t")
    assert len(held) <= 6 and any("/L2-" in n for n in held)


def test_a_batch_writes_its_own_rows_only_and_once(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/s")
    big = spark.range(20_000).select(F.col("id").cast("string").alias("id"), *(F.lit(None).cast("string").alias(c) for c in DIMENSIONS), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("content"), F.lit(False).alias("deleted"))
    store.update(lambda t: deltas.add_batch(t, "t", big, 0))
    before = store.current()
    small = big.where("seq < 5").withColumn("seq", F.col("seq") + 50_000).withColumn("content", F.lit("new"))
    store.update(lambda t: deltas.add_batch(t, "t", small, 1))
    size = lambda path: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path.removeprefix("file://")) for f in fs)
    first, second = (size(store.tables()[n]) for n in store.begin().names("t"))
    assert second * 20 < first and deltas.read(store, "t").where("content = 'new'").count() == 5 and deltas.read(store, "t", before).where("content = 'new'").count() == 0
    again = store.begin()
    deltas.add_batch(again, "t", small, 1)
    assert not again._new
    with pytest.raises(ValueError, match="another stream"):
        deltas.add_batch(store.begin(), "t", small, 0, stream="elsewhere")


def at(hour):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hour)


def test_idle_runs_leave_the_state(spark, tmp_path):
    own = timed.timed_session(spark)
    schema = "run_id string, type string, tokens long, ts timestamp"
    batches = [
        [("a", "llm", 5, at(0)), ("a", "tool", None, at(1)), ("b", "llm", 2, at(1.5)), (None, "llm", 9, at(1)), ("c", "x", 1, None)],
        [("b", "tool", 3, at(5)), ("a", "llm", 1, at(1.9)), ("d", "llm", 7, at(9))],  # with 3 hours of delay the watermark is behind hour 1.9: that event still counts
        [("d", "llm", 100, at(2)), ("a", "llm", 4, at(20))],  # hour 2 is behind the watermark of hour 6
        [("e", "llm", 1, at(40))],
    ]
    found, left = [], []
    for n, rows in enumerate(batches):
        own.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = timed.closed_runs(feeds.file_feed(own, f"{tmp_path}/in", own.createDataFrame([], schema).schema), idle_ms=2 * 3_600_000, late="3 hours")
        query = feeds.append_log(stream, f"{tmp_path}/out", f"{tmp_path}/cp")  # each time from the checkpoint
        query.awaitTermination()
        left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        assert query.exception() is None
        found = sorted((r.run_id, r.n_events, r.llm_calls, r.tool_calls, r.tokens_used) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        if n == 1:
            assert found == [("a", 3, 2, 1, 6)]
    assert found == [("a", 1, 1, 0, 4), ("a", 3, 2, 1, 6), ("b", 2, 1, 1, 5), ("d", 1, 1, 0, 7)]
    assert left[-1] <= left[0]


def test_metrics_count_late_rows(spark, tmp_path):
    schema = "id long, ts timestamp"
    batches = [[(i, at(i)) for i in range(10)], [(100 + i, at(i)) for i in range(0, 14)], [(200 + i, at(i)) for i in range(6, 9)]]
    with metrics.StreamMetrics(spark) as seen:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            events = feeds.file_feed(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema).observe("read", F.count("*").alias("n"))
            query = feeds.append_log(feeds.once(events, "id", "ts", "3 hours"), f"{tmp_path}/out", f"{tmp_path}/cp")
            query.awaitTermination()
            assert seen.wait(query.runId)
        bad = spark.readStream.schema("x long").parquet(f"{tmp_path}/no*").select(F.raise_error(F.lit("broken")).alias("x"))
        spark.range(1).withColumnRenamed("id", "x").write.parquet(f"{tmp_path}/no1")
        failing = feeds.append_log(bad, f"{tmp_path}/out2", f"{tmp_path}/cp2")
        with pytest.raises(Exception, match="broken"):
            failing.awaitTermination()
        assert seen.wait(failing.runId)
    late, mark = 0, None
    for rows in batches:
        late += sum(mark is not None and ts <= mark for _, ts in rows)
        mark = max([ts - dt.timedelta(hours=3) for _, ts in rows] + ([mark] if mark else []))
    rows = seen.table()
    good = rows.where("error IS NULL")
    assert late == 7 + 3 and good.agg(F.sum("dropped_rows")).first()[0] == late
    assert good.agg(F.sum("input_rows")).first()[0] == good.agg(F.sum(F.get_json_object("observed", "$.read.n").cast("long"))).first()[0] == 27
    assert "broken" in rows.where("error IS NOT NULL").first().error
    n = rows.count()
    assert seen.save(f"{tmp_path}/log") == n and seen.save(f"{tmp_path}/log") == 0 and spark.read.parquet(f"{tmp_path}/log").count() == n and seen.lost == 0


def test_held_reports_are_bounded(spark):
    seen = metrics.StreamMetrics(spark, most=3)
    for n in range(5):
        seen._keep(("r", n), ("q", "r", n, 1, 0, 0, None, "{}", None))
    assert seen.lost == 2 and sorted(r.batch for r in seen.table().collect()) == [2, 3, 4]


def test_runs_are_kept_in_slices(spark, tmp_path):
    """State rows and timers are those of the slices, however many runs are open; one slice gives out runs that are due at the watermark itself and keeps the others."""
    own = timed.timed_session(spark)
    schema = "run_id string, type string, tokens long, ts timestamp"
    first = [(f"r{i}", ["llm", "tool", None][i % 3], None if i % 5 == 0 else i, at(i % 7)) for i in range(700)]
    batches = [first + [("big", "llm", 2**53 + 1, at(6)), ("big", "x", None, at(5))], [("late", "llm", 1, at(10))]]  # the watermark comes to hour 7: runs up to hour 5 are due
    for rows in batches:
        own.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = timed.closed_runs(feeds.file_feed(own, f"{tmp_path}/in", own.createDataFrame([], schema).schema), idle_ms=2 * 3_600_000, late="3 hours", slices=3)
        query = feeds.append_log(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 3
    found = {r.run_id: (r.n_events, r.llm_calls, r.tool_calls, r.tokens_used) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {f"r{i}": (1, int(i % 3 == 0), int(i % 3 == 1), 0 if i % 5 == 0 else i) for i in range(700) if i % 7 <= 5}
    own.createDataFrame([("end", "llm", 1, at(30))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = timed.closed_runs(feeds.file_feed(own, f"{tmp_path}/in", own.createDataFrame([], schema).schema), idle_ms=2 * 3_600_000, late="3 hours", slices=3)
    feeds.append_log(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {(r.n_events, r.tokens_used) for r in spark.read.parquet(f"{tmp_path}/out").where("run_id = 'big'").collect()} == {(2, 2**53 + 1)}
