"""An outbox applied as deltas: what a batch writes is in proportion to the batch.

A table is kept as runs in a store, each named by its level, its stream, and the first and last batch in it. A batch adds a run of level 0 that holds its changed items, once each; where `fan`
runs of one level would have come together it becomes one of the next level with them instead. So a row is written again once for each level, of which there are log(batches, base fan).
Readers take the newest row of each key of all runs. A batch that is run again after a failure finds its number within a run and changes nothing.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.tables import key_of
from tessera.sources.versioned import Transaction, VersionedStore

#: Runs of one level that are merged.
FAN = 8
_RUN = re.compile(r".*/L(\d+)-([0-9a-f]{8})-(\d+)-(\d+)")


def newest(rows: DataFrame) -> DataFrame:
    """The last row of each item, by `seq`; of equal ones the one that is greater in the other columns, so the result does not depend on order. Partial aggregation takes most copies before the shuffle."""
    key = key_of(rows)
    others = [c for c in rows.columns if c not in key and c != "seq"]
    return rows.groupBy(*key).agg(F.max(F.struct("seq", *others)).alias("_newest")).select(*key, "_newest.*").select(*rows.columns)


def add_batch(t: Transaction, table: str, batch: DataFrame, number: int, *, stream: str = "", fan: int = FAN) -> None:
    """The items of a batch (key, seq, deleted, ...) as a run, with the runs that are due; nothing if a run has that batch already.

    Batches are numbered by one stream, named by its checkpoint: a table that another stream has begun raises, as its numbers say nothing of this one's batches.
    """
    own = hashlib.sha256(stream.encode()).hexdigest()[:8]
    runs = sorted((int(m[1]), int(m[3]), int(m[4]), m[2], m[0]) for m in map(_RUN.fullmatch, t.names(table)) if m)
    if any(other != own for *_, other, _ in runs):
        raise ValueError(f"{table} is kept by another stream")
    if any(first <= number <= last for _, first, last, *_ in runs):
        return
    level, due = 0, []
    while len(alike := [r for r in runs if r[0] == level]) + 1 >= fan:
        due += alike
        level += 1
    rows = newest(reduce(DataFrame.unionByName, [t.read(name) for *_, name in due], batch))
    if len(due) == len(runs):
        rows = rows.where("NOT deleted")  # no older row is left for a deletion to hide
    first = min([number, *(r[1] for r in due)])
    t.write(f"{table}/L{level}-{own}-{first}-{number}", rows)
    for *_, name in due:
        t.drop(name)


def read(store: VersionedStore, table: str, version: str | None = None) -> DataFrame:
    """The items as of a version, without those whose newest row is a deletion."""
    return newest(store.read(table, version)).where("NOT deleted").drop("deleted")


def apply(stream: DataFrame, store: VersionedStore, table: str, checkpoint: str, *, fan: int = FAN) -> StreamingQuery:
    """Adds each batch of changed items (key, seq, deleted, ...) to the table, for all that is there now. `deleted` may be left out and is false where it is null. An empty batch adds nothing."""
    if fan < 2:
        raise ValueError("at least two runs are merged")
    deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in stream.columns else F.lit(False)

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.update(lambda t: add_batch(t, table, batch.withColumn("deleted", deleted), number, stream=checkpoint, fan=fan))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
