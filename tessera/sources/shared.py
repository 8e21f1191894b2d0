"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a temporary one, on a local master only: a cluster's executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _folders:
        _folders[key] = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    return _folders[key]


_folders: dict[str, str] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: later jobs start from files that outlive executors.

    The table is removed when the driver's Python ends, or by `released`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows up to which a side of a join is broadcast, after they have been counted.
BROADCAST_ROWS = 200_000


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a frame has at most so many rows; looks at one more of them."""
    return df.limit(most + 1).count() <= most


def spread_out(df: DataFrame) -> DataFrame:
    """A scan over fewer tasks than there are cores (a small file is one task) dealt out to all of them; any other frame as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


#: Rows and bytes that go to Python at once: texts are long, and each batch stands in the JVM, in Arrow and in Python at the same time.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, with its session's Arrow batches bounded to BATCH_ROWS rows and BATCH_BYTES bytes (a longer row is a batch of its own)."""
    conf = df.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, BATCH_ROWS)
    if not 0 < int(conf.get(size).rstrip("bB")) <= BATCH_BYTES:
        conf.set(size, BATCH_BYTES)
    return df
