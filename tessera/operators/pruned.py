"""Exact nearest neighbours without looking at every pair: pivots, rings and the triangle inequality.

Each vector belongs to its nearest pivot; those of a pivot are packed by their distance from it, so a block is a ring around the pivot. A query first looks at its nearest pivots, as
many as hold k vectors: its k-th distance there is one that the k nearest keep to. A vector of a ring is at least as far away as the query is from the ring. So rings that are farther away
than that distance are left out, first by whole pivots, then by blocks, and the rest is looked at as `search.nearest` does. Results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors as vx
from tessera.operators import search
from tessera.operators.blocks import ITEM_ROWS, QUERY_ROWS, nearest_in
from tessera.operators.tables import key_of
from tessera.sources.shared import few, materialize

#: Pivots for each length of vectors at most, parts that a pivot's vectors are dealt out to, and relative slack of the bounds.
PIVOTS, PARTS, SLACK = 256, 8, 1e-9


@dataclass
class VectorIndex:
    """blocks: pivot, dim, low, high (distances of its vectors from the pivot), n, keys, values. pivots: pivot, dim, center; a bounded table."""

    blocks: DataFrame
    pivots: DataFrame
    key: list[str]


def usable(df: DataFrame, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))))


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def built(items: DataFrame, *, pivots: int = PIVOTS, rows: int = ITEM_ROWS) -> VectorIndex:
    """The index of id (and scope), embedding. Vectors that are null, empty or hold nulls or NaN are left out. Pivots are the vectors whose keys hash lowest: a fixed, bounded sample."""
    key = key_of(items)
    fine = usable(items, "embedding").select(F.struct(*key).alias("key"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim"))
    lowest = F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64("key"), "key"))
    # some of the keys at first, by their hash, so that no task sorts the whole table
    chosen = fine.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(max(1, fine.count() // (4 * pivots)))) == 0)
    chosen = chosen.withColumn("pivot", lowest).where(F.col("pivot") <= pivots).select("pivot", "dim", F.col("v").alias("center"))
    chosen = materialize(chosen, "knn-pivots")
    centers = {dim: np.array([r.center for r in rs]) for dim, rs in grouped(chosen.orderBy("pivot").collect()).items()}  # PIVOTS for each length
    shared = items.sparkSession.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                x, c = vectors_of(own.column("v"), dim), shared.value.get(int(dim))
                if c is None:
                    near, away = np.zeros(len(x), np.int64), np.linalg.norm(x, axis=1)
                else:
                    near = np.argmin((c**2).sum(1)[None, :] - 2 * x @ c.T, axis=1)
                    away = np.linalg.norm(x - c[near], axis=1)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(near + 1, pa.int32()), pa.array(away)], names=["key", "v", "dim", "pivot", "away"])

    placed = fine.mapInArrow(assign, T.StructType([*fine.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("away", T.DoubleType())]))
    # a pivot that holds many vectors is dealt out over several tasks
    dealt = placed.repartition(F.col("dim"), F.col("pivot"), F.pmod(F.xxhash64("key"), F.lit(PARTS))).sortWithinPartitions("dim", "pivot", "away")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, near = batch.column("dim").to_numpy(), batch.column("pivot").to_numpy()
            ends = [0, *(np.flatnonzero((dims[1:] != dims[:-1]) | (near[1:] != near[:-1])) + 1).tolist(), len(near)]
            for a, b in zip(ends, ends[1:]):
                for at in range(a, b, rows):
                    own = batch.slice(at, min(rows, b - at))
                    away, keys = own.column("away").to_numpy(), own.column("key")
                    listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                    flat = vectors_of(own.column("v"), int(dims[at])).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([near[at]], pa.int32()), pa.array([dims[at]], pa.int32()), pa.array([away[0]]), pa.array([away[-1]]), pa.array([len(keys)], pa.int64()), listed, pa.array([flat], pa.binary())],
                        names=["pivot", "dim", "low", "high", "n", "keys", "values"],
                    )

    schema = T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("dim", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("n", T.LongType())])
    schema = schema.add("keys", T.ArrayType(fine.schema["key"].dataType)).add("values", T.BinaryType())
    blocks = dealt.mapInArrow(pack, schema).withColumn("block", F.monotonically_increasing_id())
    return VectorIndex(materialize(blocks, "knn-blocks"), chosen, key)


def grouped(rows: list) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r.dim, []).append(r)
    return out


def looked_at(index: VectorIndex, pairs: DataFrame, queries: DataFrame, k: int, on: list[str]) -> DataFrame:
    """query_id, key, distance: of each pair of a query and a pivot or block (`on`), the query's k nearest there."""
    # queries of one place are packed, as many to a row as make a product worth while
    packs = pairs.join(queries, "query_id").withColumn("pack", F.pmod(F.xxhash64("query_id"), F.lit(64)))
    packs = packs.groupBy(*on, "pack").agg(F.collect_list(F.struct("query_id", "query")).alias("q"))
    joined = index.blocks.join(packs, on).select("keys", "values", "dim", "q")
    kind = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("key", index.blocks.schema["keys"].dataType.elementType), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, keys = batch.column("dim")[row].as_py(), batch.column("keys").slice(row, 1).flatten()
                x = np.frombuffer(batch.column("values")[row].as_py()).reshape(-1, dim)
                asked = batch.column("q").slice(row, 1).flatten()
                ids, q = asked.field("query_id"), vectors_of(asked.field("query"), dim)
                for s in range(0, len(q), QUERY_ROWS):
                    at, col, exact = nearest_in(keys, x, q[s : s + QUERY_ROWS], k, "l2")
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + s)), keys.take(pa.array(col)), pa.array(exact)], names=["query_id", "key", "distance"])

    return joined.mapInArrow(run, kind)


@dataclass
class Found:
    """The hits, and counts of pairs of a query and a vector: all, and those looked at."""

    hits: DataFrame
    pairs: int
    looked: int


def nearest(index: VectorIndex, queries: DataFrame, *, top_k: int = search.TOP_K) -> Found:
    """As `search.nearest` by L2 gives them: query_id, the item's key, distance, rank, score. Runs jobs: the distances to keep to are known before rings are left out.

    Queries (query_id, query) that are null, empty or hold nulls or NaN find nothing; each finds vectors of its own length.
    """
    search.checked_sizes(top_k, top_k)
    asked = usable(queries, "query").select("query_id", F.col("query").cast("array<double>").alias("query"), F.size("query").alias("dim"))
    asked = materialize(asked, "knn-asked")
    rings = materialize(index.blocks.select("block", "dim", "pivot", "low", "high", "n"), "knn-rings")
    of_pivot = rings.groupBy("dim", "pivot").agg(F.sum("n").alias("n"), F.max("high").alias("high"))
    # a row for each query and pivot, of which there are few
    centers = of_pivot.join(index.pivots, ["dim", "pivot"], "left").withColumn("center", F.coalesce("center", F.array_repeat(F.lit(0.0), F.col("dim"))))
    gap = F.sqrt(F.aggregate(F.zip_with("query", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    away = asked.join(F.broadcast(centers), "dim").select("query_id", "dim", "pivot", "n", "high", gap.alias("gap"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("query_id", "dim").orderBy("gap", "pivot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    away = materialize(away.withColumn("first", before < top_k), "knn-away")
    vectors = asked.select("query_id", "query")
    first = looked_at(index, away.where("first").select("query_id", "dim", "pivot"), vectors, top_k, ["dim", "pivot"])
    first = materialize(search.ranked(first, top_k, F.col("distance"), F.col("key")).drop("rank"), "knn-first")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= top_k, F.max("distance")).alias("kth"))
    kth = kth.withColumn("most", F.coalesce(F.col("kth") * (1 + SLACK) + SLACK, F.lit(float("inf")))).select("query_id", "most")
    near = away.where("NOT first").join(F.broadcast(kth) if few(kth) else kth, "query_id").where(F.col("gap") - F.col("high") <= F.col("most"))
    rest = near.select("query_id", "dim", "pivot", "gap", "most").join(rings.select("block", "dim", "pivot", "low", "high", F.col("n").alias("held")), ["dim", "pivot"])
    rest = materialize(rest.where((F.col("gap") - F.col("high") <= F.col("most")) & (F.col("low") - F.col("gap") <= F.col("most"))).select("query_id", "block", "held"), "knn-rest")
    more = looked_at(index, rest.select("query_id", "block"), vectors, top_k, ["block"])
    hits = search.ranked(first.unionByName(more), top_k, F.col("distance"), F.col("key")).select("query_id", "key.*", "distance", "rank").withColumn("score", vx.distance_score(F.col("distance")))
    count = away.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.when(F.col("first"), F.col("n"))), F.lit(0)).alias("first")).first()  # one row
    return Found(hits, count.pairs, count.first + (rest.agg(F.sum("held").alias("s")).first().s or 0))
