"""Exact top-k search over vectors by three phases with a uniform threshold.

A vector's components are cut into slices; each slice gives every candidate a partial score, and the scores of a
slice over all candidates form one list. Per query:

1. every block of candidates gathers a local list: the best of a spread part of its rows, with their whole scores. The k-th best over
   all blocks is a safe cutoff, for k candidates reach it;
2. the cutoff goes back to the blocks. A candidate that reaches it has at least cutoff / lists in some list, so a
   block collects all entries from there on: no other can matter;
3. what is still missing of the scores of the collected is resolved, exactly.

Queries and candidates are packed into blocks of bounded size; each pair of blocks is one matrix product inside a task, and a further
sixteenth of one for the cutoff. Query blocks go to the tasks in groups of bounded bytes, so candidates are read and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, read
from tessera.operators.blocks import every_pair

#: Up to this product of a component squared and the number of components, float64 sums are exact.
EXACT = 2.0**53
#: Of so many rows of a block one is looked at for the cutoff.
SPREAD = 16
LONG = (-(2**63), 2**63 - 1)


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a double, or null for a vector that takes no part."""
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() of a double is a long, which the largest doubles are too large for: from 2**52 on a double has no fraction
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
    return F.when(fine, F.transform(vector, lambda x: whole(F.least(F.greatest(x.cast("double") * F.lit(float(scale)), F.lit(-1e300)), F.lit(1e300)))))


def packed(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """One row for up to `rows` vectors (id, v and, for queries, cutoff) of a partition: their ids, components and cutoffs, with the number of components."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                dim = int(sizes.max(initial=0))
                whole = np.zeros((part.num_rows, dim))
                whole[np.arange(dim) < sizes[:, None]] = part.column(1).flatten().to_numpy(zero_copy_only=False)
                cut = part.column(2).to_numpy(zero_copy_only=False).astype(float) if part.num_columns > 2 else np.zeros(0)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([dim], pa.int32()), pa.array([whole.tobytes()], pa.binary()), pa.array([np.nan_to_num(cut, nan=-np.inf).tobytes()], pa.binary())], names=[f"{name}_ids", f"{name}_dim", f"{name}_values", f"{name}_cut"])

    return vectors.mapInArrow(pack, f"{name}_ids binary, {name}_dim int, {name}_values binary, {name}_cut binary")


def unpack(batch: pa.RecordBatch, row: int, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, components and cutoffs of a block."""
    field = lambda c: batch.column(batch.schema.get_field_index(f"{name}_{c}"))[row].as_py()
    ids = np.frombuffer(field("ids"), np.int64)
    return ids, np.frombuffer(field("values")).reshape(len(ids), field("dim")), np.frombuffer(field("cut"))


def shared_part(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Both sides' common components (what one side lacks counts as zero), and how far a float64 sum over them may be off: 0 where it is exact."""
    dim = min(q.shape[1], c.shape[1])
    q, c = q[:, :dim], c[:, :dim]
    most = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) * max(1, dim)
    return q, c, 0.0 if most < EXACT else most * max(1, dim) * 2.0**-50


def exact_scores(q: np.ndarray, c: np.ndarray, off: float) -> np.ndarray:
    """Row by row; beyond what float64 can hold by whole numbers of any size, then cut to the range of a long."""
    if not off:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(a, b)), LONG[0]), LONG[1]) for a, b in zip(q, c)], np.int64)


def best_of(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their query, each id once: by score, ties to the smaller id. They come in order."""
    ranked = np.lexsort((ids, -score, at))
    at, ids = at[ranked], ids[ranked]
    once = np.sort(np.unique(np.stack([at, ids]), axis=1, return_index=True)[1])
    at = at[once]
    return ranked[once[np.arange(len(at)) - np.searchsorted(at, at) < k]]


FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])


def found_batch(query_ids: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(ids), pa.array(score)], names=["query_id", "id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, lists: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """query_id, rank, `id_col`, score: each query's k best candidates by inner product of floor(scale * x).

    `queries` has the columns of `vectors`; ties go to the smaller id; a candidate with the query's own id takes no
    part. Vectors that are null, or hold a null or non-finite component, and rows without id take no part.
    Equal rows count once, and of several vectors of one id the best. Of vectors of unequal length, the shorter is filled with zeros. A score
    beyond the range of a long is the end of that range; among such scores the smaller id goes first. Scaled components are cut at 1e300. No
    candidate, no row. Other columns are not read.
    """

    def usable(df: DataFrame) -> DataFrame:
        kept = df.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vec_col), scale).alias("v"))
        return kept.where("id IS NOT NULL AND v IS NOT NULL")

    candidates = materialize(packed(usable(vectors), block_rows, "c"), "topk-candidates")
    asked = materialize(usable(queries).repartition("id"), "topk-asked")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q, _ = unpack(batch, row, "q")
                c_ids, c, _ = unpack(batch, row, "c")
                some = slice(0, None, max(1, min(SPREAD, len(c_ids) // k)))
                c_ids, c = c_ids[some], c[some]
                q, c, off = shared_part(q, c)
                rough = np.where(q_ids[:, None] == c_ids, -np.inf, q @ c.T)
                near = np.argpartition(-rough, min(k, len(c_ids)) - 1, axis=1)[:, :k]
                at = np.repeat(np.arange(len(q_ids)), near.shape[1])
                col = near.ravel()
                fine = np.isfinite(rough[at, col])
                at, col = at[fine], col[fine]
                score = exact_scores(q[at], c[col], off)
                kept = best_of(at, c_ids[col], score, k)
                yield found_batch(q_ids[at[kept]], c_ids[col[kept]], score[kept])

    local = every_pair(candidates, packed(asked, query_rows, "q"), "q_values", gather, FOUND)
    # an id that stands in several rows counts once; Spark keeps k rows of a query in each partition before the shuffle
    local = local.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))
    cutoff = local.withColumn("place", place).where(F.col("place") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("cutoff"))
    # a query with fewer than k candidates looked at has no cutoff and collects everything
    with_cutoff = asked.join(materialize(cutoff, "topk-cutoffs"), "id", "left").select("id", "v", "cutoff")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q, cut = unpack(batch, row, "q")
                c_ids, c, _ = unpack(batch, row, "c")
                q, c, off = shared_part(q, c)
                edges = [q.shape[1] * n // lists for n in range(lists + 1)]
                parts = [q[:, a:b] @ c[:, a:b].T for a, b in zip(edges, edges[1:])]
                # a cutoff as a double may be above the score that it stands for
                least = (cut - np.abs(cut) * 2.0**-50)[:, None] / lists - off
                entries = np.logical_or.reduce([p >= least for p in parts]) & (q_ids[:, None] != c_ids)
                at, col = np.nonzero(entries)
                score = sum(p[at, col] for p in parts).astype(np.int64) if not off else exact_scores(q[at], c[col], off)
                kept = best_of(at, c_ids[col], score, k)
                yield found_batch(q_ids[at[kept]], c_ids[col[kept]], score[kept])

    found = every_pair(candidates, packed(with_cutoff, query_rows, "q"), "q_values", collect, FOUND)
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.select("query_id", rank.alias("rank"), F.col("id").alias(id_col), "score").where(F.col("rank") <= k)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = {
    "op1_exact_top_k": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
