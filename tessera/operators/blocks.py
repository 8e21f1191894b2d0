"""Vectors in blocks: queries against items as matrix products inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.shared import materialize, small_batches

ITEM_ROWS, QUERY_ROWS = 4096, 512
#: Bytes of query blocks that go to every task at once; more of them are worked off in turn.
GROUP_BYTES = 64 << 20


def packed(df: DataFrame, key: Column, vec_col: str, rows: int, name: str) -> DataFrame:
    """A row for up to `rows` vectors of equal length of a partition: their keys, length and values. Null and empty vectors, and those with nulls, are left out."""
    fine = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, lambda x: x.isNotNull())
    picked = df.where(fine).select(key.alias("key"), F.col(vec_col).cast("array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                for at in range(0, own.num_rows, rows):
                    keys, flat = own.column(0).slice(at, rows), own.column(1).slice(at, rows).flatten().to_numpy(zero_copy_only=False)
                    listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                    yield pa.RecordBatch.from_arrays([listed, pa.array([int(dim)], pa.int32()), pa.array([flat.tobytes()], pa.binary())], names=[f"{name}_keys", f"{name}_dim", f"{name}_values"])

    schema = [T.StructField(f"{name}_keys", T.ArrayType(picked.schema["key"].dataType)), T.StructField(f"{name}_dim", T.IntegerType()), T.StructField(f"{name}_values", T.BinaryType())]
    return picked.mapInArrow(pack, T.StructType(schema))


def every_pair(items: DataFrame, queries: DataFrame, values: str, run: Callable, schema: T.StructType, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """`run` over every pair of a row of `items` and one of `queries`, both packed blocks; `values`: the column of `queries` that makes up its bytes.

    Query blocks are broadcast in groups of bounded bytes, so that the items, however many, are only read: once if one group is enough,
    else once for each group, whose result is written before the next begins. A pair holds both its blocks, so few of them go to Python at once.
    """
    q = materialize(queries, "query-blocks")
    total = q.agg(F.sum(F.octet_length(values)).alias("b")).first().b or 0
    groups = -(-total // group_bytes) or 1
    if groups == 1:
        return small_batches(items.join(F.broadcast(q), how="cross")).mapInArrow(run, schema)
    c, out = materialize(items, "item-blocks"), []
    for g in range(groups):
        own = q.where(F.pmod(F.xxhash64(values), F.lit(groups)) == g)
        out.append(materialize(small_batches(c.join(F.broadcast(own), how="cross")).mapInArrow(run, schema), "block-pairs"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def block(batch: pa.RecordBatch, k: int, name: str) -> tuple[pa.Array, np.ndarray]:
    """Keys and vectors of the k-th row's block."""
    column = batch.column(batch.schema.get_field_index(f"{name}_keys"))
    keys = column.slice(k, 1).flatten()
    values = np.frombuffer(batch.column(batch.schema.get_field_index(f"{name}_values"))[k].as_py())
    return keys, values.reshape(len(keys), -1)


def order_of(keys: pa.Array) -> np.ndarray:
    """For each key its place in their order; structs are ordered field by field."""
    fields = keys.flatten() if pa.types.is_struct(keys.type) else [keys]
    table = pa.table(fields, names=[str(n) for n in range(len(fields))])
    place = np.empty(len(keys), np.int64)
    place[pc.sort_indices(table, sort_keys=[(n, "ascending") for n in table.column_names]).to_numpy()] = np.arange(len(keys))
    return place


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Row by row."""
    if metric == "l2":
        return np.sqrt(((a - b) ** 2).sum(1))
    norm = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    return 1 - np.divide((a * b).sum(1), norm, out=np.zeros_like(norm), where=norm > 0)


def nearest_in(keys: pa.Array, x: np.ndarray, q: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of `q`, rows of `x` and distances: each query's k nearest of a block, by distance and then key."""
    if metric == "l2":
        rough = (x**2).sum(1)[None, :] - 2 * q @ x.T
    else:
        norm = np.linalg.norm(x, axis=1)
        rough = -(q @ x.T) / np.where(norm > 0, norm, 1)[None, :]
    most = min(k, rough.shape[1])
    edge = np.partition(rough, most - 1, axis=1)[:, most - 1]
    at, col = np.nonzero(rough <= edge[:, None] + 1e-9 * (1 + np.abs(edge))[:, None])
    exact = np.concatenate([distances(q[at[s : s + 65536]], x[col[s : s + 65536]], metric) for s in range(0, len(at), 65536)])
    ranked = np.lexsort((order_of(keys)[col], exact, at))
    at, col, exact = at[ranked], col[ranked], exact[ranked]
    best = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[best], col[best], exact[best]


def block_nearest(items: DataFrame, queries: DataFrame, key: Column, k: int, metric: str) -> DataFrame:
    """query_id, key, distance: of every pair of an item block and a query block, each query's k nearest by distance and then key.

    A product over the blocks finds k and those as near as the k-th, whose distances are then taken term by term; k of them leave the task, however many are equal.
    """
    left = packed(items, key, "embedding", ITEM_ROWS, "i")
    right = packed(queries, F.col("query_id"), "query", QUERY_ROWS, "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                i_keys, x = block(batch, row, "i")
                q_keys, q = block(batch, row, "q")
                if x.shape[1] != q.shape[1]:
                    continue
                at, col, exact = nearest_in(i_keys, x, q, k, metric)
                yield pa.RecordBatch.from_arrays([q_keys.take(pa.array(at)), i_keys.take(pa.array(col)), pa.array(exact)], names=["query_id", "key", "distance"])

    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("key", left.schema["i_keys"].dataType.elementType), T.StructField("distance", T.DoubleType())])
    return every_pair(left, right, "q_values", run, schema)
