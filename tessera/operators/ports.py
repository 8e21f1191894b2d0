"""Ports for what a model does: embedding, rescoring, rewriting queries. Each takes a plain function of a batch, run in Arrow batches on the executors."""

from __future__ import annotations

import inspect
import types
import typing
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import query_list
from tessera.operators import search, tables
from tessera.operators.scope import in_range
from tessera.sources.versioned import VersionedStore

#: Texts in one call of an embedder.
EMBED_BATCH = 256


def embedded(df: DataFrame, text_col: str, embed: Callable[[list[str]], list[list[float]]], dim: int, *, out_col: str = "embedding") -> DataFrame:
    """`df` with the vectors that `embed` gives for up to EMBED_BATCH texts at a time; a null text has no vector.

    A wrong number of vectors or a wrong length fails the job: an index must not take in part of a batch.
    """
    kept = df.drop(out_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[list[float] | None] = [None] * len(f)
            at = np.flatnonzero(f[text_col].notna().to_numpy())
            for k in range(0, len(at), EMBED_BATCH):
                part = at[k : k + EMBED_BATCH]
                vectors = embed(f[text_col].iloc[part].tolist())
                if len(vectors) != len(part) or any(len(v) != dim for v in vectors):
                    raise ValueError(f"expected {len(part)} vectors of {dim} numbers")
                for i, v in zip(part, vectors):
                    out[i] = list(map(float, v))
            yield f.assign(**{out_col: pd.Series(out, index=f.index, dtype=object)})

    return kept.mapInPandas(run, T.StructType([*kept.schema, T.StructField(out_col, T.ArrayType(T.FloatType()))]))


def rescored(pairs: DataFrame, query_col: str, text_col: str, score: Callable[[list[tuple[str, str]]], list[float]], *, out_col: str = "rerank_score") -> DataFrame:
    """`pairs` with the scores of (query, text)."""
    kept = pairs.drop(out_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{out_col: np.asarray(score(list(zip(f[query_col], f[text_col]))), float)})

    return kept.mapInPandas(run, T.StructType([*kept.schema, T.StructField(out_col, T.DoubleType())]))


def variants(queries: DataFrame, rewritten: Column, *, most: int = 8) -> DataFrame:
    """query_id, variant (from 0), query: the query itself and its rewritings (an array column), distinct, at most `most`."""
    whole = query_list(F.concat(F.array("query"), F.coalesce(rewritten, F.array().cast("array<string>"))), F.col("query"), most)
    return queries.select("query_id", F.posexplode(whole).alias("variant", "query"))


def offline_rewritings(query: Column) -> Column:
    """Stand-in for a model: the query's longer words, and its words in order of the alphabet."""
    words = F.regexp_extract_all(F.lower(query), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    return F.array(F.array_join(F.filter(words, lambda w: F.char_length(w) > 4), " "), F.array_join(F.array_sort(F.array_distinct(words)), " "))


def batches_of(df: DataFrame, size: int, *order: str) -> DataFrame:
    """`df` with batch and the place in it, by key order within each partition key: how a writer would send it."""
    n = F.row_number().over(W.partitionBy(order[0]).orderBy(*order[1:])) - 1
    return df.withColumn("batch", F.floor(n / size).cast("int")).withColumn("place", (n % size).cast("int"))


def hyde(queries: DataFrame, written: Column) -> DataFrame:
    """query_id, query, embed_text: what is searched by words stays the query; what is embedded is the passage that a model has written for it, or the query where it has written none."""
    return queries.select("query_id", "query", F.when(F.trim(F.coalesce(written, F.lit(""))) != "", written).otherwise(F.col("query")).alias("embed_text"))


class VectorStore(Protocol):
    """Vectors by key (id and scope)."""

    def upsert(self, rows: DataFrame) -> None: ...
    def delete(self, ids: DataFrame, scope: dict[str, str | None]) -> None: ...
    def search(self, queries: DataFrame, *, top_k: int, scope: dict[str, str | None]) -> DataFrame: ...


class KeywordIndex(Protocol):
    """Texts by key (id and scope)."""

    def upsert(self, rows: DataFrame) -> None: ...
    def delete(self, ids: DataFrame, scope: dict[str, str | None]) -> None: ...
    def search(self, queries: DataFrame, *, top_k: int, scope: dict[str, str | None]) -> DataFrame: ...


class ContextSource(Protocol):
    """A named source of candidates (query_id, pos, score, content, embedding) for queries (query_id, query)."""

    name: str

    def fetch(self, queries: DataFrame) -> DataFrame: ...


def gathered(sources: list[ContextSource], queries: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """The candidates of all sources with their name; a source without a ratio, or a name that stands twice, raises before anything is fetched."""
    names = [s.name for s in sources]
    unknown, twice = set(names) - set(ratios), {n for n in names if names.count(n) > 1}
    if unknown or twice:
        raise ValueError(f"sources without a ratio: {sorted(unknown)}; named twice: {sorted(twice)}")
    found = [s.fetch(queries).withColumn("source", F.lit(s.name)) for s in sources]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


class _TableIndex:
    """A keyed table of a store, changed version by version."""

    def __init__(self, store: VersionedStore, table: str):
        self.store, self.table = store, table

    def rows(self) -> DataFrame:
        return self.store.read(self.table)

    def upsert(self, rows: DataFrame) -> None:
        if tables.repeated_keys(rows).limit(1).count():
            raise ValueError("a key stands twice in the batch")
        self.store.update(lambda t: t.write(self.table, tables.upsert(t.read(self.table), rows) if t.names(self.table) else rows))

    def delete(self, ids: DataFrame, scope: dict[str, str | None]) -> None:
        self.store.update(lambda t: t.write(self.table, tables.delete_in_range(t.read(self.table), ids, in_range(scope))))


class TableVectors(_TableIndex):
    """A VectorStore over a store's table of id, scope, embedding."""

    def search(self, queries: DataFrame, *, top_k: int, scope: dict[str, str | None]) -> DataFrame:
        return search.nearest(self.rows(), queries, top_k=top_k, where=in_range(scope))


class TableKeywords(_TableIndex):
    """Keyword search over a store's table of id, scope, content, which takes every text apart again; `keyword_index.KeywordIndex` keeps postings."""

    def search(self, queries: DataFrame, *, top_k: int, scope: dict[str, str | None]) -> DataFrame:
        return search.bm25(self.rows(), queries, top_k=top_k, where=in_range(scope))


#: Spark types and JSON schema types of Python annotations.
ANNOTATIONS = {str: (T.StringType(), "string"), int: (T.LongType(), "integer"), float: (T.DoubleType(), "number"), bool: (T.BooleanType(), "boolean")}


def _annotated(kind: object) -> tuple[T.DataType, dict]:
    options = [k for k in typing.get_args(kind) if k is not type(None)] if isinstance(kind, types.UnionType) or typing.get_origin(kind) is typing.Union else [kind]
    if len(options) == 1 and options[0] in ANNOTATIONS:
        spark, name = ANNOTATIONS[options[0]]
        return spark, {"type": name}
    if len(options) == 1 and typing.get_origin(options[0]) is list:
        spark, inner = _annotated(typing.get_args(options[0])[0])
        return T.ArrayType(spark), {"type": "array", "items": inner}
    raise TypeError(f"no Spark type for {kind}")


def tool(f: Callable) -> tuple[Callable[..., Column], dict]:
    """A column function of a typed Python function, and the JSON schema of its call: names, types, which are required, and its first line of text.

    It runs on Arrow batches, a row at a time; rows in which an argument without a default is null give null.
    """
    hints, signature = typing.get_type_hints(f), inspect.signature(f)
    fields = {n: _annotated(hints[n]) for n in signature.parameters}
    required = [n for n, p in signature.parameters.items() if p.default is inspect.Parameter.empty]
    schema = {"name": f.__name__, "description": (inspect.getdoc(f) or "").split("\n")[0], "parameters": {"type": "object", "properties": {n: s for n, (_, s) in fields.items()}, "required": required}}

    @F.pandas_udf(_annotated(hints["return"])[0])
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            rows = zip(*columns)
            yield pd.Series([None if any(v is None or v != v for n, v in zip(fields, row) if n in required) else f(*row) for row in rows], dtype=object)

    return run, schema
