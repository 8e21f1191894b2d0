"""Nearest neighbours by pivots and rings against every pair."""

import numpy as np
import pytest

from tessera.operators import pruned, search


def frames(spark, x, q):
    items = spark.createDataFrame([(f"{i:05d}", [float(v) for v in r]) for i, r in enumerate(x)] + [("n", None), ("e", []), ("h", [None, 1.0]), ("s", [1.0]), ("nan", [float("nan")] * len(x[0]))], "id string, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)] + [(900, None), (901, [2.0]), (902, [])], "query_id int, query array<double>")
    return items, queries


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 6])
def test_same_rows_as_every_pair(spark, k):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 8)) * 40
    x = centers[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8))
    x[700:1200] = x[3]  # a third of all rows are one vector
    q = np.concatenate([x[::100], rng.normal(size=(5, 8)) * 60, x[3:4]])
    items, queries = frames(spark, x, q)
    found = pruned.nearest(pruned.built(items, pivots=24, rows=64), queries, top_k=k)
    clean = items.where("id <> 'nan'")
    assert rows(found.hits) == rows(search.nearest(clean, queries, top_k=k))
    assert found.pairs == len(q) * 1500 + 1 and found.looked < 0.35 * found.pairs  # clusters: most rings are too far away


def test_without_clusters_the_rows_are_the_same(spark):
    rng = np.random.default_rng(2)
    x, q = np.round(rng.normal(size=(400, 3)), 1), np.round(rng.normal(size=(20, 3)), 1)  # many ties
    items, queries = frames(spark, x, q)
    index = pruned.built(items, pivots=10, rows=16)
    assert rows(pruned.nearest(index, queries, top_k=7).hits) == rows(search.nearest(items.where("id <> 'nan'"), queries, top_k=7))
    assert rows(pruned.nearest(index, queries, top_k=1000).hits) == rows(search.nearest(items.where("id <> 'nan'"), queries, top_k=1000))
    assert pruned.nearest(index, queries.where("false")).hits.count() == 0
    assert pruned.nearest(pruned.built(items.where("false")), queries).hits.count() == 0
