"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_agrees_with_sql(spark, duck, sf, name):
    found, expected = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_query_sanitize_collects_distinct_values_only(spark, tmp_path):
    types = ["b", " ", "a", None] * 500 + list("cdefghij")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(types)] + [(9000, 2, "")], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    found = catalog.QUERIES["query_sanitize"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, "b|a|c|d|e|f|g|h"), (2, "none")]
    assert "min(event_id" in found._jdf.queryExecution().toString()
