"""The kept keyword index against the search that takes every text apart."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import scope, search
from tessera.operators.keyword_index import KeywordIndex
from tessera.sources.versioned import CommitConflict, VersionedStore


def items(spark, rows):
    df = spark.createDataFrame(rows, "id string, content string, owner string")
    return scope.scoped(df, base="rag", sc_user=F.col("owner")).drop("owner")


def queries(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.id, r.sc_user, round(r.score, 9)) for r in df.collect())


def text(rng, n):
    # a few terms stand everywhere, many in few documents
    return " ".join(f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(n))


def test_the_index_finds_what_bm25_finds_after_every_change(spark, tmp_path):
    rng = random.Random(7)
    index = KeywordIndex(VersionedStore(spark, f"file://{tmp_path}/s"), "kw", block=4)
    held, asked = {}, queries(spark, [text(rng, 3), text(rng, 12), "w1 w1 w2", "w399 W1", "nothing here", "", "été w2"])
    for step in range(3):
        batch = {(str(rng.randrange(90)), rng.choice("ab")): rng.choice([text(rng, rng.randrange(1, 40)), text(rng, 5), "", "Été w2 w2", None]) for _ in range(45)}
        index.upsert(items(spark, [(i, t, o) for (i, o), t in batch.items()]))
        held |= batch
        if step:
            ids = [str(k) for k in range(step, 90, 9)]
            index.delete(spark.createDataFrame([(i,) for i in ids], "id string"), scope.in_range({"base": "rag", "sc_user": "a"}))
            held = {k: t for k, t in held.items() if not (k[0] in ids and k[1] == "a")}
        if step == 2:
            index.compact()
            assert len(index.store.read("kw/dead").collect()) == 0
        now = items(spark, [(i, t, o) for (i, o), t in held.items()])
        for k in (1 + 4 * (step % 2),):
            assert rows_of(index.search(asked, top_k=k)) == rows_of(search.bm25(now, asked, top_k=k))
        one = scope.in_range({"sc_user": "b"})
        assert rows_of(index.search(asked, where=one)) == rows_of(search.bm25(now, asked, where=one))
    assert {(r.id, r.sc_user) for r in index.documents().collect()} == set(held)
    assert len(held) > 50


def test_blocks_are_left_out(spark, tmp_path):
    """Common terms cannot bring a document up beside a rare one: most of their blocks stay closed."""
    rng = random.Random(3)
    index = KeywordIndex(VersionedStore(spark, f"file://{tmp_path}/s"), "kw", block=8)
    docs = [(str(i), " ".join(["the", "of", *(["rare"] * 4 if i % 200 == 0 else ["plain"] * 4), f"x{rng.randrange(50)}"]), "a") for i in range(2000)]
    index.upsert(items(spark, docs))
    found = index.looked_up(queries(spark, ["the rare of"]), top_k=3)
    assert rows_of(found.hits) == rows_of(search.bm25(items(spark, docs), queries(spark, ["the rare of"]), top_k=3))
    read = {r.term: (r.blocks, r.read) for r in found.blocks.groupBy("term").agg(F.count("*").alias("blocks"), F.count_if("read").alias("read")).collect()}
    assert read["the"][0] >= 128 and read["the"][1] <= 10 and read["of"][1] <= 10 and read["rare"][1] == read["rare"][0]


def test_a_change_touches_its_own_documents_only(spark, tmp_path):
    index = KeywordIndex(VersionedStore(spark, f"file://{tmp_path}/s"), "kw")
    index.upsert(items(spark, [(str(i), f"common word{i}", "a") for i in range(500)]))
    before = {p: os.stat(p).st_mtime_ns for p in files(tmp_path)}
    index.upsert(items(spark, [("7", "common fresh", "a"), ("new", "fresh", "b")]))
    after = {p: os.stat(p).st_mtime_ns for p in files(tmp_path)}
    assert all(after[p] == t for p, t in before.items())
    deltas = {r.term: r.d for r in spark.read.parquet(index.store.tables()["kw/frequencies/000002"]).collect()}
    assert deltas == {"word7": -1, "fresh": 2}  # common: one out, one in
    assert spark.read.parquet(index.store.tables()["kw/postings/000002"]).agg(F.sum("n")).first()[0] == 3
    assert spark.read.parquet(index.store.tables()["kw/totals/000002"]).first().asDict() == {"docs": 1, "terms": 1}
    assert [(r.id, r.segment) for r in spark.read.parquet(index.store.tables()["kw/dead/000002"]).collect()] == [("7", "000001")]
    with pytest.raises(ValueError, match="twice"):
        index.upsert(items(spark, [("1", "a", "a"), ("1", "b", "a")]))


def files(top):
    return [os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")]


def test_two_writers_of_an_index(spark, tmp_path, monkeypatch):
    store = VersionedStore(spark, f"file://{tmp_path}/s")
    index, other = KeywordIndex(store, "kw"), KeywordIndex(store, "kw")
    index.upsert(items(spark, [("1", "a b", "a")]))
    real = KeywordIndex._write

    def slow(self, t, segment, fresh, old):
        real(self, t, segment, fresh, old)
        if self is index:
            other.upsert(items(spark, [("2", "b", "a")]))

    monkeypatch.setattr(KeywordIndex, "_write", slow)
    with pytest.raises(CommitConflict):
        index.upsert(items(spark, [("3", "b", "a")]))
    assert {r.id for r in index.search(queries(spark, ["b"])).collect()} == {"1", "2"}


def test_an_empty_index(spark, tmp_path):
    index = KeywordIndex(VersionedStore(spark, f"file://{tmp_path}/s"), "kw")
    index.upsert(items(spark, []))
    assert index.search(queries(spark, ["a"])).count() == 0
    index.upsert(items(spark, [("1", "a", "a")]))
    index.delete(spark.createDataFrame([("1",)], "id string"), F.lit(True))
    index.compact()
    assert index.search(queries(spark, ["a"])).count() == 0 and index.documents().count() == 0


def test_of_many_queries_only_the_best_leave_their_chunk(spark, tmp_path, monkeypatch):
    """What a search writes does not grow with documents times queries, nor with blocks times queries; where the weights of all queries are too many for one matrix the hits are the same."""
    from tessera.operators import keyword_index

    rng = random.Random(5)
    index = KeywordIndex(VersionedStore(spark, f"file://{tmp_path}/s"), "kw", block=8)
    index.upsert(items(spark, [(str(i), " ".join(["the", "of", *(f"x{rng.randrange(90)}" for _ in range(rng.randrange(1, 60)))]), "a") for i in range(2000)]))
    asked, rows, real = queries(spark, [f"the of {i}" for i in range(40)]), [], keyword_index.materialize

    def seen(df, name):
        out = real(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(keyword_index, "materialize", seen)
    found = rows_of(index.search(asked))
    assert len(found) == 200 and max(rows) < 2000
    monkeypatch.setattr(search, "WEIGHTS", 0)
    assert rows_of(index.search(asked)) == found
