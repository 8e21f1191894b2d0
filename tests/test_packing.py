"""Packing by array functions against the chunker in Python."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, packing

SCHEMA = "doc_id string, content string, title string, format string, records array<string>"


def both(spark, rows, most, overlap):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {(r.doc_id, r.idx): (r.heading_path, r.content) for r in packing.text_chunks(docs, most=most, overlap=overlap).collect()}
    return found, {(r.doc_id, r.idx): (r.heading_path, r.content) for r in chunking.chunked(docs, most=most, overlap=overlap).collect()}


def drawn(rng, n):
    return "".join(rng.choices(["a", "bc ", "word", "。", ". ", "你好", "\n\n", "\n \x1c\n", "\n", " ", "　", "😀", "x" * 30, "漢" * 12], k=n))


@pytest.mark.parametrize("most, overlap", [(1, 0), (3, 1), (8, 7), (20, 5), (1 << 40, 0)])
def test_same_chunks_as_the_chunker(spark, most, overlap):
    rng = random.Random(most)
    rows = [(str(i), drawn(rng, rng.randrange(60)), rng.choice(["t", None]), rng.choice(["txt", "JSON", "csv", None]), rng.choice([None, [], [drawn(rng, 9), None, " ", drawn(rng, 30)]])) for i in range(150)]
    rows += [("null", None, None, None, None), ("blank", " \n　", "t", "txt", None), ("null", "again", "", "txt", None)]
    found, expected = both(spark, rows, most, overlap)
    assert found == expected and len(found) > 100


def test_a_long_document_is_packed_in_time(spark):
    rng = random.Random(5)
    long = "\n\n".join("w" * rng.randrange(1, 40) for _ in range(100_000))
    began = time.perf_counter()
    found, expected = both(spark, [("long", long, "", "txt", None), ("line", "漢z" * 20_000, "", "txt", None)], 64, 16)
    assert found == expected and time.perf_counter() - began < 60


def test_no_python_worker_and_no_shuffle_of_texts(spark):
    docs = spark.range(0, 20, 1, 20).select(F.col("id").cast("string").alias("doc_id"), F.lit("a\n\nb").alias("content"), F.lit("").alias("title"), F.lit("txt").alias("format"), F.lit(None).cast("array<string>").alias("records"))
    plan = packing.text_chunks(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Exchange" not in plan and "size(transform" not in plan
    with pytest.raises(ValueError, match="overlap"):
        packing.text_chunks(docs, most=4, overlap=4)
    with pytest.raises(Exception, match="chunking.chunked"):
        packing.text_chunks(docs.withColumn("format", F.lit("md"))).collect()


def test_sections_of_fences_and_levels():
    assert chunking.sections("a\n# A\n~~~\n# no\n```\n# no\n~~~~\n## B\nb\n# C\n### D\n## E\n") == [("", "a"), ("A", "~~~\n# no\n```\n# no\n~~~~"), ("A > B", "b"), ("C > D", ""), ("C > E", "")]
    assert chunking.sections("") == [] and chunking.sections("```\n# x") == [("", "```\n# x")] and chunking.sections("## x\n# y") == [("x", ""), ("y", "")]


def test_small_documents_leave_together(monkeypatch):
    """The chunks of a batch of documents go out in few batches of bounded size, not one for each document."""

    class Frame:
        columns = ["doc_id", "content", "title", "format", "records"]
        selectExpr = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    for name in ("spread_out", "small_batches"):
        monkeypatch.setattr(chunking, name, lambda df: df, raising=False)
    docs = [{"doc_id": str(i), "content": " " if i % 5 == 0 else f"w{i}", "title": "", "format": "txt", "records": None, "source": None, "metadata": [("k", str(i))]} for i in range(2500)]
    out = list(chunking.chunked(Frame())(iter([pa.RecordBatch.from_pylist(docs)])))
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["doc_id"], r["idx"], r["content"], dict(r["metadata"])) for r in rows] == [(str(i), 0, f"w{i}", {"k": str(i), "source": "", "format": "txt"}) for i in range(2500) if i % 5]
    assert len(out) == 2 and out[0].num_rows == 1000
