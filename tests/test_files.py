"""The data source of documents against the loader."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, loaders

COLUMNS = ["doc_id", "content", "title", "source", "format", "records", "record_count"]


@pytest.fixture
def folder(tmp_path):
    for name, text in {"a.txt": "plain", "sub/b.jsonl": '{"a": 1}\n\n{"a": 2}\n', "c.json": '[{"x": 1}, 2]', "d.html": "<h1>T</h1><p>one</p>", "e.pdf": "%", "bad.json": "[1,", "big.md": "x" * 500, "t.csv": "k,v\n1,2\n", "none": "", "é x.md": "# h"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "_hidden.txt").write_text("no")
    return str(tmp_path)


def test_reads_what_the_loader_reads(spark, folder):
    files.register(spark)
    docs, rejected = loaders.load(spark, folder, most_bytes=100)
    rows = spark.read.format(files.NAME).option("most_bytes", 100).option("task_bytes", 10).load(folder)
    assert [(r.title, r.content) for r in rows.where("length = 0").collect()] == [("none", "")]  # a scan of Spark's leaves empty files out
    found = rows.where("reason IS NULL AND length > 0").select(*COLUMNS).collect()
    plain = lambda r: (r.doc_id, r.content, r.format, r.records, r.record_count) if "%" not in r.source and "é" not in r.source else r.title
    assert sorted(map(repr, map(plain, found))) == sorted(map(repr, map(plain, docs.select(*COLUMNS).collect())))
    assert sorted(r.reason for r in rows.where("reason IS NOT NULL").collect()) == sorted(r.reason for r in rejected.collect())
    assert rows.rdd.getNumPartitions() > 2 and rows.where("source LIKE '%hidden%'").count() == 0


def test_filters_keep_files_closed(spark, folder):
    files.register(spark, "files_with_readers", {"pdf": lambda text: f"read {text}", "txt": lambda text: 1 / 0})
    rows = spark.read.format("files_with_readers").load(folder)
    assert [(r.ext, r.content) for r in rows.where("ext = 'pdf' AND length < 100").collect()] == [("pdf", "read %")]
    assert rows.where("ext IN ('md', 'csv') AND length >= 5 AND title <> 'big'").select("title").collect() == [("t",)]
    reader = files.Reader({"path": folder}, {})
    left = list(reader.pushFilters([files.ds.EqualTo(("ext",), "md"), files.ds.LessThan(("length",), 100), files.ds.EqualTo(("title",), "x")]))
    assert len(left) == 1 and [os.path.basename(p[0]) for part in reader.partitions() for p in part.paths] == ["é x.md"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    files.register(spark)
    path, out = str(tmp_path / "out"), spark.range(0, 20, 1, 4).select(F.col("id"), F.concat(F.lit("té "), F.col("id")).alias("text"))
    os.mkdir(path)
    out.write.format(files.NAME).mode("append").save(path)
    assert sorted(r.id for r in spark.read.option("recursiveFileLookup", "true").json(path).collect()) == list(range(20))
    with pytest.raises(Exception, match="broken"):
        out.withColumn("text", F.when(F.col("id") < 15, F.col("text")).otherwise(F.raise_error(F.lit("broken")))).write.format(files.NAME).mode("append").save(path)
    assert len(os.listdir(path)) == 1 and os.listdir(path)[0].startswith("batch-")
    out.where("id < 3").write.format(files.NAME).mode("overwrite").save(path)
    assert sorted(r.text for r in spark.read.option("recursiveFileLookup", "true").json(path).collect()) == ["té 0", "té 1", "té 2"] and len(os.listdir(path)) == 1
    read = spark.read.format(files.NAME).load(path)
    assert sum(r.record_count for r in read.collect()) == 3 and set(read.columns) >= set(COLUMNS)
