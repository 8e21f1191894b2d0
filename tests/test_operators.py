"""Operators on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, context, memory, rag, scope, search, sessions, sync, tables, tools, traces
from tessera.sources import loaders
from tessera.sources.markdown import markdown, to_markdown
from tessera.sources.versioned import VersionedStore, require_schema
from tessera.streaming import feeds


def test_scope_guards():
    with pytest.raises(scope.ScopeError):
        scope.guarded({})
    assert scope.guarded({}, all_scopes=True)["base"] == ""
    with pytest.raises(scope.ScopeError):
        scope.with_base({"base": "rag"}, "memory")
    with pytest.raises(scope.ScopeError):
        scope.overlaid({"sc_user": "a"}, {"sc_user": "b"}, ("sc_user",))
    with pytest.raises(KeyError):
        scope.metadata_is("x", 1, ("y",))


def test_upsert_keeps_scopes_apart(spark):
    rows = spark.createDataFrame([("1", "alice", "a"), ("1", "bob", "b")], "id string, u string, content string")
    t = scope.scoped(rows, sc_user=F.col("u")).drop("u")
    new = t.where("sc_user = 'alice'").withColumn("content", F.lit("c"))
    out = {(r.sc_user, r.content) for r in tables.upsert(t, new).collect()}
    assert out == {("alice", "c"), ("bob", "b")}
    assert tables.repeated_keys(t.union(t)).count() == 2
    left = tables.delete_in_range(t, t.select("id"), scope.in_range({"sc_user": "bob"}))
    assert [r.sc_user for r in left.collect()] == ["alice"]
    assert tables.replace(t, t, new).count() == 1


def test_knn_and_rrf(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [0.9, 0.1, 0.0])], "query_id int, query array<float>")
    assert [r.id for r in search.nearest(items, q).orderBy("rank").collect()] == ["a", "b"]
    lists = spark.createDataFrame([(1, 0, 1, "x"), (1, 1, 1, "x"), (1, 1, 2, "y")], "query_id int, list_no int, rank int, key string")
    best = search.rrf(lists).orderBy("rank").first()
    assert best.key == "x" and best.score == pytest.approx(2 / 61)
    keys = spark.createDataFrame([("", "c1"), ("", "c2")], "id string, content string").select(search.fuse_key(F.col("id"), F.col("content")).alias("k"))
    assert keys.distinct().count() == 2
    with pytest.raises(ValueError):
        search.checked_sizes(5, 4)


def test_bm25_repeats_and_scope(spark):
    docs = spark.createDataFrame([("1", "cat sat", "u"), ("2", "dog", "v"), ("3", "bird", "v"), ("4", "Çat", "v")], "id string, content string, owner string")
    q = spark.createDataFrame([(1, "cat"), (2, "cat cat"), (3, "")], "query_id int, query string")
    found = {(r.query_id, r.id): r.score for r in search.bm25(docs, q).collect()}
    assert set(found) == {(1, "1"), (1, "4"), (2, "1"), (2, "4")}
    assert found[2, "1"] == pytest.approx(2 * found[1, "1"])
    narrow = {(r.query_id, r.id): r.score for r in search.bm25(docs, q, where=F.col("owner") == "u").collect()}
    assert narrow == {k: pytest.approx(v) for k, v in found.items() if k[1] == "1"}


def test_neighbours(spark):
    chunks = spark.createDataFrame([("d", i, f"c{i}") for i in range(4)], "doc_id string, idx int, content string")
    hits = spark.createDataFrame([(1, 1, "d", 2), (1, 2, "d", 1), (1, 3, "d", 2)], "query_id int, rank int, doc_id string, idx int")
    assert [r.content for r in rag.expanded(hits, chunks, 1).orderBy("rank").collect()] == ["c1\nc2\nc3", "c0"]


def test_mmr(spark):
    rows = [(1, 0, 0.90, [1.0, 0.0, 0.0]), (1, 1, 0.85, [0.99, 0.10, 0.0]), (1, 2, 0.60, [0.0, 1.0, 0.0]), (2, 0, 0.9, [1.0, 0.0]), (2, 1, 0.8, None)]
    df = spark.createDataFrame(rows, "query_id int, pos int, score double, embedding array<double>")
    picked = {}
    for r in context.mmr(df, k=3).orderBy("query_id", "pick").collect():
        picked.setdefault(r.query_id, []).append(r.pos)
    assert picked == {1: [0, 2], 2: [0, 1]}


def test_greedy_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (1, 2, 1)], "query_id int, pos int, tokens int")
    assert [r.taken for r in context.greedy(df, F.lit(10), "query_id").orderBy("pos").collect()] == [True, False, False]


def test_prune(spark):
    m = spark.createDataFrame([("s", i, f"m{i}") for i in range(10)], "session string, seq int, content string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert [r.content for r in sessions.pruned(m, ("session",), keep_last=3).orderBy("seq").collect()] == ["m7", "m8", "m9"]
    with pytest.raises(ValueError):
        sessions.pruned(m, ("session",))


def test_reduce_keeps_whole_units(spark):
    roles = ["user", "assistant", "tool", "assistant", "tool", "tool", "assistant", "tool"]
    m = spark.createDataFrame([("s", i, r, 100) for i, r in enumerate(roles)], "session string, seq int, role string, tokens int")
    parts = [r.part for r in sessions.reduced(m, ("session",), budget=300).orderBy("seq").collect()]
    assert parts == ["head", "middle", "middle", "recent", "recent", "recent", "recent", "recent"]


def test_consolidate_is_void_after_a_change(spark):
    t = "id string, content string, importance double, created_at timestamp, updated_at timestamp, invalid_at timestamp, superseded_by string"
    m = spark.createDataFrame([("a", "x", 0.5, None, None, None, None), ("b", "y", 0.5, None, None, None, None)], t)
    now = F.lit("2024-01-01").cast("timestamp")
    merged = m.where("id = 'a'").withColumn("id", F.lit("m"))
    fine = m.select("id", F.lit("m").alias("by"), "content", "updated_at")
    out = {r.id: r.superseded_by for r in memory.consolidate(m, merged, fine, now).collect()}
    assert out == {"a": "m", "b": "m", "m": None}
    stale = fine.withColumn("content", F.when(F.col("id") == "b", "old").otherwise(F.col("content")))
    assert {r.id: r.superseded_by for r in memory.consolidate(m, merged, stale, now).collect()} == {"a": None, "b": None}


def test_sync_round(spark):
    s = scope.scoped(spark.createDataFrame([("1", "h1"), ("2", "h2")], "id string, content_hash string"))
    b = scope.scoped(spark.createDataFrame([("1", "h1"), ("3", "h3")], "id string, content_hash string")).withColumn("updated_at", F.lit(None).cast("timestamp")).withColumn("pending_since", F.lit(None).cast("timestamp"))
    now = F.lit("2024-01-01").cast("timestamp")
    assert [r.id for r in sync.changed(s, b).collect()] == ["2"]
    assert [r.id for r in sync.stale(s, b).collect()] == ["3"]
    done = sync.reconciled(s, b, now)
    assert sync.changed(s, done).count() == 0 and sync.divergence(s, done).count() == 0
    assert sync.changed(s, sync.marked_pending(done, s.where("id = '1'"), now)).count() == 1


def test_findings(spark):
    e = spark.createDataFrame([("r", 0, "tool", "error", None, None), ("r", 1, "retrieval", None, 0, None), ("r", 2, "llm", None, None, "length")], "run_id string, pos int, type string, status string, hits int, finish_reason string")
    assert {r.code for r in traces.findings(traces.steps(e)).collect()} == {"tool_error", "empty_retrieval", "llm_truncated"}


def test_chunkers():
    text = "# Title\n```\n# no heading\n```\n## Real Section\nbody"
    assert [h for h, _ in chunking.sections(text)] == ["Title", "Title > Real Section"]
    assert [h for h, _ in chunking.sections("# Title\n```\n# x\n")] == ["Title"]
    for n in (3, 10, 40):
        chunks = chunking.pack(["abc def. ghi", "x" * 200, "你好世界", "tail"], n, n // 2)
        assert all(chunking.tokens(c) <= n for c in chunks)
    assert chunking.split(" \n ", "txt", "", None, 10, 2) == []
    assert chunking.split("x", "jsonl", "t", ["a", "b"], 10, 2) == [("t", "a"), ("t", "b")]


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "c.json").write_text('[{"x": 1}, 2]')
    (tmp_path / "d.html").write_text("<h1>T</h1><p>one <b>two</b></p><script>no</script>")
    (tmp_path / "e.doc").write_text("old")
    (tmp_path / "big.txt").write_text("x" * 100)
    found = {r.title: r for r in loaders.documents(spark, str(tmp_path), most_bytes=60).collect()}
    assert set(found) == {"a", "b", "c", "d"}
    assert found["b"].records == ['{"a": 1}', '{"a": 2}'] and found["b"].record_count == 2
    assert len(found["c"].records) == 2
    assert found["d"].content == "# T\n\none **two**"
    assert {r.reason for r in loaders.load(spark, str(tmp_path), most_bytes=60)[1].collect()} == {"too large", "format not read"}
    csv = tmp_path / "csv"
    csv.mkdir()
    (csv / "t.csv").write_text("k,v\n1,2\n3,4\n")
    (csv / "u.csv").write_text('a,b,c\n"x\ny",5,6\n')
    found = {r.title: r.records for r in loaders.documents(spark, str(csv)).collect()}
    assert found == {"t": ["k: 1\nv: 2", "k: 3\nv: 4"], "u": ["a: x\ny\nb: 5\nc: 6"]}


def test_broken_files_and_containers(spark, tmp_path):
    import zipfile

    (tmp_path / "bad.json").write_text("[1, 2")
    (tmp_path / "ok.json").write_text('{"b":"\u00e9", "a": [1]}')
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    text = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "w.docx", "w") as z:
        z.writestr("word/document.xml", text)
    with zipfile.ZipFile(tmp_path / "bomb.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "0" * 30_000_000)
    docs, rejected = loaders.load(spark, str(tmp_path), readers={"odd": str.upper})
    found = {r.title: r for r in docs.collect()}
    assert found["ok"].records == ['{"b": "é", "a": [1]}'] and found["w"].content == "# Top\n\none two"
    reasons = {r.path.rpartition("/")[2]: r.reason for r in rejected.collect()}
    assert reasons["bomb.docx"] == "expands too far" and reasons["bad.json"].startswith("broken:")


def test_skills_and_traces(spark, tmp_path):
    for n in ("x", "y"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "SKILL.md").write_text(f"---\nname: {n}\ndescription: does {n}\n---\nbody of {n}")
    assert [(r.name, r.description, r.body) for r in loaders.skills(spark, str(tmp_path)).collect()] == [(n, f"does {n}", f"body of {n}") for n in "xy"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "SKILL.md").write_text("---\nname: &n z\n---\nbody")
    (broken,) = [r for r in loaders.skills(spark, str(tmp_path)).collect() if r.reason]
    assert broken.name is None and broken.path.endswith("bad/SKILL.md") and "anchors" in broken.reason
    (tmp_path / "t.jsonl").write_text('{"type": "llm"}\n\nnot json\n')
    good, bad = loaders.trace_lines(spark, str(tmp_path / "t.jsonl"))
    assert [r.pos for r in good.collect()] == [1] and [r.pos for r in bad.collect()] == [3]


def test_markdown_of_lists_and_links():
    assert markdown("<ul><li>a</li><li><a href='u'>b</a></li></ul>") == "- a\n- [b](u)"


def test_store_flips_whole_versions(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    assert store.current() is None
    first = store.commit({"t": spark.range(2)})
    pinned = store.read("t", first)
    store.commit({"t": spark.range(5)})
    assert pinned.count() == 2 and store.read("t").count() == 5
    with pytest.raises(TypeError):
        require_schema(spark.range(1), {"id": "string"})


def test_outbox_is_idempotent(spark, tmp_path):
    rows = scope.scoped(spark.createDataFrame([("1", "h1", 1), ("1", "h2", 2), ("2", "h1", 1)], "id string, content_hash string, seq long"))
    rows.write.parquet(f"{tmp_path}/feed")
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    for n in range(2):  # the second run sees the same rows again
        feeds.apply_outbox(feeds.file_feed(spark, f"{tmp_path}/feed", rows.schema), store, "t", f"{tmp_path}/cp{n}").awaitTermination()
    assert {(r.id, r.content_hash) for r in store.read("t").collect()} == {("1", "h2"), ("2", "h1")}
    assert store.current().startswith("000000000001")


def test_session_windows(spark, tmp_path):
    e = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:05:00"), ("u", "2024-01-01 02:00:00"), ("w", "2024-01-02 00:00:00")], "user string, t string").withColumn("ts", F.to_timestamp("t"))
    e.write.parquet(f"{tmp_path}/e")
    out = feeds.sessions(feeds.file_feed(spark, f"{tmp_path}/e", e.schema), "ts", "10 minutes", "1 minute", "user")
    feeds.append_log(out, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.n_events for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_is_exact_and_skips_odd_vectors(spark, metric):
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 5)), 1)
    x[50:60] = x[7]
    rows = [(f"{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)] + [("n", None), ("e", []), ("s", [1.0]), ("h", [None] * 5), ("z", [0.0] * 5)]
    items = spark.createDataFrame(rows, "id string, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(0, 300, 30)], "query_id int, query array<double>")
    found = {}
    for r in search.nearest(items, queries, metric=metric).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(round(r.distance, 9))
    for q, got in found.items():
        if metric == "l2":
            d = [float(np.sqrt(((x[q] - r) ** 2).sum())) for r in [*x, np.zeros(5)]]
        else:
            d = [1 - float(x[q] @ r / (np.linalg.norm(x[q]) * np.linalg.norm(r) or 1)) for r in [*x, np.zeros(5)]]
        assert got == pytest.approx(sorted(d)[:5], abs=1e-8)
    assert len(found) == 10
    with pytest.raises(ValueError):
        search.nearest(items, queries, metric="l1")


def test_ports(spark):
    from tessera.operators import ports

    df = spark.createDataFrame([(i, None if i == 3 else f"t{i}", "clash") for i in range(600)], "id int, text string, embedding string")
    sizes = lambda texts: [[float(len(texts)), 0.0] for _ in texts]
    out = {r.id: r.embedding for r in ports.embedded(df, "text", sizes, 2).collect()}
    assert out[3] is None and max(v[0] for v in out.values() if v) <= ports.EMBED_BATCH
    with pytest.raises(Exception, match="expected"):
        ports.embedded(df, "text", lambda t: [[1.0]] * len(t), 2).collect()
    scores = ports.rescored(df.where("id < 3"), "text", "embedding", lambda pairs: [len(a) + len(b) for a, b in pairs])
    assert {r.rerank_score for r in scores.collect()} == {7.0}
    q = spark.createDataFrame([(1, "alpha be"), (2, " ")], "query_id int, query string")
    assert [(r.query_id, r.query) for r in ports.variants(q, ports.offline_rewritings(F.col("query"))).orderBy("query_id", "variant").collect()] == [(1, "alpha be"), (1, "alpha"), (2, " ")]


def test_files_beyond_the_limits_are_named(spark, tmp_path):
    for name, text in (("a.txt", "x" * 10), ("b.txt", "x" * 11), ("c.txt", "é" * 10), ("d.txt", "x" * 40)):
        (tmp_path / name).write_text(text, encoding="utf-8")
    read, rejected = loaders.load(spark, str(tmp_path), most_bytes=30, most_chars=10)
    assert sorted(r.content for r in read.collect()) == ["x" * 10, "é" * 10]
    assert sorted((r.path[-5:], r.reason) for r in rejected.collect()) == [("b.txt", "text too long"), ("d.txt", "too large")]
    with pytest.raises(ValueError, match="1 text too long, as .*b.txt; 1 too large"):
        loaders.documents(spark, str(tmp_path), most_bytes=30, most_chars=10, strict=True)
    with pytest.warns(UserWarning, match="1 text too long, as .*b.txt; 1 too large"):
        assert loaders.documents(spark, str(tmp_path), most_bytes=30, most_chars=10).count() == 2


def brute_pack(units, most, overlap):
    """Straight from the rule, counting every joined text again."""
    size = lambda x: chunking.tokens("\n".join(x))
    out, held = [], []
    for u in units:
        if held and size([*held, u]) > most:
            out.append(held)
            k = len(held)
            while k and size(held[k - 1 :]) <= overlap:
                k -= 1
            held = held[k:]
            while held and size([*held, u]) > most:
                held = held[1:]
        held = [*held, u]
    return ["\n".join(x).strip() for x in ([*out, held] if held else out)]


def test_packing_is_what_the_rule_says():
    import random

    rng = random.Random(1)
    for _ in range(400):
        units = ["".join(rng.choices("ab字. ", k=rng.randrange(1, 40))) for _ in range(rng.randrange(0, 30))]
        most = rng.randrange(2, 40)
        overlap = rng.randrange(0, most)
        pieces = chunking.pieces_of(units, most)
        assert "".join(pieces) == "".join(units) and all(chunking.tokens(p) <= most for p in pieces)
        assert chunking.pack(units, most, overlap) == brute_pack(pieces, most, overlap)
        assert chunking.pack(units, most, overlap, len) == [c for c in chunking.pack(units, most, overlap, lambda t: len(t))]
    with pytest.raises(ValueError, match="one character"):
        chunking.cut_characters("abc", 1, lambda t: 2 * len(t))


def test_equal_ids_of_two_owners_stay_apart(spark):
    rows = scope.scoped(spark.createDataFrame([("1", "alice", "cat"), ("1", "bob", "cat dog")], "id string, u string, content string"), sc_user=F.col("u")).drop("u")
    hits = search.bm25(rows, spark.createDataFrame([(1, "cat")], "query_id int, query string"))
    assert {(r.sc_user, r.rank) for r in hits.collect()} == {("alice", 1), ("bob", 2)}
    chunks = rows.where("sc_user = 'bob'").withColumnRenamed("id", "chunk_id")
    assert [r.sc_user for r in rag.hydrated(hits.select("query_id", "rank", "id", *scope.DIMENSIONS), chunks).collect()] == ["bob"]
    assert [r.sc_user for r in rag.orphans(hits, chunks).collect()] == ["alice"]
    at = F.lit("2024-01-01").cast("timestamp")
    m = rows.withColumns({c: F.lit(None).cast("timestamp") for c in ("created_at", "updated_at", "last_accessed_at", "invalid_at")}).withColumn("superseded_by", F.lit(None).cast("string")).withColumn("importance", F.lit(0.5))
    gone = m.where("sc_user = 'alice'").select("id", *scope.DIMENSIONS, F.lit("x").alias("by"))
    assert {r.sc_user: r.superseded_by for r in memory.invalidated(m, gone, at).collect()} == {"alice": "x", "bob": None}
    assert {r.sc_user: r.created_at is not None for r in tables.touched(m, gone, "created_at", at).collect()} == {"alice": True, "bob": False}
    both = memory.blended(hits, m, at)
    assert {(r.sc_user, r.query_id) for r in both.collect()} == {("alice", 1), ("bob", 1)}


def test_superseded_chains_end_or_go_in_circles(spark):
    rows = [(str(i), str(i + 1) if i < 99 else None) for i in range(100)] + [("a", "b"), ("b", "c"), ("c", "b"), ("z", "gone")]
    out = {r.id: (r.final, r.steps) for r in memory.superseded_chain(spark.createDataFrame(rows, "id string, superseded_by string")).collect()}
    assert all(out[str(i)] == ("99", 99 - i) for i in range(100))
    assert out["a"] == out["b"] == out["c"] == (None, None) and out["z"] == ("gone", 1)


def test_equal_vectors_do_not_flood(spark):
    items = spark.createDataFrame([(f"{i:05d}", [1.0, 0.0]) for i in range(9000)], "id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, query array<double>")
    found = search.nearest(items, q)
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(n, f"{i:05d}") for n in (1, 2) for i in range(5)]
    from tessera.operators import blocks

    left, right = blocks.packed(items, F.col("id"), "embedding", 4096, "i"), blocks.packed(q, F.col("query_id"), "query", 1, "q")
    import pyarrow as pa
    from pyspark.sql import types as T

    def pairs(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(blocks.block(b, k, "i")[0]) for k in range(b.num_rows)])], names=["n"])

    grouped = blocks.every_pair(left, right, "q_values", pairs, T.StructType([T.StructField("n", T.LongType())]), group_bytes=16)
    assert sum(r.n for r in grouped.collect()) == 18000


def test_unique_names_never_clash(spark):
    from tessera.operators import tools

    names = ["a", "a", "a_2", "b", "b", "b", "x" * 64, "x" * 64, "a_2", "x" * 62 + "_2"]
    t = spark.createDataFrame(list(enumerate(names)), "n int, name string")
    out = {r.n: r.unique_name for r in tools.unique_names(t, "n").collect()}
    assert len(set(out.values())) == len(names) and all(len(v) <= 64 for v in out.values())
    assert [out[i] for i in range(6)] == ["a", "a_2", "a_2_2", "b", "b_2", "b_3"]


def test_sinks_fail_alone(spark, tmp_path):
    from tessera.streaming import exporters

    def broken(events, batch):
        raise OSError("no disk")

    e = spark.createDataFrame([("r", i, "llm", 5.0) for i in range(20)], "run_id string, pos int, type string, latency_ms double").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    e.write.parquet(f"{tmp_path}/e")
    store = VersionedStore(spark, f"file://{tmp_path}/ring")
    fan = exporters.Fanout({"bad": broken, "json": exporters.json_lines(f"{tmp_path}/json"), "table": exporters.table(f"{tmp_path}/table"), "spans": exporters.span_table(f"{tmp_path}/spans"), "ring": exporters.ring(store, "t", 8)})
    fan.start(feeds.file_feed(spark, f"{tmp_path}/e", e.schema), f"{tmp_path}/cp").awaitTermination()
    assert {(r.exporter, r.failures, r.lost_events) for r in fan.counters(e).collect()} == {("bad", 1, 20), ("json", 0, 0), ("table", 0, 0), ("spans", 0, 0), ("ring", 0, 0)}
    assert spark.read.json(f"{tmp_path}/json").count() == spark.read.parquet(f"{tmp_path}/table").count() == 20
    assert sorted(r.pos for r in store.read("t").collect()) == list(range(12, 20))
    s = spark.read.parquet(f"{tmp_path}/spans").first()
    assert (s.span_end - s.span_start).total_seconds() == 0.005


def test_untouched_parts_keep_their_files(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    store.commit({"t/0": spark.range(3), "t/1": spark.range(3, 5)})
    before = store.tables()
    store.commit({"t/1": spark.range(3, 9)})
    assert store.tables()["t/0"] == before["t/0"] and store.tables()["t/1"] != before["t/1"]
    assert store.read("t").count() == 9 and store.read("t", store.current()).count() == 9


def test_indexes_and_tools_as_ports(spark, tmp_path):
    from tessera.operators import ports

    store = VersionedStore(spark, f"file://{tmp_path}/store")
    keywords = ports.TableKeywords(store, "k")
    rows = scope.scoped(spark.createDataFrame([("1", "cat"), ("2", "dog")], "id string, content string"), base="rag")
    keywords.upsert(rows)
    keywords.upsert(rows.where("id = '2'").withColumn("content", F.lit("cat cat")))
    with pytest.raises(ValueError):
        keywords.upsert(rows.union(rows))
    q = spark.createDataFrame([(1, "cat")], "query_id int, query string")
    assert {r.id for r in keywords.search(q, top_k=5, scope={"base": "rag"}).collect()} == {"1", "2"}
    keywords.delete(rows.where("id = '1'"), {"base": "rag"})
    assert keywords.rows().count() == 1

    def join(text: str, times: int, sign: str | None = None) -> str:
        """Repeats a text.

        More of it."""
        return (sign or "-").join([text] * times)

    f, schema = ports.tool(join)
    assert schema["description"] == "Repeats a text." and schema["parameters"]["required"] == ["text", "times"] and schema["parameters"]["properties"]["sign"] == {"type": "string"}
    df = spark.createDataFrame([("a", 2), ("b", None)], "t string, n long")
    assert [r.x for r in df.select(f("t", "n").alias("x")).collect()] == ["a-a", None]
    with pytest.raises(ValueError, match="named twice"):
        source = type("S", (), {"name": "m", "fetch": None})()
        ports.gathered([source, source], q, {"m": 1.0})


def test_mmr_drops_equal_contents_first(spark):
    rows = [(1, 0, 0.2, "same", [1.0, 0.0]), (1, 1, 0.9, "same", [1.0, 0.0]), (1, 2, 0.8, "other", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "query_id int, pos int, score double, content string, embedding array<double>")
    assert [(r.pick, r.pos) for r in context.mmr(df, k=None).orderBy("pick").collect()] == [(1, 1), (2, 2)]


def test_long_sessions_are_digested_once(spark):
    import hashlib

    m = spark.createDataFrame([("s", i, "user", f"m{i}") for i in range(3000)] + [("t", 0, "user", None)], "session string, seq int, role string, content string")
    out = {(r.session, r.seq): r.digest for r in sessions.prefix_digests(m, ("session",)).collect()}
    joined = lambda n: "\x1e".join(f"user\x1fm{i}" for i in range(n + 1))
    assert all(out["s", n] == hashlib.sha256(joined(n).encode()).hexdigest() for n in (0, 1, 2999)) and len(out) == 3001


def test_frontmatter_limits():
    fields, body = loaders.frontmatter("---\nname: 'x'\nextra:\n  deep: 1\ndescription: |\n  does\n  things\n---\nbody\n---\nmore")
    assert fields == {"name": "x", "description": "does things"} and body == "body\n---\nmore"
    assert loaders.frontmatter("no\n---\n") == ({}, "no\n---\n")
    assert loaders.frontmatter("---\nname: n\ndescription: passes *args to R &D, a: *b\nnotes: |\n  *bold* text\n  &more\n---\n")[0] == {"name": "n", "description": "passes *args to R &D, a: *b"}
    for bad in ("a: &x 1", "a: *x", "- *x", "a: [1, *x]", "a:\n  - k: &y 2", "a: {b: &c 1}", "\n".join(" " * i + "k:" for i in range(40)), "\n".join(["k: 1"] * 5000)):
        with pytest.raises(ValueError):
            loaders.frontmatter(f"---\n{bad}\n---\n")


def test_bm25_of_many_terms_joins(spark, monkeypatch):
    docs = spark.createDataFrame([(str(i), f"w{i % 7} w{i % 3} common") for i in range(60)] + [("e", ""), ("n", None)], "id string, content string")
    q = spark.createDataFrame([(1, "w1 w2"), (2, "common")], "query_id int, query string")
    plain = {tuple(r) for r in search.bm25(docs, q).collect()}
    monkeypatch.setattr(search, "few", lambda df: False)
    assert {tuple(r) for r in search.bm25(docs, q).collect()} == plain and len(plain) == 10


def test_joined_text_keeps_the_break_at_the_bound(spark):
    """A block that ends one character before the bound leaves room for the line break; one that ends at it does not."""
    rows = [("a", 0, "x" * 5), ("a", 1, "y" * 3), ("a", 2, "z"), ("b", 0, "x" * 10), ("b", 1, "y"), ("c", 0, "x" * 9), ("d", 0, "x" * 8), ("d", 1, None), ("d", 2, "y")]
    whole = {k: "\n".join(t or "" for b, _, t in rows if b == k) for k in "abcd"}
    found = {r.by: (r.text, r.truncated) for r in tools.joined_text(spark.createDataFrame(rows, "by string, n int, text string"), "by", "n", 10).collect()}
    assert found == {k: (t[:10], len(t) > 10) for k, t in whole.items()} and found["a"][0] == "xxxxx\nyyy\n"


@pytest.mark.parametrize("make", ["markdown", "vectors"])
def test_python_gets_bounded_batches(spark, make):
    """Pages, and pairs of blocks of vectors, come to Python in batches of bounded bytes, however many rows a partition has."""
    conf = {c: spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        for c in conf:
            spark.conf.unset(c)
        if make == "markdown":
            out = to_markdown(spark.range(40).select("id", F.concat(F.lit("<p>"), F.col("id")).alias("html")), "html")
        else:
            v = spark.range(40).select(F.col("id").cast("string").alias("id"), F.array(F.col("id").cast("double")).alias("embedding"))
            out = search.nearest(v, v.select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), top_k=1)
        assert out.count() == 40
        rows, size = (spark.conf.get(c) for c in conf)
        assert 0 < int(rows) <= 1000 and 0 < int(size.rstrip("bB")) <= 4 << 20
    finally:
        for c, v in conf.items():
            spark.conf.set(c, v)


@pytest.mark.parametrize("products", [1 << 20, 256])
def test_bm25_within_rows_is_that_of_the_join(spark, monkeypatch, products):
    """Scores added up within rows are those of postings joined to queries: filters, repeated terms, unknown terms, equal texts of many owners, blank and null texts; only the best rows of a task are shuffled."""
    docs = spark.createDataFrame([(str(i), f"w{i % 7} w{i % 3} w{i % 3} common" + " x" * (i % 11)) for i in range(300)] + [("t" + str(i), "same text") for i in range(50)] + [("e", ""), ("n", None)], "id string, content string")
    q = spark.createDataFrame([(1, "w1 w2 w1"), (2, "common"), (3, "nowhere"), (4, "same"), (5, ""), (None, "w0"), (7, "x text")], "query_id int, query string")
    monkeypatch.setattr(search, "PRODUCTS", products)
    for kw in ({}, {"where": F.col("id") > "2"}, {"where": F.col("id") > "2", "scoped_stats": True}, {"top_k": 400}):
        asked = lambda: {(r.query_id, r.id, r.rank, round(r.score, 9)) for r in search.bm25(docs, q, **kw).collect()}
        found = asked()
        with monkeypatch.context() as m:
            m.setattr(search, "WEIGHTS", 0)
            assert found == asked() and len(found) > 10
    assert "Join" not in search.bm25(docs, q)._jdf.queryExecution().executedPlan().toString()
