"""Near-duplicates, the classifier and the pipeline against brute force, and on odd tables."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import classifier, neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts):
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(len(sets[i]), root(i)) for i in range(len(texts))]


def varied(rng, base, share):
    return [w if rng.random() > share else f"v{rng.randrange(10**6)}" for w in base]


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "one", "ONE", "a b c d", "a b c d e", "A b C d e", "É é É é É", "é é é é é"]
    for size in (6, 12, 40, 150, 700):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts += [" ".join(base).upper()] + [" ".join(varied(rng, base, s)) for s in (0, 0.01, 0.02, 0.03, 0.05, 0.08) for _ in range(6)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 80))) for _ in range(40)]
    chain = [f"c{i}" for i in range(60)]
    for k in range(12):  # each is near the one before, the ends are far apart
        texts.append(" ".join(chain))
        chain = [*chain[4:], *(f"d{k}x{i}" for i in range(4))]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"list_rows": 2, "block_rows": 8}), (3, {"list_rows": 2, "block_rows": 16, "wide_k": 64})])
def test_components_are_exact(spark, seed, options):
    texts = corpus(seed)
    found = neardup.near_duplicates(frame(spark, texts), near=neardup.Near(**options))
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)
    assert found.where("kept <> (doc_id = component_id)").count() == 0


def test_rows_without_id_and_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    docs = frame(spark, [(7, t), (7, t), (None, t), (9, t), (10, None)])
    out = sorted((r.doc_id or -1, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert out == [(-1, None, True), (7, 7, True), (7, 7, True), (9, 7, False), (10, 10, True)]
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def test_label_propagation_of_long_chains(spark):
    links = spark.createDataFrame([(i.to_bytes(2, "big"), (i + 1).to_bytes(2, "big")) for i in range(60) if i != 29], "a binary, b binary")
    out = {bytes(r.node): bytes(r.label) for r in neardup.components(links).collect()}
    assert {int.from_bytes(v, "big") for v in out.values()} == {0, 30} and len(out) == 61


def test_isotonic_is_the_monotone_fit():
    rng = np.random.default_rng(0)
    y, n = rng.random(60) * 5, rng.integers(1, 9, 60).astype(float)
    fit = classifier.isotonic(y * n, n)
    assert (np.diff(fit) >= -1e-12).all() and fit @ n == pytest.approx((y * n).sum())
    # optimality: between jumps, the running sums of the residuals never fall below zero
    assert np.cumsum(n * (y - fit)).min() > -1e-9


def test_classifier_on_held_out_rows(spark, sf):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = classifier.classify(docs, labels)
    rows = out.join(labels, "doc_id").toPandas()
    assert (out.toPandas().doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1) == out.toPandas().held_out).all()
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()


def test_held_out_labels_are_not_looked_at(spark):
    docs = frame(spark, [f"{'*** ' * (i % 2)}some text number {i} with words" * 3 for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2 ^ 1) for i in range(60)], "doc_id long, quality int")
    wrong = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ([r.score for r in classifier.classify(docs, x).orderBy("doc_id").collect()] for x in (labels, wrong))
    assert a == b


def test_classifier_on_odd_tables(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "x"), (3, "y" * 100_000), (3, "again")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = classifier.classify(docs, none)
    assert {r.score for r in out.collect()} == {0.5} and out.count() == 5
    some = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0), (3, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in classifier.classify(docs, some).collect())
    assert classifier.classify(docs.where("false"), some).count() == 0


def test_pipeline_stages_keep_their_promises(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "minhash_near_dedup":
            texts = [r.text for r in docs.orderBy("doc_id").collect()]
            assert len({c for _, c in brute(texts)}) == len(texts) <= before.count()
        if name == "pii_surrogates":
            assert docs.count() == before.count()
            assert docs.where(r"text rlike '@mail[0-9]+[.]example'").count() == 0
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_of_odd_documents(spark, sf):
    import corpus_pipeline as cp

    docs = frame(spark, [(1, None), (2, ""), (None, "text without id " * 9), (4, "z" * 70_000)]).withColumn("extra", F.lit(1))
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
    docs.collect()
    empty = frame(spark, []).where("false")
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_ridge_is_what_one_matrix_gives(spark):
    """The partitions' packed sums against the normal equations of all rows at once."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, len(classifier.NAMES)))
    y = (x[:, 0] + 0.3 * x[:, 3] > 0).astype(int)
    rows = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y)] + [(None, 1), (x[0].tolist(), None)], "x array<double>, y int").repartition(7)
    m = classifier.fit(rows, size=40, ridge=0.5)
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.scale, x.std(0))
    z = m.features(x)
    penalty = np.diag([1e-9] + [0.5] * 40)
    assert np.allclose(m.beta, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-8)
    raw = z @ m.beta
    bins = np.clip(((raw + 0.5) * classifier.BINS / 2).astype(int), 0, classifier.BINS - 1)
    count, positive = np.bincount(bins, minlength=classifier.BINS), np.bincount(bins, y, classifier.BINS)
    fit = classifier.isotonic(positive[count > 0], count[count > 0])
    assert np.all(np.diff(fit) >= 0) and m.levels.shape == fit.shape and np.all(np.abs(m.levels - fit) <= 0.005 + 1e-9)


def test_pipeline_takes_out_rows_not_ids(spark, sf):
    """One id with two texts keeps the text that is no copy; of repeated rows one stays; rows without id are judged too."""
    import corpus_pipeline as cp

    rng = np.random.default_rng(2)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, 5000, 60))
    a, b, c = text(), text(), text()
    docs = frame(spark, [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c), (None, a), (None, text()), (7, ""), (7, "")])
    left = sorted((r.doc_id is None, r.doc_id or 0, r.text[:5]) for r in cp.near_dedup(spark, docs, sf).collect())
    assert [x[:2] for x in left] == [(False, 1), (False, 2), (False, 3), (False, 7), (False, 7), (True, 0)]
    assert (False, 2, b[:5]) in left


def test_pipeline_keeps_columns_of_any_name(spark, sf):
    import corpus_pipeline as cp

    docs = frame(spark, [(k, f"text number {k} " * 20) for k in range(8)] + [(3, "text number 3 " * 20)])
    for name in ("_text", "_text_", "_gone_0", "_again_1", "_row", "kept", "score"):
        docs = docs.withColumn(name, F.lit("mine"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert {tuple(r)[5:] for r in out.collect()} <= {("mine",) * 7}, name
        assert out.count() > 0
