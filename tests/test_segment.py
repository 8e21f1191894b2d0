"""Word segmentation by a learned vocabulary, against exhaustive search."""

import itertools
import math
import random

from pyspark.sql import functions as F

from tessera.operators import scope, search, segment
from tessera.operators.keyword_index import KeywordIndex
from tessera.sources.versioned import VersionedStore

WORDS = ["北京", "大学", "学生", "東京", "図書館", "研究", "データ", "检索", "我们", "喜欢", "苹果", "すし", "の", "在", "了"]


def cuts(run):
    for k in range(len(run)):
        for at in itertools.combinations(range(1, len(run)), k):
            ends = [0, *at, len(run)]
            yield [run[a:b] for a, b in zip(ends, ends[1:])]


def test_cuts_are_the_best_of_all():
    rng = random.Random(1)
    for _ in range(300):
        letters = "abc"[: rng.choice([2, 3])]
        logp = {"".join(rng.choices(letters, k=rng.randrange(1, 5))): -rng.random() * 9 for _ in range(12)}
        run = "".join(rng.choices(letters + "z", k=rng.randrange(1, 10)))
        price = lambda c: sum(logp.get(p, -20.0 if len(p) == 1 else -math.inf) for p in c)
        found = segment.cut(run, logp, 4, -20.0)
        assert "".join(found) == run and math.isclose(price(found), max(map(price, (c for c in cuts(run) if all(len(p) <= 4 for p in c)))))


def test_expected_counts_are_sums_over_all_cuts():
    rng = random.Random(2)
    for _ in range(60):
        logp = {"".join(rng.choices("ab", k=rng.randrange(1, 4))): -rng.random() * 4 for _ in range(7)} | {"a": -2.0, "b": -1.0}
        run, into = "".join(rng.choices("ab", k=rng.randrange(1, 9))), {}
        segment.expected(run, 3.0, logp, 3, into)
        fine = [c for c in cuts(run) if all(p in logp for p in c)]
        mass = [math.exp(sum(logp[p] for p in c)) for c in fine]
        for piece in set(itertools.chain(*fine)):
            assert math.isclose(into[piece], 3.0 * sum(m * c.count(piece) for c, m in zip(fine, mass)) / sum(mass), rel_tol=1e-9)


def corpus(spark, n=400):
    rng = random.Random(3)
    rows = [(str(i), "。".join("".join(rng.choices(WORDS, k=rng.randrange(2, 7))) for _ in range(4))) for i in range(n)]
    return spark.createDataFrame(rows, "id string, content string"), dict(rows)


def test_words_are_found_again(spark):
    docs, _ = corpus(spark)
    vocabulary = segment.learned(docs)
    terms = segment.segmenter(vocabulary)
    found = spark.createDataFrame([("我们喜欢北京大学的Café了",), ("東京の図書館 ÀÉŌ ｶﾀｶﾅ がぎ",), (None,), ("",)], "t string").select(terms(F.col("t")).alias("w")).collect()
    assert found[0].w == ["我们", "喜欢", "北京", "大学", "的", "cafe", "了"]
    assert found[1].w[:3] == ["東京", "の", "図書館"] and found[1].w[3] == "aeo" and "".join(found[1].w[4:]) == "カタカナがぎ"
    assert found[2].w == found[3].w == []
    share = sum(math.exp(r.logp) for r in vocabulary.collect())
    assert math.isclose(share, 1.0, rel_tol=1e-6)
    assert segment.learned(docs.where("false")).count() == 0 and segment.learned(docs, pattern="q+").count() == 0


def test_queries_hit_inside_runs(spark, tmp_path):
    docs, texts = corpus(spark)
    asked = spark.createDataFrame([(1, "図書館"), (2, "苹果 北京")], "query_id int, query string")
    assert search.bm25(docs, asked, top_k=None).count() == 0  # a run is one term
    terms = segment.segmenter(segment.learned(docs))
    found = {(r.query_id, r.id) for r in search.bm25(docs, asked, top_k=None, terms=terms).collect()}
    for k, words in ((1, ["図書館"]), (2, ["苹果", "北京"])):
        hit, hold = {i for q, i in found if q == k}, {i for i, t in texts.items() if any(w in t for w in words)}
        # a word may hide in a longer piece that the corpus holds by chance
        assert hit <= hold and len(hit) >= 0.97 * len(hold)
    index = KeywordIndex(VersionedStore(spark, f"file://{tmp_path}/s"), "kw", terms=terms)
    index.upsert(scope.scoped(docs, base="rag"))
    plain = sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in search.bm25(docs, asked, terms=terms).collect())
    assert sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in index.search(asked).collect()) == plain


def test_many_runs_at_once_are_counted_and_cut_as_one_by_one():
    rng = random.Random(4)
    for _ in range(40):
        logp = {"".join(rng.choices("ab北😀", k=rng.randrange(1, 5))): -rng.choice([1.0, 2.0, 3.5, rng.random() * 9]) for _ in range(14)}
        runs = ["".join(rng.choices("ab北😀z" if rng.random() < 0.3 else "ab北😀", k=rng.randrange(1, 25))) for _ in range(30)]
        weights, into, pieces = [rng.randrange(1, 9) for _ in runs], {}, segment.Pieces(logp)
        for run, n in zip(runs, weights):
            segment.expected(run, n, logp, 4, into)
        assert all(math.isclose(x, into.get(p, 0.0), rel_tol=1e-9, abs_tol=1e-12) for p, x in zip(pieces.names, pieces.expected(runs, weights, 4)))
        assert pieces.cuts(runs, 4, -20.0) == [segment.cut(run, logp, 4, -20.0) for run in runs]
    assert segment.Pieces({}).cuts(["ab", "c"], 4, -10.0) == [["a", "b"], ["c"]]


def test_substrings_are_counted_for_all_runs_at_once():
    rng = random.Random(6)
    runs = ["".join(rng.choices("ab北😀", k=rng.randrange(1, 12))) for _ in range(50)]
    counts, wanted, found = [rng.randrange(1, 9) for _ in runs], {}, {}
    for run, n in zip(runs, counts):
        for i, k in itertools.product(range(len(run)), range(1, 5)):
            if i + k <= len(run):
                wanted[run[i : i + k]] = wanted.get(run[i : i + k], 0) + n
    for batch in segment.substring_counts(runs, counts, 4):
        found |= dict(zip(*(c.to_pylist() for c in batch.columns)))
    assert found == wanted and not any(b.num_rows for b in segment.substring_counts([], [], 4))
