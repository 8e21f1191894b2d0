"""Top-k search and source mixing against brute force, and on odd tables."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.llm import mixing, topk

VECTORS = "vec_id long, embedding array<float>, query_id string, score int"


def brute(rows, k, scale=256):
    fine = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.setdefault(i, set()).add(tuple(math.floor(scale * float(np.float32(x))) for x in v))
    out = set()
    for q, qs in fine.items():
        if q % 50:
            continue
        best = {}
        for c, cs in fine.items():
            if c != q:
                best[c] = max(sum(a * b for a, b in zip(x, y)) for x in qs for y in cs)
        for n, c in enumerate(sorted(best, key=lambda c: (-best[c], c))[:k], 1):
            out.add((q, n, c, best[c]))
    return out


@pytest.mark.parametrize("lists, block, seed", [(1, 7, 0), (2, 50, 1), (4, 16, 2), (5, 4096, 3)])
def test_top_k_is_exact(spark, lists, block, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=6), 1)], "x", 1) for i in range(160)]
    rows += [(200 + i, rows[3][1], "copy", 1) for i in range(30)]
    rows += [(None, rows[0][1], "", 0), (300, None, "", 0), (301, [1.0, None] + [0.0] * 4, "", 0), (302, [float("nan")] + [0.0] * 5, "", 0), (303, [float("inf")] + [0.0] * 5, "", 0), rows[5], (400, [0.0] * 6, "", 0)]
    df = spark.createDataFrame(rows, VECTORS)
    found = topk.top_k(df, df.where("vec_id % 50 = 0"), lists=lists, block_rows=block, query_rows=3)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()} == brute(rows, 5)


def test_top_k_of_few_or_none(spark):
    few = spark.createDataFrame([(0, [1.0], "", 0), (1, [2.0], "", 0)], VECTORS)
    assert [(r.vec_id, r.score) for r in topk.top_k(few, few.where("vec_id = 0")).collect()] == [(1, 256 * 512)]
    assert topk.top_k(few.where("false"), few.where("false")).count() == 0


DOCS = "doc_id long, source string, text string, epoch string, n_tokens string, lang string"
CLASH = ("cut", "epochs", "blocks", "rest", "tokens", "row", "block", "all")


def shares(spark, docs, **options):
    rows = mixing.mix(docs, **options).collect()
    out = {}
    for r in rows:
        out.setdefault(r.source, []).append(r)
    return out


def test_mixture_meets_budget_and_limit(spark):
    rows = [(i, "big" if i % 10 else "small", " ".join(["w"] * (1 + i % 7)), "", "", "") for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS)
    total = {s: sum(1 + i % 7 for i, x, *_ in rows if x == s) for s in ("big", "small")}
    found = shares(spark, docs, repetition=2.0)
    tokens = {s: sum(r.n_tokens for r in x) for s, x in found.items()}
    assert abs(tokens["small"] - 2 * total["small"]) <= 8
    assert abs(sum(tokens.values()) - sum(total.values())) <= 16
    # whole epochs hold every document once, the last one its first places
    for s, x in found.items():
        by_epoch = {}
        for r in x:
            by_epoch.setdefault(r.epoch, []).append(r)
        last = max(by_epoch)
        assert all(len({r.doc_id for r in v}) == len(v) for v in by_epoch.values())
        assert all(len(v) == sum(1 for i in rows if i[1] == s) for e, v in by_epoch.items() if e < last)
    assert {(r.doc_id, r.epoch, r.place) for x in found.values() for r in x} == {(r.doc_id, r.epoch, r.place) for r in mixing.mix(docs, repetition=2.0).collect()}


def test_entropy_target(spark):
    rows = [(i, f"s{min(i % 16, 3)}", "w", "", "", "") for i in range(3200)]
    docs = spark.createDataFrame(rows, DOCS)
    found = shares(spark, docs, entropy=0.9, repetition=None)
    p = np.array([sum(r.n_tokens for r in x) for x in found.values()], float)
    p /= p.sum()
    assert -(p * np.log(p)).sum() / np.log(4) == pytest.approx(0.9, abs=0.01)


def test_odd_documents_to_mix(spark):
    rows = [(1, None, None, "", "", ""), (2, "a", "", "", "", ""), (2, "a", "", "", "", ""), (None, "a", "x " * 5000, "", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(docs, repetition=1.0)
    assert out.columns == ["doc_id", "source", "text", "lang", "epoch", "place", "n_tokens"]
    assert out.count() == 4
    assert mixing.mix(docs.where("false")).count() == 0
    joined = mixing.mix(docs, repetition=1.0, broadcast_rows=0)
    assert joined.count() == 4


def test_sources_of_equal_size_stay_whole(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "a b", "", "", "") for i in range(30)], DOCS)
    assert mixing.mix(docs, repetition=1.0).count() == 30


def test_clashing_names_pass_through(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "a b", "", "", "") for i in range(30)], DOCS)
    for name in CLASH:
        docs = docs.withColumn(name, F.lit(name))
    out = mixing.mix(docs, repetition=1.0)
    assert out.count() == 30 and {tuple(r[c] for c in CLASH) for r in out.collect()} == {CLASH}


def test_top_k_of_huge_components(spark):
    """Beyond what float64 and a long can hold: exact where a long can hold the score, else the end of its range."""
    rows = [(0, [3.0e6, 1.0], "", 0), (1, [2.9e6, 5.0], "", 0), (2, [2.9e6, 4.0], "", 0), (3, [1e30, 0.0], "", 0), (4, [-1e300, 0.0], "", 0), (5, [0.0, 0.0], "", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string, score int")
    found = [(r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    big = lambda a, b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))
    assert found == [(3, 2**63 - 1), (1, big(rows[0][1], rows[1][1])), (2, big(rows[0][1], rows[2][1])), (5, 0), (4, -(2**63))]


def test_mixture_is_what_sorting_gives(spark):
    """Each source's last epoch against its rows sorted by their place, its power against bisection."""
    rng = np.random.default_rng(3)
    rows = [(int(i), ["a", "b", None, "c"][int(rng.choice(4, p=[0.7, 0.2, 0.06, 0.04]))], " ".join(["w"] * int(rng.integers(0, 12))), "", "", "") for i in range(900)]
    rows += [(5, "a", "same text twice", "", "", "")] * 40
    docs = spark.createDataFrame(rows, DOCS)
    budget, limit, seed = 3000, 1.5, 29
    size = lambda t: max(1, len(t.split()))
    tokens = {}
    for _, s, t, *_ in rows:
        tokens[s] = tokens.get(s, 0) + size(t)
    whole = sum(tokens.values())

    def epochs(power):
        z = sum((n / whole) ** power for n in tokens.values())
        return {s: (n / whole) ** power / z * budget / n for s, n in tokens.items()}

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if max(epochs(mid).values()) <= limit else (mid, hi)
    wanted = {s: min(limit, e) for s, e in epochs(hi).items()}
    expected = []
    for s, e in wanted.items():
        full = math.floor(e + 1e-9)
        own = docs.where(F.col("source").eqNullSafe(s)).select("doc_id", "text", mixing.place(seed, F.lit(full), F.xxhash64(F.struct("doc_id", "text"))).alias("p")).collect()
        rest, upto = int((e + 1e-9) % 1 * tokens[s]), 0
        expected += [(r.doc_id, n) for r in own for n in range(full)]
        places = sorted({r.p for r in own}) if rest else []
        for p in places:
            if upto >= rest:
                break
            held = [r for r in own if r.p == p]
            upto += sum(size(r.text) for r in held)
            expected += [(r.doc_id, full) for r in held]
    found = [(r.doc_id, r.epoch) for r in mixing.mix(docs, budget=budget, repetition=limit, seed=seed).collect()]
    assert sorted(found) == sorted(expected)
