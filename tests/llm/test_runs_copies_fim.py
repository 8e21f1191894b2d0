"""Periodic runs, exact copies and fill-in-the-middle against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.llm import exactdedup, fim, periodic

ODD = [None, "", " \t\n", "a", "\x00\x1c\x85", "é" * 50_000, "no space " * 20_000, "x" * 120_000, "same same same " * 10, "🎉 emoji 🎉", "a <P> b", "mark <M", "w w w"]
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute_runs(w, least_words=24, least_periods=3):
    out = set()
    for q in range(1, len(w) // least_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_words, least_periods * q) and not any((i, j + q - i, p) in out or shorter(w, i, j + q, p) for p in range(1, q)):
                out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def shorter(w, start, end, p):
    return all(w[k] == w[k + p] for k in range(start, end - p))


class Word:
    """A word that counts how often words are compared, and has no hash."""

    compared = 0
    __hash__ = None

    def __init__(self, v):
        self.v = v

    def __eq__(self, o):
        Word.compared += 1
        return self.v == o.v

    def __lt__(self, o):
        Word.compared += 1
        return self.v < o.v


def some_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(70)
    w = [rng.randrange(k) for _ in range(n)]
    return w if rng.random() < 0.5 else w[: n // 2] + w[: rng.randrange(1, 7)] * rng.randrange(1, 12) + w[: rng.randrange(9)]


def test_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(4000):
        w = some_words(rng)
        for words, periods in ((3, 3), (24, 3), (8, 4)):
            assert periodic.runs_of(w, words, periods) == brute_runs(w, words, periods)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_comparisons_grow_with_the_text_only():
    rng = random.Random(2)
    for n in (3_000, 30_000):
        hard = [[0] * n, fibonacci(n), [i.bit_count() & 1 for i in range(n)], ([0] * (n // 10) + [1]) * 10, [rng.randrange(2) for _ in range(n)], [rng.randrange(9) for _ in range(n // 3)] * 3]
        hard.append([x for k in range(1, int((2 * n) ** 0.5)) for x in [0] * k + [1]])
        for w in hard + [w[::-1] for w in hard] + [[-x for x in w] for w in hard]:
            Word.compared = 0
            periodic.runs_of([Word(x) for x in w])
            assert Word.compared <= 16 * len(w)


def planted(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def test_op13_matches_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(f"w{x}" for x in some_words(rng)) for _ in range(300)] + ["\n\t".join(f"v{x}" for x in some_words(rng) * 3) for _ in range(60)] + [t for t in ODD if t is None or len(t) < 1000]
    rows = [*enumerate(texts), (None, "a b " * 20), (7, texts[7])]
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for doc_id, text in rows:
        w = planted(doc_id, text)
        runs = brute_runs(w)
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        expected.append((doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    found = periodic.op13_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    assert sum(e[1] for e in expected) > 100


def test_runs_on_odd_tables(spark):
    docs = spark.createDataFrame([(i, t, "clash", "c") for i, t in enumerate(ODD)], "doc_id long, text string, runs string, extra string")
    found = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert len(found) == len(ODD) and found[6].runs[0].asDict() == {"start": 0, "length": 40_000, "period": 2} and found[6].collapsed == "no space"
    assert found[0].collapsed == found[2].collapsed == "" and found[0].text is None and found[4].collapsed == ODD[4]
    assert periodic.periodic_runs(docs.where("false")).columns == ["doc_id", "text", "extra", "runs", "collapsed"]
    assert periodic.periodic_runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, least_periods=2)


def test_a_cut_is_where_the_units_say(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["word", "Ab", " ", "\n", "é", "🎉", "<", "P", ">", "S", "9"], k=rng.randrange(40))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, 5, "clash") for i, t in enumerate(ODD + texts)] + [(None, "no id at all", 5, "")], "doc_id long, text string, n int, form string")
    out = fim.fill_in_middle(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    texts, forms = dict(enumerate(ODD + texts)) | {None: "no id at all"}, set()
    for r in back:
        t = texts[r.doc_id] or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
        digest = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            expected = ("plain", None, None, t)
        elif h[3] % 100 < 20:
            expected = ("spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
        else:
            expected = ("psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) == (len(units), *expected, t)
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.where("false")).count() == 0
    assert {r.form for r in fim.fill_in_middle(docs, rate=0).collect()} == {"plain"}


def copies(rows, keep):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(t or "", []).append((i, k))
    out = []
    for t, ids in groups.items():
        known = [i for i, _ in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        stays = next(k for i, k in ids if i == best)
        out += [(i, best, len(ids), k == stays, hashlib.sha256(t.encode()).hexdigest()) for i, k in ids]
    return sorted(map(repr, out))


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("heavy", [False, True])
def test_copies_match_brute_force(spark, keep, heavy):
    rng = random.Random(5)
    texts = ODD + [f"some head that many share {rng.randrange(60)}" for _ in range(200)]
    rows = [*enumerate(texts), (None, "a"), (None, None), (None, "alone"), (None, "alone"), (3, "a"), (3, "a"), (3, "b")]
    if heavy:  # two texts of a third of the rows each
        rows += [(1000 + i, ("hot " * 30, None)[i % 2]) for i in range(900)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, kept int, hash string").repartition(6)
    assert exactdedup.content_sorted(docs, "doc_id", "text", None, keep, [])[1] == heavy
    found = exactdedup.exact_duplicates(docs, keep=keep, carried=("hash", "kept"))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "hash"]
    assert sorted(repr(tuple(r)[:5]) for r in found.collect()) == copies(rows, keep)
    left = exactdedup.without_copies(docs, keep=keep)
    assert left.columns == docs.columns
    alive = sorted(repr((r.doc_id, r.text or "")) for r in left.collect())
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", []).append(i)
    pick = lambda ids: (max if keep == "largest" else min)([i for i in ids if i is not None], default=None)
    assert alive == sorted(repr((pick(ids), t)) for t, ids in by_text.items())


def test_copies_after_a_normalisation(spark):
    docs = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    plain = lambda t: F.lower(F.regexp_replace(t, " +", " "))
    assert {(r.doc_id, r.kept) for r in exactdedup.exact_duplicates(docs, normalise=plain, keep="smallest").collect()} == {(1, True), (2, False), (3, True)}
    assert {r.text for r in exactdedup.without_copies(docs, normalise=plain, keep="smallest").collect()} == {"A  b", "c"}
    assert exactdedup.exact_duplicates(docs.where("false")).count() == exactdedup.without_copies(docs.where("false")).count() == 0


@pytest.mark.parametrize("heavy", [False, True])
def test_the_sort_is_the_only_exchange(spark, heavy):
    docs = spark.createDataFrame([(i, f"text {i * (i < 50)}") for i in range(500 if heavy else 50)], "doc_id long, text string")
    found, spread = exactdedup.content_sorted(docs, "doc_id", "text", None, "largest", [])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert spread == heavy and plan.split("Initial Plan")[-1].count("Exchange rangepartitioning") == plan.split("Initial Plan")[-1].replace("BroadcastExchange", "").count("Exchange ") == 1 and "Python" not in plan and "Arrow" not in plan
