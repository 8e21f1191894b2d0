"""Repeated passages against brute force, and planted ones."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import linededup

SCHEMA = "doc_id long, text string, removed string, first string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "") for i, t in rows], SCHEMA)


def brute(rows, least):
    seen, out = set(), []
    for i, t in sorted({r for r in rows if r[0] is not None and r[1]}):
        run = []

        def close():
            if run and sum(len(w) for *_, w, _ in run) >= least:
                out.append((i, run[0][0], run[-1][1], sum(len(w) for *_, w, _ in run), len(run)))
            run.clear()

        for a, b in linededup.units_of(t):
            words = linededup.normal(t[a:b])
            if not words:
                continue
            if tuple(words) in seen:
                run.append((a, b, words, None))
            else:
                close()
            seen.add(tuple(words))
        close()
    return sorted(out)


def test_passages_match_brute_force(spark):
    rng = random.Random(1)
    bank = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(1, 12))).capitalize() + rng.choice(".!?") for _ in range(60)]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choices(bank, k=rng.randrange(1, 25)))) for i in range(80)]
    rows += [(None, rows[0][1]), (90, None), (91, ""), (92, "\n \n***"), rows[4], (93, "x" * 50_000), (94, "Word. " * 5000)]
    for least in (1, 20):
        found = linededup.repeated_passages(frame(spark, rows), min_words=least)
        assert sorted((r.doc_id, r.span_start, r.span_end, r.n_words, r.n_units) for r in found.collect()) == brute(rows, least)
    assert linededup.repeated_passages(frame(spark, rows).where("false")).count() == 0


def test_long_runs_take_linear_time():
    assert linededup.normal("a" + "-" * 200_000 + "b --x--") == ["a" + "-" * 200_000 + "b", "x"]
    text = "A\t" * 300_000
    assert list(linededup.units_of(text)) == [(0, len(text))]


def test_passage_within_a_line_is_found_and_cut(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(11) for _ in range(6))
    clean = [" ".join(sentence(9) for _ in range(12)) for _ in range(20)]
    split = lambda t: t.split(" ", 40)
    rows = [(i, t) for i, t in enumerate(clean)]
    for i in (3, 8, 15):
        parts = split(clean[i])
        rows[i] = (i, " ".join([*parts[:40], passage, parts[40]]))
    docs = frame(spark, rows)
    found = linededup.repeated_passages(docs)
    spans = {r.doc_id: r for r in found.collect()}
    assert set(spans) == {8, 15} and {r.first_doc_id for r in spans.values()} == {3}
    for i, r in spans.items():
        assert rows[i][1][r.span_start : r.span_end] in passage and r.n_words >= 55
    cut = {r.doc_id: r for r in linededup.without_passages(docs, found).collect()}
    for i, t in rows:
        expected = t if i not in spans else t[: spans[i].span_start] + t[spans[i].span_end :]
        assert cut[i].text == expected and len(cut[i].removed) == (i in spans)


def test_cutting_keeps_nulls_and_columns(spark):
    docs = frame(spark, [(1, None), (2, "abc"), (None, "z")])
    none = spark.createDataFrame([], "doc_id long, span_start int, span_end int, first_doc_id long")
    out = linededup.without_passages(docs, none)
    assert out.columns == ["doc_id", "text", "first", "removed"]
    assert sorted((r.text or "", len(r.removed)) for r in out.collect()) == [("", 0), ("abc", 0), ("z", 0)]
    assert linededup.without_passages(docs.where(F.lit(False)), none).count() == 0


def test_passages_from_mid_sentence_are_found(spark):
    """51 to 60 words that begin and end in mid-sentence, of sentences too long for whole ones to make up 30 words."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], {}
    for k in range(10):
        n = 51 + k
        words = text(n).split()
        words[20], words[44] = words[20] + ".", words[44] + "."  # one whole sentence, of 24 words
        passage = " ".join(words)
        for i in (2 * k, 2 * k + 1):
            head = f"{text(30 + i)}. {text(7)} "
            rows.append((i, head + passage + f" {text(9)}. {text(25)}."))
            planted[i] = (len(head), len(head) + len(passage), n)
    docs = frame(spark, [*rows, (None, rows[0][1]), rows[1], (50, None), (51, "")])
    assert linededup.repeated_passages(docs).count() == 0
    found = {r.doc_id: r for r in linededup.repeated_passages(docs, verbatim=True).collect()}
    assert set(found) == set(range(1, 20, 2))
    for i, r in found.items():
        assert (r.span_start, r.span_end, r.n_words) == planted[i] and r.first_doc_id == i - 1


def test_hashes_and_words_are_those_of_normal():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abİΣ\u03c3.,-_'1\u0300 \n\x1c\x85\u3000\U0001d4b3") for _ in range(rng.randrange(80))) for _ in range(500)]
    for t in texts:
        expected = [(w[0], m.span()) for m in re.finditer(r"\S+", t) if (w := linededup.normal(m[0]))]
        hashes, starts, ends = linededup.words_of(t)
        assert hashes.tolist() == linededup.hashes_of([w for w, _ in expected]).tolist()
        assert list(zip(starts.tolist(), ends.tolist())) == [s for _, s in expected]
    assert linededup.hashes_of(["--", "a.b", "_a.b!"]).tolist()[0] == 0 and len(set(linededup.hashes_of(["a.b", "_a.b!", "«a.b»"]).tolist())) == 1


def test_grams_of_many_texts_are_those_of_each():
    rng, (least, window) = np.random.default_rng(6), (linededup.GRAM, linededup.WINDOW)
    sizes = [0, 1, least, least + window - 2, least + window - 1, 40, 0, 3, 500, 29, 31]
    texts = [rng.integers(1, 1 << 63, n).astype(np.uint64) for n in sizes]
    found, digests = linededup.grams_of(np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes))
    expected, begin = [], 0
    for h in texts:
        places, own = linededup.grams_of(h, np.zeros(len(h), np.int64))
        expected += [(begin + p, *d) for p, d in zip(places.tolist(), own.tolist())]
        begin += len(h)
    assert len(expected) > 50 and [(p, *d) for p, d in zip(found.tolist(), digests.tolist())] == expected


@pytest.mark.parametrize("scale, packed", [(1, True), (1 << 40, False)])
def test_first_places_are_found_without_a_sort(spark, scale, packed):
    rng = random.Random(7)
    rows = [((rng.randrange(40) - 20) * scale, rng.randrange(50), bytes([rng.randrange(250)]) * 16) for _ in range(600)]
    rows += [(5 * scale, (1 << 31) - 1, b"x" * 16), (-20 * scale, (1 << 31) - 1, b"x" * 16), (3, 3, b"y" * 16), (3, 3, b"y" * 16)]
    found = linededup.first_places(spark.createDataFrame(rows, "doc long, idx int, digest binary"))
    places = {}
    for doc, idx, digest in rows:
        places.setdefault(digest, set()).add((doc, idx))
    assert {bytes(r.digest): tuple(r.f) for r in found.collect()} == {d: min(p) for d, p in places.items() if len(p) > 1}
    assert ("SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()) == packed
    assert linededup.first_places(spark.createDataFrame([], "doc long, idx int, digest binary")).count() == 0
