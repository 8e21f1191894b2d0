"""Words of scripts that set no spaces, by a unigram vocabulary learned from the corpus.

The vocabulary starts from substrings that runs of such a script have in common and that occur far more often than any two parts of them would meet by chance (likelihood alone would
take ever longer pieces). It is fitted by expectation and maximisation: each round takes what every piece is expected to count
over all ways to cut the runs, and leaves out pieces that hardly occur in them. A run is then cut where the product of its pieces' probabilities is largest.
The corpus stays distributed: runs are counted first, equal ones are looked at once, and rounds exchange sums by piece. The vocabulary is bounded and goes to every task.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import materialize, spread_out

#: Characters of scripts without spaces: Han, kana and their marks.
WIDE_CLASS = "\\u3005-\\u3007\\u3041-\\u3096\\u30A1-\\u30FA\\u30FC\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF"
RUN = f"[{WIDE_CLASS}]+"
#: Characters of the longest piece, how often one has to occur, how many times as often as its parts would meet by chance, pieces of more than one character, rounds, and the expected count
#: below which a piece is left out.
LONGEST, LEAST_COUNT, COHESION, VOCABULARY, ROUNDS, LEAST_EXPECTED = 6, 5, 5.0, 50_000, 4, 0.5
#: Characters of runs whose substrings a task counts before it gives them out, and those whose cuts it looks at together.
HELD, LETTERS = 1 << 21, 1 << 19


def folded(text: str) -> str:
    """Lower case and compatible forms, without the marks on letters; marks of kana and Hangul belong to the letter and stay."""
    out: list[str] = []
    for c in unicodedata.normalize("NFKD", text.lower()):
        if unicodedata.category(c) != "Mn" or c in "゙゚":
            out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def runs(docs: DataFrame, text: str = "content", pattern: str = RUN) -> DataFrame:
    """run, n: the runs of a pattern in all texts, and how often each occurs."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(0))
    return docs.select(F.explode(found).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


def substring_counts(runs: list[str], counts: list[int], longest: int) -> Iterator[pa.RecordBatch]:
    """piece, n: how often each substring of up to `longest` characters stands in the runs; a substring is known by the one without its last character, and that."""
    text, size = "".join(runs), np.array([len(r) for r in runs], int)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    room, weight = np.repeat(np.cumsum(size), size) - np.arange(len(codes)), np.repeat(np.array(counts, float), size)
    known, live = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for k in range(1, longest + 1):
        live = live[room[live] >= k]
        found, pieces = pd.factorize(known[live] * 0x110000 + codes[live + k - 1])
        known[live], first = found, np.zeros(len(pieces), int)
        first[found] = live
        n = np.bincount(found, weight[live], len(pieces)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([text[i : i + k] for i in first.tolist()], pa.string()), pa.array(n)], names=["piece", "n"])


def substrings(counted: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT) -> DataFrame:
    """piece, n: the substrings of up to `longest` characters that occur `least` times in the runs (run, n) or more, and all single characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, counts, size = [], [], 0
        for batch in batches:
            texts, n = (c.to_pylist() for c in batch.columns)
            for own in in_turns(texts):
                runs, counts, size = runs + texts[own], counts + n[own], size + sum(map(len, texts[own]))
                if size >= HELD:
                    yield from substring_counts(runs, counts, longest)
                    runs, counts, size = [], [], 0
        yield from substring_counts(runs, counts, longest)

    pieces = spread_out(counted.select("run", F.col("n").cast("long").alias("n")).where("run IS NOT NULL")).mapInArrow(run, "piece string, n long")
    return pieces.groupBy("piece").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.char_length("piece") == 1))


def cohesive(pieces: DataFrame, least: float = COHESION) -> DataFrame:
    """Of pieces (piece, n, with all their substrings) those of several characters that occur `least` times as often as by chance, however they are cut in two."""
    letters = pieces.where(F.char_length("piece") == 1).agg(F.sum("n").alias("letters"))
    several = pieces.where(F.char_length("piece") > 1)
    at = several.select("piece", "n", F.explode(F.sequence(F.lit(1), F.char_length("piece") - 1)).alias("at"))
    at = at.select("piece", "n", F.expr("substring(piece, 1, at)").alias("a"), F.expr("substring(piece, at + 1)").alias("b"))
    met = at.join(pieces.select(F.col("piece").alias("a"), F.col("n").alias("n_a")), "a").join(pieces.select(F.col("piece").alias("b"), F.col("n").alias("n_b")), "b")
    chance = met.groupBy("piece", "n").agg(F.max(F.col("n_a") * F.col("n_b").cast("double")).alias("parts"))
    return chance.crossJoin(F.broadcast(letters)).where(F.col("n") * F.col("letters") >= least * F.col("parts")).select("piece", "n")  # one row of letters


def expected(run: str, weight: float, logp: dict[str, float], longest: int, into: dict[str, float]) -> None:
    """Adds to `into` how often each piece is expected in a run, over all ways to cut it."""
    n = len(run)
    edges = [[(k, logp[run[k:i]]) for k in range(max(0, i - longest), i) if run[k:i] in logp] for i in range(n + 1)]
    ahead = [0.0] + [-math.inf] * n
    for i in range(1, n + 1):
        ahead[i] = log_sum([ahead[k] + p for k, p in edges[i]])
    behind = [-math.inf] * n + [0.0]
    for i in range(n, 0, -1):
        for k, p in edges[i]:
            behind[k] = log_sum([behind[k], behind[i] + p])
    if ahead[n] == -math.inf:
        return
    for i in range(1, n + 1):
        for k, p in edges[i]:
            piece = run[k:i]
            into[piece] = into.get(piece, 0.0) + weight * math.exp(ahead[k] + p + behind[i] - ahead[n])


def log_sum(values: list[float]) -> float:
    most = max(values, default=-math.inf)
    return most if most == -math.inf else most + math.log(sum(math.exp(v - most) for v in values))


class Pieces:
    """The vocabulary as a table of prefixes, for many runs at once: numpy steps from character to character of all of them."""

    def __init__(self, logp: dict[str, float]):
        self.names, self.logp = list(logp), np.array(list(logp.values()), float)
        nodes, keys, pieces = {"": 0}, [], [-1]
        for n, piece in enumerate(self.names):
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    keys.append(nodes[piece[: k - 1]] * 0x110000 + ord(piece[k - 1]))
                    nodes[piece[:k]] = len(nodes)
                    pieces.append(-1)
            pieces[nodes[piece]] = n
        self.keys, self.piece_of, self._index = np.array(keys, np.int64), np.array(pieces), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}

    def at(self, runs: list[str], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs, the longest first: their lengths, where each starts, and for each length and first character the piece that stands there, or -1."""
        if self._index is None:
            self._index = pd.Index(self.keys)
        codes = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(r) for r in runs])
        start = np.cumsum(size) - size
        room = np.repeat(start + size, size) - np.arange(len(codes))
        found, node, live = np.full((longest, len(codes)), -1), np.zeros(len(codes), np.int64), np.arange(len(codes))
        for k in range(longest):
            live = live[room[live] > k]
            met = self._index.get_indexer(node[live] * 0x110000 + codes[live + k])
            live, met = live[met >= 0], met[met >= 0]
            node[live] = met + 1
            found[k, live] = self.piece_of[met + 1]
        return size, start, found

    def expected(self, runs: list[str], weights: list[float], longest: int) -> np.ndarray:
        """How often each piece is expected in the runs, as `expected` adds it up."""
        order = sorted(range(len(runs)), key=lambda r: -len(runs[r]))
        size, start, found = self.at([runs[r] for r in order], longest)
        price = np.where(found >= 0, self.logp[found], -math.inf)
        slot = start + np.arange(len(size))  # a run has a place before each character and one behind the last
        ahead = np.full(len(price[0]) + len(size), -math.inf)
        behind = ahead.copy()
        ahead[slot], behind[slot + size] = 0.0, 0.0
        active = np.searchsorted(-size, -np.arange(size[0] + 1), "right")  # runs of that length or more
        for i in range(1, size[0] + 1):
            at, first = slot[: active[i]] + i, start[: active[i]] + i
            ahead[at] = log_sums([ahead[at - k] + price[k - 1, first - k] for k in range(1, min(i, longest) + 1)])
        for i in range(1, size[0] + 1):
            stop, last = (slot + size)[: active[i]] - i, (start + size)[: active[i]] - i
            behind[stop] = log_sums([behind[stop + k] + price[k - 1, last] for k in range(1, min(i, longest) + 1)])
        total = ahead[slot + size]
        weight = np.where(total > -math.inf, np.array(weights, float)[order], 0.0)
        total = np.where(total > -math.inf, total, 0.0)
        of = np.repeat(np.arange(len(size)), size)
        out = np.zeros(len(self.names))
        for k in range(longest):
            at = np.flatnonzero(found[k] >= 0)
            mass = weight[of[at]] * np.exp(ahead[at + of[at]] + price[k, at] + behind[at + of[at] + k + 1] - total[of[at]])
            out += np.bincount(found[k, at], mass, len(out))
        return out

    def cuts(self, runs: list[str], longest: int, unknown: float) -> list[list[str]]:
        """The runs as `cut` cuts them."""
        order = sorted(range(len(runs)), key=lambda r: -len(runs[r]))
        size, start, found = self.at([runs[r] for r in order], longest)
        price = np.where(found >= 0, self.logp[found] if len(self.logp) else 0.0, -math.inf)
        price[0] = np.where(found[0] >= 0, price[0], unknown)
        slot = start + np.arange(len(size))
        best, pieces, back = (np.zeros(len(price[0]) + len(size), t) for t in (float, int, int))
        active = np.searchsorted(-size, -np.arange(size[0] + 1), "right")
        for i in range(1, size[0] + 1):
            at, first = slot[: active[i]] + i, start[: active[i]] + i
            most, least, of = best[at - 1] + price[0, first - 1], pieces[at - 1] + 1, np.ones(len(at), int)
            for k in range(2, min(i, longest) + 1):
                value, n = best[at - k] + price[k - 1, first - k], pieces[at - k] + 1
                better = (value > most) | ((value == most) & (n < least))
                most, least, of = np.where(better, value, most), np.where(better, n, least), np.where(better, k, of)
            best[at], pieces[at], back[at] = most, least, of
        out, back = [[] for _ in runs], back.tolist()
        for r, n, a in zip(order, size.tolist(), slot.tolist()):
            while n:
                out[r].append(runs[r][n - back[a + n] : n])
                n -= back[a + n]
            out[r].reverse()
        return out


def log_sums(options: list[np.ndarray]) -> np.ndarray:
    most = np.max(options, axis=0)
    base = np.where(most > -math.inf, most, 0.0)
    with np.errstate(divide="ignore"):
        return base + np.log(np.sum(np.exp(np.array(options) - base), axis=0))


def in_turns(runs: list[str]) -> Iterator[slice]:
    """Slices of the runs with LETTERS characters or so."""
    a = held = 0
    for n, run in enumerate(runs):
        held += len(run)
        if held >= LETTERS:
            yield slice(a, n + 1)
            a, held = n + 1, 0
    if a < len(runs):
        yield slice(a, len(runs))


def learned(docs: DataFrame, text: str = "content", *, pattern: str = RUN, longest: int = LONGEST, least: int = LEAST_COUNT, vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """piece, logp: the vocabulary. All runs of the corpus count; it has at most `vocabulary` pieces of several characters, and the single characters that occur.

    A corpus without such runs has an empty vocabulary. Weights are sums in any order: logp is rounded to nine digits, so that cuts of equal price do not depend on it.
    """
    counted = materialize(runs(docs, text, pattern), "segment-runs")
    seeds = materialize(substrings(counted, longest, least), "segment-seeds")
    several = cohesive(seeds).orderBy(F.desc(F.col("n") * F.char_length("piece")), "piece").limit(vocabulary)
    held = materialize(several.unionByName(seeds.where(F.char_length("piece") == 1)).select("piece", F.col("n").cast("double").alias("weight")), "segment-pieces")
    for _ in range(rounds):
        logp = log_probabilities(held)
        if not logp:
            break
        shared = held.sparkSession.sparkContext.broadcast(Pieces(logp))

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, into = shared.value, np.zeros(len(shared.value.names))
            for batch in batches:
                runs, n = (c.to_pylist() for c in batch.columns[:2])
                for own in in_turns(runs):
                    into += pieces.expected(runs[own], n[own], longest)
            some = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array([pieces.names[k] for k in some], pa.string()), pa.array(into[some], pa.float64())], names=["piece", "weight"])

        found = spread_out(counted.select("run", "n")).mapInArrow(sums, "piece string, weight double").groupBy("piece").agg(F.sum("weight").alias("weight"))
        held = materialize(found.where((F.col("weight") >= LEAST_EXPECTED) | (F.char_length("piece") == 1)), "segment-pieces")
    total = held.agg(F.sum("weight").alias("total"))
    return held.crossJoin(F.broadcast(total)).select("piece", F.round(F.log(F.col("weight") / F.col("total")), 9).alias("logp")).where("logp IS NOT NULL")  # one row of totals


def log_probabilities(held: DataFrame) -> dict[str, float]:
    """The pieces on the driver: a bounded vocabulary."""
    rows = held.where("weight > 0").collect()
    total = sum(r.weight for r in rows)
    return {r.piece: math.log(r.weight / total) for r in rows}


def cut(run: str, logp: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The pieces of a run with the largest sum; of equal sums the one with fewer pieces. A character that is no piece stands for itself at the price `unknown`."""
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for i in range(1, len(run) + 1):
        options = []
        for k in range(max(0, i - longest), i):
            p = logp.get(run[k:i], unknown if k == i - 1 else None)
            if p is not None:
                options.append((best[k][0] + p, best[k][1] - 1, k))
        best.append(max(options))
    out, i = [], len(run)
    while i:
        out.append(run[best[i][2] : i])
        i = best[i][2]
    return out[::-1]


def segmenter(vocabulary: DataFrame, pattern: str = RUN, longest: int = LONGEST) -> Callable[[Column], Column]:
    """A tokeniser for `search.bm25`: terms of a text, letters folded, runs of the pattern cut into words. Null has no terms."""
    logp = {r.piece: r.logp for r in vocabulary.collect()}  # bounded, see learned
    unknown = min(logp.values(), default=0.0) - 10.0
    shared = vocabulary.sparkSession.sparkContext.broadcast(Pieces(logp))
    wide, term = re.compile(pattern), re.compile(r"[^\W_]+")

    def parts(text: str | None) -> list[tuple[bool, str]]:
        """The text's terms and runs, the latter marked."""
        out: list[tuple[bool, str]] = []
        for found in term.findall(folded(text or "")):
            at = 0
            for m in wide.finditer(found):
                out += [(False, found[at : m.start()])] if m.start() > at else []
                out += [(True, m[0])] if m[0] else []
                at = m.end()
            out += [(False, found[at:])] if at < len(found) else []
        return out

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            split = [parts(text) for text in texts]
            runs = [x for own in split for wide_run, x in own if wide_run]
            cuts = iter([c for own in in_turns(runs) for c in shared.value.cuts(runs[own], longest, unknown)])
            yield pd.Series([[w for wide_run, x in own for w in (next(cuts) if wide_run else (x,))] for own in split], index=texts.index)

    return run
