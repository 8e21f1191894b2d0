"""Periodic runs of words, from Lyndon arrays over the order of the words themselves.

For an order of words and its reverse, a pass from left to right finds, for each suffix, the next smaller one: from there to here reaches the longest Lyndon
word at that place. Every run of three periods holds such a word whose next smaller suffix is one period further on. Suffixes are compared word by word. What
one comparison has matched is kept: for places inside the matched stretch the comparison was made a shift earlier, and its extension is
taken over; what a chain of comparisons has in common is not read again either. So a text takes linear time in practice; words are compared, never hashed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import SPACE, read, small_batches, text_or_empty

#: Least words of a run, and least periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3


def next_smaller(w: Sequence, reverse: bool) -> tuple[list[int], list[int]]:
    """For each suffix of `w` the start of the next smaller one (the length if there is none), and how many words both begin with alike.

    The end is smaller than every word, in the reversed order too.
    """
    n = len(w)
    after, after_same, before, before_same = [n] * n, [0] * n, [-1] * n, [0] * n
    # the stretch from `right` to `end` equals the one that begins at right - shift
    right = end = shift = 0
    for i in range(1, n):
        word, j, k, known = w[i], i - 1, -1, 0
        while j >= 0:
            other = w[j]
            if other != word:
                same, larger = 0, (other < word) == reverse
            else:
                same, exact = 1, False
                if i < end and j >= right:
                    jj, ii = j - shift, i - shift
                    if after[jj] == ii:
                        same = after_same[jj]
                    elif before[ii] == jj:
                        same = before_same[ii]
                    if same < end - i:
                        exact = same > 1 or after[jj] == ii or before[ii] == jj
                    else:
                        same = end - i
                elif k >= 0:
                    # suffix k lies between: it shares `known` with i and before_same[k] with j
                    same = before_same[k]
                    exact = same != known
                    same = min(same, known) or 1
                if not exact:
                    at, by = i + same, j + same
                    while at < n and w[at] == w[by]:
                        at += 1
                        by += 1
                    same = at - i
                    if at > end:
                        right, end, shift = i, at, i - j
                larger = i + same == n or (w[j + same] < w[i + same]) == reverse
            if not larger:
                before[i], before_same[i] = j, same
                break
            after[j], after_same[j] = i, same
            k, known, j = j, same, before[j]
    return after, after_same


def runs_of(w: Sequence, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """start, length and smallest period of every maximal run of at least so many words and periods (three or more), by start, then period."""
    found, n = set(), len(w)
    if n < max(least_words, least_periods):
        return []
    for reverse in (False, True):
        after, same = next_smaller(w, reverse)
        reached: dict[int, int] = {}
        for i in range(n):
            # the first such word of a run of three periods is followed by another whole one
            if same[i] and same[i] >= after[i] - i and reached.get(after[i] - i, 0) <= i:
                period = after[i] - i
                start, end = i, after[i] + same[i]
                while start and w[start - 1] == w[start - 1 + period]:
                    start -= 1
                reached[period] = end - period
                if end - start >= max(least_words, least_periods * period):
                    found.add((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w: Sequence, runs: list[tuple[int, int, int]]) -> list:
    """The words without what any run holds after its first period."""
    out, at = [], 0
    for start, end in sorted((s + p, s + length) for s, length, p in runs):
        if end > at:
            out += w[at : max(start, at)]
            at = end
    return out + list(w[at:])


RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, *, text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """`docs` with `runs`, the maximal runs of words as (start, length, period) by start, then period, and `collapsed`, the kept words of the whole text, a space between.

    A null text or one without words has no runs and an empty `collapsed`. A text stands in one task, and each row is taken by itself: repeated rows each
    give a row. Columns named runs or collapsed are replaced, all others stay. least_periods is 3 or more.
    """
    if least_periods < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    names = [c for c in docs.columns if c not in ("runs", "collapsed")]
    kind = pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in RUN.names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = [], []
            for value in batch.columns[-1]:
                # bytes are split at the six ASCII kinds of white space
                words = value.as_py().split()
                own = runs_of(words, least_words, least_periods)
                runs.append([dict(zip(RUN.names, r)) for r in own])
                texts.append(b" ".join(collapsed(words, own) if own else words))
            made = [pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*names, "runs", "collapsed"])

    rows = docs.select(*names, text_or_empty(text_col).cast("binary").alias("collapsed"))
    return small_batches(rows).mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())]))


def summarised(found: DataFrame) -> DataFrame:
    """n_runs, the run with the most periods (ties: first start, then period) and digests, in place of runs and collapsed."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    # length / period are compared as products
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    names = [c for c in found.columns if c not in ("runs", "collapsed")]
    rows = found.select(*names, "runs", best.alias("best"), F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").alias("listed"), "collapsed")
    return rows.select(
        *names, F.size("runs").cast("long").alias("n_runs"), *(F.col("best")[c].alias(c) for c in RUN.names), F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    )


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """doc_id and the contract's text: for one document in ten, the words from a place on are a few words again and again."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.floor(h / 10).alias("g"), (h % 10 == 0).alias("planted"))
    rows = rows.withColumn("words", F.when(F.col("planted"), F.array_remove(F.split("text", SPACE), ""))).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), again), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarised(periodic_runs(with_planted_tails(read(spark, sf_dir, "documents"))).drop("text"))


SQL: dict[str, str] = {}
