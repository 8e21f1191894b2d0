"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a comparison of a few measures of the text. On a sample spread over the table the cascade times every measure on
the texts themselves and takes what every rule rejects, and then asks the rules in order of rejections per cost: a measure that an earlier rule has
needed is free, and rejections count among the texts that are left. A measure is taken of a text only when a rule asks for it that the text has
come to; a text that a rule rejects is not put to the ones after it. The order changes the work and which rule is named, never which texts are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, free_name, materialize, read, text_or_empty

#: Words of a window in which repetition is looked for.
WINDOW = 8
#: How often the sample is gone over to time a measure.
COPIES = 8
#: The measures that the query gives out.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # the lines are used twice and made once
    return F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]


#: Measures of a text as columns; n_repeat_words takes several steps, see with_repeats.
MEASURED: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(F.array_remove(F.split(t, SPACE), "")),
    "word_chars": lambda t: F.char_length(F.translate(t, " \t\n\x0b\x0c\r", "")),
    "n_symbols": lambda t: F.regexp_count(t, F.lit("[#*$%&|<>]")),
    "n_dup_lines": duplicate_lines,
    "n_lines": lambda t: F.size(F.split(t, "\n")),
    "n_capitals": lambda t: F.regexp_count(t, F.lit("[A-Z]")),
    # most characters of a text are letters: the others are fewer to count
    "n_letters": lambda t: F.char_length(t) - F.regexp_count(t, F.lit("\\P{L}")),
    "n_ellipses": lambda t: F.regexp_count(t, F.lit("\\.\\.\\.|…")),
}
REPEATS = "n_repeat_words"


@dataclass(frozen=True)
class Rule:
    """`rejects` is true for a text that fails, over the measures that it `needs`; null does not reject."""

    name: str
    needs: tuple[str, ...]
    rejects: Column


def default_rules() -> list[Rule]:
    """Limits that ordinary prose of any language stays well clear of."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    return [
        Rule("too_short", ("n_words",), n < 20),
        Rule("repeated_words", ("n_words", REPEATS), 100 * F.col(REPEATS) > 30 * n),
        Rule("symbols", ("word_chars", "n_symbols"), 10 * F.col("n_symbols") > chars),
        Rule("word_length", ("n_words", "word_chars"), (chars > 15 * n) | (chars < 2 * n)),
        Rule("repeated_lines", ("n_lines", "n_dup_lines"), 10 * F.col("n_dup_lines") > 6 * lines),
        Rule("capitals", ("word_chars", "n_capitals"), 2 * F.col("n_capitals") > chars),
        Rule("letterless", ("word_chars", "n_letters"), 5 * F.col("n_letters") < 2 * chars),
        Rule("ellipses", ("n_lines", "n_ellipses"), 10 * F.col("n_ellipses") > 3 * lines),
    ]


def windows(words: Column, n: Column) -> Column:
    """A hash of each run of WINDOW words: hashes of 1 word, joined to those of 2, 4 and 8."""
    hashes, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < WINDOW:
        count = F.greatest(n - F.lit(2 * width - 1), F.lit(0))
        hashes = F.zip_with(F.slice(hashes, F.lit(1), count), F.slice(hashes, F.lit(width + 1), count), lambda a, b: F.xxhash64(a, b))
        width *= 2
    return hashes


def with_repeats(docs: DataFrame, text: Column, active: Column, out: str) -> DataFrame:
    """`docs` with `out`, the words in windows that stand in a text more than once; null where not active."""
    names = [c for c in docs.columns if c != out]
    its_w, its_h, its_s, its_p, active_now = (free_name(names, f"_rule_{k}") for k in ("words", "hashes", "sorted", "places", "active"))
    rows = docs.select(*names, F.when(active, F.array_remove(F.split(text, SPACE), "")).alias(its_w))
    rows = rows.select(*names, F.col(its_w).isNotNull().alias(active_now), windows(F.col(its_w), F.size(its_w)).alias(its_h))
    repeated = F.size(F.array_distinct(its_h)) < F.size(its_h)
    # only texts with a repeated window are sorted: equal hashes then stand side by side
    ranked = F.array_sort(F.transform(its_h, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*names, active_now, F.when(repeated, ranked).alias(its_s))
    at = F.transform(
        F.filter(its_s, lambda s, i: F.get(its_s, i - 1)["h"].eqNullSafe(s["h"]) | F.get(its_s, i + 1)["h"].eqNullSafe(s["h"])),
        lambda s: s["i"],
    )
    rows = rows.select(*names, active_now, F.sort_array(at).alias(its_p))
    cover = F.aggregate(
        F.transform(its_p, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(its_p, i + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda total, x: total + x
    )
    return rows.select(*names, F.when(F.col(active_now), F.coalesce(cover, F.lit(0).cast("long"))).alias(out))


def with_measure(docs: DataFrame, name: str, text: Column, active: Column) -> DataFrame:
    """`docs` with a measure of the texts where active, null elsewhere."""
    if name == REPEATS:
        return with_repeats(docs, text, active, name)
    return docs.withColumn(name, F.when(active, MEASURED[name](text)).cast("long"))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of the whole text; null counts as empty.

    Columns of these names are replaced; all others stay, and repeated rows each give a row.
    """
    out = docs.select(*(c for c in docs.columns if c not in MEASURES))
    for name in MEASURES:
        out = with_measure(out, name, text_or_empty(text_col), F.lit(True))
    return out


def spread_sample(docs: DataFrame, text_col: str, rows: int) -> DataFrame:
    """About `rows` texts, drawn from all partitions alike, as a table of its own."""
    total = docs.count()
    drawn = docs.select(text_or_empty(text_col).alias("text"))
    return materialize(drawn if total <= rows else drawn.sample(fraction=rows / total, seed=11), "rules-sample")


def ordered(rules: list[Rule], sample: DataFrame, wanted: tuple[str, ...] = ()) -> list[Rule]:
    """The rules in order of rejections per second on `sample`, a small table of texts, each after what the ones before it leave and have measured.

    The measures `wanted` are taken of every text in any case and cost a rule nothing.
    """
    text = F.col("text")

    def seconds(measure: Callable[[DataFrame], DataFrame]) -> float:
        """Of one pass over the sample: what COPIES of its texts take more than one, so that compiling and starting a job cancel out."""
        took = []
        for copies in (1, COPIES):
            texts = sample.select(text, F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy")).select("text")
            runs = []
            for _ in range(2):
                work = measure(texts)  # made anew: a frame that has run once keeps its shuffled rows
                began = time.perf_counter()
                work.collect()  # a single sum
                runs.append(time.perf_counter() - began)
            took.append(min(runs))
        return max(0.0, took[1] - took[0]) / (COPIES - 1)

    scan = seconds(lambda texts: texts.agg(F.sum(F.char_length(text)).alias("s")))
    timed = sorted({m for r in rules for m in r.needs} - {*wanted})
    cost = {m: max(1e-4, seconds(lambda texts: with_measure(texts, m, text, F.lit(True)).agg(F.sum(m).alias("s"))) - scan) for m in timed}
    known = sample
    for m in sorted({*cost, *wanted}):
        known = with_measure(known, m, text, F.lit(True))
    verdicts = [set(r.v) for r in known.select(F.array(*(F.when(F.coalesce(r.rejects, F.lit(False)), F.lit(k)) for k, r in enumerate(rules))).alias("v")).collect()]
    left, taken, out = list(range(len(rules))), {*wanted}, []
    while left:
        # a comparison alone costs next to nothing, but not nothing
        worth = {k: sum(k in v for v in verdicts) / (1e-4 + sum(cost[m] for m in rules[k].needs if m not in taken)) for k in left}
        k = max(left, key=lambda k: (worth[k], -k))
        out.append(rules[k])
        left.remove(k)
        taken.update(rules[k].needs)
        verdicts = [v for v in verdicts if k not in v]
    return out


def cascade(docs: DataFrame, *, rules: list[Rule] | None = None, sample_rows: int = 1000, text_col: str = "text", wanted: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with the measures of the query, `failed_rule`, the first rule in the cascade that rejects (null if kept), and `kept`.

    The measures `wanted` are taken of every text, once, before the rules; any other is null where no rule up to the rejecting one needs it. Only the order comes from the sample of about `sample_rows` rows; every row is
    judged by every rule up to the first that rejects it. A null or empty text has zero counts and fails as too short by the default rules. Columns named
    like a measure, failed_rule or kept are replaced.
    """
    rules = default_rules() if rules is None else rules
    names = {*MEASURED, REPEATS, "failed_rule", "kept"}
    out = docs.select(*(c for c in docs.columns if c not in names)).withColumn("failed_rule", F.lit(None).cast("string"))
    for m in wanted:
        out = with_measure(out, m, text_or_empty(text_col), F.lit(True))
    for rule in ordered(rules, spread_sample(docs, text_col, sample_rows), wanted) if len(rules) > 1 else rules:
        for m in rule.needs:
            if m not in out.columns:
                out = with_measure(out, m, text_or_empty(text_col), F.col("failed_rule").isNull())
        out = out.withColumn("failed_rule", F.coalesce("failed_rule", F.when(rule.rejects, F.lit(rule.name))))
    measures = (F.col(m) if m in out.columns else F.lit(None).cast("long").alias(m) for m in MEASURES)
    own = [c for c in docs.columns if c not in names]
    return out.select(*own, *measures, "failed_rule", F.col("failed_rule").isNull().alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts and the contract's counts of every text: as they are taken in any case, the cascade orders and cuts short what it takes beside them."""
    out = cascade(read(spark, sf_dir, "documents").select("doc_id", "text"), wanted=MEASURES)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", *MEASURES, base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"))


SQL = {
    "op9_quality_rules": """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)
), repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > word_chars OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 10 * n_dup_lines > 6 * n_lines
    OR 2 * len(regexp_extract_all(text, '[A-Z]')) > word_chars OR 5 * len(regexp_extract_all(text, '\\p{L}')) < 2 * word_chars
    OR 10 * len(regexp_extract_all(text, '\\.\\.\\.|…')) > 3 * n_lines) AS kept
FROM b
""",
}
