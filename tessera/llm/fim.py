"""Fill-in-the-middle: texts cut at two units into prefix, middle and suffix, and put together in another order.

A matcher goes over each text twice and holds one match at a time: first it counts the units, then a second, lazy pass goes on to the two
cutting points. Units are never held together, so a text costs no memory beyond itself and its result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import read, small_batches, text_or_empty

#: The units of a text, the marks before its parts, and shares of a hundred that are rearranged, and rearranged with the suffix first.
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SUFFIX_FIRST = 90, 20


def draws(id_col: str, salt: str = "1:") -> list[Column]:
    """Four numbers from 0 to 2**32 - 1 for each id, from a digest of the salt and the id; a row without id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def count_units(text: str) -> int:
    n = 0
    for _ in UNIT.finditer(text):
        n += 1
    return n


def cut_points(text: str, first: int, second: int) -> tuple[int, int]:
    """Where the first `first` and the first `second` units end (first <= second)."""
    lazy, at = UNIT.finditer(text), 0
    ends, done = [], 0
    for rank in (first, second):
        if rank > done:
            at, done = next(islice(lazy, rank - done - 1, None)).end(), rank
        ends.append(at)
    return ends[0], ends[1]


def rearranged(text: str, h: tuple[int, int, int, int], rate: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle, and the output."""
    n = count_units(text)
    if not text or h[2] % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = cut_points(text, *sorted((h[0] % (n + 1), h[1] % (n + 1))))
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


FIELDS = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salt: str = "1:", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """`docs` without the text, with n (units of the whole text), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    A text that is null, empty or holds one of the marks stays plain. Equal rows draw equal numbers and give equal outputs; a row without id draws as
    an empty one. Columns named like those that are added are replaced, all others stay.
    """
    names = [c for c in docs.columns if c != text_col and c not in FIELDS]
    rows = docs.select(*names, F.array(*draws(id_col, salt)).alias("n"), text_or_empty(text_col).alias("output"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, texts = batch.columns[-2].to_pylist(), batch.columns[-1]
            made = [rearranged(t.as_py(), tuple(h), rate, suffix_first) for t, h in zip(texts, numbers)]
            columns = [pa.array(c, k) for c, k in zip(zip(*made), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))] if made else [pa.array([], k) for k in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=[*names, *FIELDS])

    return small_batches(rows).mapInArrow(run, T.StructType([*rows.schema.fields[:-2], *(T.StructField(c, k) for c, k in FIELDS.items())]))


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form: no part holds a mark, so the first of each mark is the one that was set."""
    s, m, p = (F.locate(mark, output) for mark in (SUFFIX, MIDDLE, PREFIX))
    between = lambda a, b: F.substring(output, a + 3, b - a - 3)
    rest = F.substring(output, m + 3, F.char_length(output))
    return F.when(form == "psm", F.concat(between(p, s), rest, between(s, m))).when(form == "spm", F.concat(between(p, m), rest, between(s, p))).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = {
    "op11_fill_in_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
), r AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM r
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM f
""",
}
