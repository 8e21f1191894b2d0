"""Substring dedup by hashing lines, and runs of words within them.

Lines are normalised and hashed, digests are grouped over all documents, and the occurrence in the first document keeps its text. Runs of other
occurrences that are long enough are passages to remove, known by their offsets in the original text.

Passages also stand in the middle of lines, begin and end in mid-sentence. Runs of GRAM words are therefore hashed too; of any WINDOW
neighbours the one with the smallest hash is kept, so equal texts of GRAM + WINDOW - 1 words have one in common, wherever lines begin. The outermost
ones of a run are compared word by word with their first occurrence, as far as the words are equal. Without these (`verbatim` off)
lines are cut at sentence ends and before capitals into smaller units, places that depend on nothing but the words next to them.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read, small_batches

#: Where a unit may end. A capital begins a new unit only after SHORT words.
CUT = re.compile(r"\n|(?<=[.!?…])[^\S\n]++|(?<!\s)[^\S\n]++(?=[A-ZÀ-ÖØ-ÞΑ-ΩА-Я])")
SENTENCE_ENDS = ".!?…"
EDGES = re.compile(r"^[\W_]+|(?<![\W_])[\W_]++$")
SHORT = 3
#: Words of a gram; grams of which one is kept. GRAM >= WINDOW: the kept ones of a repeated run leave no gap.
GRAM, WINDOW = 16, 15
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

SCHEMA = "doc long, idx int, word_at int, words int, start int, stop int, digest binary"


def lines_of(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines of a text."""
    start = 0
    while (at := text.find("\n", start)) >= 0:
        if at > start:
            yield start, at
        start = at + 1
    if start < len(text):
        yield start, len(text)


def units_of(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the units of a text."""
    start = counted = spaces = 0
    for m in CUT.finditer(text):
        at = m.start()
        spaces, counted = spaces + text.count(" ", counted, at), at
        if text[at] != "\n" and (at == 0 or text[at - 1] not in SENTENCE_ENDS) and spaces < SHORT - 1:
            continue
        if at > start:
            yield start, at
        start = counted = m.end()
        spaces = 0
    if start < len(text):
        yield start, len(text)


def normal(unit: str) -> list[str]:
    """Lower-case words without what is no letter or digit around them; words without any are dropped."""
    words = unit.lower().split()
    return [x for w in words if (x := w if w.isalnum() else EDGES.sub("", w))]


def hashes_of(words: list[str]) -> np.ndarray:
    """64-bit hashes of lower-case words as `normal` leaves them, 0 for those that it drops. Nothing is kept: a hash takes less time than its place in a large table."""
    one = xxhash.xxh3_64_intdigest

    def bare(word: str) -> int:
        found = word.strip(string.punctuation)  # nearly always all that is to go
        if not found.isalnum():
            found = EDGES.sub("", word)
        return one(found) if found else 0

    return np.array([one(w) if w.isalnum() else bare(w) for w in words], np.uint64)


def powers(factor: int, n: int) -> np.ndarray:
    """factor**0 .. factor**(n - 1) modulo 2**64."""
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def slide(values: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """The smallest or largest of each n neighbours."""
    size = 1
    while size < n:
        step = min(size, n - size)
        values, size = best(values[:-step], values[step:]), size + step
    return values


def grams_of(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 128-bit hashes (two columns) of the grams that are kept; none of texts too short for a whole window. `text`: the number of each word's text."""
    n = len(hashes) - GRAM + 1
    if n < WINDOW:
        return np.empty(0, np.int64), np.empty((0, 2), np.uint64)
    columns = []
    for factor in FACTORS:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(factor, len(hashes)), dtype=np.uint64)])
        h = (total[GRAM:] - total[:-GRAM]) * powers(pow(factor, -1, 1 << 64), n)
        h ^= h >> np.uint64(32)
        h *= np.uint64(FACTORS[1])
        columns.append(h ^ (h >> np.uint64(29)))
    least = slide(columns[0], WINDOW, np.minimum)
    least[text[: len(least)] != text[GRAM + WINDOW - 2 :]] = 0  # windows that reach into the next text
    edge = np.zeros(WINDOW - 1, np.uint64)
    places = np.flatnonzero(slide(np.concatenate([edge, least, edge]), WINDOW, np.maximum) == columns[0])
    return places, np.stack([c[places] for c in columns], axis=1)


def unit_rows(docs: DataFrame, grams: bool = False) -> DataFrame:
    """A row for each unit with a word: its document, number, place in words and characters, and digest. `docs` has id and text.

    With `grams` the units are lines, and there is a row for each kept gram too: idx is its place in words, start and stop are null.
    """
    cut = lines_of if grams else units_of
    names = ["doc", "idx", "word_at", "words", "start", "stop", "digest"]

    def rows(doc: np.ndarray, ints: list[np.ndarray], digests: bytes) -> pa.RecordBatch:
        """Rows of these columns, of which start and stop may be missing; 16 bytes of digest each."""
        n = len(doc)
        digest = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, np.int32)), pa.py_buffer(digests)])
        filled = [pa.array(x.astype(np.int32)) for x in ints] + [pa.nulls(n, pa.int32())] * (5 - len(ints))
        return pa.RecordBatch.from_arrays([pa.array(doc), *filled, digest], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids, parts, n_words, unit_doc, unit_words, spans = [], [], [], [], [], []
                for i, v in zip(batch.column(0).slice(at, 1000).to_pylist(), batch.column(1).slice(at, 1000).to_pylist()):
                    if i is None or not v:
                        continue
                    words: list[str] = []
                    for a, b in cut(v):
                        found = v[a:b].lower().split()
                        unit_doc.append(len(ids))
                        unit_words.append(len(found))
                        spans.append((a, b))
                        words += found
                    ids.append(i)
                    parts.append(hashes_of(words))
                    n_words.append(len(words))
                if not unit_doc:
                    continue
                # of all texts at once: words that are dropped go, and units without any other
                hashes, doc, size = np.concatenate(parts), np.array(ids, np.int64), np.array(unit_words)
                kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(hashes != 0)])
                text = np.repeat(np.arange(len(ids)), n_words)[hashes != 0]
                hashes, ends, begins = hashes[hashes != 0], np.cumsum(size), kept[np.cumsum(n_words) - n_words]
                lo, hi = kept[ends - size], kept[ends]
                whole = hi > lo
                of, lo, hi, span = np.array(unit_doc)[whole], lo[whole], hi[whole], np.array(spans)[whole]
                raw = memoryview(hashes.tobytes())
                digests = b"".join(xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(lo.tolist(), hi.tolist()))
                yield rows(doc[of], [np.arange(len(of)) - np.searchsorted(of, of), lo - begins[of], hi - lo, span[:, 0], span[:, 1]], digests)
                if grams:
                    places, found = grams_of(hashes, text)
                    of = text[places]
                    place = places - begins[of]
                    yield rows(doc[of], [place, place, np.full(len(place), GRAM)], found.tobytes())

    return small_batches(docs.select("id", "text")).mapInArrow(run, SCHEMA)


#: Whether a code point up to the last white space is white space.
IS_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a text that are not dropped."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = np.concatenate([[True], IS_SPACE[np.minimum(points, len(IS_SPACE) - 1)], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    hashes = hashes_of(text.lower().split())
    kept = hashes != 0
    return hashes[kept], edges[::2][kept], edges[1::2][kept]


def first_places(units: DataFrame) -> DataFrame:
    """digest, f (doc, idx): the first place of each digest that stands in several."""
    # document and number as one long where the ids allow it, so that the minimum is found by hashing and nothing is sorted for it
    lo, hi = units.agg(F.min("doc"), F.max("doc")).first()
    packed = lo is not None and hi - lo < 1 << 32
    at = F.shiftleft(F.col("doc") - F.lit(lo), 31) + F.col("idx") if packed else F.struct("doc", "idx")
    first = units.groupBy("digest").agg(F.min(at).alias("f"), F.max(at).alias("l")).where("f <> l").select("digest", "f")
    if not packed:
        return first
    idx = F.col("f").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    return first.select("digest", F.struct((F.shiftright("f", 31) + F.lit(lo)).alias("doc"), idx.alias("idx")).alias("f"))


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, pos, side, hashes, bounds: the WINDOW - 1 words before (side 0) or after (side 1) a place between the words of a text.

    They are listed away from the place. bounds has one entry more: where the text begins or ends that takes 0, 1, ... of them in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes, bounds = [], [], []
            for i, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                words, starts, ends = words_of(text)
                for p in places:
                    pos, side = p["pos"], p["side"]
                    if not 0 <= (pos - 1 if side else pos) < len(words):
                        continue  # one id with several texts: the place is in another one
                    low = max(pos - WINDOW + 1, 0)
                    keys.append((i, pos, side))
                    hashes.append(words[pos : pos + WINDOW - 1] if side else words[low:pos][::-1])
                    bounds.append(ends[pos - 1 : pos + WINDOW - 1] if side else starts[low : pos + 1][::-1])
            if keys:
                columns = [pa.array(c, k) for c, k in zip(zip(*keys), (pa.int64(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, lists(hashes, np.int64), lists(bounds, np.int32)], names=["id", "pos", "side", "hashes", "bounds"])

    def lists(rows: list[np.ndarray], kind: type) -> pa.ListArray:
        offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).astype(kind)))

    places = wanted.distinct().groupBy("id").agg(F.collect_list(F.struct("pos", "side")).alias("places"))
    found = small_batches(docs.join(places, "id").select("id", "text", "places")).mapInArrow(run, "id long, pos int, side int, hashes array<long>, bounds array<int>")
    return found.groupBy("id", "pos", "side").agg(F.max(F.struct("hashes", "bounds")).alias("c")).select("id", "pos", "side", "c.hashes", "c.bounds")


def islands(pieces: DataFrame) -> DataFrame:
    """`pieces` (doc, a, b: words from a up to b) with `island`, the same number for those that touch or overlap."""
    w = W.partitionBy("doc").orderBy("a", F.desc("b"))
    before = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    return pieces.withColumn("_new", F.when(F.col("a") <= before, 0).otherwise(1)).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def extended(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The islands (with gram_l, gram_r: their outermost grams), widened as far as the words beside these grams equal those beside their first occurrence."""
    found = materialize(found, "passages-islands")
    sides = []
    for side, gram, shift in ((0, "gram_l", 0), (1, "gram_r", GRAM)):
        g = F.col(gram)
        sides.append(found.where(g.isNotNull()).select("doc", "island", F.lit(side).alias("side"), (g["a"] + shift).alias("pos"), g["fdoc"].alias("fdoc"), (g["fpos"] + shift).alias("fpos")))
    both = sides[0].unionByName(sides[1])
    wanted = both.select(F.col("doc").alias("id"), "pos", "side").unionByName(both.select(F.col("fdoc").alias("id"), F.col("fpos").alias("pos"), "side"))
    near = materialize(contexts(docs, wanted), "passages-contexts")
    own = near.select(F.col("id").alias("doc"), "pos", "side", F.col("hashes").alias("mine"), "bounds")
    there = near.select(F.col("id").alias("fdoc"), F.col("pos").alias("fpos"), "side", F.col("hashes").alias("theirs"))
    # the number of equal words: up to the first place where they differ or one of the texts ends
    same = F.zip_with("mine", "theirs", lambda x, y: F.coalesce(x == y, F.lit(False)))
    differ = F.array_position(same, False)
    n = F.when(differ > 0, differ - 1).otherwise(F.size(same)).cast("int")
    grown = both.join(own, ["doc", "pos", "side"]).join(there, ["fdoc", "fpos", "side"]).withColumn("n", n)
    grown = grown.withColumn("edge", F.get("bounds", F.col("n"))).groupBy("doc", "island").agg(
        F.min(F.when(F.col("side") == 0, F.col("pos") - F.col("n"))).alias("_a"),
        F.max(F.when(F.col("side") == 1, F.col("pos") + F.col("n"))).alias("_b"),
        F.min(F.when(F.col("side") == 0, F.col("edge"))).alias("_start"),
        F.max(F.when(F.col("side") == 1, F.col("edge"))).alias("_stop"),
    )
    pick = lambda best, a, b: best(F.coalesce(a, b), F.coalesce(b, a)).alias(a)
    return found.join(grown, ["doc", "island"], "left").select(
        "doc", pick(F.least, "a", "_a"), pick(F.greatest, "b", "_b"), pick(F.least, "start", "_start"), pick(F.greatest, "stop", "_stop"), "lo", "hi", "first"
    )


def repeated_passages(docs: DataFrame, *, min_words: int = 30, verbatim: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, span_start, span_end, n_words, n_units, first_doc_id: the passages to remove, with offsets in code points, end exclusive.

    A passage is a run of at least `min_words` words of units that stand in a document with a smaller id, or earlier in the same one.
    With `verbatim` units are whole lines, and words of repeated grams and the equal words around them count as well, wherever lines begin and end; n_units counts
    from the first whole repeated line to the last and is 0 if there is none. first_doc_id: the smallest of the documents that keep its units.
    Rows with equal id and text count as one document. Rows without id take no part; null and empty texts have no units. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    units = materialize(unit_rows(docs, verbatim), "passages-units")
    # as a table of its own, so that Spark can split the units of a very common digest over several tasks of the join
    first = materialize(first_places(units), "passages-first")
    # a digest has one first place, so these are hashed, and the units are not sorted
    again = units.join(first.hint("shuffle_hash"), "digest").where((F.col("doc") != F.col("f.doc")) | (F.col("idx") != F.col("f.idx")))
    pieces = again.select("doc", F.col("word_at").alias("a"), (F.col("word_at") + F.col("words")).alias("b"), "start", "stop", F.col("f.doc").alias("first"), F.when(F.col("start").isNull(), F.col("f.idx")).alias("fpos"), F.when(F.col("start").isNotNull(), F.col("idx")).alias("unit"))
    gram = F.when(F.col("fpos").isNotNull(), F.struct("a", F.col("first").alias("fdoc"), "fpos"))
    found = islands(pieces).groupBy("doc", "island").agg(
        F.min("a").alias("a"),
        F.max("b").alias("b"),
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        F.min("unit").alias("lo"),
        F.max("unit").alias("hi"),
        F.min("first").alias("first"),
        F.min(gram).alias("gram_l"),
        F.max(gram).alias("gram_r"),
    )
    if verbatim:
        found = extended(found.where(F.col("b") - F.col("a") >= min(GRAM, min_words)), docs.where("id IS NOT NULL AND text IS NOT NULL"))
        found = islands(found).groupBy("doc", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"))
    n_words = (F.col("b") - F.col("a")).cast("long")
    return found.where(n_words >= min_words).select(
        F.col("doc").alias(id_col), F.col("start").alias("span_start"), F.col("stop").alias("span_end"), n_words.alias("n_words"), F.coalesce(F.col("hi") - F.col("lo") + 1, F.lit(0)).cast("long").alias("n_units"), F.col("first").alias("first_doc_id")
    )


def without_passages(docs: DataFrame, passages: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the passages cut out of `text_col`, and removed, array<struct<span_start, span_end, first_doc_id>>: what was cut, by original offsets.

    A text that is null stays null; documents without passages stay as they are and have an empty array.
    """
    names = [c for c in docs.columns if c != "removed"]
    spans = passages.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end", "first_doc_id"))).alias("removed"))
    joined = docs.select(*names).join(spans, id_col, "left")
    ends = F.transform(F.col("removed"), lambda s: s["span_end"])
    # what stays: from each passage's end (or the start) to the next passage's start (or the end)
    kept = F.transform(
        F.sequence(F.lit(0), F.size("removed")),
        lambda i: F.substring(
            F.col(text_col),
            F.coalesce(F.get(ends, i - 1), F.lit(0)) + 1,
            F.coalesce(F.get("removed", i)["span_start"], F.char_length(text_col)) - F.coalesce(F.get(ends, i - 1), F.lit(0)),
        ),
    )
    text = F.when(F.col("removed").isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(F.array_join(kept, ""))
    empty = F.array().cast(spans.schema["removed"].dataType)
    return joined.withColumn(text_col, text).withColumn("removed", F.coalesce("removed", empty)).select(*names, "removed")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"), verbatim=True)


def line_dedup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the passages of op4_line_dedup cut out, and what was cut."""
    docs = read(spark, sf_dir, "documents")
    return without_passages(docs, repeated_passages(docs, verbatim=True)).select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"))
