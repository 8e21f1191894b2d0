"""Chunk packing by array functions: the chunks of `chunking.pack` without a Python worker.

A run of pieces a..b costs at most m tokens just when 4 * wide + others + line breaks between them is at most 4 * m, in whole numbers, as m is one. So each piece weighs
4 * wide + others + 1, and one fold over a document's pieces finds the chunks: its state is the sum so far, the sums at the start of each piece that the open chunk holds, and the chunks
found. A chunk ends where the next piece would not fit; those sums then say which of the last pieces are within the overlap and leave room for the next. A state holds no text, and no more sums
than a chunk has pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import WIDE
from tessera.operators.chunking import PER_TOKEN
from tessera.sources.shared import spread_out

#: White space as str.strip takes it, in the syntax of Java's patterns.
_SPACE = r"[\s\x{1c}-\x{1f}]"
_ENDS = rf"(?U)^{_SPACE}+|{_SPACE}+$"
_BLANK = rf"(?U)\n{_SPACE}*\n"
_SENTENCE = r"(?s)[^。！？.!?\n]*[。！？.!?\n]|[^。！？.!?\n]+"
_CHUNKS = "array<struct<start:int,end:int>>"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def paragraphs(text: Column) -> Column:
    """The texts between blank lines, without those that hold none."""
    return F.filter(F.transform(F.split(text, _BLANK, -1), stripped), lambda p: p != "")


def weight(text: Column) -> Column:
    """Four for a wide character, one for any other."""
    n = F.char_length(text)
    return (n + (PER_TOKEN - 1) * (n - F.char_length(F.regexp_replace(text, WIDE, "")))).cast("long")


def _runs(weights: Column, most: int, overlap: int) -> Column:
    """(start, end) of the runs of pieces, from 0 and end exclusive; every weight counts the line break after its piece."""
    zero = F.lit(0).cast("long")
    initial = F.struct(zero.alias("sum"), F.lit(0).alias("n"), F.array(zero).alias("held"), F.array().cast(_CHUNKS).alias("done"))

    def step(acc: Column, w: Column) -> Column:
        total, held = acc["sum"] + w, acc["held"]
        # the first of `held` is the sum before the open chunk, the last the sum before this piece
        full = (F.size(held) > 1) & (total - held[0] - 1 > PER_TOKEN * most)
        kept = F.filter(held, lambda s: (s == acc["sum"]) | ((acc["sum"] - s - 1 <= PER_TOKEN * overlap) & (total - s - 1 <= PER_TOKEN * most)))
        chunk = F.struct((acc["n"] - F.size(held) + 1).alias("start"), acc["n"].alias("end"))
        return F.struct(
            total.alias("sum"),
            (acc["n"] + 1).alias("n"),
            F.array_append(F.when(full, kept).otherwise(held), total).alias("held"),
            F.when(full, F.array_append(acc["done"], chunk)).otherwise(acc["done"]).alias("done"),
        )

    last = lambda acc: F.when(acc["n"] == 0, acc["done"]).otherwise(F.array_append(acc["done"], F.struct((acc["n"] - F.size(acc["held"]) + 1).alias("start"), acc["n"].alias("end"))))
    return F.aggregate(weights, initial, step, last)


def _cut(sentence: Column, most: int) -> Column:
    """Pieces of a sentence as long as the budget allows, between characters."""
    plain = F.regexp_extract_all(sentence, F.lit(f"(?s).{{1,{min(PER_TOKEN * most, 2**31 - 1)}}}"), F.lit(0))
    # nothing stands between characters, so their weights go in without the one for a line break
    letters = F.regexp_extract_all(sentence, F.lit("(?s)."), F.lit(0))
    zero = F.lit(0).cast("long")
    initial = F.struct(zero.alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("start"), F.array().cast(_CHUNKS).alias("done"))

    def step(acc: Column, c: Column) -> Column:
        w = F.when(c.rlike(WIDE), F.lit(PER_TOKEN)).otherwise(F.lit(1)).cast("long")
        full = acc["sum"] + w > PER_TOKEN * most
        return F.struct(
            F.when(full, w).otherwise(acc["sum"] + w).alias("sum"),
            (acc["n"] + 1).alias("n"),
            F.when(full, acc["n"]).otherwise(acc["start"]).alias("start"),
            F.when(full, F.array_append(acc["done"], F.struct(acc["start"].alias("start"), acc["n"].alias("end")))).otherwise(acc["done"]).alias("done"),
        )

    found = F.aggregate(letters, initial, step, lambda acc: F.array_append(acc["done"], F.struct(acc["start"].alias("start"), acc["n"].alias("end"))))
    mixed = F.transform(found, lambda r: F.substring(sentence, r["start"] + 1, r["end"] - r["start"]))
    return F.when(sentence.rlike(WIDE), mixed).otherwise(plain)


def pieces(units: Column, most: int) -> Column:
    """The units; those over the budget as their sentences, sentences over it cut between characters."""
    fits = lambda t: weight(t) <= PER_TOKEN * most
    sentences = lambda u: F.flatten(F.transform(F.regexp_extract_all(u, F.lit(_SENTENCE), F.lit(0)), lambda s: F.when(fits(s), F.array(s)).otherwise(_cut(s, most))))
    return F.flatten(F.transform(units, lambda u: F.when(fits(u), F.array(u)).otherwise(sentences(u))))


def text_chunks(docs: DataFrame, *, most: int = 512, overlap: int = 64) -> DataFrame:
    """doc_id, idx, heading_path, content of documents (doc_id, content, title, format, records), as `chunking.chunked` cuts all but Markdown ones.

    Records of a document whose format is json, jsonl or csv are chunks of their own, cut only if they are over the budget; without a list of records, and for other formats, a blank line
    parts units, and neighbours are packed together. A null or blank document has no chunks. Markdown raises: its sections are for `chunking.chunked`.
    """
    if not 0 <= overlap < most:
        raise ValueError("the overlap is smaller than a chunk")
    kind = F.lower(F.coalesce("format", F.lit("")))
    listed = kind.isin("json", "jsonl", "csv")
    content = F.when(kind.isin("md", "markdown"), F.raise_error(F.lit("Markdown is cut by chunking.chunked"))).otherwise(F.coalesce("content", F.lit("")))
    records = F.filter(F.transform(F.filter("records", lambda r: r.isNotNull()), stripped), lambda r: r != "")
    rows = spread_out(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("title", F.lit("")).alias("heading_path"), listed.alias("_listed"), content.alias("_text"), records.alias("_records"))
    rows = rows.where(stripped(F.col("_text")) != "")
    units = F.when(F.col("_listed") & F.col("_records").isNotNull(), F.col("_records")).otherwise(paragraphs(F.col("_text")))
    cut = rows.select("doc_id", "heading_path", "_listed", pieces(units, most).alias("_pieces"))
    # the pieces are used twice, so they stay a projection of their own and are made once
    alone = F.transform("_pieces", lambda p, i: F.struct(i.alias("start"), (i + 1).alias("end")))
    packed = _runs(F.transform("_pieces", lambda p: weight(p) + 1), most, overlap)
    found = cut.select("doc_id", "heading_path", F.transform(F.when(F.col("_listed"), alone).otherwise(packed), lambda r: stripped(F.array_join(F.slice("_pieces", r["start"] + 1, r["end"] - r["start"]), "\n"))).alias("_chunks"))
    # outer: without it the optimizer puts "has chunks" as a filter below the projections, and works all of them out once more there
    return found.select("doc_id", F.posexplode_outer("_chunks").alias("idx", "content"), "heading_path").where("idx IS NOT NULL").select("doc_id", "idx", "heading_path", "content")
