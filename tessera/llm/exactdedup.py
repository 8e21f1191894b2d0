"""Exact copies by a content sort, in DataFrame functions only.

Sampled splitters deal the rows out into ranges of their texts, each range is sorted (on disk where it must be), so equal texts stand side by side, and
neighbours are compared in full. A splitter is the head of a text and a hash of the whole of it: the driver holds the splitters, and texts have no bound.

A text that fills a range or more is found in a small sample and dealt out over several ranges by a salt; the parts' first rows, a few for each such
text, are then sorted and compared once more. The sample only spreads the work: a heavy text that it misses stays in one range, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read, text_or_empty

#: Characters of a splitter's head; sampled rows for each range, and for each part of a heavy text; heavy texts at most, so their list is 10,000 rows of two numbers.
HEAD, RANGE_SAMPLE, PART_SAMPLE, HEAVY = 16, 32, 8, 10_000


def heavy_texts(rows: DataFrame) -> DataFrame:
    """hash, parts: texts that hold a quarter of a range's rows or more in a sample, and over how many parts they are spread."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, wanted = rows.count(), RANGE_SAMPLE * ranges
    drawn = rows if total <= wanted else rows.sample(fraction=wanted / total, seed=13)
    counts = drawn.groupBy(F.xxhash64("text").alias("hash")).agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / PART_SAMPLE).cast("int")
    return counts.where(F.col("n") > PART_SAMPLE).orderBy(F.desc("n"), "hash").limit(HEAVY).select("hash", parts.alias("parts"))


def content_sorted(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column] | None, keep: str, carried: list[str]) -> tuple[DataFrame, bool]:
    """id, text, row (the carried columns), hash, salt, local_keep, local_n, place: the rows beside their equals of one salt, place 1 for the one that stays.

    Also whether any text is spread over several salts.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (normalise(text) if normalise else text).alias("text"), F.struct(F.lit(0).alias("_"), *carried).alias("row"))
    heavy = materialize(heavy_texts(rows), "exact-heavy")
    spread = heavy.limit(1).count() > 0
    rows = rows.withColumns({"head": F.substring("text", 1, HEAD), "hash": F.xxhash64("text")})
    if spread:
        salt = F.coalesce(F.pmod(F.xxhash64("id", F.spark_partition_id()), F.col("parts")) + 1, F.lit(0))
        rows = rows.join(F.broadcast(heavy), "hash", "left").withColumn("salt", salt).drop("parts")
    else:
        rows = rows.withColumn("salt", F.lit(0).cast("long"))
    # a constant among the range's keys would not be known as one of the window's
    ends = ["head", "hash", *(["salt"] if spread else [])]
    order = F.desc_nulls_last("id") if keep == "largest" else F.asc_nulls_last("id")
    # equal texts of a salt are in one range: the window needs no further exchange, its sort is the sort of the range
    equal = W.partitionBy(*ends, "text").orderBy(order)
    whole = equal.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.repartitionByRange(*ends).select("id", "text", "row", "hash", "salt", F.first("id").over(whole).alias("local_keep"), F.count("*").over(whole).alias("local_n"), F.row_number().over(equal).alias("place")), spread


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, keep: str = "largest", carried: tuple[str, ...] = ()) -> DataFrame:
    """The id, keep_id, group_size, kept, text_sha256 and the carried columns of every row.

    Texts are equal when `normalise` makes the same bytes of them (by default: as they are); a null text counts as empty. Of equal texts the row with
    the largest (or smallest) id stays; a row without id only where none of them has one; of repeated rows with that id one stays. An empty table gives none.
    """
    names = [c for c in carried if c not in (id_col, "keep_id", "group_size", "kept", "text_sha256")]
    rows, spread = content_sorted(docs, id_col, text_col, normalise, keep, names)
    first = F.col("place") == 1
    out = (F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256", *(F.col("row")[c].alias(c) for c in names))
    found = rows.select("id", "row", "hash", "salt", "local_keep", "local_n", first.alias("first"), F.sha2("text", 256).alias("text_sha256"), F.when(first & (F.col("salt") > 0), F.col("text")).alias("text"))
    if not spread:
        return found.select("*", F.col("local_keep").alias("keep_id"), F.col("local_n").alias("group_size"), F.col("first").alias("kept")).select(*out)
    found = materialize(found, "exact-sorted")
    # a row for each part of a heavy text: at most one for each PART_SAMPLE rows of the sample
    order = F.desc_nulls_last("local_keep") if keep == "largest" else F.asc_nulls_last("local_keep")
    equal = W.partitionBy("text").orderBy(order, "salt")
    whole = equal.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    parts = found.where("text IS NOT NULL").select(
        "hash", "salt", "text_sha256", F.first("local_keep").over(whole).alias("keep_id"), F.sum("local_n").over(whole).alias("group_size"), (F.row_number().over(equal) == 1).alias("wins")
    )
    parts = materialize(parts, "exact-parts")
    joined = found.drop("text").join(F.broadcast(parts), ["hash", "salt", "text_sha256"], "left")
    own = {"keep_id": F.when(F.col("salt") > 0, F.col("keep_id")).otherwise(F.col("local_keep")), "group_size": F.coalesce("group_size", "local_n"), "kept": F.col("first") & F.coalesce("wins", F.lit(True))}
    return joined.withColumns(own).select(*out)


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, keep: str = "largest") -> DataFrame:
    """The rows of `docs` that stay, with all their columns (the text as it was)."""
    rows, spread = content_sorted(docs, id_col, text_col, normalise, keep, docs.columns if normalise else [c for c in docs.columns if c != text_col])
    firsts = rows.where("place = 1")
    if spread:
        firsts = materialize(firsts.select("id", "text", "row", "salt"), "exact-firsts")
        order = F.desc_nulls_last("id") if keep == "largest" else F.asc_nulls_last("id")
        again = firsts.where("salt > 0").withColumn("place", F.row_number().over(W.partitionBy("text").orderBy(order, "salt")))
        firsts = firsts.where("salt = 0").unionByName(again.where("place = 1").drop("place"))
    inside = normalise is not None
    return firsts.select(*(F.col("text").alias(c) if c == text_col and not inside else F.col("row")[c].alias(c) for c in docs.columns))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = {
    "op12_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)
""",
}
