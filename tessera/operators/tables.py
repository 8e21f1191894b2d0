"""Keyed tables: upsert, delete, replace, latest row. All return the whole new table; a store writes it as a version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.scope import DIMENSIONS

#: The key of an item: its id within its exact scope.
ITEM_KEY = ("id", *DIMENSIONS)


def key_of(*tables: DataFrame) -> list[str]:
    """The columns of an item's key that all these tables have: an id without scope columns is a key of its own."""
    return [c for c in ITEM_KEY if all(c in t.columns for t in tables)]


def upsert(table: DataFrame, rows: DataFrame, key: tuple[str, ...] = ITEM_KEY) -> DataFrame:
    """`rows` in place of those with their key, and all other rows of `table`."""
    return table.join(rows.select(*key), list(key), "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def repeated_keys(rows: DataFrame, key: tuple[str, ...] = ITEM_KEY) -> DataFrame:
    """Keys that stand in a batch more than once; an upsert needs none."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def delete_exact(table: DataFrame, keys: DataFrame, key: tuple[str, ...] = ITEM_KEY) -> DataFrame:
    return table.join(keys.select(*key).distinct(), list(key), "left_anti").select(*table.columns)


def delete_in_range(table: DataFrame, ids: DataFrame, scope: Column) -> DataFrame:
    """Without the rows in the scope whose id is among `ids`; doing it again changes nothing."""
    hit = table.where(scope).join(ids.select("id").distinct(), "id", "left_semi")
    return table.join(hit.select(*ITEM_KEY).distinct(), list(ITEM_KEY), "left_anti").select(*table.columns)


def replace(table: DataFrame, old: DataFrame, new: DataFrame, key: tuple[str, ...] = ITEM_KEY) -> DataFrame:
    """`new` upserted, and the rows of `old` that have no successor in `new` taken out."""
    stale = old.select(*key).join(new.select(*key), list(key), "left_anti")
    return upsert(delete_exact(table, stale, key), new, key)


def latest(table: DataFrame, key: tuple[str, ...], order: Column) -> DataFrame:
    """The last row of each key."""
    last = F.row_number().over(W.partitionBy(*key).orderBy(order.desc()))
    return table.withColumn("_n", last).where("_n = 1").drop("_n")


def ambiguous(table: DataFrame, id_col: str, scope: Column) -> DataFrame:
    """Ids that stand in several exact scopes of the range: a point lookup of one must fail."""
    return table.where(scope).groupBy(id_col).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def touched(table: DataFrame, keys: DataFrame, column: str, now: Column) -> DataFrame:
    """`table` with `column` set to `now` for the keys: ids within their scopes, as far as both tables have scopes."""
    key = key_of(table, keys)
    hit = keys.select(*key).distinct().withColumn("_hit", F.lit(True))
    return table.join(hit, key, "left").withColumn(column, F.when(F.col("_hit"), now).otherwise(F.col(column))).select(*table.columns)


def with_decoded(table: DataFrame, column: str = "value") -> DataFrame:
    """`table` with is_json and the text of its value: of a JSON text what it stands for, of anything else the raw text."""
    parsed = F.try_parse_json(F.col(column))
    text = F.when(parsed.isNull(), F.col(column)).when(F.schema_of_variant(parsed) == "STRING", F.try_variant_get(parsed, "$", "string")).otherwise(F.to_json(parsed))
    return table.withColumn("is_json", parsed.isNotNull()).withColumn(column, text)


def cleared(table: DataFrame, scope: Column) -> DataFrame:
    """Without the rows of a scope."""
    return table.where(~F.coalesce(scope, F.lit(False)))


def materialised_metadata(table: DataFrame, declared: tuple[str, ...], column: str = "metadata") -> DataFrame:
    """`table` with a text column md_<key> for each declared key of its metadata map, '' where it is missing or null."""
    return table.withColumns({f"md_{k}": F.coalesce(F.col(column)[k].cast("string"), F.lit("")) for k in declared})
