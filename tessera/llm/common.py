"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import BATCH_BYTES, BATCH_ROWS, few, materialize, shared_dir, small_batches

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "SPACE", "few", "free_name", "materialize", "read", "shared_dir", "small_batches", "text_or_empty"]

#: White space as the contracts of this subpackage define it: space and \t \n \v \f \r.
SPACE = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(taken: list[str], name: str) -> str:
    """`name`, with as many signs behind it as it takes to be none of `taken`."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
