"""Tool registries as tables: permissions, selection, retrieval fallbacks, pinning, names."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.shared import few


def permitted(name: Column, origin: Column, *, deny_names: tuple[str, ...] = (), deny_origins: tuple[str, ...] = (), allow_names: tuple[str, ...] = (), allow_origins: tuple[str, ...] = ()) -> Column:
    """A denied name or origin is out; with an allowlist, only what it names or whose origin it names is in."""
    denied = name.isin(*deny_names) | origin.isin(*deny_origins)
    listed = name.isin(*allow_names) | origin.isin(*allow_origins) if allow_names or allow_origins else F.lit(True)
    return ~denied & listed


def selected(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """request_id, place, name: the wanted names (an array) that exist, each once, in their order."""
    rows = wanted.select("request_id", F.posexplode(F.array_distinct("names")).alias("place", "name"))
    return rows.join(registry.select("name"), "name", "left_semi").select("request_id", "place", "name")


def retrieved(hits: DataFrame, registry: DataFrame, queries: DataFrame, *, top_k: int = 5, always: tuple[str, ...] = (), fallback: str = "all", selector: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, place, name: the resident tools, then hits (query_id, rank, name) that exist and are not among them.

    A selector takes the hits and gives those to use, with their ranks.
    A query without hits gets all tools, only the resident ones, or none, by `fallback`.
    """
    known = (selector(hits) if selector else hits).join(registry.select("name"), "name", "left_semi").where(F.col("rank") <= top_k)
    named = registry.select("name").where(F.col("name").isin(*always)).distinct()
    fixed = queries.select("query_id").crossJoin(F.broadcast(named))  # no more than are named in the call
    fixed = fixed.select("query_id", F.lit(0).alias("tier"), F.lit(0).alias("rank"), "name")
    found = known.where(~F.col("name").isin(*always)).select("query_id", F.lit(1).alias("tier"), "rank", "name")
    none = queries.select("query_id").join(known.select("query_id"), "query_id", "left_anti")
    if fallback == "all":
        others = registry.select("name").where(~F.col("name").isin(*always))
        # every tool for every such query is what is asked for; the smaller side goes to all tasks if it is small
        rest = none.crossJoin(F.broadcast(others) if few(others) else others).select("query_id", F.lit(2).alias("tier"), F.lit(0).alias("rank"), "name")
        out = fixed.unionByName(found).unionByName(rest)
    else:
        out = fixed.unionByName(found)
        if fallback == "none":
            out = out.join(none, "query_id", "left_anti")
    return out.select("query_id", F.row_number().over(W.partitionBy("query_id").orderBy("tier", "rank", "name")).alias("place"), "name")


def index_text(name: Column, description: Column, parameters: Column) -> Column:
    return F.concat(name, F.lit(": "), F.concat_ws(" ", description, F.array_join(parameters, " ")))


def canonical_json(text: Column) -> Column:
    """A JSON text in one form: keys in order, no spaces; a text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def pin(name: Column, description: Column, schema: Column) -> Column:
    """sha256 of a definition, its schema in canonical form; one that changes is another tool."""
    schema = canonical_json(schema)
    return F.sha2(F.concat(name, F.lit("\0"), F.coalesce(description, F.lit("")), F.lit("\0"), F.coalesce(schema, F.lit(""))), 256)


def unique_names(tools: DataFrame, order: str, most: int = 64, registry: tuple[str, ...] = ()) -> DataFrame:
    """`tools` with unique_name: in order, a name that is taken gets _2, _3, ... until it is free, cut to fit.

    Names that could meet share their first characters but for numbers at the end. Where all names of such a group are equal their number
    is the suffix; groups of different names, as a, a and a_2, are small and go through one by one.
    """
    stem = F.left(F.regexp_replace("name", "(_[0-9]+)+$", ""), F.lit(most - 12))
    group = W.partitionBy(*registry, "_stem")
    marked = tools.withColumn("_stem", stem).withColumn("_plain", F.min("name").over(group) == F.max("name").over(group))
    nth = F.row_number().over(W.partitionBy(*registry, "name").orderBy(order))
    plain = marked.where("_plain").withColumn("_n", nth)
    suffix = F.concat(F.lit("_"), F.col("_n").cast("string"))
    named = F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat(F.left(F.col("name"), F.lit(most) - F.char_length(suffix)), suffix))
    plain = plain.withColumn("unique_name", named).select(*tools.columns, "unique_name")

    columns = tools.columns

    def one_by_one(frame: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        last: dict[str, int] = {}
        out = []
        frame = frame.sort_values(order)
        for name in frame["name"]:
            new, n = name, last.get(name, 1)
            while new in taken:
                n += 1
                new = f"{name[: most - len(str(n)) - 1]}_{n}"
            last[name] = n
            taken.add(new)
            out.append(new)
        return frame[columns].assign(unique_name=out)

    mixed = marked.where("NOT _plain")
    schema = T.StructType([*tools.schema, T.StructField("unique_name", T.StringType())])
    return plain.unionByName(mixed.groupBy(*registry, "_stem").applyInPandas(one_by_one, schema))


def catalog(tools: DataFrame, *by: str) -> DataFrame:
    """A line for each tool, by name."""
    one = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.coalesce("description", F.lit("")))
    return tools.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", one.alias("t")))), lambda s: s["t"]), "\n").alias("catalog"))


def first_trip(checks: DataFrame) -> DataFrame:
    """subject, guard: the first guardrail (by place) that a subject fails, null if none."""
    return checks.groupBy("subject").agg(F.min_by("guard", F.when(~F.col("passed"), F.col("place"))).alias("guard"))


def resolved_limits(calls: DataFrame, profiles: DataFrame, catalogue: DataFrame, default_model: str) -> DataFrame:
    """`calls` (model, context_window, max_output) with the limits that hold: those given, else the profile's for the default model, else the catalogue's, else null.

    Both tables are (model, context_window, max_output), one row for each model.
    """
    fields = ("context_window", "max_output")
    own = profiles.where(F.col("model") == default_model).select("model", *(F.col(f).alias(f"_p_{f}") for f in fields))
    listed = catalogue.select("model", *(F.col(f).alias(f"_c_{f}") for f in fields))
    met = calls.join(own, "model", "left").join(listed, "model", "left")
    return met.withColumns({f: F.coalesce(f, f"_p_{f}", f"_c_{f}") for f in fields}).select(*calls.columns)


def resolved_capability(given: Column, by_model: Column, by_provider: Column) -> Column:
    """What is given, else what the model is known for, else the provider's default."""
    return F.coalesce(given, by_model, by_provider)


def retryable(status: Column, error: Column) -> Column:
    """Whether a request may be sent again: a status of 408, 429 or 500 and more, or an error whose class speaks of a timeout."""
    slow = F.coalesce(F.lower(error).contains("timeout"), F.lit(False))
    return F.coalesce(status.isin(408, 429) | (status >= 500), F.lit(False)) | slow


def joined_text(blocks: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """by, text, truncated: the text blocks of a result joined by line breaks, up to `most` characters; the block that goes over is cut."""
    size = F.char_length(F.coalesce("text", F.lit(""))) + 1
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    placed = blocks.withColumn("_end", F.sum(size).over(w) - 1).withColumn("_start", F.col("_end") - size + 1)
    whole = F.max("_end")
    # a block that starts at the bound itself still leaves the line break before it
    kept = F.when(F.col("_start") <= most, F.left(F.coalesce("text", F.lit("")), F.greatest(F.lit(most) - F.col("_start"), F.lit(0)).cast("int")))
    joined = placed.groupBy(by).agg(F.array_sort(F.collect_list(F.when(kept.isNotNull(), F.struct(order, kept.alias("t"))))).alias("s"), (whole > most).alias("truncated"))
    return joined.select(by, F.array_join(F.transform("s", lambda s: s["t"]), "\n").alias("text"), "truncated")


def cut_output(text: Column, most: int) -> tuple[Column, Column]:
    """A command's output cut to `most` characters, and its status: partial if it was cut."""
    over = F.char_length(text) > most
    return F.left(text, F.lit(most)), F.when(over, F.lit("partial")).otherwise(F.lit("ok"))
