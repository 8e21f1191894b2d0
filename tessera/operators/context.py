"""Context selection: exact dedup, maximal marginal relevance, quotas, greedy budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vectors as vx
from tessera.functions.text import token_count


def exact_dedup(candidates: DataFrame) -> DataFrame:
    """Of equal contents of a query the best-scored, in the order in which contents first appear (`place`)."""
    w = W.partitionBy("query_id", "content")
    best = candidates.withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), "pos"))).withColumn("_first", F.min("pos").over(w)).where("_n = 1")
    return best.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("_first"))).drop("_n", "_first")


def normalized(candidates: DataFrame) -> DataFrame:
    """`candidates` with relevance: scores as a share of the query's largest, min-max if any is negative."""
    w = W.partitionBy("query_id")
    return candidates.withColumn("relevance", vx.share_of_max(F.col("score"), F.min("score").over(w), F.max("score").over(w)))


def mmr(candidates: DataFrame, *, k: int | None = 5, trade_off: float = 0.7, same: float = 0.95) -> DataFrame:
    """query_id, pick (from 1), pos: greedy choice by trade_off * relevance - (1 - trade_off) * largest similarity to the chosen.

    `candidates` has query_id, pos, score, embedding: a bounded pool for each query. A candidate as similar as `same` to a chosen one is out; one
    without embedding is similar to none. Ties go to the earliest. With a column content, of equal contents only the best-scored is a candidate, at the place
    where the content first stands. k None: all that are not out. Each query is one fold over its pool, inside the JVM.
    """
    if "content" in candidates.columns:
        origin = F.col("pos")
        once = exact_dedup(candidates.withColumn("_origin", origin))
        picked = mmr(once.drop("content").withColumn("pos", F.col("place")), k=k, trade_off=trade_off, same=same)
        back = once.select("query_id", F.col("place").alias("pos"), "_origin")
        return picked.join(back, ["query_id", "pos"]).select("query_id", "pick", F.col("_origin").alias("pos"))
    rows = normalized(candidates).select("query_id", F.struct("pos", "relevance", F.col("embedding").alias("e"), F.lit(None).cast("double").alias("sim")).alias("c"))
    pool = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("left"), F.count("*").alias("n"))
    empty = F.array().cast(f"array<{candidates.schema['pos'].dataType.simpleString()}>")
    start = F.struct(F.col("left").alias("left"), empty.alias("picked"))

    def value(c: Column) -> Column:
        return trade_off * c["relevance"] - (1 - trade_off) * F.coalesce(c["sim"], F.lit(0.0))

    def step(state: Column, _: Column) -> Column:
        fine = F.filter(state["left"], lambda c: F.coalesce(c["sim"], F.lit(-2.0)) < same)
        best = F.reduce(fine, fine[0], lambda a, c: F.when(value(c) > value(a), c).otherwise(a))
        rest = F.transform(
            F.filter(fine, lambda c: c["pos"] != best["pos"]),
            lambda c: F.struct(c["pos"].alias("pos"), c["relevance"].alias("relevance"), c["e"].alias("e"), F.greatest(c["sim"], vx.cosine(c["e"], best["e"])).alias("sim")),
        )
        return F.when(F.size(fine) > 0, F.struct(rest.alias("left"), F.array_append(state["picked"], best["pos"]).alias("picked"))).otherwise(state)

    chosen = pool.select("query_id", F.reduce(F.sequence(F.lit(1), F.col("n").cast("int") if k is None else F.lit(k)), start, step, lambda s: s["picked"]).alias("picked"))
    return chosen.select("query_id", F.posexplode("picked").alias("pick", "pos")).withColumn("pick", F.col("pick") + 1)


def quotas(sources: DataFrame, budget: int | Column) -> DataFrame:
    """`sources` (query_id, source, ratio) with quota: the budget by ratio among the sources that are there, rounded down."""
    total = F.sum("ratio").over(W.partitionBy("query_id"))
    return sources.withColumn("quota", F.coalesce(F.floor((budget if isinstance(budget, Column) else F.lit(budget)) * F.col("ratio") / F.nullif(total, F.lit(0.0))), F.lit(0)).cast("long"))


def greedy(candidates: DataFrame, limit: Column, *by: str) -> DataFrame:
    """`candidates` (with pos, tokens) with `taken`: those up to the first that would exceed the limit, none after it."""
    upto = F.sum("tokens").over(W.partitionBy(*by).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return candidates.withColumn("taken", upto <= limit)


def allocated(candidates: DataFrame, ratios: DataFrame, budget: int | DataFrame) -> DataFrame:
    """query_id, source, pos, tokens, round (1, 2 or null): two rounds of a shared budget.

    In round 1 each source takes up to its quota. What is left over is lent to the sources with candidates left, by the tokens that those
    still want, and they take again up to their part of it. `candidates` has query_id, source, pos, tokens; ratios source, ratio; the budget is
    one for all queries or a table (query_id, budget).
    """
    present = candidates.select("query_id", "source").distinct().join(ratios, "source")
    present = present.join(budget, "query_id") if isinstance(budget, DataFrame) else present.withColumn("budget", F.lit(budget))
    given = quotas(present, F.col("budget")).select("query_id", "source", "quota")
    first = greedy(candidates.join(given, ["query_id", "source"]), F.col("quota"), "query_id", "source")
    w = W.partitionBy("query_id")
    used = F.sum(F.when(F.col("taken"), F.col("tokens")).otherwise(0)).over(w)
    wanted = F.sum(F.when(F.col("taken"), 0).otherwise(F.col("tokens")))
    # what is idle: the quotas' sum less what was taken
    quota_sum = given.groupBy("query_id").agg(F.sum("quota").alias("_quotas"))
    whole = first.join(quota_sum, "query_id") if isinstance(budget, DataFrame) else first.withColumn("_quotas", F.lit(budget))
    state = whole.withColumn("idle", F.col("_quotas") - used).withColumn("want", wanted.over(W.partitionBy("query_id", "source"))).withColumn("want_all", wanted.over(w))
    share = F.floor(F.col("idle") * F.col("want") / F.nullif(F.col("want_all"), F.lit(0)))
    again = greedy(state.where("NOT taken").withColumn("share", share).drop("taken"), F.col("share"), "query_id", "source")
    return state.where("taken").select("query_id", "source", "pos", "tokens", F.lit(1).alias("round")).unionByName(again.select("query_id", "source", "pos", "tokens", F.when(F.col("taken"), 2).alias("round")))


SECTION_ORDER = ("memory", "rag", "history", "tool")


def sections(chosen: DataFrame) -> DataFrame:
    """query_id, context: contents by source in the fixed order, other sources after them by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SECTION_ORDER)), F.col("source")), F.lit(0)), F.lit(len(SECTION_ORDER) + 1))
    by_source = chosen.withColumn("place", place).groupBy("query_id", "place", "source").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("c"))
    text = F.concat(F.lit("## "), F.col("source"), F.lit("\n"), F.array_join(F.transform("c", lambda c: c["content"]), "\n"))
    return by_source.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "source", text.alias("t")))).alias("s")).select("query_id", F.array_join(F.transform("s", lambda s: s["t"]), "\n\n").alias("context"))


def overhead(ratios: DataFrame) -> Column:
    """Tokens of the section headers of all sources and of the blank lines between them, as a scalar: whether a source will have text is not known before."""
    headers = ratios.select(F.sum(token_count(F.concat(F.lit("## "), F.col("source"), F.lit("\n")))).alias("h"), F.count("*").alias("n")).first()  # one row
    return F.lit((headers.h or 0) + max(0, headers.n - 1))


def build_block(queries: DataFrame, candidates: DataFrame, ratios: DataFrame, *, max_tokens: int | None = None, budget: int | None = None, reserve: float = 0.2, fixed: Column | None = None, trade_off: float = 0.7, same: float = 0.95) -> DataFrame:
    """query_id, context: for each query the chosen candidates of all sources as sections; '' where there are none.

    `queries` has query_id and query, `candidates` query_id, source, pos, score, content, embedding, `ratios` source, ratio. Within a source the order is that of
    mmr() without equal contents; what is taken follows allocated(). The budget is given as it is, or is max_tokens less the reserve for the
    answer and what is fixed (by default the query); the overhead of sections comes off both.
    """
    if budget is None and not max_tokens:
        raise ValueError("a context needs max_tokens or a budget")
    kept = F.lit(budget) if budget is not None else F.lit(max_tokens - int(max_tokens * reserve)) - (token_count(F.col("query")) if fixed is None else fixed)
    limits = queries.select("query_id", F.greatest(kept - overhead(ratios), F.lit(0)).alias("budget"))
    key = F.struct("query_id", "source")
    pools = candidates.withColumn("_pool", key)
    order = mmr(pools.select(F.col("_pool").alias("query_id"), "pos", "score", "content", "embedding"), k=None, trade_off=trade_off, same=same).select("query_id.query_id", "query_id.source", "pick", "pos")
    rows = order.join(candidates.select("query_id", "source", "pos", "content"), ["query_id", "source", "pos"]).drop("pos").withColumnRenamed("pick", "pos")
    taken = allocated(rows.withColumn("tokens", token_count(F.concat("content", F.lit("\n")))), ratios, limits).where("round IS NOT NULL")
    text = sections(taken.join(rows.select("query_id", "source", "pos", "content"), ["query_id", "source", "pos"]))
    return queries.select("query_id").join(text, "query_id", "left").select("query_id", F.coalesce("context", F.lit("")).alias("context"))


def build(queries: DataFrame, candidates: DataFrame, ratios: DataFrame, *, max_tokens: int, system: str = "", reserve: float = 0.2, **how: float) -> DataFrame:
    """query_id, context: system prompt, sections and question as one text within max_tokens less the reserve."""
    question = F.concat(F.lit("## question\n"), F.col("query"))
    block = build_block(queries, candidates, ratios, max_tokens=max_tokens, reserve=reserve, fixed=token_count(F.lit(system)) + token_count(question), **how)
    parts = F.filter(F.array(F.lit(system), F.col("context"), question), lambda x: x != "")
    return queries.join(block, "query_id").select("query_id", F.array_join(parts, "\n\n").alias("context"))
