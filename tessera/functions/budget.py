"""Token budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def output_reserve(window: Column, desired: Column, model_most: Column) -> Column:
    """Tokens kept for the answer: the desired number, at most half the window and what the model can write."""
    half = F.floor(window * 0.5)
    return F.greatest(F.least(desired, half, F.coalesce(model_most, half)), F.lit(0)).cast("long")


def spendable(window: Column, reserve: Column, margin: float = 0.02) -> Column:
    """What is left of the window for the prompt, less a margin."""
    return F.greatest(window - reserve - F.floor(window * margin), F.lit(0)).cast("long")


def quota(budget: Column, ratio: Column, total_ratio: Column) -> Column:
    """A source's part of the budget, rounded down."""
    return F.coalesce(F.floor(budget * ratio / F.nullif(total_ratio, F.lit(0.0))), F.lit(0)).cast("long")


def total_tokens(prompt: Column, completion: Column, *cached: Column) -> tuple[Column, Column]:
    """Prompt tokens with what a cache read or wrote, and all tokens; nulls count 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = zero(prompt)
    for c in cached:
        whole = whole + zero(c)
    return whole, whole + zero(completion)


def renamed_usage(counters: Column) -> Column:
    """prompt_tokens, completion_tokens, total_tokens of a usage struct that calls them promptTokenCount, candidatesTokenCount and totalTokenCount; nulls count 0."""
    names = {"promptTokenCount": "prompt_tokens", "candidatesTokenCount": "completion_tokens", "totalTokenCount": "total_tokens"}
    return F.struct(*(F.coalesce(counters[a], F.lit(0)).cast("long").alias(b) for a, b in names.items()))


def window_split(window: Column, reserve: Column, system: Column, tools: Column, rag_ratio: Column) -> Column:
    """spendable, rag_budget, trajectory_whole, trajectory_apart: what a window leaves beside the answer, the system prompt and the tool schemas.

    rag_budget is a share of that, rounded down. A trajectory that holds the retrieved block itself may fill the window but for answer and schemas
    (trajectory_whole); one beside it gets what the block leaves (trajectory_apart). Nothing is negative.
    """
    least = lambda c: F.greatest(c, F.lit(0)).cast("long")
    spare = least(window - reserve - system - tools)
    rag = F.floor(spare * rag_ratio).cast("long")
    return F.struct(spare.alias("spendable"), rag.alias("rag_budget"), least(window - reserve - tools).alias("trajectory_whole"), least(spare - rag).alias("trajectory_apart"))


def context_limits(window: Column, rag_ratio: float, fraction: float = 0.5) -> tuple[Column, Column]:
    """max_tokens of a context, a fraction of the window, and the share of it for retrieval; both rounded down."""
    return F.floor(window * fraction).cast("long"), F.floor(window * (rag_ratio * fraction)).cast("long")
