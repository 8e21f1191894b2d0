"""Streams with state of their own by key: counters of a run, the part of a session that is summed up."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def run_counters(events: DataFrame) -> DataFrame:
    """run_id, llm_calls, tool_calls, tokens_used: after each batch the counters so far of the runs in it. `events` has run_id, type, tokens; events without run are left out.

    Output mode: update. The state of a run is three numbers.
    """

    def count(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        llm, tool, tokens = state.get if state.exists else (0, 0, 0)
        for f in frames:
            llm += int((f["type"] == "llm").sum())
            tool += int((f["type"] == "tool").sum())
            tokens += int(f["tokens"].fillna(0).sum())
        state.update((llm, tool, tokens))
        yield pd.DataFrame({"run_id": [key[0]], "llm_calls": [llm], "tool_calls": [tool], "tokens_used": [tokens]})

    schema = "llm_calls long, tool_calls long, tokens_used long"
    kept = events.where("run_id IS NOT NULL").select("run_id", "type", "tokens")
    return kept.groupBy("run_id").applyInPandasWithState(count, f"run_id string, {schema}", schema, "update", GroupStateTimeout.NoTimeout)


def running_summaries(messages: DataFrame, summarise: Callable[[str, list[str]], str], *, keep_recent: int = 4) -> DataFrame:
    """session, n_summed, summary: a session's summary as its messages come; it takes in what is no longer among the last `keep_recent`.

    `messages` has session, seq, content, in order of seq by batch. `summarise` makes a new summary of the old one and the messages to take in; it is called once for each session
    and batch that has some. The state of a session is its summary and its recent messages. Output mode: update.
    """

    def take_in(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        summary, n, recent = state.get if state.exists else ("", 0, "[]")
        rows = pd.concat(list(frames)).sort_values("seq")
        recent = [*json.loads(recent), *rows["content"].fillna("")]
        old, recent = recent[: max(0, len(recent) - keep_recent)], recent[-keep_recent:]
        if old:
            summary, n = summarise(summary, old), n + len(old)
        state.update((summary, n, json.dumps(recent)))
        yield pd.DataFrame({"session": [key[0]], "n_summed": [n], "summary": [summary]})

    kept = messages.select(F.col("session").cast("string").alias("session"), "seq", "content")
    return kept.groupBy("session").applyInPandasWithState(take_in, "session string, n_summed long, summary string", "summary string, n long, recent string", "update", GroupStateTimeout.NoTimeout)
