"""Streams: stateless anonymisation, counts in windows, and conversations whose numbers live in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskwright.operators.recognise import default_registry
from maskwright.operators.resolve import resolve
from maskwright.operators.spans import prenormalise
from maskwright.operators.tag import map_key, tag_text
from maskwright.policy import Policy

OUTPUT = "conversation_id string, turn int, text string, entity_count int"
STATE = "keys array<string>, originals array<string>"


def anonymise_sessions(stream: DataFrame, policy: Policy | None = None, idle_ms: int | None = None) -> DataFrame:
    """(conversation_id, turn, text, entity_count) of messages (conversation_id, turn, text), numbers kept per conversation.

    Messages of a batch are taken in order of their turn; the state of a conversation idle for ``idle_ms``, if given, is dropped. Null texts stay null.
    """
    rules, registry = policy or Policy(), default_registry()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        keys, originals = state.get if state.exists else ([], [])
        known = dict(zip(keys, originals, strict=True))
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        out = []
        for turn, text in zip(rows["turn"], rows["text"], strict=True):
            found = [] if text is None else resolve(registry.find_all(text, rules), [], text, rules)
            tagged, numbered, fresh = (text, [], {}) if text is None else tag_text(text, found, rules, known)
            known |= fresh
            out.append((key[0], int(turn), tagged, len(numbered)))
        state.update((list(known), list(known.values())))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["conversation_id", "turn", "text", "entity_count"])

    kept = stream.select("conversation_id", F.col("turn").cast("int").alias("turn"), prenormalise(F.col("text")).alias("text")).where("conversation_id IS NOT NULL AND turn IS NOT NULL")
    return kept.groupBy("conversation_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def counts_in_windows(entities: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Entities by type in windows of time; rows later than ``late`` are not counted."""
    windows = entities.withWatermark(time, late).groupBy(F.window(time, width), F.col(kind).alias("pii_type")).agg(F.count(F.lit(1)).alias("n"))
    return windows.select(F.col("window.start").alias("window_start"), "pii_type", "n")


__all__ = ["anonymise_sessions", "counts_in_windows", "map_key"]
