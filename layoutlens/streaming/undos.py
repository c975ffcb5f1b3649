"""Edits taken back in a stream: what `operators.undo.undone` gives in batch, by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from layoutlens.operators.undo import BACK, EDIT, HOTKEY, MODIFIER, TTL_MS
from layoutlens.streaming.inorder import InOrder, over


class Undos(InOrder):
    EVENT = "ts_ms bigint, tie bigint, kind string, window_id string, original string, replacement string, delimiter string, source_language int"
    #: The edit that may still be undone; `valid` is false where there is none.
    STATE = "made_ms bigint, window_id string, original string, replacement string, delimiter string, source_language int, valid boolean"
    ROW = "session_id string, ts_ms bigint, age_ms bigint, delete_count bigint, restored string, delimiter string, target_language int"

    def __init__(self, ttl_ms: int = TTL_MS) -> None:
        self.ttl_ms = ttl_ms

    def takes(self, event: tuple) -> bool:
        return event[2] != MODIFIER

    def step(self, state, event):
        at, _, kind, *edit = event
        if kind == EDIT:
            return (at, *edit, True), []
        rows = []
        if state is not None and state[6] and kind in (BACK, HOTKEY) and edit[0] == state[1]:
            made, _, original, replacement, delimiter, language, _ = state
            rows = [(at, at - made, len(replacement) + len(delimiter or ""), original, delimiter if kind == HOTKEY else None, language)]
        return (at, None, None, None, None, None, False), rows

    def due(self, state):
        return state[0] + self.ttl_ms if state[6] else None

    def lapse(self, state):
        return (state[0], None, None, None, None, None, False), []


def undo_stream(events: DataFrame, late: str = "2 seconds", ttl_ms: int = TTL_MS) -> DataFrame:
    """session_id and what `undone` tells of every undo, from a stream of edits and what else is typed (session_id, ts_ms, tie and the columns of `undone`)."""
    return over(Undos(ttl_ms), events, "session_id", late)
