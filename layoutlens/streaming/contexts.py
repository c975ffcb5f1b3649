"""Language contexts over a stream: what `operators.context.fold_sessions` gives in batch, emitted as contexts run out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from layoutlens.functions.layout import ENGLISH, OTHER, PERSIAN
from layoutlens.operators.context import TTL_MS
from layoutlens.streaming.inorder import InOrder, names, over

CONTEXT = "session bigint, window_id string, since_ms bigint, until_ms bigint, language int, strength int, observed_words bigint"
NAMES = names(CONTEXT)


def observed(language: int, strength: int, word: int, evidence: int) -> tuple[int, int]:
    """One step of the context, as the column `operators.context.observe` takes it."""
    weight = max(1, min(4, evidence))
    if language == OTHER or strength <= 0:
        return word, weight
    if language == word:
        return word, weight if strength < weight else min(4, strength + 1)
    left = strength - weight
    return (language, left) if left > 0 else (OTHER, 0) if left == 0 else (word, -left)


class Contexts(InOrder):
    EVENT = "ts_ms bigint, tie bigint, window_id string, language int, evidence int"
    STATE = CONTEXT
    ROW = f"typist string, {CONTEXT}"

    def __init__(self, ttl_ms: int = TTL_MS) -> None:
        self.ttl_ms = ttl_ms

    def takes(self, event: tuple) -> bool:
        return event[3] in (ENGLISH, PERSIAN)

    def step(self, state, event):
        at, _, window, language, evidence = event
        rows = []
        if state is not None and state[6] and state[1] != window:
            state, rows = self.lapse(state)
        if state is None or not state[6]:
            state = ((state[0] if state else 0) + 1, window, at, at, OTHER, 0, 0)
        return (*state[:3], at, *observed(state[4], state[5], language, evidence), state[6] + 1), rows

    def due(self, state):
        return state[3] + self.ttl_ms if state[6] else None

    def lapse(self, state):
        # What is left tells the next session's number.
        return (state[0], None, state[2], state[3], OTHER, 0, 0), [state]


def context_stream(words: DataFrame, late: str = "10 seconds", ttl_ms: int = TTL_MS) -> DataFrame:
    """typist and CONTEXT of every context that has run out, from a stream of words (typist, window_id, ts_ms, tie, language, evidence). `tie` orders words of one time."""
    return over(Contexts(ttl_ms), words, "typist", late)
