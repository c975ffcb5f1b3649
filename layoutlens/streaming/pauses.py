"""Pauses in typing over a stream of key strokes: the word so far, whenever no stroke has come for as long as its writer's cadence asks for.

The word is judged by columns afterwards (`judged`): only words that a key left waiting are corrected at a pause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layoutlens.functions.text import MOST_KEYS
from layoutlens.operators import decide as D
from layoutlens.operators.context import FASTEST, MIDDLE, SLOWEST
from layoutlens.operators.typing import BACK, KEY
from layoutlens.streaming.inorder import InOrder, over

#: Keys that a word must have to be judged at a pause.
LEAST_KEYS = 2


def next_cadence(average: int, interval: int) -> int:
    """As the column `functions.text.next_cadence`."""
    average = average if FASTEST <= average <= SLOWEST else MIDDLE
    return (3 * average + interval) // 4 if 20 <= interval <= 1_500 else average


def idle_delay(sensitivity: int, average: int) -> int:
    """As the column `functions.text.idle_delay`."""
    pace = max(FASTEST, min(SLOWEST, average))
    times, low, high = {2: (2, 280, 650), 0: (4, 650, 1_200)}.get(sensitivity, (3, 450, 900))
    return max(low, min(high, times * pace))


class Pauses(InOrder):
    EVENT = "ts_ms bigint, tie bigint, stroke string, english string, persian string"
    #: The word's keys in both readings, the keys beyond MOST_KEYS, the cadence, when the last key came (0: none in this word), and whether a pause is awaited.
    STATE = "en string, fa string, overflow int, cadence int, last_ms bigint, awaited boolean"
    ROW = "session_id string, ts_ms bigint, en string, fa string, cadence int"

    def __init__(self, sensitivity: int = 1) -> None:
        self.sensitivity = sensitivity

    def step(self, state, event):
        at, _, stroke, english, persian = event
        en, fa, overflow, cadence, last, _ = state or ("", "", 0, MIDDLE, 0, False)
        if stroke == KEY:
            cadence = next_cadence(cadence, at - last) if last else cadence
            if len(en) < MOST_KEYS and not overflow:
                en, fa = en + english, fa + persian
            else:
                overflow += 1
            return (en, fa, overflow, cadence, at, overflow == 0 and len(en) >= LEAST_KEYS), []
        if stroke == BACK:
            overflow, en, fa = (overflow - 1, en, fa) if overflow else (0, en[:-1], fa[:-1])
            return (en, fa, overflow, cadence, 0, False), []
        return ("", "", 0, cadence, 0, False), []

    def due(self, state):
        return state[4] + idle_delay(self.sensitivity, state[3]) if state[5] else None

    def lapse(self, state):
        return (*state[:5], False), [(self.due(state), *state[:2], state[3])]


def pause_stream(strokes: DataFrame, late: str = "2 seconds", sensitivity: int = 1) -> DataFrame:
    """session_id, ts_ms (when the pause was long enough), en, fa, cadence, from a stream of strokes (session_id, ts_ms, tie, stroke, english, persian; each reading one character).

    A stroke at the very moment still prevents the pause. Every pause is told once.
    """
    return over(Pauses(sensitivity), strokes, "session_id", late)


def judged(pauses: DataFrame, active: Column, sensitivity: Column, context: Column, strength: Column, sentence_start: Column) -> DataFrame:
    """Classified words of pauses with priors, with the decision `d` of the pause: none where the last key would not have waited for one."""
    waited = D.contextual(active, sensitivity, context, strength, sentence_start, F.lit(D.LIVE))["action"] == D.WAIT
    made = D.contextual(active, sensitivity, context, strength, sentence_start, F.lit(D.IDLE))
    return pauses.withColumn("d", F.when(waited, made))
