"""Keyed streams taken in order of event time, as declared state.

Events wait in a key's list until the watermark has passed them, and are then taken in order of time, however they came. So an event that comes
late but within the watermark's delay counts in its place; one that comes later still is dropped by Spark before it gets here, and is counted in the
query's progress (`numRowsDroppedByWatermark`). What is to happen when nothing comes for a while happens by the watermark too, through a timer; nothing
depends on the clock. State is columns (a value, and the events that wait), which the state data source reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _values(column: pd.Series, kind: str) -> list:
    """A column's values; whole numbers are whole even where pandas has made them others for the sake of nulls."""
    found = column.astype(object).where(column.notna(), None).tolist()
    return [None if x is None else int(x) for x in found] if kind in ("int", "bigint") else found


class InOrder(StatefulProcessor):
    """Subclasses name their events (`ts_ms` and `tie` first), their state and their rows, and say what events and silence do to a state."""

    EVENT: str
    STATE: str
    ROW: str

    def takes(self, event: tuple) -> bool:
        """Whether an event counts at all."""
        return True

    def step(self, state: tuple | None, event: tuple) -> tuple[tuple, list[tuple]]:
        """The state after an event, and rows."""
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """The last moment at which an event would still find the state as it is; after it, it lapses."""
        raise NotImplementedError

    def lapse(self, state: tuple) -> tuple[tuple, list[tuple]]:
        """The state after that moment, and rows."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)
        self.waiting = handle.getListState("waiting", self.EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            columns = [_values(frame[part.split()[0]], part.split()[1]) for part in self.EVENT.split(", ")]
            events = [e for e in zip(*columns, strict=True) if self.takes(e)]
            if events:
                self.waiting.appendList(events)
                # Taken when the watermark is past the event.
                for at in {e[0] for e in events}:
                    self.handle.registerTimer(int(at) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed is taken at the first timer; those of the other events find nothing left.
        now = timerValues.getCurrentWatermarkInMs()
        events = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: e[:2]) if self.waiting.exists() else []
        taken = [e for e in events if e[0] < now]
        if taken:
            self.waiting.put(events[len(taken) :]) if len(taken) < len(events) else self.waiting.clear()
        state = tuple(self.state.get()) if self.state.exists() else None
        out: list[tuple] = []
        for event in taken:
            state = self._lapsed(state, event[0], out)
            state, rows = self.step(state, event)
            out += rows
        state = self._lapsed(state, now, out)
        if state is not None:
            self.state.update(state)
            if taken and (due := self.due(state)) is not None:
                self.handle.registerTimer(due + 1)
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=names(self.ROW))

    def _lapsed(self, state: tuple | None, now: int, out: list[tuple]) -> tuple | None:
        due = None if state is None else self.due(state)
        if due is None or due >= now:
            return state
        state, rows = self.lapse(state)
        out += rows
        return state

    def close(self) -> None:
        pass


def over(processor: InOrder, events: DataFrame, key: str, late: str) -> DataFrame:
    """The rows that a processor makes of a stream with `key` and the columns of its events; `late`: how far behind the latest event one may come. Needs the RocksDB state store."""
    typed = [F.col(part.split()[0]).cast(part.split()[1]).alias(part.split()[0]) for part in processor.EVENT.split(", ")]
    timed = events.select(F.col(key).cast("string").alias(key), *typed, F.timestamp_millis(F.col("ts_ms").cast("bigint")).alias("at")).withWatermark("at", late)
    return timed.groupBy(key).transformWithStateInPandas(processor, processor.ROW, "Append", "EventTime")
