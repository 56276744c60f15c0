"""Study sessions over a stream of phase events: a state machine in event time.

A participant's events may arrive in any order within the watermark.  They wait in
state until the watermark passes them and are then taken in their own
order, so batches decide nothing.  A session ends with its last phase or after
``gap`` without an event, by an event-time timer; it is given out once, and its
state is removed.  Sessions that are open when a query starts can be handed over as
initial state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kerbline.streaming.votes import PHASES

#: What a query with this operator needs of the session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

OPEN = "start long, last long, reached int, odd long, events long"
PLACE = {phase: i for i, phase in enumerate(PHASES)}


class Sessions(StatefulProcessor):
    """Events (at: ms, seq, phase) of one participant; yields (key, start, end, reached, out_of_order, events, ended)."""

    def __init__(self, key: str, gap_ms: int):
        self.key, self.gap = key, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)
        self.waiting = handle.getListState("waiting", "at long, seq long, phase string")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState.iloc[0]
        self.open.update(tuple(int(row[c.split()[0]]) for c in OPEN.split(", ")))
        self.handle.registerTimer(int(row["last"]) + self.gap + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch.dropna(subset=["at", "seq", "phase"])  # here, as a filter would be moved below the watermark
            if batch.empty:
                continue
            self.waiting.appendList([(int(a), int(s), str(p)) for a, s, p in zip(batch["at"], batch["seq"], batch["phase"], strict=True)])
        yield from self._go_on(key, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._go_on(key, timerValues)

    def _go_on(self, key: Any, timerValues: Any) -> Iterator[pd.DataFrame]:
        """Take all events that the watermark has passed, in order; then wait for the next one or for the gap."""
        now = timerValues.getCurrentWatermarkInMs()
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [e for e in events if e[0] <= now], [e for e in events if e[0] > now]
        state = list(self.open.get()) if self.open.exists() else None
        done: list[tuple] = []

        def end(why: str) -> None:
            nonlocal state
            done.append((key[0], state[0], state[1], state[2], state[3], state[4], why))
            state = None

        for at, _, phase in due:
            if state and at > state[1] + self.gap:
                end("idle")
            place = PLACE.get(phase, -1)
            if state is None:
                state = [at, at, 0, 0, 0]
            if place < state[2] or place > state[2] + 1:
                state[3] += 1
            state = [state[0], at, max(state[2], place), state[3], state[4] + 1]
            if place == len(PHASES) - 1:
                end("done")
        if state and now > state[1] + self.gap:
            end("idle")
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if state:
            self.open.update(tuple(state))
            self.handle.registerTimer(state[1] + self.gap + 1)
        elif self.open.exists():
            self.open.clear()
        if later:
            self.handle.registerTimer(later[0][0])
        if done:
            yield pd.DataFrame(done, columns=[self.key, "start", "end", "reached", "out_of_order", "events", "ended"])

    def close(self) -> None:
        pass


def study_sessions(stream: DataFrame, key: str, time: str, seq: str, phase: str, gap_ms: int, initial: DataFrame | None = None) -> DataFrame:
    """Finished sessions of a stream with a watermark on ``time``: key, start, end, reached (place of the furthest phase), out_of_order, events, ended.

    Of one moment, events go by ``seq``; rows without a phase or seq only move the watermark.  ``initial`` has the key and the columns of ``OPEN``, one row a key.
    """
    kind = dict(stream.dtypes)[key]
    events = stream.select(F.col(key), F.col(time), F.unix_millis(time).alias("at"), F.col(seq).cast("long").alias("seq"), F.col(phase).alias("phase"))
    schema = f"{key} {kind}, start long, end long, reached int, out_of_order long, events long, ended string"
    found = events.groupBy(key).transformWithStateInPandas(Sessions(key, gap_ms), schema, "append", "eventTime", initialState=initial.groupBy(key) if initial is not None else None)
    return found.select(key, F.timestamp_millis("start").alias("start"), F.timestamp_millis("end").alias("end"), "reached", "out_of_order", "events", "ended")
