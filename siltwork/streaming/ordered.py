"""Keyed state machines over rows that arrive late, out of order and more than once.

A key's rows wait in its state until the watermark has passed them; then they are
applied in order of (time, id), each once. Nothing is final before, so a late row
inside the watermark takes its proper place, and what a machine has said needs no
taking back. Rows behind the watermark are Spark's to drop; all of a replayed batch
are, or still wait under the same id. Timers wake a key when its next row or its next
own deadline has passed, so it also moves on without input.
"""

from __future__ import annotations

import json
from abc import abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

WAITING = "at array<long>, id array<long>, row array<string>, wake long"  # the time of the timer in milliseconds, -1 without one


class InOrder(StatefulProcessor):
    """Subclasses say which state they keep, what a row does and what time alone does; times are in microseconds."""

    schema: str  # of the rows that come out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", WAITING)
        self.begin(handle)

    @abstractmethod
    def begin(self, handle: StatefulProcessorHandle) -> None:
        """Names the state variables."""

    def load(self) -> None:
        """Reads what ``apply`` changes, once for all rows at hand."""

    def save(self) -> None:
        """Writes it back."""

    @abstractmethod
    def apply(self, key: tuple, at: int, id: int, row: dict) -> list[tuple]:
        """What a row gives; rows come in order."""

    def tick(self, key: tuple, now: int) -> list[tuple]:
        """What it gives that no row will come up to ``now``; also called with each row's time before the row."""
        return []

    def due(self) -> int | None:
        """When ``tick`` has something to say next."""
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, wake = self._held()
        for frame in rows:
            for at, id, row in zip(frame["at"].tolist(), frame["id"].tolist(), frame["row"].tolist(), strict=True):
                if id >= 0:
                    held.setdefault(id, (at, row))
        yield from self._advance(key, held, wake, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, wake = self._held()
        if 0 <= wake <= timerValues.getCurrentWatermarkInMs():
            yield from self._advance(key, held, wake, timerValues)

    def close(self) -> None:
        pass

    def _held(self) -> tuple[dict[int, tuple[int, str]], int]:
        waiting = self.waiting.get()
        if not waiting:
            return {}, -1
        at, ids, rows, wake = waiting
        return {int(i): (int(a), r) for a, i, r in zip(at, ids, rows, strict=True)}, int(wake)

    def _advance(self, key, held, wake, timers) -> Iterator[pd.DataFrame]:
        """Each access to state is a call to the JVM, so the machine's own is left alone until a row or its timer is due."""
        mark, out = timers.getCurrentWatermarkInMs(), []
        ready = sorted((at, id) for id, (at, _) in held.items() if at <= mark * 1000)
        expired = 0 <= wake <= mark
        following = [-(-at // 1000) for at, _ in held.values() if at > mark * 1000]
        if ready or expired:
            self.load()
            for at, id in ready:
                out += self.tick(key, at - 1)
                out += self.apply(key, at, id, json.loads(held.pop(id)[1]))
            out += self.tick(key, mark * 1000)
            self.save()
            own = self.due()
            following += [] if own is None else [-(-own // 1000)]
        elif wake >= 0:
            following.append(wake)
        first = min(following, default=-1)
        if first >= 0 and (expired or first != wake):
            self.handle.registerTimer(first)
        ids = list(held)
        self.waiting.update(([held[i][0] for i in ids], ids, [held[i][1] for i in ids], first))
        if out:
            yield pd.DataFrame(out, columns=[x.strip().split()[0] for x in self.schema.split(",")])


def machine(rows: DataFrame, key: Column, at: Column, id: str, columns: list[str], processor: InOrder, late: str) -> DataFrame:
    """The processor's rows over a stream; ``at`` is a timestamp, ``id`` unique in a key, ``columns`` what the processor sees.

    A row without an id only moves the clock. Rows without a key are a key of their own;
    rows without a time are never applied.
    """
    rows = rows.where(at.isNotNull()).select(key.alias("key"), at.cast("timestamp").alias("time"), F.coalesce(F.col(id).cast("long"), F.lit(-1)).alias("id"), F.to_json(F.struct(*columns)).alias("row"))
    rows = rows.withWatermark("time", late).withColumn("at", F.unix_micros("time")).select("key", "time", "at", "id", "row")
    return rows.groupBy("key").applyInPandasWithState(_advanced(processor), processor.schema, _state_schema(processor), "append", "EventTimeTimeout")


class Held:
    """A state variable of one key, at hand while the key is."""

    def __init__(self):
        self.value = None

    def exists(self) -> bool:
        return self.value is not None

    def get(self) -> tuple | None:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = value


class Variables:
    """A processor's handle: its variables, in the order in which it names them, and the timer of the key at hand."""

    def __init__(self):
        self.held: list[Held] = []
        self.schemas: list[str] = []

    def getValueState(self, name: str, schema: str) -> Held:
        self.held.append(Held())
        self.schemas.append(f"{name}: struct<{', '.join(': '.join(c.split(None, 1)) for c in schema.split(', '))}>")
        return self.held[-1]

    def registerTimer(self, at: int) -> None:
        """The processor keeps its timer among its variables."""


class Clock:
    def __init__(self, at: int):
        self.at = at

    def getCurrentWatermarkInMs(self) -> int:
        return self.at


def _state_schema(processor: StatefulProcessor) -> str:
    seen = Variables()
    processor.init(seen)
    processor.handle = processor.waiting = None
    return ", ".join(seen.schemas)


def _at_hand(processor: StatefulProcessor, made: list[Variables], state: GroupState) -> list[Held]:
    """The processor's variables with the values of the key at hand."""
    if not made:
        made.append(Variables())
        processor.init(made[0])
    held = made[0].held
    values = state.get if state.exists else [None] * len(held)
    for variable, value in zip(held, values, strict=True):
        variable.value = None if value is None else tuple(value)
    return held


def _advanced(processor: InOrder):
    """All variables of a key come and go with its rows: no call to the JVM for any of them."""
    made: list[Variables] = []

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, clock = _at_hand(processor, made, state), Clock(state.getCurrentWatermarkMs())
        if state.hasTimedOut:
            yield from processor.handleExpiredTimer(key, clock, None)
        else:
            yield from processor.handleInputRows(key, frames, clock)
        state.update(tuple(variable.value for variable in held))
        wake = int(processor.waiting.get()[3])
        if wake >= 0:
            # Spark wakes a key when the watermark is past its time; it must lie ahead
            state.setTimeoutTimestamp(max(wake - 1, clock.at + 1))

    return run


def untimed(rows: DataFrame, key: str, processor: StatefulProcessor) -> DataFrame:
    """The rows of a processor without a clock; as in ``machine``, a key's state comes and goes with its rows."""
    made: list[Variables] = []
    schema = _state_schema(processor)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _at_hand(processor, made, state)
        yield from processor.handleInputRows(key, frames, None)
        state.update(tuple(variable.value for variable in held))

    return rows.groupBy(key).applyInPandasWithState(run, processor.schema, schema, "append", "NoTimeout")
