"""Keyed state machines on streams in the order of event time, with changes that time alone brings about.

Commands of a key may arrive in any order, spread over triggers. They wait in a buffer, kept in typed state, until the watermark has
passed them, and are then folded in the order of (ts, order) by the step functions of tesserae.operators.keyed. Between
commands, and where no command comes any more, event-time timers bring about what is due: a session that has 30 minutes left is
ending, whether anything is sent or not. `replay` gives the rows of a batch by the same rules, so a stream that has caught up
has given the rows of the batch.

Defined results: a command that comes later than the watermark's delay allows is dropped by Spark, as in any windowed query. What is due
at the instant of a command comes before it. Rows are (order, key, at, due, output...): for a command `due` is null, for a change
by time `order` is null and `due` names it, with the status as the output's first column and the other columns null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from tesserae.operators.sessions import ENDING, URGENT

State = dict[str, Any]
Step = Callable[[State | None, State], tuple[State, State]]
#: What is due for a state: (instant, name), in any order.
Due = Callable[[State], list[tuple[float, str]]]

TIMER_STATE = "status string, total long, end double, left long, paused boolean"
DESK_STATE = "status string, mode string, start double, end double, extra_count long, extra_fee double, pause_start double, paused double"
_BUCKET = "struct<most: long, rate: double, tokens: double, at: long>"
LIMIT_STATE = f"minute {_BUCKET}, day {_BUCKET}, seen long"

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks(spark: SparkSession) -> None:
    """transformWithState needs this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def nothing_due(state: State) -> list[tuple[float, str]]:
    return []


def desk_due(desk: State) -> list[tuple[float, str]]:
    """A countdown that is not paused is ending, urgent, and out of time."""
    if desk["status"] == "empty" or desk["end"] is None or desk["pause_start"] is not None:
        return []
    return [(desk["end"] - 60 * ENDING, "ending"), (desk["end"] - 60 * URGENT, "urgent"), (desk["end"], "timeout")]


def timer_due(timer: State) -> list[tuple[float, str]]:
    """A running timer nears its end, and passes it."""
    if timer["end"] is None or timer["paused"]:
        return []
    return [(timer["end"] - 60 * URGENT, "WARNING"), (timer["end"], "OVERTIME")]


def next_due(state: State | None, at: float, due: Due) -> tuple[float, str] | None:
    """The first of what is due after `at`."""
    return min((d for d in due(state) if d[0] > at), default=None) if state is not None else None


def advance(state: State | None, at: float, commands: Iterable[State], until: float, step: Step, due: Due) -> Iterator[tuple[State | None, float, State | None, str | None, State | None]]:
    """(state, at, command, due, output) one after another: commands in their order, and between and after them what is due before `until`."""
    for command in [*commands, None]:
        limit = until if command is None else command["ts"]
        while (found := next_due(state, at, due)) and (found[0] < until if command is None else found[0] <= limit):
            at = found[0]
            yield state, at, None, found[1], None
        if command is not None:
            state, output = step(state, command)
            at = command["ts"]
            yield state, at, command, None, output


def _row(command: State | None, at: float, due: str | None, output: State | None, order: str, key: str, ident: Any, names: list[str]) -> State:
    shown = output or {names[0]: due}
    return {order: command and command[order], key: ident, "at": float(at), "due": due, **{n: shown.get(n) for n in names}}


def plain(row: State) -> State:
    return {k: None if v is None or v != v else v.item() if hasattr(v, "item") else v for k, v in row.items()}


def _output(events: DataFrame, key: str, order: str, output: str) -> str:
    kinds = dict(events.dtypes)
    return f"{order} {kinds[order]}, {key} {kinds[key]}, at double, due string, {output}"


_NO_KEY = object()


def replay(events: DataFrame, key: str, order: str, step: Step, output: str, due: Due = nothing_due, until: float = float("inf")) -> DataFrame:
    """The rows of all commands (order, key, ts, ...) of a batch, and of what is due before `until`; ts is in seconds."""
    text = _output(events, key, order, output)
    schema = to_arrow_schema(_parse_datatype_string(text))
    names = [f.name for f in _parse_datatype_string(output)]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, state, at = _NO_KEY, None, float("-inf")

        def went(commands: list[State], limit: float) -> list[State]:
            nonlocal state, at
            rows = []
            for state, at, command, name, out in advance(state, at, commands, limit, step, due):
                rows.append(_row(command, at, name, out, order, key, ident, names))
            return rows

        for batch in batches:
            rows = []
            for r in map(plain, batch.to_pylist()):
                if r[key] != ident:
                    if ident is not _NO_KEY:
                        rows += went([], until)
                    ident, state, at = r[key], None, float("-inf")
                rows += went([r], r["ts"])
            yield pa.RecordBatch.from_pylist(rows, schema)
        if ident is not _NO_KEY:
            yield pa.RecordBatch.from_pylist(went([], until), schema)

    return events.repartition(key).sortWithinPartitions(key, "ts", order).mapInArrow(folded, text)


def as_tuple(value: Any, kind: Any) -> Any:
    if value is None or not isinstance(kind, StructType):
        return value
    cast = {"double": float, "bigint": int}
    return tuple(as_tuple(x, f.dataType) if isinstance(f.dataType, StructType) or x is None else cast.get(f.dataType.simpleString(), lambda v: v)(x) for f, x in ((f, value[f.name]) for f in kind))


def as_dict(value: Any, kind: Any) -> Any:
    if value is None or not isinstance(kind, StructType):
        return value
    return {f.name: as_dict(x, f.dataType) for f, x in zip(kind, value, strict=True)}


class _Ordered(StatefulProcessor):
    """Buffers commands, folds those that the watermark has passed, and has a timer for the next command or the next thing due."""

    def __init__(self, key: str, order: str, step: Step, due: Due, names: list[str], events: StructType, state: StructType):
        self.key, self.order, self.step, self.due, self.names, self.events, self.state = key, order, step, due, names, events, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.events)
        self.held = handle.getValueState("held", StructType().add("at", "double").add("state", self.state))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:  # a part at a time: the trigger's commands of a key are not gathered
            new = [plain(r) for r in pdf[[f.name for f in self.events]].astype(object).to_dict("records")]
            self.waiting.appendList([as_tuple(r, self.events) for r in new])
            earliest = min(r["ts"] for r in new)
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            self.handle.registerTimer(int(first * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        at, state = float("-inf"), None
        if self.held.exists():
            at, state = self.held.get()
            state = as_dict(state, self.state)
        commands = [as_dict(r, self.events) for r in self.waiting.get()]
        ready = sorted((c for c in commands if c["ts"] < now), key=lambda c: (c["ts"], c[self.order]))
        rows = []
        for state, at, command, name, out in advance(state, at, ready, now, self.step, self.due):  # noqa: B007
            rows.append(_row(command, at, name, out, self.order, self.key, key[0], self.names))
        if ready:
            left = [c for c in commands if c["ts"] >= now]
            self.waiting.put([as_tuple(c, self.events) for c in left]) if left else self.waiting.clear()
        else:
            left = commands
        if rows:
            self.held.update((float(at), as_tuple(state, self.state)))
        coming = [c["ts"] for c in left]
        if found := next_due(state, at, self.due):
            coming.append(found[0])
        if coming:
            self.handle.registerTimer(int(min(coming) * 1000) + 1)
        if rows:
            yield pd.DataFrame(rows)

    def close(self) -> None:
        pass


def run(events: DataFrame, key: str, order: str, step: Step, output: str, state: str, delay: str, due: Due = nothing_due) -> DataFrame:
    """The rows of `replay` from a stream of commands (order, key, ts, ...): those that come at most `delay` late, whatever their order.

    ts is in seconds; `state` is the schema of the machine's state. State is kept in RocksDB, which transformWithState requires: the session's
    state store is set to it.
    """
    use_rocks(events.sparkSession)
    names = [f.name for f in _parse_datatype_string(output)]
    processor = _Ordered(key, order, step, due, names, events.schema, _parse_datatype_string(state))
    timed = events.withColumn("event_time", F.timestamp_millis((F.col("ts") * 1000).cast("long"))).withWatermark("event_time", delay)
    return timed.groupBy(key).transformWithStateInPandas(processor, _output(events, key, order, output), "Append", "EventTime")
