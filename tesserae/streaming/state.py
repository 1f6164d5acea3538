"""The keyed state machines on streams: the same step functions as in batches, their state kept by Spark.

Events are answered in the trigger that brings them, those of one trigger in the order of ts. Where commands may come late,
and where time alone changes what is, tesserae.streaming.ordered waits for the watermark instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType, _parse_datatype_string

from tesserae.streaming.ordered import as_dict, as_tuple, plain, use_rocks

State = dict[str, Any]


class _AtOnce(StatefulProcessor):
    """Folds a key's commands of a trigger as they have come."""

    def __init__(self, key: str, order: str, step: Callable[[State | None, State], tuple[State, State]], state: StructType, idle: int | None):
        self.key, self.order, self.step, self.state, self.idle = key, order, step, state, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.state, self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts", self.order], kind="stable")
        held = as_dict(self.held.get(), self.state) if self.held.exists() else None
        out = []
        for r in pdf.astype(object).to_dict("records"):
            held, row = self.step(held, plain(r))
            out.append(row)
        self.held.update(as_tuple(held, self.state))
        yield pd.concat([pdf[[self.order, self.key]].reset_index(drop=True), pd.DataFrame(out)], axis=1)

    def close(self) -> None:
        pass


def run(events: DataFrame, key: str, order: str, step: Callable[[State | None, State], tuple[State, State]], output: str, state: str, idle: int | None = None) -> DataFrame:
    """(order, key, output...) of every event of a stream, in the trigger that brings it; `idle` (milliseconds) drops the state of keys that no event has reached for so long.

    `state` is the schema of the machine's state, which is kept typed. One key's events of one trigger are sorted in memory: a source's
    limit on a trigger is theirs.
    """
    use_rocks(events.sparkSession)
    kinds = dict(events.dtypes)
    processor = _AtOnce(key, order, step, _parse_datatype_string(state), idle)
    return events.groupBy(key).transformWithStateInPandas(processor, f"{order} {kinds[order]}, {key} {kinds[key]}, {output}", "Append", "ProcessingTime" if idle else "None")


def countdowns(sessions: DataFrame, minutes: str = "10 minutes") -> DataFrame:
    """Sessions that end, by windows of event time: (window, region, n). Late rows are dropped after the window's watermark."""
    return sessions.withWatermark("end", minutes).groupBy(F.window("end", minutes), "region").agg(F.count("*").alias("n"))


def recent_texts(texts: DataFrame, reason: Callable[[str, list[str]], str], most: int = 30) -> DataFrame:
    """(text_id, topic, reason) of a stream of texts (text_id, topic, ts, text): each is judged by what was accepted before it, of which the last `most` are kept."""
    kinds = dict(texts.dtypes)

    def one(ident: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "text_id"], kind="stable")
        held = list(state.get[0]) if state.exists else []
        found = []
        for t in pdf["text"]:
            found.append(reason(t, held))
            if not found[-1]:
                held = [*held, t][-most:]
        state.update((held,))
        yield pd.DataFrame({"text_id": pdf["text_id"].to_numpy(), "topic": pdf["topic"].to_numpy(), "reason": found})

    return texts.groupBy("topic").applyInPandasWithState(one, f"text_id {kinds['text_id']}, topic {kinds['topic']}, reason string", "held array<string>", "append", GroupStateTimeout.NoTimeout)
