"""Keyed state machines over ordered events: table timers, desks, and token buckets.

The step functions are small and pure: (state, event) to (state, output). A batch runs them over rows
sorted by key and time, holding the state of one key at a time; tesserae.streaming runs the same functions on streams. One key's events are folded
one after another, as each depends on the one before it; different keys are independent.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Most seconds of a timer; capacity, window of the buckets for most paths, for the review path, and of a day; when idle entries go.
DAY_SECONDS = 86_400
MINUTE, REVIEW, DAY = (5, 60_000), (8, 64_000), (50, 86_400_000)
REVIEW_PATH, STALE_MS = "/api/review", 2 * 86_400_000

State = dict[str, Any]
NEW_TIMER: State = {"status": "IDLE", "total": 3600, "end": None, "left": 0, "paused": False}


def clamp_seconds(x: float) -> int:
    return max(0, min(DAY_SECONDS, int(x)))


def timer_step(state: State | None, event: State) -> tuple[State, State]:
    """One command on a table's timer; ts and end are epoch seconds. A start with nothing left, or a command without its minutes, is refused."""
    t, now, action = dict(state or NEW_TIMER), event["ts"], event["action"]
    refused = False
    minutes = event.get("minutes")
    if action == "start":
        left = clamp_seconds((t["left"] if t["paused"] else t["total"]) or t["total"])
        refused = left <= 0
        if not refused:
            t |= {"status": "RUNNING", "end": now + left, "left": 0, "paused": False}
    elif action == "pause":
        if t["status"] != "IDLE" and not t["paused"]:
            t |= {"left": t["total"] if t["end"] is None else clamp_seconds(t["end"] - now), "end": None, "paused": True, "status": "RUNNING"}
    elif action == "reset":
        t = NEW_TIMER | {"total": t["total"]}
    elif minutes is None:
        refused = True
    elif action == "set_total":
        t["total"] = clamp_seconds(minutes * 60)
        if t["status"] == "IDLE":
            t |= {"left": 0, "end": None, "paused": False}
        elif t["paused"]:
            t["left"] = t["total"]
        else:
            t["end"] = now + t["total"]
    elif action in ("add_time", "sub_time"):
        shift = minutes * 60 * (1 if action == "add_time" else -1)
        if t["status"] == "IDLE":
            t["total"] = clamp_seconds(t["total"] + shift)
        elif t["paused"]:
            t["left"] = clamp_seconds(t["left"] + shift)
        elif t["end"] is not None:
            t["end"] += shift
    if t["status"] != "IDLE" and not t["paused"] and t["end"] is not None:
        t["status"] = "OVERTIME" if t["end"] <= now else "RUNNING"
    return t, {"status": t["status"], "total": t["total"], "end": t["end"], "left": t["left"], "paused": t["paused"], "refused": refused}


def _bucket(kind: tuple[int, int], now: int) -> State:
    return {"most": kind[0], "rate": kind[0] / kind[1], "tokens": float(kind[0]), "at": now}


def _refill(b: State, now: int) -> State:
    return b | {"tokens": min(b["most"], b["tokens"] + max(0, now - b["at"]) * b["rate"]), "at": now}


def _wait(b: State) -> int:
    return 0 if b["tokens"] >= 1 else max(1, math.ceil((1 - b["tokens"]) / b["rate"] / 1000))


def limit_step(state: State | None, event: State) -> tuple[State, State]:
    """One request of an address; ts is epoch milliseconds. Both buckets must hold a token; a refused request spends none."""
    now = event["ts"]
    kind = REVIEW if event["path"] == REVIEW_PATH else MINUTE
    if state is None or now - state["seen"] > STALE_MS:
        state = {"minute": _bucket(kind, now), "day": _bucket(DAY, now)}
    elif state["minute"]["most"] != kind[0]:
        state = state | {"minute": _bucket(kind, now)}
    minute, day = _refill(state["minute"], now), _refill(state["day"], now)
    allowed = minute["tokens"] >= 1 and day["tokens"] >= 1
    wait = 0 if allowed else max(_wait(minute), _wait(day))
    if allowed:
        minute, day = minute | {"tokens": minute["tokens"] - 1}, day | {"tokens": day["tokens"] - 1}
    return {"minute": minute, "day": day, "seen": now}, {"allowed": allowed, "retry_after": wait}


NEW_DESK: State = {"status": "empty", "mode": "countdown", "start": None, "end": None, "extra_count": 0, "extra_fee": 0.0, "pause_start": None, "paused": 0}


def _hour(ts: float) -> int:
    return int(ts // 3600) % 24


def extension_fee(minutes: float, hour: int) -> float:
    from tesserae.functions.money import BLOCK_MINUTES, HALF_RATE, HOUR_RATE, LATE

    blocks = math.ceil(max(0, minutes) / BLOCK_MINUTES)
    return blocks // 2 * HOUR_RATE[hour >= LATE] + blocks % 2 * HALF_RATE[hour >= LATE]


def added_fee(minutes: float, hour: int) -> float:
    """The price of time that is added in one go: that of half an hour for 30 minutes, of an hour for anything else."""
    from tesserae.functions.money import HALF_RATE, HOUR_RATE, LATE

    return (HALF_RATE if minutes == 30 else HOUR_RATE)[hour >= LATE]


def desk_step(state: State | None, event: State) -> tuple[State, State]:
    """One command on a desk: start, add, pause, resume, adjust, cancel or finish; ts is epoch seconds.

    start needs minutes (countdown) or none (count up); what does not fit the state is ignored. The pause counts
    as paused time, and moves a countdown's end. Time can be added to, and adjusted on, countdowns only, and added only
    while they are not paused; it runs from the later of end and now, at now's rate. Overtime goes by the rate at the
    session's end. Rates are those of the hour where the desk stands: the event's `offset` is that of its clock from UTC in
    seconds; without it the event's `hour`, that of ts on the clock, tells it in whole hours; without both it is 0.
    """
    d, now, action = dict(state or NEW_DESK), event["ts"], event["action"]
    minutes = event.get("minutes")
    offset = event.get("offset")
    if offset is None:
        offset = 0 if event.get("hour") is None else (event["hour"] - _hour(now)) % 24 * 3600
    hour = _hour(now + offset)
    closed = None
    busy = d["status"] != "empty"
    timed = busy and d["mode"] == "countdown"
    if action == "start" and not busy:
        d = NEW_DESK | {"status": "running", "start": now, "mode": "countup" if minutes is None else "countdown", "end": None if minutes is None else now + 60 * minutes}
    elif action == "add" and timed and d["pause_start"] is None and minutes:
        d |= {"end": max(d["end"], now) + 60 * minutes, "extra_count": d["extra_count"] + 1, "extra_fee": d["extra_fee"] + added_fee(minutes, hour)}
    elif action == "pause" and busy and d["pause_start"] is None:
        d["pause_start"] = now
    elif action == "resume" and busy and d["pause_start"] is not None:
        gap = max(0, now - d["pause_start"])
        d |= {"paused": d["paused"] + gap, "pause_start": None, "end": None if d["end"] is None else d["end"] + gap}
    elif action == "adjust" and timed and minutes and minutes > 0:
        d["end"] = now + 60 * minutes
    elif action == "cancel" and busy:
        d = dict(NEW_DESK)
    elif action == "finish" and busy:
        at = now if d["pause_start"] is None else d["pause_start"]
        over = 0 if d["end"] is None else max(0, at - d["end"])
        from tesserae.functions.money import GRACE_SECONDS

        late = 0.0 if over <= GRACE_SECONDS else extension_fee(math.ceil(over / 60), _hour(d["end"] + offset))
        closed = {"minutes": math.ceil(max(0, at - d["start"] - d["paused"]) / 60), "over": int(over), "fee": d["extra_fee"] + late}
        d = dict(NEW_DESK)
    out = closed or {"minutes": None, "over": None, "fee": None}
    return d, {"status": d["status"], "closed": closed is not None, **out}


def fold(step: Callable[[State | None, State], tuple[State, State]], events: Iterable[State], state: State | None = None) -> tuple[State | None, list[State]]:
    out = []
    for event in events:
        state, row = step(state, event)
        out.append(row)
    return state, out


_NO_KEY = object()


def run(events: DataFrame, key: str, order: str, step: Callable[[State | None, State], tuple[State, State]], output: str) -> DataFrame:
    """(event_id, key, output...) of every event; order is the column that breaks ties of ts."""
    kinds = dict(events.dtypes)
    schema = to_arrow_schema(_parse_datatype_string(f"{order} {kinds[order]}, {key} {kinds[key]}, {output}"))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = _NO_KEY, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                event = {k: None if v is None or v != v else v for k, v in r.items()}
                if event[key] != at:
                    at, state = event[key], None
                state, row = step(state, event)
                rows.append({order: r[order], key: r[key], **row})
            yield pa.RecordBatch.from_pylist(rows, schema)

    dealt = events.repartition(key).sortWithinPartitions(key, "ts", order)
    return dealt.mapInArrow(folded, f"{order} {kinds[order]}, {key} {kinds[key]}, {output}")


TIMER_OUTPUT = "status string, total long, end double, left long, paused boolean, refused boolean"
LIMIT_OUTPUT = "allowed boolean, retry_after long"
DESK_OUTPUT = "status string, closed boolean, minutes double, over double, fee double"
