"""Chat formatting: tool calls linked with their results.

Messages (conv_id, turn, role, text) hold calls and results as one JSON object each:

    assistant  {"call": {"id": ..., "name": ..., "arguments": {...}, "after": [ids]}}
    tool       {"result": {"id": ..., "content": ...}}

1. parse: a text that is such an object is a call or result, any other a plain message;
2. link: of several calls, or results, with one (conv_id, id) the one of smallest turn counts (of equal turns, that of the
   smaller hash of its JSON), the others are `repeated`; the calls that count and the results that count meet in a hash
   join on (conv_id, id), which carries turns and numbers of rows, no texts;
3. order: a call's level is 0 if it comes after no other, else one more than the greatest level of those it comes after;
   calls on a cycle, and those after them, have none. A call stands at its own turn, or at that of an earlier call that
   comes after it, directly or not; a result at its own turn, or at its call's place if that is later; everything else
   at its turn. So turns keep their order but where a link goes against them, and no message stands before a call of a
   smaller turn;
4. validate: arguments are held against the tool's schema (a subset of JSON Schema: type, required, properties,
   enum, items, additionalProperties);
5. serialise: canonical JSON, keys sorted, no spaces, numbers as Python's json writes them.

Every message gives one row, (conv_id, position, turn, kind, status, level, json): position counts from 0 within a
conversation by place, level, kind (call, message, result), turn and id. All messages are dealt out by ranges of that
order, so that a long conversation is spread over tasks, each of which counts its part.

Levels and places of a conversation of up to SMALL calls and links are found within a task. Longer ones are cut, by turn,
into blocks of about SMALL calls. In each round every block goes as far as it can within its task, then links from one block
to another carry what was found: as many rounds as a path crosses blocks, which is one for
SMALL calls of a chain if calls come after earlier ones.

Defined results: a null text is an empty plain message; a null turn is smaller than any; messages of null conv_id are one conversation, which is not the
one named ""; a result without a call is `orphan`, a call without a result `open`; an id in `after` that no call has
is ignored; repeated rows stay, all but one as `repeated`; JSON that is nested too deep to be read, or holds numbers
that JSON does not have (NaN, infinities), is a plain message; lone surrogates in it are replaced by question marks;
very long texts are parsed whole; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.batches import column
from tesserae.session import materialise, scratch

#: Calls, and links between them, of a conversation that is put in order within a task; calls of a block of a longer one.
SMALL = 10_000
#: Where a null turn stands.
_FIRST = -(1 << 62)
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_PARSED = "conv_id {}, turn long, role string, kind string, id string, name string, after array<string>, body string, fault string"


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value: Any, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or value == value // 1)
    return kind not in _TYPES or isinstance(value, _TYPES[kind])


def fault_of(value: Any, schema: dict, path: str = "$") -> str | None:
    """The first place where value breaks the schema."""
    kinds = schema.get("type") or []
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return f"{path}: no {' or '.join(kinds)}"
    if "enum" in schema and not any(value == x and isinstance(value, bool) == isinstance(x, bool) for x in schema["enum"]):
        return f"{path}: not in enum"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{path}.{name}: missing"
        for name in sorted(value):
            if name in known:
                if found := fault_of(value[name], known[name], f"{path}.{name}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{path}.{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := fault_of(x, schema["items"], f"{path}[{i}]"):
                return found
    return None


def _no_number(text: str) -> Any:
    raise ValueError(f"{text} is no JSON number")


def _finite(text: str) -> float:
    value = float(text)
    return value if abs(value) < float("inf") else _no_number(text)


def _plain_text(text: str) -> str:
    """The text, or where it cannot be encoded, with question marks."""
    return text.encode("utf-8", "replace").decode()


def _parse(text: str | None, role: str | None, schemas: dict[str, dict]) -> tuple:
    """(kind, id, name, after, body, fault) of one message."""
    plain = ("message", None, None, [], canonical({"content": text or "", "role": role}), None)
    if not text or text[:1] != "{" or role not in ("assistant", "tool"):
        return plain
    try:
        value = json.loads(text, parse_constant=_no_number, parse_float=_finite)
        what = "call" if role == "assistant" else "result"
        inner = value.get(what)
        if not isinstance(inner, dict) or not isinstance(inner.get("id"), str):
            return plain
        key = _plain_text(inner["id"])
        if what == "result":
            return ("result", key, None, [], _plain_text(canonical({"content": inner.get("content"), "id": key, "role": "tool"})), None)
        name, arguments, after = inner.get("name"), inner.get("arguments"), inner.get("after") or []
        schema = schemas.get(name) if isinstance(name, str) else None
        fault = "unknown tool" if schema is None else fault_of(arguments, schema)
        body = canonical({"arguments": arguments, "id": key, "name": name, "role": "assistant"})
        return ("call", key, _plain_text(str(name)), [_plain_text(str(x)) for x in after] if isinstance(after, list) else [], _plain_text(body), fault and _plain_text(fault))
    except (ValueError, RecursionError):
        return plain


def _parsed(batches: Iterator[pa.RecordBatch], schemas: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
    for batch in batches:
        rows = [_parse(t, r, schemas) for t, r in zip(column(batch, "text").to_pylist(), column(batch, "role").to_pylist(), strict=True)]
        made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("conv_id", "turn", "role")] + made, ["conv_id", "turn", "role", "kind", "id", "name", "after", "body", "fault"])


def longest(nodes: dict[str, tuple[int, list[str], int]], step: int) -> tuple[dict[str, int], list[str]]:
    """The value of each node (own, before, waits): max(own, value of each node before it + step); and which nodes are settled.

    Nodes on a cycle or after one, or that wait for nodes not given here, or come after such, are not settled: their value is that
    of the settled nodes before them. Ids that are no node are ignored.
    """
    left = {i: len(set(before) & nodes.keys()) for i, (_, before, _) in nodes.items()}
    then: dict[str, list[str]] = {}
    for i, (_, before, _) in nodes.items():
        for b in set(before) & nodes.keys():
            then.setdefault(b, []).append(i)
    values = {i: own for i, (own, _, _) in nodes.items()}
    ready = [i for i, n in left.items() if not n and not nodes[i][2]]
    for i in ready:  # grows as it is read
        for j in then.get(i, ()):
            values[j] = max(values[j], values[i] + step)
            left[j] -= 1
            if not left[j] and not nodes[j][2]:
                ready.append(j)
    return values, ready


def levels_and_places(calls: dict[str, tuple[int, list[str]]]) -> dict[str, tuple[int, int]]:
    """(level, place) of each call (turn, after) of one conversation that is on no cycle and after none."""
    levels, settled = longest({i: (0, after, 0) for i, (_, after) in calls.items()}, 1)
    later: dict[str, list[str]] = {i: [] for i in settled}
    for i in settled:
        for b in set(calls[i][1]) & calls.keys():
            later[b].append(i)
    places, _ = longest({i: (-calls[i][0], later[i], 0) for i in settled}, 0)
    return {i: (levels[i], -places[i]) for i in settled}


def _by_key(batches: Iterator[pa.RecordBatch], key: str, value: tuple[str, ...]) -> Iterator[tuple[Any, dict[str, tuple]]]:
    """(key, {id: values}) of rows sorted by key."""
    of, nodes = None, {}
    for batch in batches:
        for k, i, *values in zip(*(column(batch, c).to_pylist() for c in (key, "id", *value)), strict=True):
            if k != of:
                if nodes:
                    yield of, nodes
                of, nodes = k, {}
            nodes[i] = tuple(values)
    if nodes:
        yield of, nodes


def _order_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, id, turn, after) sorted by conv."""
    for conv, calls in _by_key(batches, "conv", ("turn", "after")):
        found = levels_and_places(calls)
        columns = ([conv] * len(found), list(found), [v for v, _ in found.values()], [p for _, p in found.values()])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["conv", "id", "level", "place"])


_NODES = "block string, conv string, id string, own long, before array<string>"


def _go_on_in_task(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, conv, id, own, before, waits) sorted by block, of one conversation each, with their value as own, and whether they are settled."""
    for block, nodes in _by_key(batches, "block", ("conv", "own", "before", "waits")):
        values, settled = longest({i: v[1:] for i, v in nodes.items()}, step)
        settled = set(settled)
        columns = ([block] * len(nodes), [v[0] for v in nodes.values()], list(nodes), [values[i] for i in nodes], [v[2] for v in nodes.values()], [i in settled for i in nodes])
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "conv", "id", "own", "before", "settled"])


def _longest_in_blocks(nodes: DataFrame, step: int) -> DataFrame:
    """(conv, id, value), as `longest`, of nodes (block, conv, id, own, before): each round goes on in all blocks, then across."""
    spark, key = nodes.sparkSession, ["conv", "id"]
    where = nodes.select("conv", F.col("id").alias("to"), F.col("block").alias("there"))
    links = nodes.select("block", "conv", "id", F.explode(F.array_distinct("before")).alias("to")).join(where.hint("shuffle_hash"), ["conv", "to"])
    across = materialise(links.filter(F.col("block") != F.col("there")).select("conv", "id", "to"), "links-across")
    folder, kind = scratch(spark, "values"), "conv string, id string, own long"
    waits = across.groupBy(*key).agg(F.lit(None).cast("long").alias("base"), F.count("*").alias("waits"))
    while True:
        state = nodes.join(waits, key, "left").select("block", *key, F.greatest("own", "base").alias("own"), "before", F.coalesce("waits", F.lit(0)).alias("waits"))
        found = state.repartition("block").sortWithinPartitions("block").mapInArrow(lambda b: _go_on_in_task(b, step), f"{_NODES}, settled boolean")
        found = materialise(found, "found")
        found.filter("settled").select(*key, "own").write.mode("append").parquet(folder)
        done, nodes = spark.read.schema(kind).parquet(folder), found.filter("not settled")
        if found.filter("settled").isEmpty() or nodes.isEmpty():
            return done.withColumnRenamed("own", "value")
        met = across.join(nodes.select(*key).hint("shuffle_hash"), key).join(done.select("conv", F.col("id").alias("to"), F.col("own").alias("value")), ["conv", "to"], "left")
        waits = met.groupBy(*key).agg((F.max("value") + step).alias("base"), F.count_if(F.col("value").isNull()).alias("waits"))


def _order_in_blocks(calls: DataFrame, small: int) -> DataFrame:
    """As _order_in_task, for conversations of any length."""
    count = max(1, -(-calls.count() // small))
    blocks = calls.repartitionByRange(count, "conv", "turn", "id").withColumn("block", F.concat("conv", F.lit("\n"), F.spark_partition_id()))
    blocks = materialise(blocks.select("block", "conv", "id", "turn", F.lit(0).cast("long").alias("own"), F.col("after").alias("before")), "blocks")
    levels = _longest_in_blocks(blocks, 1)
    ordered = materialise(blocks.join(levels, ["conv", "id"]), "levels-in-blocks")
    later = ordered.select("conv", F.explode(F.array_distinct("before")).alias("to"), F.col("id").alias("by")).groupBy("conv", "to").agg(F.collect_list("by").alias("later"))
    turned = ordered.select("block", "conv", "id", (-F.col("turn")).alias("own")).join(later.withColumnRenamed("to", "id"), ["conv", "id"], "left")
    turned = materialise(turned.select("block", "conv", "id", "own", F.coalesce("later", F.array().cast("array<string>")).alias("before")), "turned")
    places = _longest_in_blocks(turned, 0).select("conv", "id", (-F.col("value")).alias("place"))
    return ordered.select("conv", "id", F.col("value").alias("level")).join(places, ["conv", "id"])


def _ordered(calls: DataFrame, small: int) -> DataFrame:
    """(conv, id, level, place) of the calls (conv, id, turn, after) that are on no cycle and after none."""
    sizes = calls.groupBy("conv").agg((F.count("*") + F.sum(F.size("after"))).alias("n"))
    long = materialise(sizes.filter(F.col("n") > small).select("conv"), "long-conversations")
    if long.isEmpty():
        short, in_blocks = calls, None
    else:
        short, in_blocks = calls.join(long, "conv", "left_anti"), _order_in_blocks(calls.join(long, "conv", "left_semi"), small)
    found = short.repartition("conv").sortWithinPartitions("conv").mapInArrow(_order_in_task, "conv string, id string, level long, place long")
    return found if in_blocks is None else found.union(in_blocks)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds nth, the place of each row within its conversation's part in this task, and whether that is the task's first conversation."""
    conv, n, lead = None, 0, True
    for batch in batches:
        nth, leads = [], []
        for c in column(batch, "conv").to_pylist():
            if c != conv:
                lead = conv is None
                conv, n = c, 0
            nth.append(n)
            leads.append(lead)
            n += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64()), pa.array(leads, pa.bool_())], [*batch.schema.names, "nth", "lead"])


def _with_positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with position, which counts from 0 within a conv (never null) by `order`.

    Rows are dealt out by ranges of conv and order, equal ones by numbers of their own, and counted part by part. What
    a conversation has in the parts before comes from one row for each part.
    """
    spark = rows.sparkSession
    rows = materialise(rows, "unordered")  # so that the numbers below are the same should a task run again
    keys = ["conv", *order, "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("part", F.spark_partition_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    parts = materialise(dealt.mapInArrow(_numbered, f"{kinds}, nth long, lead boolean"), "parts")
    ends = parts.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "nth")).alias("last"))  # a row for each task
    before, carried = [], (None, 0)
    for part, first, (conv, nth) in sorted(map(tuple, ends.collect()), key=lambda r: r[0]):
        start = carried[1] if carried[0] == first else 0
        before.append((part, start))
        carried = (conv, nth + 1 + (start if conv == first else 0))
    if not before:
        return parts.withColumn("position", F.col("nth"))
    starts = spark.createDataFrame(before, "part int, before long")
    return parts.join(starts, "part").withColumn("position", F.col("nth") + F.when(F.col("lead"), F.col("before")).otherwise(0))


def link(messages: DataFrame, schemas: dict[str, dict], small: int = SMALL) -> DataFrame:
    """(conv_id, position, turn, kind, status, level, json) of every message; schemas: a JSON schema for each tool."""
    kind = messages.schema["conv_id"].dataType.simpleString()
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    parsed = rows.mapInArrow(lambda b: _parsed(b, schemas), _PARSED.format(kind)).withColumn("conv", F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))))
    parsed = materialise(parsed, "messages")
    # Plain messages go by; only calls and results are joined, and their bodies but once, with what was found.
    tools = materialise(parsed.filter("id is not null").withColumn("tie", F.monotonically_increasing_id()), "tools")
    first = tools.groupBy("conv", "id", "kind").agg(F.min(F.struct(F.coalesce("turn", F.lit(_FIRST)).alias("turn"), F.xxhash64("body").alias("hash"), "tie")).alias("first"))
    first = materialise(first.select("conv", "id", "kind", "first.turn", "first.tie"), "first-of-each")
    calls, results = (first.filter(F.col("kind") == k).select("conv", "id", F.col("tie").alias(k), F.col("turn").alias(f"{k}_turn")) for k in ("call", "result"))
    pairs = materialise(calls.join(results.hint("shuffle_hash"), ["conv", "id"], "full"), "pairs")
    waiting = tools.filter("kind = 'call'").select("conv", "id", "tie", "after").join(pairs.filter("call is not null").select("conv", "id", F.col("call").alias("tie"), F.col("call_turn").alias("turn")).hint("shuffle_hash"), ["conv", "id", "tie"])
    ordered = _ordered(materialise(waiting.select("conv", "id", "turn", "after"), "calls"), small)
    links = materialise(pairs.join(materialise(ordered, "order-of-calls"), ["conv", "id"], "left").drop("result_turn", "call_turn"), "links")
    linked = tools.join(links, ["conv", "id"])
    counts = F.col("tie") == F.when(F.col("kind") == "call", F.col("call")).otherwise(F.col("result"))
    status = (
        F.when(~counts, "repeated")
        .when(F.col("call").isNull(), "orphan")
        .when(F.col("level").isNull(), "cyclic")
        .when(F.col("fault").isNotNull(), F.concat(F.lit("invalid "), "fault"))
        .when(F.col("result").isNull(), "open")
        .otherwise("linked")
    )
    turn = F.coalesce("turn", F.lit(_FIRST))
    place = F.when(counts & (F.col("kind") == "call"), F.coalesce("place", turn)).when(counts, F.greatest(turn, "place")).otherwise(turn)
    columns = ("conv", "conv_id", "turn", "kind", "id", "status", "level", "body", "place")
    linked = linked.select("*", status.alias("status"), place.alias("at")).drop("place").withColumnRenamed("at", "place").withColumn("level", F.col("level").cast("int"))
    plain = parsed.filter("id is null").withColumns({"status": F.lit("plain"), "level": F.lit(None).cast("int"), "place": turn})
    every = linked.select(*columns).unionByName(plain.select(*columns)).withColumn("step", F.coalesce("level", F.lit(0)))
    placed = _with_positions(every, ["place", "step", "kind", "turn", "id", "body", "status"])
    return placed.select("conv_id", "position", "turn", "kind", "status", "level", F.col("body").alias("json"))
