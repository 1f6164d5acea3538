import json

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import resampling as R
from tesserae.llm import tool_calls as T

TOOLS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "number"}}, "c": {"enum": ["x"]}}, "additionalProperties": False}}


def call(i, name="add", arguments=None, after=()):
    return json.dumps({"call": {"id": i, "name": name, "arguments": {"a": 1} if arguments is None else arguments, "after": list(after)}})


def result(i, content="ok"):
    return json.dumps({"result": {"id": i, "content": content}})


def test_linking(spark):
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", call("late", after=["early"])), (1, 2, "assistant", call("early", arguments={"b": [1, 2.5], "a": 3})), (1, 3, "tool", result("early")),
        (1, 4, "tool", result("late")), (1, 5, "tool", result("nobody")), (1, 6, "assistant", call("open")), (1, 7, "assistant", call("early")),
        (2, 0, "assistant", call("p", after=["q"])), (2, 1, "assistant", call("q", after=["p"])), (2, 2, "assistant", call("bad", arguments={"a": "1"})), (2, 3, "assistant", call("worse", arguments={"a": 1, "z": 2})),
        (2, 4, "assistant", call("who", name="none")), (2, 5, "assistant", "{not json"), (2, 6, None, None), (None, 0, "user", None), (None, 0, "user", None), (3, None, "tool", call("x")),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, status string")
    got = sorted(T.link(df, TOOLS).collect(), key=lambda r: (str(r.conv_id), r.position))
    assert len(got) == len(rows)
    one = [(r.turn, r.kind, r.status, r.level) for r in got if r.conv_id == 1]
    assert one == [(0, "message", "plain", None), (2, "call", "linked", 0), (1, "call", "linked", 1), (3, "result", "linked", 0), (4, "result", "linked", 1), (5, "result", "orphan", None), (6, "call", "open", 0), (7, "call", "repeated", 0)]
    two = {r.turn: r.status for r in got if r.conv_id == 2}
    assert two == {0: "cyclic", 1: "cyclic", 2: "invalid $.a: no integer", 3: "invalid $.z: unknown", 4: "invalid unknown tool", 5: "plain", 6: "plain"}
    assert [r.json for r in got if r.turn == 2 and r.conv_id == 1] == ['{"arguments":{"a":3,"b":[1,2.5]},"id":"early","name":"add","role":"assistant"}']
    assert T.link(df.limit(0), TOOLS).count() == 0


def facts(rows, schemas):
    """(conv_id, turn, kind, status, level, json) of every message, one conversation after the other, by following links one by one."""
    by_conv, out = {}, []
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, *T._parse(text, role, schemas)))
    for conv, messages in by_conv.items():
        first = {}
        for k, (turn, kind, i, _, _, body, _) in enumerate(messages):
            hashed = xxhash.xxh64_intdigest(body, 42)
            first[kind, i] = min(first.get((kind, i), ((2,),)), ((turn is not None, turn or 0), hashed - (hashed >> 63 << 64), k))
        first = {key: k for key, (*_, k) in first.items()}
        after = {m[2]: m[4] for k, m in enumerate(messages) if m[1] == "call" and first["call", m[2]] == k}

        def level(i, path=()):
            if i in path:
                return None
            below = [level(b, (*path, i)) for b in after[i] if b in after]
            return None if None in below else max(below, default=-1) + 1

        levels = {i: level(i) for i in after}
        for k, (turn, kind, i, _, _, body, fault) in enumerate(messages):
            if kind == "message":
                out.append((conv, turn, kind, "plain", None, body))
                continue
            status = "repeated" if first[kind, i] != k else "orphan" if i not in after else "cyclic" if levels[i] is None else f"invalid {fault}" if fault else "open" if ("result", i) not in first else "linked"
            out.append((conv, turn, kind, status, levels.get(i), body))
    return sorted(out, key=str)


def check_order(got, rows, schemas):
    """Positions are 0, 1, ... in a conversation; calls stand after those they come after, and results after their call; else by turn."""
    links = {}
    for conv, _, role, text in rows:
        kind, i, _, after, body, _ = T._parse(text, role, schemas)
        links[conv, kind, body] = (i, after)
    by_conv = {}
    for r in got:
        by_conv.setdefault(r.conv_id, []).append(r)
    for conv, found in by_conv.items():
        found.sort(key=lambda r: r.position)
        assert [r.position for r in found] == list(range(len(found)))
        turn = lambda r: -1 if r.turn is None else r.turn
        at = {links[conv, "call", r.json][0]: r for r in found if r.kind == "call" and r.status not in ("repeated", "cyclic")}
        after = {i: [b for b in links[conv, "call", r.json][1] if b in at] for i, r in at.items()}
        assert all(at[b].position < at[i].position for i in at for b in after[i])
        for r in found:
            if r.kind == "result" and r.status != "repeated" and (i := links[conv, "result", r.json][0]) in at:
                assert r.position > at[i].position
        latest = -1  # of messages that no link moves, none stands before a call of a smaller turn
        for r in found:
            if r.kind == "call":
                assert turn(r) >= latest
            elif r.kind == "message":
                latest = max(latest, turn(r))
        if all(turn(at[b]) < turn(at[i]) for i in at for b in after[i]) and all(turn(r) > turn(at[i]) for r in found if r.kind == "result" and (i := links[conv, "result", r.json][0]) in at):
            assert [turn(r) for r in found] == sorted(map(turn, found))  # nothing to mend: turns alone


@pytest.mark.parametrize("small", [T.SMALL, 3])
def test_any_conversations(spark, small):
    rng = np.random.default_rng(small)
    rows = []
    for conv in [None, "", *map(str, range(12))]:
        for turn in range(rng.integers(1, 30)):
            i = f"c{rng.integers(0, 12)}"
            text = call(i, ["add", "none"][rng.random() < 0.1], {"a": [turn, str(turn)][rng.random() < 0.2]}, [f"c{x}" for x in rng.integers(0, 14, rng.integers(0, 3)) if f"c{x}" < i or rng.random() < 0.1]) if rng.random() < 0.6 else result(i, f"r{turn}")
            rows += [(conv, None if rng.random() < 0.05 else turn, "assistant" if '"call"' in text else "tool", text)] * (1 + (rng.random() < 0.1))
    rows += [("long", t, "assistant", call(f"c{t:03}", after=[f"c{t - 1:03}"])) for t in range(12)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id string, turn long, role string, text string, conv string, tie int").repartition(5)
    got = T.link(df, TOOLS, small).collect()
    assert sorted(((r.conv_id, r.turn, r.kind, r.status, r.level, r.json) for r in got), key=str) == facts(rows, TOOLS)
    check_order(got, rows, TOOLS)
    assert [tuple(r) for r in sorted(got, key=str)] == [tuple(r) for r in sorted(T.link(df.repartition(2), TOOLS, 1000 + small).collect(), key=str)]


def test_turns_keep_their_order(spark):
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", call("c1")), (1, 2, "tool", result("c1")), (1, 3, "assistant", call("c2", after=["c1"])), (1, 4, "tool", result("c2")), (1, 5, "assistant", "done")]
    got = sorted(T.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect(), key=lambda r: r.position)
    assert [(r.turn, r.level) for r in got] == [(0, None), (1, 0), (2, 0), (3, 1), (4, 1), (5, None)]


def test_long_chain_in_blocks(spark):
    rows = [(1, t, "assistant", call(f"c{t}", after=[f"c{t - 1}", f"c{t - 7}"])) for t in range(2000)] + [(1, 2000, "assistant", call("loop", after=["loop", "c3"])), (1, 2001, "assistant", call("behind", after=["loop", "c9"]))]
    got = T.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), TOOLS, 300).collect()
    assert sorted((r.turn, r.position, r.level) for r in got if r.turn < 2000) == [(t, t, t) for t in range(2000)]
    assert {r.turn: r.status for r in got if r.turn >= 2000} == {2000: "cyclic", 2001: "cyclic"}


def test_one_conversation_in_many_parts(spark):
    rows = [(7, t // 3, "user", f"m{t % 5}") for t in range(500)] + [(7, 0, "user", "same")] * 300 + [(8, 1, "user", "x")] + [(9, t, "user", "y") for t in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = T.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7), {}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(((r.conv_id, r.turn, r.kind, r.status, r.level, r.json) for r in got), key=str) == facts(rows, {})
    check_order(got, rows, {})


def test_bad_json_is_plain(spark):
    bad = ['{"call":{"id":"a","name":"add","arguments":' + "[" * 50_000 + "]" * 50_000 + "}}", '{"call":{"id":"a","name":"add","arguments":{"a":NaN}}}', '{"call":{"id":"a","name":"add","arguments":{"a":1e999}}}', '{"call":{"id":"a","name":"add","arguments":{"a":-Infinity}}}', "{" * 100_000, '{"call":[]}']
    odd = '{"result":{"id":"a\\ud800","content":"\\udfff"}}'
    rows = [(1, i, "assistant", t) for i, t in enumerate(bad)] + [(1, 9, "tool", odd), (1, 10, "assistant", call("z", arguments={"a": 10**400})), (1, 11, "assistant", call("y", arguments={"a": 1, "b": ["x" * 200_000]}))]
    got = {r.turn: r for r in T.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect()}
    assert [got[i].status for i in range(len(bad))] == ["plain"] * len(bad)
    assert got[9].status == "orphan" and got[9].json == '{"content":"?","id":"a?","role":"tool"}'
    assert got[10].status == "open" and got[11].status == "invalid $.b[0]: no number"


def test_schema_faults():
    f = lambda v: T.fault_of(v, TOOLS["add"])
    assert f({"a": 1, "b": [1, True]}) == "$.b[1]: no number" and f({"a": 1, "c": "y"}) == "$.c: not in enum" and f([]) == "$: no object" and f({}) == "$.a: missing" and f({"a": 2.0}) is None
    either = {"type": ["integer", "null"], "enum": [1, None, 5]}
    assert T.fault_of(None, either) is None and T.fault_of(5, either) is None and T.fault_of("x", either) == "$: no integer or null" and T.fault_of(True, {"enum": [1]}) == "$: not in enum"


def test_levels_of_a_long_chain():
    n = 20_000
    assert T.levels_and_places({str(i): (i, [str(i - 1), "none"]) for i in range(n)}) == {str(i): (i, i) for i in range(n)}
    turned = {str(i): (n - i, [str(i - 1)]) for i in range(n)}  # each call waits for a later one: all stand at the turn of the last
    assert T.levels_and_places(turned) == {str(i): (i, 1) for i in range(n)}


def test_resampling(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["good", "fine", "nice"] if i % 4 == 0 else ["bad", "dull", "poor"], 30)), i % 8 == 0) for i in range(400)]
    rows += [(400, None, None), (401, "", True), (None, "good good", None), (3, rows[3][1], False), (3, rows[3][1], False)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, target boolean, key double").repartition(3)
    got = R.resample(df, 0.25).collect()
    assert len(got) == len(rows) and [r.selected for r in got if r.n_grams == 0] == [False, False]
    chosen = [r for r in got if r.selected]
    keys = sorted((r.key for r in got if r.key is not None), reverse=True)
    k = int(len(keys) * 0.25)
    assert sorted((r.key for r in chosen), reverse=True) == [x for x in keys if x >= keys[k - 1]]  # equal keys are rows of one document here
    assert np.mean([r.doc_id is None or r.doc_id % 4 == 0 for r in chosen]) > 0.9
    # The weight is that of two models counted one by one.
    ratio = R.fit(df)
    data = lambda t: (np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))
    sums = np.ones((2, R.BUCKETS))
    bucket = lambda words: int(R._ngrams(*data(" ".join(words)))[1][-1])  # noqa: E731  of a word or pair on its own
    for _, t, target in rows:
        words = (t or "").lower().split()
        for n in [*([w] for w in words), *map(list, zip(words, words[1:], strict=False))]:
            sums[0, bucket(n)] += 1
            sums[1, bucket(n)] += bool(target)
    want = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    assert np.allclose(ratio, want)
    assert R.resample(df.limit(0)).count() == 0 and not R.resample(df, 0.0).filter("selected").count()
    again = {(r.doc_id, r.key) for r in R.resample(df, 0.25).filter("selected").collect()}
    assert again == {(r.doc_id, r.key) for r in chosen}


def test_queries_run(spark):
    from tesserae.llm import catalogue

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in catalogue._with_calls(catalogue._table(spark, sf, "conversations")).collect()]
    found = catalogue.op1_tool_calls(spark, sf).collect()
    assert sorted(((r.conv_id, r.turn, r.kind, r.status, r.level, r.json) for r in found), key=str) == facts(rows, catalogue.TOOLS)
    check_order(found, rows, catalogue.TOOLS)
    assert {r.status.split(" ")[0] for r in found} >= {"plain", "linked", "open"} and max(r.level or 0 for r in found) >= 2
    assert catalogue.op3_importance_resampling(spark, sf).filter("selected").count() == 100
