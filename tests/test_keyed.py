"""State machines: boundaries, a second model of the buckets, and streams that give what batches give."""

import os
import random
from pathlib import Path

import pytest

from tesserae.operators import keyed as K
from tesserae.streaming import ordered, state


def timer(*commands):
    return K.fold(K.timer_step, [{"ts": ts, "action": a, "minutes": m} for ts, a, m in commands])


@pytest.mark.parametrize(
    ("commands", "last"),
    [
        ([(0, "pause", None)], {"status": "IDLE", "paused": False}),
        ([(0, "start", None), (10, "pause", None)], {"status": "RUNNING", "end": None, "left": 3590, "paused": True}),
        ([(0, "start", None), (10, "pause", None), (99, "start", None)], {"end": 99 + 3590, "left": 0, "paused": False}),
        ([(0, "start", None), (3600, "add_time", 0)], {"status": "OVERTIME"}),
        ([(0, "start", None), (10, "sub_time", 100)], {"status": "OVERTIME", "end": 3600 - 6000}),
        ([(0, "sub_time", 100), (1, "start", None)], {"status": "IDLE", "total": 0, "refused": True}),
        ([(0, "set_total", 1441), (1, "start", None)], {"total": 86_400, "end": 86_401}),
        ([(0, "start", None), (5, "set_total", 2)], {"total": 120, "end": 125}),
        ([(0, "start", None), (5, "reset", None)], {"status": "IDLE", "total": 3600, "end": None}),
        ([(0, "add_time", None)], {"refused": True, "total": 3600}),
    ],
)
def test_timer(commands, last):
    out = timer(*commands)[1][-1]
    assert {k: out[k] for k in last} == last


def requests(*times, path="/x"):
    return [r["allowed"] for r in K.fold(K.limit_step, [{"ts": t, "path": path} for t in times])[1]]


def test_buckets():
    assert requests(*[0] * 6) == [True] * 5 + [False]
    assert requests(*[0] * 9, path=K.REVIEW_PATH) == [True] * 8 + [False]
    assert requests(*[0] * 5, 11_999, 12_000) == [True] * 5 + [False, True]
    day = [i * 20_000 for i in range(60)]
    assert requests(*day).count(True) == 50
    refused = K.fold(K.limit_step, [{"ts": 0, "path": "/x"}] * 6)[1][-1]
    assert refused == {"allowed": False, "retry_after": 12}
    mixed = [{"ts": 0, "path": "/x"}] * 5 + [{"ts": 1, "path": K.REVIEW_PATH}]
    assert K.fold(K.limit_step, mixed)[1][-1]["allowed"]  # another capacity: a new, full bucket


def test_buckets_keep_their_bounds():
    rng, held, now = random.Random(4), None, 0
    for _ in range(2000):
        now += rng.choice([0, 10, 1000, 60_000, 10_000_000])
        held, _ = K.limit_step(held, {"ts": now, "path": rng.choice(["/x", K.REVIEW_PATH])})
        assert 0 <= held["minute"]["tokens"] <= held["minute"]["most"] and 0 <= held["day"]["tokens"] <= 50


def test_desk():
    out = K.fold(K.desk_step, [{"ts": t, "action": a, "minutes": m} for t, a, m in [(0, "start", 60), (600, "pause", None), (700, "pause", None), (1200, "resume", None), (1300, "add", 30), (10_000, "finish", None)]])[1]
    end = 3600 + 600 + 1800
    assert out[-1] == {"status": "empty", "closed": True, "minutes": 157, "over": 10_000 - end, "fee": 10.0 + K.extension_fee(67, 1)}
    def after(*commands, **more):
        return K.fold(K.desk_step, [{"ts": t, "action": a, "minutes": m, **more} for t, a, m in commands])

    held, _ = after((0, "start", 60), (600, "pause", None), (700, "add", 30))
    assert held["extra_count"] == 0 and held["end"] == 3600  # nothing is added while it is paused
    held, _ = after((0, "start", None), (60, "add", 30), (70, "adjust", 20))
    assert held["extra_count"] == 0 and held["end"] is None  # nor to, or adjusted on, a desk that counts up
    assert after((0, "start", 60), (60, "add", 90))[0]["extra_fee"] == 20 and after((0, "start", 60), (60, "add", 30), hour=21)[0]["extra_fee"] == 30 and after((0, "start", 60), (60, "add", 15), hour=22)[0]["extra_fee"] == 50
    paused = K.fold(K.desk_step, [{"ts": t, "action": a, "minutes": m} for t, a, m in [(0, "start", 10), (500, "pause", None), (99_999, "finish", None)]])[1][-1]
    assert paused["over"] == 0 and paused["minutes"] == 9 and paused["fee"] == 0


@pytest.mark.parametrize(("ends", "late", "fee"), [("20:50:00", 20, 10), ("20:59:59", 20, 10), ("21:00:00", 20, 30), ("23:50:00", 20, 30), ("23:59:00", 65, 80), ("00:10:00", 20, 10), ("20:50:00", 10, 0)])
@pytest.mark.parametrize("zone", [0, 8 * 3600, -5 * 3600, 19_800])
def test_overtime_goes_by_the_hour_of_the_end(ends, late, fee, zone):
    h, m, s = map(int, ends.split(":"))
    end = 3 * 86_400 + h * 3600 + m * 60 + s - zone  # in UTC
    start, finish = end - 3600, end + late * 60
    clock = lambda t: {"offset": zone} if zone % 3600 else {"hour": K._hour(t + zone)}
    out = K.fold(K.desk_step, [{"ts": start, "action": "start", "minutes": 60, **clock(start)}, {"ts": finish, "action": "finish", "minutes": None, **clock(finish)}])[1]
    assert out[-1]["fee"] == fee


@pytest.mark.parametrize(("minutes", "hour", "fee"), [(0, 20, 0), (1, 20, 10), (30, 20, 10), (31, 20, 20), (61, 20, 30), (61, 21, 80), (30, 21, 30), (60, 21, 50)])
def test_extension_fee(spark, minutes, hour, fee):
    from pyspark.sql import functions as F

    from tesserae.functions import money

    assert K.extension_fee(minutes, hour) == fee
    assert spark.range(1).select(money.extension_fee(F.lit(minutes), F.lit(hour)).alias("x")).first().x == fee


@pytest.mark.parametrize(("seconds", "charged"), [(600, 0), (601, 30), (1800, 30), (1801, 60), (3661, 90)])
def test_overtime_grace(spark, seconds, charged):
    from pyspark.sql import functions as F

    from tesserae.functions import money

    fee, minutes = money.overtime(F.lit(seconds), F.lit(20))
    assert tuple(spark.range(1).select(fee, minutes).first()) == (charged // 30 // 2 * 20 + charged // 30 % 2 * 10, charged)


def test_every_user_is_an_address_and_state_outlives_a_batch(spark):
    from pyspark.sql import functions as F

    from tesserae.plans import images

    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {r.event_id: (r.ip, r.allowed, r.retry_after) for r in images.rate_limit(spark, sf).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000).cast("long").alias("ts"))
    held, want = {}, {}
    for r in sorted(e.collect(), key=lambda r: (r.ts, r.event_id)):
        held[r.user_id], out = K.limit_step(held.get(r.user_id), {"ts": r.ts, "path": K.REVIEW_PATH if r.event_type == "view" else "/api/other"})
        want[r.event_id] = (r.user_id, out["allowed"], out["retry_after"])
    assert got == want


def test_streams_give_what_batches_give(spark, tmp_path):
    from tesserae.plans.images import _commands

    sf = "/root/testdata/sf0.001"
    events = _commands(spark, sf).orderBy("ts").coalesce(1)
    events.write.parquet(str(tmp_path / "in"))
    batch = K.run(events, "table_id", "event_id", K.timer_step, K.TIMER_OUTPUT)
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = state.run(source, "table_id", "event_id", K.timer_step, K.TIMER_OUTPUT, ordered.TIMER_STATE)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == events.count() and not got.exceptAll(batch).count()


def _on_a_stream(spark, folder, rows, schema, parts, rng, **what):
    """The rows that a stream gives for `rows`, shuffled and dealt over `parts` triggers, and then a last command that moves the watermark on."""
    rows = rng.sample(rows, len(rows))
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.parquet(f"{folder}/in/{i:02}")
    spark.createDataFrame([(-1, "last", 1e6, "none", None)], schema).coalesce(1).write.parquet(f"{folder}/in/{parts:02}")
    for i in range(parts + 1):  # files are taken by the time of their change
        for f in Path(folder, "in", f"{i:02}").glob("*.parquet"):
            os.utime(f, (1e9 + i, 1e9 + i))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    out = ordered.run(source, "desk", "event_id", **what, delay="100000 seconds")
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").filter("desk != 'last'").collect()]


COMMANDS = "event_id long, desk string, ts double, action string, minutes long"


@pytest.mark.parametrize("machine", ["desk", "timer"])
def test_late_commands_and_changes_by_time(spark, tmp_path, machine):
    rng = random.Random(7)
    what = {
        "desk": {"step": K.desk_step, "output": K.DESK_OUTPUT, "state": ordered.DESK_STATE, "due": ordered.desk_due},
        "timer": {"step": K.timer_step, "output": K.TIMER_OUTPUT, "state": ordered.TIMER_STATE, "due": ordered.timer_due},
    }[machine]
    actions = {"desk": ["start", "start", "add", "pause", "resume", "adjust", "finish", "cancel"], "timer": ["start", "start", "pause", "reset", "set_total", "add_time", "sub_time"]}[machine]
    rows = [(i, rng.choice("abc"), float(rng.randrange(0, 60_000, 50)), rng.choice(actions), rng.choice([30, 60, 90])) for i in range(90)]
    rows += [(100, "d", 1000.0, "start", 60), (101, "e", 5.0, "start", 20)]  # nothing comes after these
    batch = spark.createDataFrame(rows, COMMANDS)
    want = ordered.replay(batch, "desk", "event_id", what["step"], what["output"], what["due"], until=900_000.0)
    got = _on_a_stream(spark, str(tmp_path), rows, COMMANDS, 4, rng, **what)
    assert sorted(got, key=str) == sorted(map(tuple, want.collect()), key=str)
    due = [(r[2], r[3]) for r in sorted(got, key=lambda r: r[2]) if r[1] == "d" and r[3]]
    assert due == ([(2800.0, "ending"), (4000.0, "urgent"), (4600.0, "timeout")] if machine == "desk" else [(4000.0, "WARNING"), (4600.0, "OVERTIME")])


def test_replay_against_a_clock_that_ticks():
    """Every second looked at one by one gives the same changes, and the same commands."""
    rng = random.Random(8)
    for _ in range(30):
        commands = sorted(({"ts": rng.randrange(0, 6000), "event_id": i, "action": rng.choice(["start", "add", "pause", "resume", "finish"]), "minutes": rng.choice([20, 30, 45])} for i in range(8)), key=lambda c: (c["ts"], c["event_id"]))
        got = [(at, name or command["event_id"]) for _, at, command, name, _ in ordered.advance(None, float("-inf"), commands, 12_000, K.desk_step, ordered.desk_due)]
        state, want = None, []
        for t in range(12_000):
            for instant, name in sorted(ordered.desk_due(state)) if state else []:
                if instant == t and (t, name) not in want:
                    want.append((t, name))
            for c in commands:
                if c["ts"] == t:
                    state, _ = K.desk_step(state, c)
                    want.append((t, c["event_id"]))
        assert got == want


def test_buckets_on_a_stream_keep_nested_state(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), i * 3000, rng.choice(["/x", K.REVIEW_PATH])) for i in range(60)]
    schema = "event_id long, ip string, ts long, path string"
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for f in Path(tmp_path, "in", str(k)).glob("*.parquet"):
            os.utime(f, (1e9 + k, 1e9 + k))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = state.run(source, "ip", "event_id", K.limit_step, K.LIMIT_OUTPUT, ordered.LIMIT_STATE, idle=3_600_000)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = K.run(spark.createDataFrame(rows, schema), "ip", "event_id", K.limit_step, K.LIMIT_OUTPUT)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, want.collect()))


def test_recent_texts_on_a_stream(spark, tmp_path):
    rows = [(1, "a", 1, "x"), (2, "a", 2, "y"), (3, "a", 3, "x"), (4, "b", 1, "x"), (5, "a", 4, "bad"), (6, "a", 5, "bad")]
    spark.createDataFrame(rows, "text_id long, topic string, ts long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    judge = lambda t, held: "similar" if t in held else "bad" if t == "bad" else ""
    source = spark.readStream.schema("text_id long, topic string, ts long, text string").parquet(str(tmp_path / "in"))
    q = state.recent_texts(source, judge).writeStream.format("memory").queryName("recent_texts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.text_id: r.reason for r in spark.table("recent_texts").collect()} == {1: "", 2: "", 3: "similar", 4: "", 5: "bad", 6: "bad"}
