"""Desk sessions: presets, statuses, checkout, and daily figures over event-time tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import clock, money
from tesserae.operators.pieces import ranked
from tesserae.session import materialise

#: Fixed values: (type, mode, fixed hour, minutes, weekdays only, base fee) of each preset; DEFAULT is the row for unknown types.
PRESETS = [
    ("morning", "countdown", 14, None, True, 0.0),
    ("afternoon", "countdown", 19, None, True, 0.0),
    ("night", "countdown", 21, None, True, 0.0),
    ("day", "countup", 21, None, False, 0.0),
    ("1h", "countdown", None, 60, False, 0.0),
    ("2h", "countdown", None, 120, False, 0.0),
    ("infinit", "countup", 21, None, False, 0.0),
    ("iron52", "countup", None, None, False, 0.0),
    ("iron78", "countup", None, None, False, 0.0),
]
DEFAULT = 4
#: Minutes left at which a session is ending, and urgent; the delay of a countdown's start; the first desks of the second and third region.
ENDING, URGENT, DELAY = 30, 10, 10
REGIONS = ((6, "window"), (16, "table1"), (30, "table2"))


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "type string, mode string, fixed_hour int, minutes int, weekday_only boolean, base_fee double")


def with_preset(sessions: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """sessions (session_type, ...) with their preset's columns; unknown types get the default preset's."""
    dim = presets(sessions.sparkSession) if table is None else table
    _, *values = PRESETS[DEFAULT]
    names = ("mode", "fixed_hour", "minutes", "weekday_only", "base_fee")
    both = sessions.join(dim.withColumn("known", F.lit(True)), sessions["session_type"] == dim["type"], "left")
    filled = {n: F.when(F.col("known"), F.col(n)).otherwise(F.lit(v)) for n, v in zip(names, values, strict=True)}
    return both.withColumns(filled).drop("type", "known")


def region(desk: Column) -> Column:
    return F.when(desk <= REGIONS[0][0], REGIONS[0][1]).when(desk <= REGIONS[1][0], REGIONS[1][1]).otherwise(REGIONS[2][1])


def start_at(ts: Column, mode: Column) -> Column:
    """Countdown sessions begin DELAY minutes later."""
    return F.when(mode == "countdown", ts + F.expr(f"INTERVAL {DELAY} MINUTES")).otherwise(ts)


def end_at(start: Column, mode: Column, fixed_hour: Column, minutes: Column) -> Column:
    """A fixed hour of the start's day, or so many minutes on; null without either."""
    at_hour = clock.at_hour(start, fixed_hour)
    return F.when(mode == "countup", at_hour).when(minutes.isNotNull(), start + F.make_dt_interval(mins=minutes)).otherwise(at_hour)


def admissible(start: Column, end: Column, mode: Column, weekday_only: Column) -> Column:
    return ~(weekday_only & clock.is_weekend(start)) & ((mode == "countup") | F.coalesce(end > start, F.lit(False)))


def countdown_status(end: Column, now: Column) -> tuple[Column, Column]:
    """(status, seconds over)."""
    left = clock.seconds_between(now, end)
    status = F.when(left <= 0, "timeout").when(left > ENDING * 60, "normal").when(left > URGENT * 60, "ending").otherwise("urgent")
    return status, F.greatest(F.lit(0), -left)


def desk_status(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions (desk, session_type, opened_at) as they stand at an instant."""
    s = with_preset(sessions)
    s = s.withColumn("start", start_at(F.col("opened_at"), F.col("mode")))
    s = s.withColumn("end", end_at(F.col("start"), F.col("mode"), F.col("fixed_hour"), F.col("minutes")))
    s = s.withColumn("admissible", admissible(F.col("start"), F.col("end"), F.col("mode"), F.col("weekday_only")))
    status, over = countdown_status(F.col("end"), now)
    running = F.when(now < F.col("start"), "preparing").when(F.col("mode") == "countup", "infinit")
    return s.withColumns({"status": running.otherwise(status), "over_seconds": F.when(F.col("mode") == "countup", F.lit(0)).otherwise(over), "region": region(F.col("desk"))})


def checkout(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions (start, end, pause_start, paused_seconds, base_fee, extra_fee) closed now, or, if paused, when the pause began."""
    closed = sessions.withColumn("closed_at", F.coalesce("pause_start", now))
    over = F.greatest(F.lit(0), clock.seconds_between(F.col("end"), F.col("closed_at")))
    out = closed.withColumn("over_seconds", F.coalesce(over, F.lit(0)))
    fee, charged = money.overtime(F.col("over_seconds"), F.hour("end"))
    minutes = F.ceil(clock.elapsed(F.col("start"), F.col("closed_at"), F.col("paused_seconds")) / F.lit(60.0)).cast("int")
    out = out.withColumns({"minutes": minutes, "timeout_fee": fee, "charged_minutes": charged, "is_timeout": F.col("over_seconds") > 0})
    return out.withColumn("total_fee", F.col("base_fee") + F.col("extra_fee") + F.col("timeout_fee"))


def details(sessions: DataFrame, now: Column) -> DataFrame:
    """What is shown of sessions (start, end, mode, pause_start, paused_seconds) that go on: elapsed, over_minutes and timeout_fee, as of now, or of the pause they are in.

    Only countdowns run over; a session that has not begun has none of these.
    """
    at = F.coalesce("pause_start", now)
    begun = F.col("start").isNotNull()
    over = F.when(begun & (F.col("mode") == "countdown"), F.greatest(F.lit(0), clock.seconds_between(F.col("end"), at)))
    out = sessions.withColumn("over_seconds", F.coalesce(over, F.lit(0)).cast("long"))
    fee, _ = money.overtime(F.col("over_seconds"), F.hour("end"))
    elapsed = F.when(begun, clock.elapsed(F.col("start"), at, F.col("paused_seconds")))
    return out.withColumns({"elapsed": elapsed, "over_minutes": F.floor(F.col("over_seconds") / 60).cast("int"), "timeout_fee": F.coalesce(fee, F.lit(0.0))})


def daily_ledger(records: DataFrame) -> DataFrame:
    """Checkout records (date, desk, total_fee) by day: desks, revenue, records, and the share of each day in all so far."""
    per = records.groupBy("date").agg(F.countDistinct("desk").alias("desks"), F.sum("total_fee").alias("revenue"), F.count("*").alias("records"))
    return per.withColumn("revenue_so_far", F.sum("revenue").over(Window.orderBy("date")))


def desk_counts(desks: DataFrame) -> DataFrame:
    """Desks by status, for each region; those in preparation are in use."""
    return desks.groupBy("region").agg(
        F.count_if(F.col("status") != "empty").alias("using"), F.count_if(F.col("status") == "empty").alias("empty"), F.count_if(F.col("status") == "timeout").alias("timeout"), F.count_if(F.col("status").isin("ending", "urgent")).alias("ending")
    )


def live_class(end: Column, now: Column, paused: Column) -> Column:
    """idle, paused, overtime, warning (10 minutes or less) or running."""
    left = clock.seconds_between(now, end)
    return F.when(paused, "paused").when(end.isNull(), "idle").when(left <= 0, "overtime").when(left <= URGENT * 60, "warning").otherwise("running")


def by_class(timers: DataFrame) -> DataFrame:
    """Timers (table_id, class) with their rank by id in their class."""
    return ranked(timers.select("class", "table_id"), ["class"], ["table_id"])


def class_counts(timers: DataFrame) -> DataFrame:
    return timers.groupBy("class").agg(F.count("*").alias("n"))


def crossings(readings: DataFrame, bound: int = URGENT * 60) -> DataFrame:
    """Readings (table_id, ts, end, left) at which the seconds left first come down to the bound, once for each end."""
    order = Window.partitionBy("table_id", "end").orderBy("ts")
    down = readings.withColumn("before", F.lag("left").over(order)).filter((F.col("left") <= bound) & (F.col("left") > 0) & (F.col("before") > bound))
    first = down.withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return first.select("table_id", "ts", "end", "left")


def first_entries(statuses: DataFrame, status: str = "timeout") -> DataFrame:
    """Rows (desk, ts, status) at which a desk comes into a status."""
    order = Window.partitionBy("desk").orderBy("ts")
    return statuses.withColumn("before", F.lag("status").over(order)).filter((F.col("status") == status) & ~F.col("before").eqNullSafe(F.lit(status))).select("desk", "ts")


def overlay_saved(defaults: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """Defaults with the saved rows' values where there are any (the last of repeated keys, by `seq`), and saved rows of other keys."""
    last = saved.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).filter("nth = 1").drop("nth", "seq")
    b = last.select(key, *[F.col(c).alias(f"s_{c}") for c in last.columns if c != key])
    return defaults.join(b, key, "full").select(key, *[F.coalesce(f"s_{c}", c).alias(c) if c in last.columns else F.col(c) for c in defaults.columns if c != key])


#: How a move is noted, the sign between notes, and the longest note.
MOVE_NOTE, NOTE_SEPARATOR, NOTE_MOST = "由 %s 换至 %s", "；", 80


def move_targets(desks: DataFrame) -> DataFrame:
    """(house, id, side, targets) of desks (house, id, status): each one in use is a `source`, each empty one a `target` of all sources of its house.

    `targets` is how many desks a source can move to. Rows stand for the classes that sources and targets form, not for their pairs.
    """
    side = F.when(F.col("status") == "empty", "target").otherwise("source")
    free = desks.groupBy("house").agg(F.count_if(F.col("status") == "empty").alias("free"))
    both = desks.select("house", "id", side.alias("side")).alias("d").join(free.alias("f"), F.col("d.house").eqNullSafe(F.col("f.house")))
    return both.select("d.house", "id", "side", F.when(F.col("side") == "source", F.col("free")).alias("targets"))


#: Desks of a house and side that meet as many of the other side in one group, about; tasks that groups are dealt to, at most.
MEETING, MEETING_TASKS = 2000, 10_000


def _meeting(used: DataFrame, free: DataFrame, size: int) -> DataFrame:
    """(source, target) of used (house, source) and free (house, target): all pairs of a house, none of a null one.

    The sides of each house are cut into blocks of about `size`, and each block of one meets each of the other in a group of its own:
    so no group is larger than a pair of blocks, however large a house is, and each group can have a task.
    """
    blocks = lambda rows, name: rows.groupBy("house").agg(F.ceil(F.count("*") / size).alias(name))
    cut = materialise(blocks(used, "u").join(blocks(free, "f"), "house"), "blocks")
    tasks = min(MEETING_TASKS, cut.agg(F.sum(F.col("u") * F.col("f"))).first()[0] or 1)
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = used.join(cut, "house").select("house", "source", own("source", "u").alias("i"), every("f").alias("j")).repartition(tasks, "house", "i", "j")
    right = free.join(cut, "house").select("house", "target", own("target", "f").alias("j"), every("u").alias("i")).repartition(tasks, "house", "i", "j")
    return left.join(right, ["house", "i", "j"]).select("source", "target")


def move_pairs(desks: DataFrame, size: int = MEETING) -> DataFrame:
    """(source, target): each desk in use with each empty desk of its house that it can move to. Desks are (house, id, status); the result is as large as the product of a house's sides."""
    used = desks.filter("status <> 'empty'").select("house", F.col("id").alias("source"))
    return _meeting(used, desks.filter("status = 'empty'").select("house", F.col("id").alias("target")), size)


def targets_of(desks: DataFrame, sources: DataFrame, size: int = MEETING) -> DataFrame:
    """(source, target): the empty desks that each of some desks in use (a column id) can move to, of its house."""
    used = desks.filter("status <> 'empty'").join(sources.select("id").distinct(), "id").select("house", F.col("id").alias("source"))
    return _meeting(used, desks.filter("status = 'empty'").select("house", F.col("id").alias("target")), size)


def move(desks: DataFrame, moves: DataFrame, empty: Mapping[str, object]) -> DataFrame:
    """desks (id, region, status, note, ...) after moves (source, target): what is at a source goes to its target, with a note; the source is as `empty`.

    A move from an empty desk, or to one that is not empty, is ignored; of moves with one source or target all but the
    first are.
    """
    first = moves.groupBy("source").agg(F.min("target").alias("target")).groupBy("target").agg(F.min("source").alias("source")).filter("source <> target")
    rest = [c for c in desks.columns if c not in ("id", "region", "note")]
    going = desks.filter("status <> 'empty'").select(F.col("id").alias("source"), F.struct("note", *rest).alias("moved"))
    free = desks.filter("status = 'empty'").select(F.col("id").alias("target"))
    valid = first.join(going, "source").join(free, "target")
    note = F.substring(F.concat(F.when(F.coalesce("moved.note", F.lit("")) != "", F.concat("moved.note", F.lit(NOTE_SEPARATOR))).otherwise(""), F.format_string(MOVE_NOTE, "source", "target")), 1, NOTE_MOST)
    arrived = desks.select("id", "region").join(valid.select(F.col("target").alias("id"), note.alias("note"), *[F.col(f"moved.{c}").alias(c) for c in rest]), "id").select(*desks.columns)
    left = desks.select("id", "region").join(valid.select(F.col("source").alias("id")), "id").select("id", "region", *[F.lit(empty.get(c)).cast(desks.schema[c].dataType).alias(c) for c in desks.columns if c not in ("id", "region")]).select(*desks.columns)
    others = desks.join(valid.select(F.explode(F.array("source", "target")).alias("id")), "id", "left_anti").select(*desks.columns)
    return others.unionByName(arrived).unionByName(left)
