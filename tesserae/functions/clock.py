"""Dates, clock texts and durations. Zones are parameters; naive timestamps are in the zone of the table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_date(ts: Column, zone: str) -> Column:
    """The date in a zone of an instant given in UTC."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def last_dates(day: Column, n: int = 7) -> Column:
    return F.sequence(F.date_sub(day, n - 1), day)


def date_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def is_weekend(ts: Column) -> Column:
    return F.dayofweek(ts).isin(1, 7)


def at_hour(ts: Column, hour: Column) -> Column:
    """That hour of the same day."""
    return F.date_trunc("day", ts) + F.make_dt_interval(hours=hour)


def at_time(day: Column, text: Column) -> Column:
    """A text H:MM put on a day, hours and minutes clamped; other texts give the day's own instant."""
    ok = text.rlike(r"^\s*\d{1,2}:\d{1,2}\s*$")
    part = lambda i, most: F.least(F.lit(most), F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{1,2})", i).try_cast("int"))
    return F.when(ok, F.date_trunc("day", day) + F.make_dt_interval(hours=part(1, 23), mins=part(2, 59))).otherwise(day)


def duration_clock(seconds: Column) -> Column:
    """H:MM:SS, never below 0."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def duration_words(minutes: Column) -> Column:
    m = F.greatest(F.lit(0), F.floor(minutes)).cast("long")
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit(" h "), (m % 60).cast("string"), F.lit(" min")))


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", a, b)


def elapsed(start: Column, now: Column, paused_seconds: Column) -> Column:
    """Seconds since the start without pauses, at least 0; 0 without a start."""
    return F.coalesce(F.greatest(F.lit(0), seconds_between(start, now) - paused_seconds), F.lit(0))


def dos_time(ts: Column) -> tuple[Column, Column]:
    """(date, time) as an archive packs them."""
    date = F.shiftleft(F.year(ts) - 1980, 9).bitwiseOR(F.shiftleft(F.month(ts), 5)).bitwiseOR(F.dayofmonth(ts))
    time = F.shiftleft(F.hour(ts), 11).bitwiseOR(F.shiftleft(F.minute(ts), 5)).bitwiseOR(F.floor(F.second(ts) / 2).cast("int"))
    return date, time
