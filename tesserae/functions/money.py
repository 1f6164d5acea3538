"""Price rounding and overtime fees, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds that are not charged, minutes of a block, and the rates by hour and half hour before and from LATE o'clock.
GRACE_SECONDS = 600
BLOCK_MINUTES = 30
LATE = 21
HOUR_RATE, HALF_RATE = (20.0, 50.0), (10.0, 30.0)


def round_price(x: Column, rule: str = "whole") -> Column:
    """Up to a whole number, a half, a five, or to .9 or .99; what is not a positive number gives 0."""
    if rule in ("nine", "ninetynine"):
        part = {"nine": 0.9, "ninetynine": 0.99}[rule]
        low = F.floor(x).cast("double") + F.lit(part)
        up = F.round(F.when(low >= x, low).otherwise(F.floor(x).cast("double") + F.lit(1 + part)), 2)
    elif rule == "half":
        up = F.ceil(x * 2).cast("double") / 2
    elif rule == "five":
        up = F.ceil(x / 5).cast("double") * 5
    else:
        up = F.ceil(x).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < F.lit(float("inf"))), up).otherwise(F.lit(0.0))


def extension_fee(minutes: Column, hour: Column) -> Column:
    """Started blocks of half an hour, two at a time at the hour's rate; the rates follow the hour given."""
    blocks = F.ceil(F.greatest(F.lit(0), minutes) / F.lit(float(BLOCK_MINUTES)))
    late = hour >= LATE
    return F.floor(blocks / 2) * F.when(late, HOUR_RATE[1]).otherwise(HOUR_RATE[0]) + (blocks % 2) * F.when(late, HALF_RATE[1]).otherwise(HALF_RATE[0])


def overtime(seconds: Column, end_hour: Column) -> tuple[Column, Column]:
    """(fee, charged minutes) of the seconds over an end in that hour; up to GRACE_SECONDS are free."""
    minutes = F.ceil(seconds / F.lit(60.0))
    free = F.coalesce(seconds <= GRACE_SECONDS, F.lit(True)) | end_hour.isNull()
    charged = (F.ceil(minutes / F.lit(float(BLOCK_MINUTES))) * BLOCK_MINUTES).cast("int")
    return F.when(free, 0.0).otherwise(extension_fee(minutes, end_hour)), F.when(free, 0).otherwise(charged)


def money_text(x: Column, digits: int = 2) -> Column:
    """A number with so many decimals and a comma at every three digits; halves of its shortest decimal form go away from zero, null and NaN are 0."""
    number = F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)
    return F.format_number(F.round(number.cast("decimal(38,12)"), digits), digits)


def percent_text(x: Column) -> Column:
    """A share as per cent with one decimal; halves of the exact binary number go away from zero, null and NaN are 0.

    The fraction is split in two, so that its distance from a half is known exactly.
    """
    y = F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x.cast("double")) * 100
    size = F.abs(y)
    whole = F.floor(size)
    part = size - whole
    high = F.floor(part * F.lit(2.0**27)) / F.lit(2.0**27)
    tenths = F.floor(part * 10)
    past = (high * 20 - (tenths * 2 + 1)) + (part - high) * 20 >= 0
    n = whole * 10 + tenths + past.cast("long")
    return F.concat(F.when(y < 0, "-").otherwise(""), F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"), F.lit("%"))
