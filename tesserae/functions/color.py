"""Colour arithmetic on scalar channel columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The weights of luma, of the colour distance, and the bounds of its two penalties.
LUMA = (0.299, 0.587, 0.114)
WEIGHTS = (0.95, 1.18, 1.05, 0.85)
GREY_SOURCE, VIVID_TARGET, VIVID_PENALTY = 28, 45, 0.45
GREEN_SOURCE, GREEN_TARGET, GREEN_PENALTY = 8, 18, 1.8

Rgb = tuple[Column, Column, Column]


def rgb(prefix: str = "") -> Rgb:
    return F.col(f"{prefix}r"), F.col(f"{prefix}g"), F.col(f"{prefix}b")


def half_up(x: Column) -> Column:
    """Halves go up, for negative numbers too."""
    return F.floor(x + F.lit(0.5))


def squared_distance(a: Rgb, b: Rgb) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), start=F.lit(0))


def distance(a: Rgb, b: Rgb) -> Column:
    return F.sqrt(squared_distance(a, b).cast("double"))


def brightness(c: Rgb) -> Column:
    return (c[0] + c[1] + c[2]) / F.lit(3.0)


def chroma(c: Rgb) -> Column:
    return F.greatest(*c) - F.least(*c)


def luma(c: Rgb) -> Column:
    return sum((x * F.lit(w) for x, w in zip(c[1:], LUMA[1:], strict=True)), start=c[0] * F.lit(LUMA[0]))


def is_dark(c: Rgb, bound: float = 128.0) -> Column:
    return luma(c) < F.lit(bound)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clamp_byte(x: Column) -> Column:
    """A whole number from 0 to 255; null and non-finite values give 0."""
    finite = x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return F.when(finite, half_up(clamp(x, 0, 255))).otherwise(F.lit(0)).cast("int")


def snap(x: Column, threshold: int, mode: str = "dominant") -> Column:
    """A channel on the grid of the mode's step; no upper bound is put on it."""
    if mode == "average" or threshold <= 0:
        return x
    step = max(1, int(threshold / (3 if mode == "smooth" else 5) + 0.5))
    return (half_up(x / F.lit(float(step))) * F.lit(step)).cast("int")


def match_distance(source: Rgb, target: Rgb) -> Column:
    """How far a palette colour is from a pixel: weighted squares, and penalties for colour that the pixel has not."""
    dl = luma(source) - luma(target)
    base = F.lit(0.0)
    for x, y, w in zip(source, target, WEIGHTS, strict=False):
        base = base + (x - y) * (x - y) * F.lit(w)
    base = base + dl * dl * F.lit(WEIGHTS[3])
    spread_s, spread_t = chroma(source), chroma(target)
    green = lambda c: c[1] - F.greatest(c[0], c[2])
    vivid = F.when((spread_s < GREY_SOURCE) & (spread_t > VIVID_TARGET), (spread_t - spread_s) * (spread_t - spread_s) * F.lit(VIVID_PENALTY)).otherwise(F.lit(0.0))
    tint = F.when((green(source) < GREEN_SOURCE) & (green(target) > GREEN_TARGET), green(target) * green(target) * F.lit(GREEN_PENALTY)).otherwise(F.lit(0.0))
    return base + vivid + tint


def from_hex(text: Column) -> Rgb:
    """Channels of #RRGGBB; null where it is none."""
    ok = text.rlike("^#[0-9A-Fa-f]{6}$")
    return tuple(F.when(ok, F.conv(F.substring(text, at, 2), 16, 10).cast("int")) for at in (2, 4, 6))


def to_hex(c: Rgb) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(x.cast("int")), 2, "0") for x in c])
