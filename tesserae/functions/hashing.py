"""Hashes and packed bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME, FNV_MASK = 2166136261, 16777619, 4294967295


def fnv1a(text: Column) -> Column:
    """FNV-1a over the text's characters (those of the basic plane), as 8 hexadecimal digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(FNV_MASK)))
    return F.lpad(F.hex(h), 8, "0")


def fingerprint(*parts: Column) -> Column:
    """The hash of the parts, joined by bars."""
    return fnv1a(F.concat_ws("|", *[p.cast("string") for p in parts]))


def packed_bits(x: Column, black: Column) -> Column:
    """An aggregate: the bits of one byte of a raster row, the leftmost first, from the pixels that are black."""
    return F.sum(F.when(black, F.call_function("shiftleft", F.lit(1), F.lit(7) - (x % 8).cast("int"))).otherwise(0))
