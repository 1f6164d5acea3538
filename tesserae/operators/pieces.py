"""Ordered groups of any size, cut into pieces that tasks work on side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import materialise

#: Rows of a piece, about.
PIECE = 20_000


def dealt(rows: DataFrame, keys: Sequence[str], size: int = PIECE) -> DataFrame:
    """rows with `tie`, a number of their own, and `piece`: ranges of (keys, tie), numbered in their order."""
    rows = materialise(rows.withColumn("tie", F.monotonically_increasing_id()), "rows")
    pieces = max(1, -(-rows.count() // size))
    return materialise(rows.repartitionByRange(pieces, *keys, "tie").withColumn("piece", F.spark_partition_id()), "pieces")


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: int = PIECE) -> DataFrame:
    """rows with `rank`, from 1 within `by` in the order of `order`; rows that are equal in it keep some order.

    Each piece counts its own rows; what the pieces before hold of a group comes from one row for each piece and group.
    """
    group, at = [f"by{i}" for i in range(len(by))], [f"at{i}" for i in range(len(order))]
    keyed = rows.select(F.struct("*").alias("row"), *[F.col(c).alias(k) for c, k in zip([*by, *order], [*group, *at], strict=True)])
    parts = dealt(keyed, [*group, *at], size)
    before = Window.partitionBy(*group).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    spans = parts.groupBy("piece", *group).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("piece", *group).orderBy(*at, "tie"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("piece", *group)]
    found = parts.withColumn("own", own).alias("p").join(materialise(spans, "spans").alias("s"), same)
    return found.select("row", (F.col("own") + F.col("before")).alias("rank")).select("row.*", "rank")
