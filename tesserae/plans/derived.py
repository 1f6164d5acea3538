"""Inputs that queries derive from the driver's tables by integer arithmetic, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Cells of one derived grid, and its width.
SIDE = 50


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid_id, row, col, r, g, b, a): one pixel for each order, in grids of SIDE x SIDE."""
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    cell = n % (SIDE * SIDE)
    return table(spark, sf_dir, "orders").select(
        F.floor(n / (SIDE * SIDE)).cast("int").alias("grid_id"),
        F.floor(cell / SIDE).cast("int").alias("row"),
        (cell % SIDE).cast("int").alias("col"),
        (F.floor(c * 7 / 16) * 16 % 256).cast("int").alias("r"),
        (F.floor(n / 24) * 24 % 256).cast("int").alias("g"),
        (F.floor(F.col("o_totalprice") / 32) * 32 % 256).cast("int").alias("b"),
        F.when(n % 23 == 0, 10).otherwise(255).alias("a"),
    )


PIXELS_SQL = f"""
    SELECT CAST(o_orderkey // {SIDE * SIDE} AS INTEGER) AS grid_id, CAST((o_orderkey % {SIDE * SIDE}) // {SIDE} AS INTEGER) AS "row",
        CAST(o_orderkey % {SIDE * SIDE} % {SIDE} AS INTEGER) AS col, CAST(o_custkey * 7 // 16 * 16 % 256 AS INTEGER) AS r, CAST(o_orderkey // 24 * 24 % 256 AS INTEGER) AS g,
        CAST(CAST(floor(o_totalprice / 32) AS BIGINT) * 32 % 256 AS INTEGER) AS b, CASE WHEN o_orderkey % 23 = 0 THEN 10 ELSE 255 END AS a
    FROM orders"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid_id, row, col, code): patches of four codes with noise, and empty cells."""
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    cell = n % (SIDE * SIDE)
    row, col = F.floor(cell / SIDE).cast("int"), (cell % SIDE).cast("int")
    v = F.when(c % 5 == 0, c % 4).otherwise((F.floor(row / 6) + F.floor(col / 8)) % 4)
    return table(spark, sf_dir, "orders").select(
        F.floor(n / (SIDE * SIDE)).cast("int").alias("grid_id"), row.alias("row"), col.alias("col"), F.when(n % 17 != 0, F.concat(F.lit("C"), v.cast("int").cast("string"))).alias("code")
    )


GRID_SQL = f"""
    SELECT grid_id, "row", col, CASE WHEN n % 17 <> 0 THEN 'C' || CAST(CASE WHEN c % 5 = 0 THEN c % 4 ELSE ("row" // 6 + col // 8) % 4 END AS INTEGER) END AS code
    FROM (SELECT o_orderkey AS n, o_custkey AS c, CAST(o_orderkey // {SIDE * SIDE} AS INTEGER) AS grid_id, CAST((o_orderkey % {SIDE * SIDE}) // {SIDE} AS INTEGER) AS "row",
        CAST(o_orderkey % {SIDE * SIDE} % {SIDE} AS INTEGER) AS col FROM orders)"""


#: A palette by rule; users bring their own as a table.
COLOURS = 48


def palette(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(COLOURS).select(
        i.cast("int").alias("idx"), ((i * 67 + 29) % 256).cast("int").alias("r"), ((i * 131 + 71) % 256).cast("int").alias("g"), ((i * 193 + 17) % 256).cast("int").alias("b"),
        F.concat(F.chr(F.lit(65) + F.floor(i / 10)), (i % 10 + 1).cast("string")).alias("code"),
    )


PALETTE_SQL = f"""
    SELECT CAST(i AS INTEGER) AS idx, CAST((i * 67 + 29) % 256 AS INTEGER) AS r, CAST((i * 131 + 71) % 256 AS INTEGER) AS g, CAST((i * 193 + 17) % 256 AS INTEGER) AS b,
        chr(CAST(65 + i // 10 AS INTEGER)) || CAST(i % 10 + 1 AS VARCHAR) AS code FROM range({COLOURS}) t(i)"""

#: The instant at which status queries look at the events.
NOW = "2024-01-20 12:00:00"
