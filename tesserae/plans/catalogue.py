"""The registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tesserae.plans import business, grids, images, texts

_PARTS = (grids, business, texts, images)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return reduce(lambda a, b: a | b.QUERIES, _PARTS, {})


def oracle_sql() -> dict[str, str]:
    return reduce(lambda a, b: a | b.ORACLES, _PARTS, {})
