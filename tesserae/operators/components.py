"""Connected components of a graph given as links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import materialise


#: Links that one forest takes in, in a task.
FOREST = 500_000


class Forest:
    """Disjoint sets of integers, each known by its smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def links(self) -> tuple[list[int], list[int]]:
        """(member, smallest member) of every member that is not the smallest."""
        a = list(self.up)
        return a, [self.root(x) for x in a]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (big, small) that connect what a task's links connect: a star for each component among them."""
    forest, n = Forest(), 0

    def out() -> pa.RecordBatch:
        a, b = forest.links()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["big", "small"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(x, y)
        n += batch.num_rows
        if n >= FOREST:
            yield out()
            forest, n = Forest(), 0
    yield out()


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows. Links are (big, small)."""
    both = links.select(F.col("big").alias("u"), F.col("small").alias("v")).union(links.select(F.col("small").alias("u"), F.col("big").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("big"), F.col("m").alias("small")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them."""
    least = links.groupBy("big").agg(F.min("small").alias("m"))
    moved = links.join(least, "big").filter("small <> m").select(F.col("small").alias("big"), F.col("m").alias("small"))
    return moved.union(least.select("big", F.col("m").alias("small"))).distinct()


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node (a long) that has a link to another; root is the smallest node of its component.

    First each task joins what its own links connect, so few rounds are left. Both steps keep the components and only lower the ends of links, so they settle as one star for each
    component. Every round is written to the shared folder; only a count and a checksum reach the driver.
    Null ends and links of a node to itself are left out; repeated links count once.
    """
    found = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("big"), F.least(a, b).cast("long").alias("small"))
    found = materialise(found.mapInArrow(_contract, "big long, small long").distinct(), "links")
    before = _signature(found)
    while before[0]:
        found = materialise(_small_star(_large_star(found)), "stars")
        now = _signature(found)
        if now == before:
            break
        before = now
    return found.select(F.col("big").alias("node"), F.col("small").alias("root")).union(found.select(F.col("small"), F.col("small")).distinct())
