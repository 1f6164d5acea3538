"""Grids cut into squares of SQUARE x SQUARE cells, which tasks work on side by side with NumPy.

A square comes with the cells around it, up to a distance of `halo`, so whatever depends on near cells only is done in one shuffle,
for grids of any size. A group holds at most (SQUARE + 2 * halo)^2 cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows and columns of a square.
SQUARE = 256

#: A square's rows, those around it among them, and its first row and column; None for rows without a place (a null grid_id, row or col).
Work = Callable[[pa.Table, "tuple[int, int] | None"], pa.Table]


def over_squares(cells: DataFrame, work: Work, fields: Sequence[StructField], halo: int = 0, square: int = SQUARE) -> DataFrame:
    """The rows (fields) that `work` makes of each square of cells (grid_id, row, col, ...)."""
    placed = F.col("grid_id").isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull()
    at = lambda c, by: F.floor((F.col(c) + by) / F.lit(float(square)))
    spread = F.pmod(F.xxhash64(*cells.columns), F.lit(4096))
    keyed = cells.withColumn("_placed", placed)
    for name, c in (("_down", "row"), ("_across", "col")):
        if halo:
            keyed = keyed.withColumn(name, F.explode(F.when(placed, F.sequence(at(c, -halo), at(c, halo))).otherwise(F.array(spread))))
        else:
            keyed = keyed.withColumn(name, F.when(placed, at(c, 0)).otherwise(spread))
    names = cells.columns

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, there, down, across = (k.as_py() for k in key)
        return work(table.select(names), (down * square, across * square) if there else None)

    return keyed.groupBy("grid_id", "_placed", "_down", "_across").applyInArrow(one, StructType(list(fields)))


def places(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(table.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))


def inside(row: np.ndarray, col: np.ndarray, corner: tuple[int, int], square: int) -> np.ndarray:
    """Which cells are the square's own."""
    return (row >= corner[0]) & (row < corner[0] + square) & (col >= corner[1]) & (col < corner[1] + square)


def ordinals(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the distinct ones in their order (of texts, that of UTF-8), -1 for null; and these values."""
    found = pa.concat_arrays(column.chunks).dictionary_encode()
    values = found.dictionary.to_pylist()
    order = sorted(range(len(values)), key=lambda i: values[i].encode() if isinstance(values[i], str) else values[i])
    rank = np.full(len(values) + 1, -1, np.int64)  # the last one is taken by null
    rank[order] = np.arange(len(values))
    return rank[found.indices.fill_null(-1).to_numpy(zero_copy_only=False)], found.dictionary.take(pa.array(order, pa.int64()))


def valued(values: pa.Array, k: np.ndarray) -> pa.Array:
    return values.take(pa.array(k, pa.int64(), mask=k < 0))


def replaced(table: pa.Table, name: str, column: pa.Array) -> pa.Table:
    return table.set_column(table.schema.get_field_index(name), table.schema.field(name), column)


def commonest(group: np.ndarray, value: np.ndarray, groups: int, values: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of votes (group, value): each group's commonest value (-1 without votes), of equally common ones the smallest, and its votes; then the distinct pairs as group * values + value, sorted, and theirs."""
    pairs, n = np.unique(group * values + value, return_counts=True)
    of = pairs // values
    first = np.lexsort((pairs, -n, of))
    lead = first[np.r_[True, of[first][1:] != of[first][:-1]]] if len(first) else first
    top, votes = np.full(groups, -1), np.zeros(groups, np.int64)
    top[of[lead]], votes[of[lead]] = pairs[lead] % values, n[lead]
    return top, votes, pairs, n


def board(row: np.ndarray, col: np.ndarray, value: np.ndarray, margin: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The values (from 0) as a dense array around the cells, -1 elsewhere, with a margin on all sides; and where each cell is in it, flat."""
    top, left = row.min() - margin, col.min() - margin
    dense = np.full((row.max() + margin - top + 1, col.max() + margin - left + 1), -1, np.int64)
    at = (row - top) * dense.shape[1] + col - left
    dense.ravel()[at] = value
    return dense, at


def connected(row: np.ndarray, col: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each cell the place of its region's first cell, row by row, among the cells; regions are 4-connected cells of one key (from 0).

    Runs along the rows are nodes from the start. Then the larger root of each link that is left goes under the smaller one, and
    paths are halved until they are flat.
    """
    dense, at = board(row, col, key)
    h, w = dense.shape
    cell = np.arange(h * w).reshape(h, w)
    new = np.ones((h, w), bool)
    new[:, 1:] = (dense[:, 1:] != dense[:, :-1]) | (dense[:, 1:] < 0)
    start = np.maximum.accumulate(np.where(new, cell, 0), axis=1)
    same = (dense[1:] == dense[:-1]) & (dense[1:] >= 0)
    a, b = start[:-1][same], start[1:][same]
    root = start.ravel().copy()
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    place = np.zeros(h * w, np.int64)
    place[at] = np.arange(len(at))
    return place[root[at]]
