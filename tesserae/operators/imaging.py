"""Raster operators whose results depend on the order of cells or rounds; each image is one group.

An image has at most MOST_SIDE x MOST_SIDE cells, so a group is bounded: a cell beyond that fails the job before images are
gathered. Images are independent.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import colour_tree

#: Rounds of the colour limit; tolerance and least size of direct colours; how an error is spread: (row, column, sixteenths).
ROUNDS, TOLERANCE, LEAST = 8, 38.0, 3
SPREAD = ((1, -1, 3), (0, 1, 7), (1, 0, 5), (1, 1, 1))

#: Rows and columns of an image.
MOST_SIDE = 1000

Palette = Sequence[tuple[str, int, int, int]]


def _bounded(pixels: DataFrame) -> DataFrame:
    """pixels, with a failure at a cell that no image may have."""
    fits = F.col("row").between(0, MOST_SIDE - 1) & F.col("col").between(0, MOST_SIDE - 1)
    failure = F.raise_error(F.format_string(f"a cell lies beyond {MOST_SIDE} x {MOST_SIDE}: (%s, %s)", "row", "col"))
    return pixels.withColumn("row", F.when(fits, F.col("row")).otherwise(failure.cast("int")))


def match_distances(c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The distances of colours c (n, 3) to palette colours p (m, 3)."""
    return colour_tree.distances(c[:, None, :], p[None, :, :])


def dither_image(rgb: np.ndarray, use: np.ndarray, palette: Palette, threshold: int) -> np.ndarray:
    """Palette indexes (-1 where not used) of one image, as if row by row: each pixel's error goes on to those after it. Sums are kept in single precision.

    Errors go one to the right, and down by one at most one to the left: so the pixels of one value of column + 2 * row depend on
    none of each other, and these skewed diagonals are taken whole. A pixel gets its errors in the same order as row by row: from
    the left above, from above, from the right above, from the left; the last two come from one diagonal, in this order.
    """
    h, w, _ = rgb.shape
    buf, out, use = rgb.reshape(-1, 3).astype(np.float32), np.full(h * w, -1), use.ravel()
    p = np.array([c[1:] for c in palette], np.float64)
    step = max(1, int(threshold / 5 + 0.5)) if threshold > 0 else 0
    for diagonal in range(w + 2 * (h - 1)):
        y = np.arange(max(0, (diagonal - w + 2) // 2), min(h - 1, diagonal // 2) + 1)
        at = y * w + (diagonal - 2 * y)
        y, at = y[use[at]], at[use[at]]
        if not len(at):
            continue
        x = diagonal - 2 * y
        value = np.clip(buf[at].astype(np.float64), 0, 255)
        if step:
            value = np.floor(value / step + 0.5) * step
        k = match_distances(value, p).argmin(axis=1)
        out[at] = k
        error = value - p[k]
        for dy, dx, part in SPREAD:
            inside = (y + dy < h) & (x + dx >= 0) & (x + dx < w)
            to = at[inside] + dy * w + dx
            buf[to] = (buf[to].astype(np.float64) + error[inside] * part / 16).astype(np.float32)
    return out.reshape(h, w)


def dither(pixels: DataFrame, palette: Palette, threshold: int = 40) -> DataFrame:
    """(grid_id, row, col, code) of pixels (grid_id, row, col, r, g, b, a); transparent cells get no code."""
    codes, kind = [c[0] for c in palette], pixels.schema["grid_id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1
        rgb, use = np.zeros((h, w, 3)), np.zeros((h, w), bool)
        rgb[pdf["row"], pdf["col"]] = pdf[["r", "g", "b"]].to_numpy()
        use[pdf["row"], pdf["col"]] = pdf["a"] >= 24
        k = dither_image(rgb, use, palette, threshold)[pdf["row"], pdf["col"]]
        return pdf[["grid_id", "row", "col"]].assign(code=[codes[i] if i >= 0 else None for i in k])

    return _bounded(pixels.select("grid_id", "row", "col", "r", "g", "b", "a")).groupBy("grid_id").applyInPandas(one, f"grid_id {kind}, row int, col int, code string")


def representatives(rgb: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Indexes of the colours (sorted by count, then code) that stand for all: seeds are the commonest, then the farthest weighted by log2(count + 1); ROUNDS rounds of means; each mean's nearest colour, and the commonest others if two share one."""
    n = len(rgb)
    if n <= most:
        return np.arange(n)
    weight = np.maximum(1, count).astype(np.float64)
    square = lambda a, b: ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    seeds, much, near = [0], np.log2(weight + 1), square(rgb, rgb[:1])[:, 0]
    while len(seeds) < most:
        gain = near * much
        k = int(gain.argmax())
        if gain[k] <= 0:
            break
        seeds.append(k)
        near = np.minimum(near, ((rgb - rgb[k]) ** 2).sum(axis=1))
    means = rgb[seeds].astype(np.float64)
    for _ in range(ROUNDS):
        owner = square(rgb, means).argmin(axis=1)
        total = np.bincount(owner, weights=weight, minlength=len(means))
        sums = np.stack([np.bincount(owner, weights=rgb[:, i] * weight, minlength=len(means)) for i in range(3)], axis=1)
        means[total > 0] = sums[total > 0] / total[total > 0, None]
    chosen: list[int] = []
    for m in means:
        d = ((rgb - m) ** 2).sum(axis=1)
        k = int(np.lexsort((-weight, d))[0])
        if k not in chosen:
            chosen.append(k)
    for k in range(n):
        if len(chosen) >= min(most, n):
            break
        if k not in chosen:
            chosen.append(k)
    return np.array(chosen)


def limit_colours(grid: DataFrame, palette: DataFrame, most: int) -> DataFrame:
    """grid with at most `most` codes in each image. Only counts of codes are grouped; the recolouring is a join."""
    kind = grid.schema["grid_id"].dataType.simpleString()
    stats = grid.filter(F.col("code").isNotNull()).groupBy("grid_id", "code").agg(F.count("*").alias("n")).join(palette.select("code", "r", "g", "b"), "code")

    def one(table: pa.Table) -> pa.Table:
        code, n = table.column("code").to_pylist(), table.column("n").to_numpy()
        order = np.array(sorted(range(len(code)), key=lambda i: (-n[i], code[i])))
        rgb = np.stack([table.column(c).to_numpy() for c in "rgb"], axis=1).astype(np.float64)[order]
        keep = representatives(rgb, n[order], most)
        to = keep[match_distances(rgb, rgb[keep]).argmin(axis=1)]
        own = table.select(["grid_id", "code"]).take(pa.array(order))
        return own.append_column("to", own.column("code").take(pa.array(to)))

    # Counts are few bytes for much work: they are dealt to the cores, not to as few tasks as their size asks for.
    tasks = 3 * grid.sparkSession.sparkContext.defaultParallelism
    new = stats.repartition(tasks, "grid_id").groupBy("grid_id").applyInArrow(one, f"grid_id {kind}, code string, to string")
    return grid.join(new, ["grid_id", "code"], "left").select("grid_id", "row", "col", F.coalesce("to", "code").alias("code"))


def leaders(colours: np.ndarray, tolerance: float = TOLERANCE, least: int = LEAST) -> np.ndarray:
    """The cluster of each colour, in order: the first one whose running mean is within the tolerance, else a new one; -1 in clusters under the least size (the largest stays if all are).

    A cluster is looked for among those whose mean lies in the colour's cell of a grid with the tolerance as its side, or in one
    beside it. Each cell lists them in the order in which they were created; a mean that moves to another cell is moved in the lists.
    """
    width, limit = tolerance or 1.0, tolerance * tolerance
    reach: dict[tuple[int, ...], list[int]] = {}
    means, sums, sizes, cells, owner = [], [], [], [], np.full(len(colours), -1)

    def around(cell: tuple[int, ...]) -> list[tuple[int, ...]]:
        return [(cell[0] + i, cell[1] + j, cell[2] + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]

    for i, (r, g, b) in enumerate(colours.tolist()):
        k = -1
        for at in reach.get((int(r // width), int(g // width), int(b // width)), ()):
            m = means[at]
            x, y, z = m[0] - r, m[1] - g, m[2] - b
            if x * x + y * y + z * z <= limit:
                k = at
                break
        if k < 0:
            k = len(sizes)
            sums.append([0.0, 0.0, 0.0])
            sizes.append(0.0)
            means.append(None)
            cells.append(None)
        total = sums[k]
        total[0] += r
        total[1] += g
        total[2] += b
        sizes[k] += 1
        n = sizes[k]
        means[k] = mean = (total[0] / n, total[1] / n, total[2] / n)
        cell = (int(mean[0] // width), int(mean[1] // width), int(mean[2] // width))
        if cell != cells[k]:
            for c in around(cells[k]) if cells[k] else ():
                reach[c].remove(k)
            for c in around(cell):
                insort(reach.setdefault(c, []), k)
            cells[k] = cell
        owner[i] = k
    sizes = np.array(sizes)
    good = sizes >= least
    if len(sizes) and not good.any():
        good[sizes.argmax()] = True
    return np.where(good[owner], owner, -1) if len(sizes) else owner


def direct_colours(pixels: DataFrame) -> DataFrame:
    """(grid_id, row, col, code, hex): codes C1, C2, ... by size, then colour; cells of clusters under the least size are empty."""
    kind = pixels.schema["grid_id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"]).reset_index(drop=True)
        c = pdf[["r", "g", "b"]].to_numpy(np.float64)
        owner = leaders(c)
        kept, size = np.unique(owner[owner >= 0], return_counts=True)
        at = np.searchsorted(kept, owner[owner >= 0])
        sums = np.stack([np.bincount(at, weights=c[owner >= 0, i], minlength=len(kept)) for i in range(3)], axis=1)
        hexes = ["#{:02X}{:02X}{:02X}".format(*map(int, m)) for m in np.floor(sums / np.maximum(1, size)[:, None] + 0.5)]
        order = sorted(range(len(kept)), key=lambda k: (-int(size[k]), hexes[k]))
        named = {int(kept[k]): (f"C{i + 1}", hexes[k]) for i, k in enumerate(order)}
        found = [named.get(int(k), (None, None)) for k in owner]
        return pdf[["grid_id", "row", "col"]].assign(code=[f[0] for f in found], hex=[f[1] for f in found])

    opaque = _bounded(pixels).filter("a >= 24").select("grid_id", "row", "col", "r", "g", "b")
    return opaque.groupBy("grid_id").applyInPandas(one, f"grid_id {kind}, row int, col int, code string, hex string")
