"""The nearest palette colour by branch and bound, for colours in batches.

The palette is cut in halves, at the median of its widest channel, down to leaves of LEAF colours. The distance is a sum of weighted
squared differences of the channels and of luma, and of two penalties that are never negative; so the weighted squared gaps
between a colour and a leaf's box, and its range of luma, are never more than the distance to any colour in it. A colour visits
leaves from the nearest box on, until a box is farther than the best colour so far; boxes as far are visited, for ties go to the
first colour of the palette.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tesserae.functions import color

LEAF = 8
#: Colours that one step of a task looks up.
STEP = 16_384
#: What a bound may be off by, in parts of itself and of a large distance.
_SLACK = 1e-9


class Tree(NamedTuple):
    colours: np.ndarray  # (m, 3), in the order of the palette, and a row of NaN
    leaves: np.ndarray  # (leaves, LEAF) places in it, the last row where a leaf has fewer
    low: np.ndarray  # (leaves, 4): least red, green, blue and luma
    high: np.ndarray


def luma(x: np.ndarray) -> np.ndarray:
    return x[..., 0] * color.LUMA[0] + x[..., 1] * color.LUMA[1] + x[..., 2] * color.LUMA[2]


def distances(c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """tesserae.functions.color.match_distance of colours c and palette colours p, (..., 3) each, broadcast; each is the same number in any batch."""
    out = 0.0
    for i in range(3):
        d = c[..., i] - p[..., i]
        out = out + d * d * color.WEIGHTS[i]
    d = luma(c) - luma(p)
    out = out + d * d * color.WEIGHTS[3]
    spread = lambda x: np.maximum(np.maximum(x[..., 0], x[..., 1]), x[..., 2]) - np.minimum(np.minimum(x[..., 0], x[..., 1]), x[..., 2])
    green = lambda x: x[..., 1] - np.maximum(x[..., 0], x[..., 2])
    own, other = spread(c), spread(p)
    d = other - own
    out = out + np.where((own < color.GREY_SOURCE) & (other > color.VIVID_TARGET), d * d * color.VIVID_PENALTY, 0)
    other = green(p)
    return out + np.where((green(c) < color.GREEN_SOURCE) & (other > color.GREEN_TARGET), other * other * color.GREEN_PENALTY, 0)


def build(colours: np.ndarray) -> Tree:
    """The tree of a palette's colours (m, 3), in its order."""
    colours = np.asarray(colours, np.float64).reshape(-1, 3)
    leaves: list[np.ndarray] = []

    def cut(places: np.ndarray) -> None:
        if len(places) <= LEAF:
            leaves.append(places)
            return
        some = colours[places]
        channel = int(((some.max(axis=0) - some.min(axis=0)) ** 2 * np.array(color.WEIGHTS[:3])).argmax())
        order = places[np.argsort(some[:, channel], kind="stable")]
        cut(order[: len(order) // 2])
        cut(order[len(order) // 2 :])

    cut(np.arange(len(colours)))
    table = np.full((len(leaves), LEAF), len(colours))
    for row, places in zip(table, leaves, strict=True):
        row[: len(places)] = np.sort(places)
    four = np.concatenate([colours, luma(colours)[:, None]], axis=1)
    low, high = (np.array([f(four[x], axis=0) for x in leaves]).reshape(-1, 4) for f in (np.min, np.max))
    return Tree(np.concatenate([colours, np.full((1, 3), np.nan)]), table, low, high)


def nearest(tree: Tree, colours: np.ndarray) -> np.ndarray:
    """The place in the palette of the colour nearest to each of these (n, 3), the first of equally near ones."""
    n, none = len(colours), len(tree.colours) - 1
    four = np.concatenate([colours, luma(colours)[:, None]], axis=1)
    bound = np.zeros((n, len(tree.leaves)))
    for i in range(4):
        gap = np.maximum(0, np.maximum(tree.low[None, :, i] - four[:, i, None], four[:, i, None] - tree.high[None, :, i]))
        bound += gap * gap * color.WEIGHTS[i]
    order = np.argsort(bound, axis=1, kind="stable")
    best, place, rows = np.full(n, np.inf), np.full(n, none), np.arange(n)
    for step in range(len(tree.leaves)):
        leaf = order[rows, step]
        near = bound[rows, leaf] * (1 - _SLACK) <= best[rows]
        rows, leaf = rows[near], leaf[near]
        if not len(rows):
            break
        members = tree.leaves[leaf]
        d = distances(colours[rows, None, :], tree.colours[members])
        d = np.where(members == none, np.inf, d)
        at = d.argmin(axis=1)  # places ascend in a leaf
        d, members = d[np.arange(len(rows)), at], members[np.arange(len(rows)), at]
        better = (d < best[rows]) | ((d == best[rows]) & (members < place[rows]))
        best[rows[better]], place[rows[better]] = d[better], members[better]
    return place


def match(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    """Rows (r, g, b), none null, with `place`."""
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP):
            rows = batch.slice(lo, STEP)
            rgb = np.stack([rows.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(3)], axis=1)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(nearest(tree, rgb).astype(np.int32))], [*rows.schema.names, "place"])
