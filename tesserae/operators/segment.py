"""Background segmentation of pixel tables (grid_id, row, col, r, g, b, a).

Cells take far less room in Parquet than in memory, and Spark goes by the former when it decides what to broadcast. So joins of cells
with cells are merge joins: they never pass through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tesserae.functions import color
from tesserae.operators import squares
from tesserae.operators.components import components
from tesserae.operators.grid import CELL, CROSS, dilate, neighbours
from tesserae.session import materialise

#: Opacity of a pixel that counts, and near white.
OPAQUE, NEAR_WHITE = 24, 248
#: Above which a reference is light, and what is like one; how far from any other reference is like it.
LIGHT_REFERENCE = 190
LIKE_BRIGHTNESS, LIKE_CHROMA, LIKE_LIGHT, LIKE_OTHER = 184, 52, 96, 54
#: Share of the shorter side in a corner's window, least window; group radius of light corners and of all; a light corner.
CORNER_SHARE, CORNER_LEAST = 0.08, 2
LIGHT_RADIUS, ALL_RADIUS, CORNER_BRIGHTNESS, CORNER_CHROMA = 62, 54, 188, 70
#: References that can be removed: light and neutral ones, and softly plain ones (corners that agree, spread, border, most of the raw mask).
NEUTRAL_BRIGHTNESS, NEUTRAL_CHROMA = 188, 64
SOFT_BRIGHTNESS, SOFT_CHROMA, SOFT_CORNERS, SOFT_SPREAD, SOFT_EDGE, SOFT_RAW = 174, 88, 4, 42, 0.78, 0.82
#: What any background that is removed must have: corners, spread, border, corner pixels, the raw mask's share, the mask's share.
LEAST_CORNERS, MOST_SPREAD, LEAST_EDGE, LEAST_CORNER_MATCH, RAW_SHARE, LEAST_MASK = 3, 58, 0.68, 0.74, (0.08, 0.92), 0.02


def opaque(alpha: Column) -> Column:
    return alpha >= OPAQUE


def near_white(c: color.Rgb) -> Column:
    return (c[0] >= NEAR_WHITE) & (c[1] >= NEAR_WHITE) & (c[2] >= NEAR_WHITE)


def background_like(c: color.Rgb, alpha: Column, reference: color.Rgb) -> Column:
    """Transparent, or like the reference: of a light one, pale and not far from it; of any other, near it."""
    far = color.distance(c, reference)
    pale = (color.brightness(c) > LIKE_BRIGHTNESS) & (color.chroma(c) < LIKE_CHROMA) & (far < LIKE_LIGHT)
    return ~opaque(alpha) | F.when(color.brightness(reference) > LIGHT_REFERENCE, pale).otherwise(far < LIKE_OTHER)


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("grid_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))


def _in_corners(pixels: DataFrame) -> DataFrame:
    """pixels with `corner`: a row for each corner's window that a pixel lies in."""
    sized = pixels.join(sizes(pixels), "grid_id")
    window = F.greatest(F.lit(CORNER_LEAST), color.half_up(F.least("h", "w") * F.lit(CORNER_SHARE)))
    down = (F.col("row") < window, F.col("row") >= F.col("h") - window)
    across = (F.col("col") < window, F.col("col") >= F.col("w") - window)
    at = F.filter(F.array(*[F.when(down[i] & across[j], F.lit(2 * i + j)) for i in (0, 1) for j in (0, 1)]), lambda x: x.isNotNull())
    return sized.withColumn("corner", F.explode(at)).drop("h", "w")


def corners(pixels: DataFrame) -> DataFrame:
    """The mean colour of the opaque pixels in each corner's window: (grid_id, corner, r, g, b)."""
    return _in_corners(pixels).filter(opaque(F.col("a"))).groupBy("grid_id", "corner").agg(*[F.avg(c).alias(c) for c in "rgb"])


def _best_group(found: DataFrame, radius: float) -> DataFrame:
    """Of each grid's corners (at most four), the largest group around one of them, of equal groups the first corner's: its size, mean, and how far from that a member is at most."""
    o = found.select("grid_id", F.struct(*[F.col(c).alias(c) for c in "rgb"]).alias("o"))
    near = found.join(o, "grid_id").filter(color.distance(color.rgb(), (F.col("o.r"), F.col("o.g"), F.col("o.b"))) <= radius)
    groups = near.groupBy("grid_id", "corner").agg(F.count("*").alias("n"), F.collect_list("o").alias("members"), *[F.avg(f"o.{c}").alias(c) for c in "rgb"])
    best = groups.groupBy("grid_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "corner", "r", "g", "b", "members")).alias("m"))
    far = lambda x: color.distance((x["r"], x["g"], x["b"]), (F.col("m.r"), F.col("m.g"), F.col("m.b")))
    return best.select("grid_id", (-F.col("m.n")).alias("n"), *[F.col(f"m.{c}").alias(c) for c in "rgb"], F.array_max(F.transform("m.members", far)).alias("spread"))


def reference(pixels: DataFrame) -> DataFrame:
    """(grid_id, n, r, g, b, spread): the background's colour, from at least three light corners that agree, else from the corners that agree best; how many these are, and how far apart."""
    found = corners(pixels)
    light = _best_group(found.filter((color.brightness(color.rgb()) >= CORNER_BRIGHTNESS) & (color.chroma(color.rgb()) <= CORNER_CHROMA)), LIGHT_RADIUS).filter("n >= 3")
    every = _best_group(found, ALL_RADIUS)
    names = ("n", "r", "g", "b", "spread")
    both = every.join(light.select("grid_id", F.struct(*names).alias("l")), "grid_id", "left")
    return both.select("grid_id", *[F.when(F.col("l").isNotNull(), F.col(f"l.{c}")).otherwise(F.col(c)).alias(c) for c in names])


def marked(pixels: DataFrame, ref: DataFrame) -> DataFrame:
    """pixels with `like`: whether each is like its grid's reference."""
    r = ref.select("grid_id", *[F.col(c).alias(f"ref_{c}") for c in "rgb"])
    return pixels.join(r, "grid_id").withColumn("like", background_like(color.rgb(), F.col("a"), color.rgb("ref_")))


def edge_ratio(pixels: DataFrame, ref: DataFrame) -> DataFrame:
    """The share of border pixels that are like the reference."""
    sized = marked(pixels, ref).join(sizes(pixels), "grid_id")
    border = sized.filter((F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == F.col("h") - 1) | (F.col("col") == F.col("w") - 1))
    return border.groupBy("grid_id").agg(F.count("*").alias("border"), F.avg(F.col("like").cast("int")).alias("edge"))


def corner_ratio(pixels: DataFrame, ref: DataFrame) -> DataFrame:
    """The share of the pixels in the corners' windows that are like the reference; a pixel in two windows counts twice."""
    return marked(_in_corners(pixels), ref).groupBy("grid_id").agg(F.avg(F.col("like").cast("int")).alias("corner_match"))


def regions(cells: DataFrame, key: str) -> DataFrame:
    """cells (grid_id, row, col, key) with `region`: one number for each 4-connected region of equal keys, null being a key.

    Regions are found within squares of cells, side by side; only cells on both sides of the squares' borders are linked, and these
    links are joined into components. The number is a hash of the first cell of one of the region's parts. Cells without a place have
    no row. Grid ids may be of any type.
    """

    def label(table: pa.Table, corner: tuple[int, int] | None) -> pa.Table:
        if corner is None:
            first = np.zeros(0, np.int64)
            table = table.slice(0, 0)
        else:
            row, col = squares.places(table)
            first = squares.connected(row, col, squares.ordinals(table.column(key))[0] + 1)
        for name, c in (("_row", "row"), ("_col", "col")):
            table = table.append_column(name, table.column(c).take(pa.array(first)).cast(pa.int64()))
        return table

    fields = [*cells.schema.fields, StructField("_row", LongType()), StructField("_col", LongType())]
    parts = squares.over_squares(cells, label, fields).withColumn("node", F.xxhash64("grid_id", "_row", "_col")).drop("_row", "_col")
    parts = materialise(parts, "parts")
    side = lambda c, k, name, by: parts.filter(F.pmod(F.col(c), F.lit(squares.SQUARE)) == k).select("grid_id", *[(F.col(x) + (by if x == c else 0)).alias(x) for x in ("row", "col")], F.col(key).alias(f"{name}_key"), F.col("node").alias(name))
    links = [side(c, squares.SQUARE - 1, "a", 1).join(side(c, 0, "b", 0).hint("merge"), CELL).filter(F.col("a_key").eqNullSafe(F.col("b_key"))).select("a", "b") for c in ("row", "col")]
    roots = components(links[0].union(links[1]))
    return parts.join(roots, "node", "left").select(*CELL, F.coalesce("root", "node").alias("region"), *[c for c in cells.columns if c not in CELL])


def flood_from_border(pixels: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Cells (grid_id, row, col) of like pixels (column `like`) that are 4-connected to the border, none of them protected."""
    open_ = pixels.filter("like").select(*CELL, F.lit(1).alias("like"))
    if protected is not None:
        open_ = open_.join(protected.hint("merge"), CELL, "left_anti")
    found = regions(open_, "like").select(*CELL, "region")
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == F.col("h") - 1) | (F.col("col") == F.col("w") - 1)
    touched = found.join(sizes(pixels), "grid_id").filter(edge).select("grid_id", "region").distinct()
    return found.join(touched, ["grid_id", "region"], "left_semi").select(*CELL)


def protection(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Cells near opaque pixels that are not like the background (pixels with `like`)."""
    radius = int(max(2, min(8, 0.035 * min(height, width))) + 0.5)
    return dilate(pixels.filter(opaque(F.col("a")) & ~F.col("like")), radius, height, width)


def removal(pixels: DataFrame, ref: DataFrame, masked: DataFrame, raw: DataFrame) -> DataFrame:
    """Whether each grid's background is plain enough to be removed: light or softly plain, corners and border in agreement, and neither too little nor too much of it."""
    total = pixels.groupBy("grid_id").agg(F.count("*").alias("n_all"))
    share = lambda m, name: m.groupBy("grid_id").agg(F.count("*").alias(name))
    t = total.join(ref, "grid_id", "left").join(edge_ratio(pixels, ref), "grid_id", "left").join(corner_ratio(pixels, ref), "grid_id", "left")
    t = t.join(share(masked, "n_masked"), "grid_id", "left").join(share(raw, "n_raw"), "grid_id", "left").withColumns({"masked": F.coalesce("n_masked", F.lit(0)) / F.col("n_all"), "raw": F.coalesce("n_raw", F.lit(0)) / F.col("n_all")})
    bright, chroma = color.brightness(color.rgb()), color.chroma(color.rgb())
    neutral = (bright >= NEUTRAL_BRIGHTNESS) & (chroma <= NEUTRAL_CHROMA)
    soft = (bright >= SOFT_BRIGHTNESS) & (chroma <= SOFT_CHROMA) & (F.col("n") >= SOFT_CORNERS) & (F.col("spread") <= SOFT_SPREAD) & (F.col("edge") >= SOFT_EDGE) & (F.col("raw") <= SOFT_RAW)
    ok = (neutral | soft) & (F.col("n") >= LEAST_CORNERS) & (F.col("spread") <= MOST_SPREAD) & (F.col("edge") >= LEAST_EDGE) & (F.col("corner_match") >= LEAST_CORNER_MATCH) & F.col("raw").between(*RAW_SHARE) & (F.col("masked") >= LEAST_MASK)
    none = F.lit(0.0)
    return t.select("grid_id", F.coalesce("edge", none).alias("edge"), F.coalesce("corner_match", none).alias("corner_match"), "raw", "masked", F.coalesce(ok, F.lit(False)).alias("remove"))


def background_mask(pixels: DataFrame, mode: str, height: int, width: int) -> DataFrame:
    """pixels with `masked` and their grid's `decision`: mode is keep, remove, or auto, which removes a background that is plain enough."""
    if mode == "keep":
        return pixels.withColumns({"masked": F.lit(False), "decision": F.lit("kept")})
    ref = materialise(reference(pixels), "references")
    liked = materialise(marked(pixels, ref), "liked")
    mask = materialise(flood_from_border(liked, protection(liked, height, width)), "mask")
    if mode == "remove":
        decided = mask.select("grid_id").distinct().withColumns({"use": F.lit(True), "decision": F.lit("force-removed")})
        other = "kept"
    else:
        decided = removal(pixels, ref, mask, materialise(flood_from_border(liked), "raw-mask")).filter("remove").select("grid_id", F.lit(True).alias("use"), F.lit("auto-removed").alias("decision"))
        other = "auto-kept"
    return pixels.join(mask.withColumn("in_mask", F.lit(True)).hint("merge"), CELL, "left").join(decided, "grid_id", "left").withColumns({"masked": F.coalesce(F.col("in_mask") & F.col("use"), F.lit(False)), "decision": F.coalesce("decision", F.lit(other))}).drop("in_mask", "use")


def denoise(pixels: DataFrame, target: tuple[int, int, int], threshold: float) -> DataFrame:
    """pixels (with `masked`, if there is a mask), those that are opaque, not masked and within the threshold of the target colour being that colour."""
    there = opaque(F.col("a")) & (~F.col("masked") if "masked" in pixels.columns else F.lit(True))
    near = there & (color.distance(color.rgb(), tuple(F.lit(x) for x in target)) <= threshold)
    return pixels.withColumns({c: F.when(near, F.lit(x).cast(pixels.schema[c].dataType)).otherwise(F.col(c)) for c, x in zip("rgb", target, strict=True)})


#: Least sizes of regions up to which a square with the cells around it tells all about the smaller ones.
NEAR = 64


def absorb_small(grid: DataFrame, least: int) -> DataFrame:
    """grid (grid_id, row, col, code) with regions of under `least` cells in the code that borders them most, of equally common ones the smallest; a region without neighbours stays.

    A region of under `least` cells lies, with its neighbours, within that distance of each of its cells, and of a larger one as many
    cells do: so each square decides about its own cells. Large bounds (over NEAR) go by the regions of the whole grid.
    """
    if least > NEAR:
        return _absorb_by_regions(grid, least)

    def absorb(table: pa.Table, corner: tuple[int, int] | None) -> pa.Table:
        if corner is None:
            return table
        row, col = squares.places(table)
        own = squares.inside(row, col, corner, squares.SQUARE)
        code, values = squares.ordinals(table.column("code"))
        full = np.flatnonzero(code >= 0)
        if len(full):
            _, region, n = np.unique(squares.connected(row[full], col[full], code[full]), return_inverse=True, return_counts=True)
            dense, at = squares.board(row[full], col[full], code[full], 1)
            small = n[region] < least
            steps = np.array([dr * dense.shape[1] + dc for dr, dc in CROSS])
            other = dense.ravel()[at[small, None] + steps]
            voting = (other >= 0) & (other != code[full][small, None])
            winner = squares.commonest(np.repeat(region[small], len(steps))[voting.ravel()], other[voting], len(n), len(values))[0]
            code[full] = np.where(small & (winner[region] >= 0), winner[region], code[full])
        return squares.replaced(table, "code", squares.valued(values, code)).filter(pa.array(own))

    cells = grid.select(*CELL, "code")
    return squares.over_squares(cells, absorb, cells.schema.fields, max(0, least))


def _absorb_by_regions(grid: DataFrame, least: int) -> DataFrame:
    found = materialise(regions(grid.filter(F.col("code").isNotNull()), "code"), "regions")
    size = found.groupBy("grid_id", "region").agg(F.count("*").alias("n")).filter(F.col("n") < least)
    small = found.join(size.select("grid_id", "region"), ["grid_id", "region"])
    around = neighbours(grid.filter(F.col("code").isNotNull()), CROSS).withColumnRenamed("code", "other")
    votes = small.join(around, CELL).filter(F.col("other") != F.col("code")).groupBy("grid_id", "region", "other").agg(F.count("*").alias("n"))
    best = votes.groupBy("grid_id", "region").agg(F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("m")).select("grid_id", "region", F.col("m.other").alias("winner"))
    changed = small.join(best, ["grid_id", "region"]).select(*CELL, "winner")
    return grid.join(changed, CELL, "left").select(*CELL, F.coalesce("winner", "code").alias("code"))


def fill(grid: DataFrame, row: int, col: int, code: str | None) -> DataFrame:
    """grid with the region of one cell in another code; an empty region can be filled too."""
    found = regions(grid.select(*CELL, "code"), "code")
    seed = found.filter((F.col("row") == row) & (F.col("col") == col)).select("grid_id", F.col("region").alias("seed"))
    return found.join(seed, "grid_id", "left").select(*CELL, F.when(F.col("region") == F.col("seed"), F.lit(code)).otherwise(F.col("code")).alias("code"))


def select_region(grid: DataFrame, row: int, col: int) -> DataFrame:
    """The cells of the region of one cell."""
    found = regions(grid.select(*CELL, "code"), "code")
    seed = found.filter((F.col("row") == row) & (F.col("col") == col)).select("grid_id", F.col("region").alias("seed"))
    return found.join(seed, "grid_id").filter(F.col("region") == F.col("seed")).select(*CELL)
