"""Operators on grids: tables (grid_id, row, col, code), where a null code is an empty cell.

All are partitioned by grid_id and cell; none gathers a grid in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import color
from tesserae.operators import colour_tree, squares
from tesserae.operators.pieces import ranked
from tesserae.session import materialise

CELL = ["grid_id", "row", "col"]
#: The tile sides to choose from, and what a tile larger than the grid costs.
TILE_SIDES = (52, 78, 104)
OVERSIZE = 0.12


#: Colours of a palette that are sent to the tasks, at most; a larger one is refused.
MOST_COLOURS = 1 << 16


def nearest_palette(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """pixels with the code of the nearest palette colour; of equally near ones the smallest idx, then code.

    Distinct colours look for it in a tree of the palette (r, g, b, idx, code), of up to MOST_COLOURS colours, which each task has
    in memory. Pixels with a null channel, and all if the palette is empty, have no row.
    """
    first = palette.select("idx", "code", *[F.col(c).cast("double").alias(c) for c in "rgb"]).orderBy("idx", "code").limit(MOST_COLOURS + 1).collect()
    if len(first) > MOST_COLOURS:
        raise ValueError(f"the palette has more than {MOST_COLOURS} colours")
    spark = pixels.sparkSession
    colours = pixels.select("r", "g", "b").filter("r is not null and g is not null and b is not null").distinct()
    tree = spark.sparkContext.broadcast(colour_tree.build([(x.r, x.g, x.b) for x in first]))
    kinds = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in "rgb")
    found = colours.mapInArrow(lambda b: colour_tree.match(b, tree.value), f"{kinds}, place int")
    named = spark.createDataFrame([(i, x.code, x.idx) for i, x in enumerate(first)], f"place int, code string, idx {palette.schema['idx'].dataType.simpleString()}")
    return pixels.join(found.join(named, "place").select("r", "g", "b", "code", "idx"), ["r", "g", "b"])


#: How pixels become codes.
MODES = ("dominant", "average", "smooth", "palette", "dither")


def rasterise(pixels: DataFrame, palette: DataFrame, mode: str = "dominant", threshold: int = 40, background: DataFrame | None = None) -> DataFrame:
    """(grid_id, row, col, code) of pixels (grid_id, row, col, r, g, b, a): their nearest colour, after their channels are put on the mode's steps.

    average keeps channels as they are, smooth has wider steps than dominant and palette, and dither spreads what is lost to
    neighbours. Transparent cells, and those of `background` (grid_id, row, col), have no code and spread nothing.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    cells = pixels.select(*CELL, "r", "g", "b", "a")
    if background is not None:
        behind = cells.join(background.select(*CELL).distinct().withColumn("behind", F.lit(True)), CELL, "left")
        cells = behind.withColumn("a", F.when(F.col("behind"), F.lit(0)).otherwise(F.col("a"))).drop("behind")
    if mode == "dither":
        from tesserae.operators import imaging

        rows = palette.select("idx", "code", "r", "g", "b").orderBy("idx", "code").limit(MOST_COLOURS).collect()
        return imaging.dither(cells, [(x.code, x.r, x.g, x.b) for x in rows], threshold)
    steps = cells.filter("a >= 24").select(*CELL, *[color.snap(F.col(c), threshold, mode).alias(c) for c in "rgb"])
    empty = cells.filter("a < 24 or a is null").select(*CELL, F.lit(None).cast("string").alias("code"))
    return nearest_palette(steps, palette).select(*CELL, "code").unionByName(empty)


def code_counts(grid: DataFrame, by: Sequence[str] = ("grid_id",)) -> DataFrame:
    """Cells of each code; order by (count desc, code) to list them."""
    return grid.filter(F.col("code").isNotNull()).groupBy(*by, "code").agg(F.count("*").alias("count"))


def ranked_counts(grid: DataFrame) -> DataFrame:
    order = Window.partitionBy("grid_id").orderBy(F.desc("count"), "code")
    return code_counts(grid).withColumn("rank", F.row_number().over(order))


def bounds(grid: DataFrame) -> DataFrame:
    """The box of the cells that are not empty, and its size."""
    box = grid.filter(F.col("code").isNotNull()).groupBy("grid_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("min", F.min), ("max", F.max))])
    return box.withColumns({"height": F.col("max_row") - F.col("min_row") + 1, "width": F.col("max_col") - F.col("min_col") + 1})


def trim(grid: DataFrame) -> DataFrame:
    """The cells inside the box, moved to its corner."""
    box = bounds(grid).select("grid_id", "min_row", "max_row", "min_col", "max_col")
    inside = grid.join(box, "grid_id").filter(F.col("row").between(F.col("min_row"), F.col("max_row")) & F.col("col").between(F.col("min_col"), F.col("max_col")))
    return inside.select("grid_id", (F.col("row") - F.col("min_row")).alias("row"), (F.col("col") - F.col("min_col")).alias("col"), "code")


def tiles(grid: DataFrame, width: int, height: int) -> DataFrame:
    """Each cell's tile, numbered row by row, and its place in it."""
    across = F.ceil((F.max("col").over(Window.partitionBy("grid_id")) + 1) / F.lit(float(width))).cast("int")
    cut = grid.withColumns({"tile_row": F.floor(F.col("row") / height).cast("int"), "tile_col": F.floor(F.col("col") / width).cast("int"), "across": across})
    return cut.select("grid_id", (F.col("tile_row") * F.col("across") + F.col("tile_col")).alias("tile"), "tile_row", "tile_col", (F.col("row") % height).alias("row"), (F.col("col") % width).alias("col"), "code")


def tile_choice(grid: DataFrame, sides: Sequence[int] = TILE_SIDES) -> DataFrame:
    """The side of square tiles that needs few tiles and leaves little unused; of equal scores the smaller side."""
    size = grid.groupBy("grid_id").agg((F.max("col") + 1).alias("w"), (F.max("row") + 1).alias("h"))
    cand = size.withColumn("side", F.explode(F.array(*map(F.lit, sides))))
    n = F.ceil(F.col("w") / F.col("side").cast("double")) * F.ceil(F.col("h") / F.col("side").cast("double"))
    room = (n * F.col("side") * F.col("side")).cast("double")
    score = n.cast("double") + (room - F.col("w") * F.col("h")) / room + F.when(F.col("side") > F.greatest("w", "h"), OVERSIZE).otherwise(0.0)
    scored = cand.select("grid_id", F.struct(score.alias("score"), F.col("side")).alias("s"))
    return scored.groupBy("grid_id").agg(F.min("s").alias("s")).select("grid_id", F.col("s.side").alias("side"), F.col("s.score").alias("score"))


def neighbours(grid: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    """(grid_id, row, col, code) of the cells next to each cell that has any, once for each offset; row and col are the cell's."""
    steps = F.array(*[F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc")) for dr, dc in offsets])
    return grid.select("grid_id", "row", "col", "code", F.explode(steps).alias("o")).select("grid_id", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), "code")


BOX = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
CROSS = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def majority_filter(grid: DataFrame, least: int = 4, ahead: int = 1) -> DataFrame:
    """A cell takes its 3x3 neighbourhood's commonest code if that has `least` votes, and over `ahead` more than its own."""

    def vote(table: pa.Table, corner: tuple[int, int] | None) -> pa.Table:
        if corner is None:
            return table.filter(pc.is_null(table.column("code")))
        row, col = squares.places(table)
        own = squares.inside(row, col, corner, squares.SQUARE)
        code, values = squares.ordinals(table.column("code"))
        full = code >= 0
        if full.any():
            dense, at = squares.board(row[full], col[full], code[full], 1)
            steps = np.array([dr * dense.shape[1] + dc for dr, dc in BOX])
            top, votes, pairs, n = squares.commonest((at[:, None] + steps).ravel(), np.repeat(code[full], len(steps)), dense.size, len(values))
            mine = n[np.searchsorted(pairs, at * len(values) + code[full])]
            code[full] = np.where((votes[at] >= least) & (votes[at] > mine + ahead), top[at], code[full])
        return squares.replaced(table, "code", squares.valued(values, code)).filter(pa.array(own))

    cells = grid.select(*CELL, "code")
    return squares.over_squares(cells, vote, cells.schema.fields, 1)


def dilate(cells: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Cells within the radius of any of the cells (grid_id, row, col), inside the grid."""
    disc = [(dr, dc) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1) if dr * dr + dc * dc <= radius * radius]

    def spread(table: pa.Table, corner: tuple[int, int] | None) -> pa.Table:
        if corner is None:
            return table.slice(0, 0)
        row, col = squares.places(table)
        dense, at = squares.board(row, col, np.zeros(len(row), np.int64), radius)
        hit = np.zeros(dense.size, bool)
        at = np.unique(at)
        for dr, dc in disc:
            hit[at + dr * dense.shape[1] + dc] = True
        down, across = np.divmod(np.flatnonzero(hit), dense.shape[1])
        down, across = down + row.min() - radius, across + col.min() - radius
        kept = squares.inside(down, across, corner, squares.SQUARE) & (down >= 0) & (down < height) & (across >= 0) & (across < width)
        first = table.column("grid_id").take(pa.array(np.zeros(int(kept.sum()), np.int64)))
        return pa.table([first, *[pa.array(x[kept]).cast(table.schema.field(c).type) for c, x in (("row", down), ("col", across))]], schema=table.schema)

    near = cells.select(*CELL)
    return squares.over_squares(near, spread, near.schema.fields, radius)


def in_polygon(grid: DataFrame, polygon: Sequence[tuple[float, float]]) -> DataFrame:
    """Cells whose centres lie in the polygon of (x, y) corners: a ray to the right crosses its edges an odd number of times."""
    x, y = F.col("col") + F.lit(0.5), F.col("row") + F.lit(0.5)
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if y1 != y2:
            over = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossed = crossed + F.when(over & (x < (F.lit(x2) - F.lit(x1)) * (y - F.lit(y1)) / (F.lit(y2) - F.lit(y1)) + F.lit(x1)), 1).otherwise(0)
    return grid.filter(crossed % 2 == 1)


def overlay(grid: DataFrame, top: DataFrame, row: int = 0, col: int = 0) -> DataFrame:
    """grid with the cells of top (grid_id, row, col, code), moved by (row, col), over it; empty ones show what is below."""
    moved = top.select("grid_id", (F.col("row") + row).alias("row"), (F.col("col") + col).alias("col"), F.col("code").alias("over"))
    return grid.join(moved, CELL, "left").select(*CELL, F.coalesce("over", "code").alias("code"))


def same_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells in which two grids differ, empty being a value of its own; no rows if they are equal."""
    left, right = a.select(*CELL, F.col("code").alias("a"), F.lit(True).alias("in_a")), b.select(*CELL, F.col("code").alias("b"), F.lit(True).alias("in_b"))
    both = left.join(right, CELL, "full")
    return both.filter(F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("a").eqNullSafe(F.col("b"))).select(*CELL, "a", "b")


def transform(grid: DataFrame, how: str) -> DataFrame:
    """mirror (left to right), flip (top to bottom), rotate_right, rotate_left or half_turn."""
    w = Window.partitionBy("grid_id")
    sized = grid.withColumns({"h": F.max("row").over(w), "w": F.max("col").over(w)})
    r, c, h, wd = F.col("row"), F.col("col"), F.col("h"), F.col("w")
    row, col = {"mirror": (r, wd - c), "flip": (h - r, c), "rotate_right": (c, h - r), "rotate_left": (wd - c, r), "half_turn": (h - r, wd - c)}[how]
    return sized.select("grid_id", row.alias("row"), col.alias("col"), "code")


def scale(grid: DataFrame, factor: float) -> DataFrame:
    """Nearest cells at twice or half the size."""
    if factor == 2:
        steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
        return grid.select("*", F.explode(steps).alias("o")).select("grid_id", (F.col("row") * 2 + F.col("o.i")).alias("row"), (F.col("col") * 2 + F.col("o.j")).alias("col"), "code")
    return grid.filter((F.col("row") % 2 == 0) & (F.col("col") % 2 == 0)).select("grid_id", (F.col("row") / 2).cast("int").alias("row"), (F.col("col") / 2).cast("int").alias("col"), "code")


def replace_code(grid: DataFrame, old: str, new: str | None) -> DataFrame:
    return grid.withColumn("code", F.when(F.col("code") == old, F.lit(new)).otherwise(F.col("code")))


def cut_rectangle(grid: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """Each cell with a mark whether it is in the rectangle, and the code it has once the rectangle is cut out."""
    inside = F.col("row").between(top, bottom) & F.col("col").between(left, right)
    return grid.select(*CELL, "code", inside.alias("copied"), F.when(~inside, F.col("code")).alias("rest"))


def paint(grid: DataFrame, cells: DataFrame, code: str) -> DataFrame:
    """grid with the selected cells (grid_id, row, col) in one code."""
    marked = grid.join(cells.select(*CELL, F.lit(True).alias("hit")).distinct(), CELL, "left")
    return marked.select(*CELL, F.when(F.col("hit"), F.lit(code)).otherwise(F.col("code")).alias("code"))


def symmetric(cells: DataFrame, height: int, width: int, horizontal: bool = True, vertical: bool = True) -> DataFrame:
    """The cells and their mirror images, each once."""
    images = [("row", "col")] + [("row", "mc")] * horizontal + [("mr", "col")] * vertical + [("mr", "mc")] * (horizontal and vertical)
    wide = cells.withColumns({"mr": F.lit(height - 1) - F.col("row"), "mc": F.lit(width - 1) - F.col("col")})
    every = F.array_distinct(F.array(*[F.struct(F.col(r).alias("row"), F.col(c).alias("col")) for r, c in images]))
    return wide.select("grid_id", F.explode(every).alias("i")).select("grid_id", "i.row", "i.col").distinct()


def runs(cells: DataFrame, key: str, along: str, across: str) -> DataFrame:
    """Maximal runs of equal, neighbouring values of `key` along one axis: (grid_id, across, start, length, key)."""
    order = Window.partitionBy("grid_id", across).orderBy(along)
    new = F.lag(key).over(order).eqNullSafe(F.col(key)) & (F.lag(along).over(order) == F.col(along) - 1)
    marked = cells.withColumn("new", F.when(F.coalesce(new, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    return marked.groupBy("grid_id", across, "run").agg(F.min(along).alias("start"), F.count("*").alias("length"), F.first(key).alias(key)).drop("run")


def cell_size(lengths: DataFrame, most: int, least_runs: int = 18, least_score: float = 80.0) -> DataFrame:
    """The side of logical pixels that most runs (grid_id, length) are multiples of, with its score.

    Lengths are counted first, so the vote is over at most `most` lengths and sizes for each grid.
    """
    counted = lengths.filter(F.col("length").between(3, 96)).groupBy("grid_id", "length").agg(F.count("*").alias("n"))
    cand = counted.withColumn("size", F.explode(F.sequence(F.lit(3), F.lit(min(96, most)))))
    times = F.greatest(F.lit(1), F.floor(F.col("length") / F.col("size").cast("double") + 0.5))
    fits = F.abs(F.col("length") - times * F.col("size")) <= F.greatest(F.lit(1.0), F.col("size") * F.lit(0.08))
    score = F.sum(F.when(fits, F.col("n") * F.least(F.lit(3), times) * F.sqrt(F.col("size").cast("double"))).otherwise(0.0))
    scored = cand.groupBy("grid_id", "size").agg(score.alias("score"))
    best = scored.groupBy("grid_id").agg(F.max(F.struct(F.round("score", 6).alias("score"), F.col("size"))).alias("m"))
    total = counted.groupBy("grid_id").agg(F.sum("n").alias("runs"))
    return best.join(total, "grid_id").filter((F.col("runs") >= least_runs) & (F.col("m.score") >= least_score)).select("grid_id", F.col("m.size").alias("size"), F.col("m.score").alias("score"), "runs")


def progress(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Cells that are not empty, those of them that are done, and the percentage, halves up."""
    marked = grid.filter(F.col("code").isNotNull()).join(done.select(*CELL, F.lit(1).alias("hit")).distinct(), CELL, "left")
    return marked.groupBy("grid_id").agg(F.count("*").alias("total"), F.count("hit").alias("done")).withColumn("percent", color.half_up(F.col("done") * F.lit(100.0) / F.col("total")).cast("int"))


def next_open(grid: DataFrame, done: DataFrame, row: int, col: int) -> DataFrame:
    """The first cell after (row, col), row by row and around, that is neither empty nor done."""
    w = Window.partitionBy("grid_id")
    sized = grid.withColumns({"w": F.max("col").over(w) + 1, "h": F.max("row").over(w) + 1})
    open_ = sized.filter(F.col("code").isNotNull()).join(done.select(*CELL), CELL, "left_anti")
    n = F.col("w") * F.col("h")
    ahead = F.pmod(F.col("row") * F.col("w") + F.col("col") - (F.lit(row) * F.col("w") + F.lit(col)) - 1 + n, n)
    return open_.groupBy("grid_id").agg(F.min_by(F.struct("row", "col"), ahead).alias("c")).select("grid_id", "c.row", "c.col")


#: Steps of cells and of colours that raise a pattern's score by 1; a dominant colour's share in more cells than; a small largest share in more colours than; a full board of more cells than; a long side; and what each of these four raises it by.
CELL_STEPS, COLOUR_STEPS = (2200, 5200, 10000, 18000), (18, 36, 60)
DOMINANT, MIXED, FULL, LONG = (0.42, 1500, 0.7), (0.16, 24, 0.7), (0.82, 4000, 0.5), (130, 0.7)
#: Labels up to each score; cells an hour, less by so many for a point, at least.
DIFFICULTIES, LAST_DIFFICULTY = ((1.5, "入门"), (3, "标准"), (4.6, "进阶"), (6.2, "困难")), "大师"
PACE, SLOWER, LEAST_PACE = 900, 78, 360


def difficulty(grid: DataFrame) -> DataFrame:
    """(grid_id, cells, colours, score, label, time): how hard a pattern is, and about how long it takes."""
    per = code_counts(grid).groupBy("grid_id").agg(F.sum("count").alias("cells"), F.count("*").alias("colours"), F.max("count").alias("most"))
    size = grid.groupBy("grid_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    t = size.join(per, "grid_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("cells", "colours", "most")})
    cells, colours = F.col("cells"), F.col("colours")
    share = F.when(cells > 0, F.col("most") / cells).otherwise(0.0)
    add = lambda met, by: F.when(met, F.lit(float(by))).otherwise(0.0)
    score = sum((add(cells > n, 1) for n in CELL_STEPS), start=F.lit(0.0)) + sum((add(colours > n, 1) for n in COLOUR_STEPS), start=F.lit(0.0))
    score = score + add((share > DOMINANT[0]) & (cells > DOMINANT[1]), DOMINANT[2]) + add((share < MIXED[0]) & (colours > MIXED[1]), MIXED[2])
    score = score + add((cells / (F.col("h") * F.col("w")) > FULL[0]) & (cells > FULL[1]), FULL[2]) + add(F.greatest("h", "w") > LONG[0], LONG[1])
    label = F
    for bound, name in DIFFICULTIES:
        label = label.when(F.col("score") < bound, name)
    t = t.withColumn("score", score).withColumn("label", label.otherwise(LAST_DIFFICULTY))
    hours = cells / F.greatest(F.lit(float(LEAST_PACE)), PACE - F.col("score") * SLOWER)
    whole = lambda x: F.ceil(x).cast("string")
    time = F.when(cells == 0, "-").when(hours < 1, "<1h").when(hours < 3, F.concat(whole(hours), F.lit("h"))).when(hours < 8, F.concat(whole(hours), F.lit("h+"))).otherwise(F.concat((F.ceil(hours / 2) * 2).cast("string"), F.lit("h+")))
    return t.select("grid_id", "cells", "colours", "score", "label", time.alias("time"))


#: Fixed value: the colour of a code that no palette has.
UNKNOWN_COLOUR = (153, 153, 153)


def look_up_colours(cells: DataFrame, palettes: DataFrame) -> DataFrame:
    """cells (code, ...) with the r, g, b of their codes: from the first palette (priority, idx, code, r, g, b) that has the code, of its colours the first; grey where none has."""
    from tesserae.functions.text import code

    first = palettes.groupBy(code(F.col("code")).alias("_code")).agg(F.min_by(F.struct("r", "g", "b"), F.struct("priority", "idx")).alias("_c"))
    found = cells.withColumn("_code", code(F.coalesce("code", F.lit("")))).join(first, "_code", "left")
    rgb = [F.when(F.col("code").isNotNull(), F.coalesce(F.col(f"_c.{c}"), F.lit(x))).alias(c) for c, x in zip("rgb", UNKNOWN_COLOUR, strict=True)]
    return found.select(*cells.columns, *rgb)


def toggled(log: DataFrame) -> DataFrame:
    """Cells that an odd number of toggles leaves on."""
    return log.groupBy(*CELL).agg(F.count("*").alias("n")).filter(F.col("n") % 2 == 1).select(*CELL)


def palette_groups(palette: DataFrame) -> DataFrame:
    """(letters, first, n, idx, code): each colour with its group, the codes of equal leading letters; groups are in the order of their first colour."""
    lettered = palette.select(F.regexp_extract("code", "^[A-Za-z]+", 0).alias("letters"), "idx", "code")
    groups = lettered.groupBy("letters").agg(F.min("idx").alias("first"), F.count("*").alias("n"))
    return lettered.join(groups, "letters").select("letters", "first", "n", "idx", "code")


def brand_codes(palette: DataFrame, mapping: DataFrame, prefix: str) -> DataFrame:
    """Each colour's code under a brand: mapped, or else the prefix and its place; mapping is (source, target)."""
    found = palette.join(mapping.withColumnRenamed("source", "code"), "code", "left")
    return found.select("idx", "code", F.coalesce("target", F.concat(F.lit(prefix), F.lpad((F.col("idx") + 1).cast("string"), 3, "0")), "code").alias("brand_code"))


def mode_cell(column: str) -> Column:
    """The commonest value of a group, the smallest of equally common ones, as an aggregate."""
    return F.mode(column, deterministic=True)


def median_cells(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """One colour for each cell of height x width pixels: of its 9 samples, spread evenly, the opaque ones' upper median by brightness; cells without one, and near-white ones, are empty."""
    row, col = F.floor(F.col("row") / height).cast("int"), F.floor(F.col("col") / width).cast("int")
    spots = lambda size: sorted({int(size * f) for f in (0.25, 0.5, 0.75)})
    samples = pixels.filter((F.col("row") % height).isin(*spots(height)) & (F.col("col") % width).isin(*spots(width)) & (F.col("a") >= 24))
    bright = F.col("r") + F.col("g") + F.col("b")
    lists = samples.groupBy("grid_id", row.alias("row"), col.alias("col")).agg(F.array_sort(F.collect_list(F.struct(bright.alias("k"), "r", "g", "b"))).alias("l"))  # nine at most
    middle = lists.withColumn("m", F.get("l", F.floor(F.size("l") / 2).cast("int")))
    white = (F.col("m.r") >= 248) & (F.col("m.g") >= 248) & (F.col("m.b") >= 248)
    return middle.filter(~white).select(*CELL, "m.r", "m.g", "m.b")


def repeated_rows(raster: DataFrame) -> DataFrame:
    """Rows of packed bytes (grid_id, y, bytes) as runs of equal ones: (grid_id, y, times, bytes)."""
    order = Window.partitionBy("grid_id").orderBy("y")
    new = F.when(F.lag("bytes").over(order).eqNullSafe(F.col("bytes")), 0).otherwise(1)
    marked = raster.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return marked.groupBy("grid_id", "run").agg(F.min("y").alias("y"), F.count("*").alias("times"), F.first("bytes").alias("bytes")).drop("run")


def logical_width(width: int, height: int, size: int) -> int | None:
    """How many logical pixels of this size a picture is wide, if both sides are near enough to a whole number of them."""
    error = max(abs(side / size - round(side / size)) for side in (width, height))
    return round(width / size) if error <= 0.18 else None


def remap(rows: DataFrame, links: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """rows with new ids 1, 2, ... in an order, and the links to them with the ids replaced; links to missing rows go.

    Ids are ranks over pieces of the ordered rows, so no task sees all of them. Keys of rows are unique.
    """
    new = ranked(rows.select(F.col(key).alias("old"), F.col(order).alias("at")), [], ["at"])
    new = materialise(new.select("old", F.col("rank").alias("new")), "new-ids")

    def swap(df: DataFrame) -> DataFrame:
        both = df.select(F.struct("*").alias("row"), F.col(key).alias("old")).join(new, "old")
        return both.select(*[(F.col("new") if c == key else F.col(f"row.`{c}`")).alias(c) for c in df.columns])

    return swap(rows), swap(links)


def walk_index(grid: DataFrame, block: int) -> DataFrame:
    """The non-empty cells' places in a walk row by row, colour by colour, and block by block."""
    w = Window.partitionBy("grid_id")
    cells = grid.filter(F.col("code").isNotNull())
    by = {"by_row": ["row", "col"], "by_colour": ["code", "row", "col"], "by_block": [F.floor(F.col("row") / block), F.floor(F.col("col") / block), "row", "col"]}
    return cells.withColumns({n: F.row_number().over(w.orderBy(*o)) for n, o in by.items()})
