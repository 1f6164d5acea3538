"""Grids as text, project files, galleries and images."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROJECT = (
    "type string, version int, exportedAt string, name string, sourceName string, sourceDataUrl string, gridData string, paletteKey string, width int, height int, "
    "settings struct<brand:string,paletteSize:int,similarity:double,colorLimit:int,isolation:int,tileSize:string,mirror:string,cropMode:string,cropZoom:double,cropX:double,cropY:double>"
)


def to_text(grid: DataFrame) -> DataFrame:
    """(grid_id, text) of cells (grid_id, row, col, code, hex): rows by semicolons, cells by commas, code|#HEX, or a dot for an empty one."""
    cell = F.when(F.col("code").isNull(), ".").otherwise(F.concat_ws("|", "code", "hex"))
    rows = grid.groupBy("grid_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", cell.alias("t")))).alias("cells"))
    rows = rows.select("grid_id", "row", F.array_join(F.transform("cells", lambda c: c["t"]), ",").alias("t"))
    all_rows = rows.groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct("row", "t"))).alias("rows"))
    return all_rows.select("grid_id", F.array_join(F.transform("rows", lambda r: r["t"]), ";").alias("text"))


def from_text(texts: DataFrame) -> DataFrame:
    """(grid_id, row, col, code, hex) of (grid_id, text); a cell without a hex has none, one with a bad hex loses it."""
    rows = texts.select("grid_id", F.posexplode(F.split("text", ";")).alias("row", "r"))
    cells = rows.select("grid_id", "row", F.posexplode(F.split("r", ",")).alias("col", "c"))
    parts = F.split("c", "\\|")
    hex_ = F.get(parts, F.lit(1))
    return cells.select("grid_id", "row", "col", F.when((F.col("c") != ".") & (F.col("c") != ""), parts[0]).alias("code"), F.when(hex_.rlike("^#[0-9A-Fa-f]{6}$"), F.upper(hex_)).alias("hex"))


def read_projects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Project files of one type that hold a grid; others, and unreadable ones, are left out."""
    found = spark.read.schema(PROJECT).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return found.filter((F.col("type") == kind) & F.col("gridData").isNotNull())


def write_projects(projects: DataFrame, path: str) -> None:
    projects.write.json(path)


def read_latest(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The rows of the first of these stores that can be read and is not empty; unreadable lines are skipped; an empty table if there is none."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            found = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
        except AnalysisException:  # there is no such path
            continue
        if not found.isEmpty():
            return found
    return spark.createDataFrame([], schema)


def into_gallery(gallery: DataFrame, item: DataFrame, most: int = 18) -> DataFrame:
    """The gallery (title, created_at, ...) with the item before it, one entry for each title, the newest `most`."""
    every = gallery.unionByName(item, allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy("title").orderBy(F.desc("created_at")))
    return every.withColumn("_nth", nth).filter("_nth = 1").drop("_nth").orderBy(F.desc("created_at"), "title").limit(most)


#: Pixels of a batch that images are decoded into.
_PIXELS = 1 << 18


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Images (path, height, width, channels, data), of bytes in the order blue, green, red, alpha or of grey ones, as rows of pixels."""
    for batch in batches:
        for path, height, width, channels, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            cells = np.frombuffer(data, np.uint8).reshape(height, width, channels)
            step = max(1, _PIXELS // max(1, width))
            for top in range(0, height, step):
                part = cells[top : top + step].reshape(-1, channels)
                rows = np.repeat(np.arange(top, top + len(part) // max(1, width)), width)
                b, g, r = (part[:, 0],) * 3 if channels == 1 else part[:, :3].T
                alpha = part[:, 3] if channels == 4 else np.full(len(part), 255)
                columns = [rows, np.tile(np.arange(width), len(part) // max(1, width)), r, g, b, alpha]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), *[pa.array(x.astype(np.int32)) for x in columns]], ["path", "row", "col", "r", "g", "b", "a"])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, r, g, b, a) of the images that Spark's image source reads; images without transparency are opaque."""
    img = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return img.select("origin", "height", "width", "nChannels", "data").mapInArrow(_decoded, "path string, row int, col int, r int, g int, b int, a int")


def crop_window(width: int, height: int, to_width: int, to_height: int, mode: str = "cover", zoom: float = 1.0, x: float = 0.0, y: float = 0.0) -> tuple[float, float, float, float]:
    """(left, top, width, height) in the source that fills the target: cover cuts, contain pads, stretch distorts; zoom 1 to 3, offsets -1 to 1."""
    z, x, y = min(3.0, max(1.0, zoom)), min(1.0, max(-1.0, x)), min(1.0, max(-1.0, y))
    if mode == "stretch":  # neither zoom nor offset
        return 0.0, 0.0, float(width), float(height)
    if mode == "contain":  # an offset moves the picture within the target, as far as there is room
        fit = min(to_width / width, to_height / height) * z
        w, h = to_width / fit, to_height / fit
        return (width - w) / 2 - x * max(0.0, w - width) / 2, (height - h) / 2 - y * max(0.0, h - height) / 2, w, h
    fit = max(to_width / width, to_height / height) * z
    w, h = to_width / fit, to_height / fit
    return (width - w) * (1 + x) / 2, (height - h) * (1 + y) / 2, w, h


def resample(pixels: DataFrame, window: tuple[float, float, float, float], to_width: int, to_height: int) -> DataFrame:
    """Nearest pixels of (grid_id, row, col, r, g, b, a) on a new raster; what lies outside the source is transparent."""
    left, top, w, h = window
    ids = pixels.select("grid_id").distinct()
    at = lambda i, origin, size, n: F.floor(F.lit(origin) + (i + F.lit(0.5)) * F.lit(size / n)).cast("int")
    cells = ids.select("grid_id", F.explode(F.sequence(F.lit(0), F.lit(to_height - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(to_width - 1))).alias("x"))
    cells = cells.withColumns({"row": at(F.col("y"), top, h, to_height), "col": at(F.col("x"), left, w, to_width)})
    found = cells.join(pixels, ["grid_id", "row", "col"], "left")
    return found.select("grid_id", F.col("y").alias("row"), F.col("x").alias("col"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("r", "g", "b", "a")])


def resample_area(pixels: DataFrame, window: tuple[float, float, float, float], to_width: int, to_height: int) -> DataFrame:
    """Box averages of (grid_id, row, col, r, g, b, a) on a new raster: a cell is the mean of what it covers of each pixel.

    Channels are weighted by area and alpha, alpha by area alone, so what lies outside the source counts as transparent; halves go up.
    Each pixel adds to the cells that it meets, with partial sums in its task, so rasters of any size are spread over tasks.
    """
    left, top, w, h = window
    sx, sy = w / to_width, h / to_height

    def met(at: Column, origin: float, size: float, n: int) -> Column:
        """(cell, length) of the cells that a pixel's interval [at, at + 1) meets along one axis."""
        first = F.greatest(F.floor((at - F.lit(origin)) / F.lit(size)), F.lit(0))
        last = F.least(F.ceil((at + 1 - F.lit(origin)) / F.lit(size)) - 1, F.lit(n - 1))
        cells = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        length = lambda i: F.least(at + 1.0, F.lit(origin) + (i + 1) * F.lit(size)) - F.greatest(at + 0.0, F.lit(origin) + i * F.lit(size))
        return F.filter(F.transform(cells, lambda i: F.struct(i.cast("int").alias("cell"), length(i).alias("length"))), lambda x: x["length"] > 0)

    parts = pixels.select("grid_id", "r", "g", "b", "a", F.explode(met(F.col("row"), top, sy, to_height)).alias("y"), "col").select("*", F.explode(met(F.col("col"), left, sx, to_width)).alias("x"))
    area = F.col("x.length") * F.col("y.length")
    weight = area * F.col("a")
    sums = parts.groupBy("grid_id", F.col("y.cell").alias("row"), F.col("x.cell").alias("col")).agg(F.sum(weight).alias("weight"), *[F.sum(weight * F.col(c)).alias(c) for c in "rgb"])
    ids = pixels.select("grid_id").distinct()
    cells = ids.select("grid_id", F.explode(F.sequence(F.lit(0), F.lit(to_height - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(to_width - 1))).alias("col"))
    whole = lambda v: F.floor(v + F.lit(0.5 + 1e-9)).cast("int")  # noqa: E731  sums differ in their last bits with their order
    found = cells.join(sums, ["grid_id", "row", "col"], "left")
    return found.select("grid_id", "row", "col", *[F.when(F.col("weight") > 0, whole(F.col(c) / F.col("weight"))).otherwise(0).alias(c) for c in "rgb"], whole(F.coalesce("weight", F.lit(0.0)) / F.lit(sx * sy)).alias("a"))


def grid_height(width: Column, source_width: Column, source_height: Column) -> Column:
    """The height that keeps the source's proportions, 10 to 1000."""
    return F.greatest(F.lit(10), F.least(F.lit(1000), F.floor(width * source_height / source_width + 0.5))).cast("int")


def page_capacity(margin_mm: float, landscape: bool = False, bead_mm: float = 2.6) -> tuple[int, int]:
    """(columns, rows) of beads on an A4 page."""
    w, h = (297, 210) if landscape else (210, 297)
    return max(1, math.floor((w - 2 * margin_mm) / bead_mm)), max(1, math.floor((h - 2 * margin_mm) / bead_mm))


def blank(spark: SparkSession, width: int, height: int) -> DataFrame:
    """An empty board."""
    cells = spark.range(height).select(F.col("id").cast("int").alias("row")).select("row", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col"))
    return cells.select(F.lit(0).alias("grid_id"), "row", "col", F.lit(None).cast("string").alias("code"))
