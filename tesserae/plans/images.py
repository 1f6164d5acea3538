"""Queries on segmentation, regions and order-dependent raster operators, and on keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import grid as G
from tesserae.operators import imaging, keyed
from tesserae.operators import segment as S
from tesserae.plans.derived import COLOURS, GRID_SQL, PIXELS_SQL, grid, palette, pixels, table
from tesserae.session import materialise

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


_LIKE = f"""px AS ({PIXELS_SQL}), lk AS (SELECT grid_id, "row", col, a < 24 OR sqrt(CAST((r - 128) * (r - 128) + (g - 120) * (g - 120) + (b - 128) * (b - 128) AS DOUBLE)) < 154 AS "like" FROM px)"""


def _liked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels, like a middling reference where they are within 154 of it."""
    from tesserae.functions import color

    far = color.distance(color.rgb(), (F.lit(128), F.lit(120), F.lit(128)))
    return pixels(spark, sf_dir).withColumn("like", ~S.opaque(F.col("a")) | (far < 154))


@query(
    f"""WITH RECURSIVE {_LIKE}, s AS (SELECT grid_id, max("row") AS h, 49 AS w FROM px GROUP BY 1), o AS (SELECT lk.*, h, w FROM lk JOIN s USING (grid_id) WHERE "like"),
    f AS (SELECT grid_id, "row", col FROM o WHERE "row" = 0 OR col = 0 OR "row" = h OR col = w UNION SELECT o.grid_id, o."row", o.col FROM f JOIN o ON f.grid_id = o.grid_id AND abs(f."row" - o."row") + abs(f.col - o.col) = 1) SELECT * FROM f"""
)
def flood_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flood_from_border(_liked(spark, sf_dir))


@query(
    f"""WITH px AS ({PIXELS_SQL}), s AS (SELECT grid_id, max("row") + 1 AS h, max(col) + 1 AS w FROM px GROUP BY 1), z AS (SELECT px.*, h, w, greatest(2, floor(least(h, w) * 0.08::DOUBLE + 0.5)) AS k FROM px JOIN s USING (grid_id)),
    c AS (SELECT grid_id, CASE WHEN bottom THEN 2 ELSE 0 END + CASE WHEN "right" THEN 1 ELSE 0 END AS corner, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM z, (VALUES (false), (true)) x(bottom), (VALUES (false), (true)) y("right")
        WHERE a >= 24 AND CASE WHEN bottom THEN "row" >= h - k ELSE "row" < k END AND CASE WHEN "right" THEN col >= w - k ELSE col < k END GROUP BY ALL) SELECT * FROM c"""
)
def corner_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.corners(pixels(spark, sf_dir))


@query(
    f"""WITH px AS ({PIXELS_SQL}), s AS (SELECT grid_id, max("row") AS h, max(col) AS w FROM px GROUP BY 1) SELECT grid_id, count(*) AS border, avg((a < 24 OR sqrt(CAST((r - 200) * (r - 200) + (g - 90) * (g - 90) + (b - 60) * (b - 60) AS DOUBLE)) < 54)::INT) AS edge
    FROM px JOIN s USING (grid_id) WHERE "row" = 0 OR col = 0 OR "row" = h OR col = w GROUP BY 1"""
)
def edge_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    ref = px.select("grid_id").distinct().select("grid_id", F.lit(200).alias("r"), F.lit(90).alias("g"), F.lit(60).alias("b"))
    return S.edge_ratio(px, ref)


@query()
def small_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all grids. SQL has to spread every region cell by cell; a test holds the whole query against a model instead."""
    return S.absorb_small(grid(spark, sf_dir), 6)


@query(f"""WITH RECURSIVE g AS ({GRID_SQL}), f AS (SELECT grid_id, "row", col, code FROM g WHERE "row" = 12 AND col = 20 UNION SELECT g.grid_id, g."row", g.col, g.code FROM f JOIN g ON g.grid_id = f.grid_id AND g.code IS NOT DISTINCT FROM f.code AND abs(g."row" - f."row") + abs(g.col - f.col) = 1)
    SELECT g.grid_id, g."row", g.col, CASE WHEN f.grid_id IS NOT NULL THEN 'F1' ELSE g.code END AS code FROM g LEFT JOIN f ON (g.grid_id, g."row", g.col) = (f.grid_id, f."row", f.col)""")
def flood_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fill(grid(spark, sf_dir), 12, 20, "F1")


@query()
def background_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    ref = materialise(S.reference(px), "references")
    liked = materialise(S.marked(px, ref), "liked")
    raw = S.flood_from_border(liked)
    masked = S.flood_from_border(liked, S.protection(liked, 50, 50))
    return S.removal(px, ref, masked, raw)


def _palette_rows() -> imaging.Palette:
    return [(chr(65 + i // 10) + str(i % 10 + 1), (i * 67 + 29) % 256, (i * 131 + 71) % 256, (i * 193 + 17) % 256) for i in range(COLOURS)]


@query()
def dither(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.dither(pixels(spark, sf_dir), _palette_rows())


@query()
def colour_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = G.nearest_palette(pixels(spark, sf_dir), palette(spark)).select(*G.CELL, "code")
    return imaging.limit_colours(matched, palette(spark), 12)


@query()
def optimised_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest colours, at most 16 of them, smoothed, without small regions."""
    matched = G.nearest_palette(pixels(spark, sf_dir), palette(spark)).select(*G.CELL, "code")
    limited = imaging.limit_colours(materialise(matched, "matched"), palette(spark), 16)
    return S.absorb_small(G.majority_filter(limited), 4)


@query()
def leader_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.direct_colours(pixels(spark, sf_dir))


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "click", "start").when(kind == "view", "pause").when(kind == "purchase", "add_time").when(kind == "signup", "set_total").otherwise("sub_time")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("table_id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("micros"), action.alias("action"), (F.floor("value") % 300 + 1).cast("long").alias("minutes")).withColumn("ts", F.floor(F.col("micros") / 1e6)).drop("micros")


@query()
def timer_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.run(_commands(spark, sf_dir), "table_id", "event_id", keyed.timer_step, keyed.TIMER_OUTPUT)


@query()
def desk_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _commands(spark, sf_dir)
    a = F.col("action")
    named = F.when(a == "start", "start").when(a == "pause", F.when(F.col("event_id") % 2 == 0, "pause").otherwise("resume")).when(a == "add_time", "add").when(a == "set_total", "finish").otherwise("adjust")
    return keyed.run(c.withColumn("action", named), "table_id", "event_id", keyed.desk_step, keyed.DESK_OUTPUT)


@query()
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests, an hour of them taken as a second so that buckets run dry."""
    e = table(spark, sf_dir, "events")
    ts = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000).cast("long")
    path = F.when(F.col("event_type") == "view", "/api/review").otherwise("/api/other")
    return keyed.run(e.select("event_id", F.col("user_id").alias("ip"), ts.alias("ts"), path.alias("path")), "ip", "event_id", keyed.limit_step, keyed.LIMIT_OUTPUT)
