"""Queries on derived grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import color
from tesserae.operators import grid as G
from tesserae.plans.derived import GRID_SQL, PALETTE_SQL, PIXELS_SQL, grid, palette, pixels

QUERIES, ORACLES = {}, {}
_LASSO = [(3.2, 4.1), (40.7, 9.3), (30.5, 44.8), (8.9, 36.6)]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


_MATCH = f"""
    WITH px AS ({PIXELS_SQL}), p AS ({PALETTE_SQL}), c AS (SELECT DISTINCT r, g, b FROM px),
    d AS (SELECT c.r, c.g, c.b, p.idx, p.code, 0.95::DOUBLE * (c.r - p.r) * (c.r - p.r) AS d1, c.r - p.r AS dr, c.g - p.g AS dg, c.b - p.b AS db,
        (0.299::DOUBLE * c.r + 0.587::DOUBLE * c.g + 0.114::DOUBLE * c.b) - (0.299::DOUBLE * p.r + 0.587::DOUBLE * p.g + 0.114::DOUBLE * p.b) AS dl,
        greatest(c.r, c.g, c.b) - least(c.r, c.g, c.b) AS ss, greatest(p.r, p.g, p.b) - least(p.r, p.g, p.b) AS st, c.g - greatest(c.r, c.b) AS gs, p.g - greatest(p.r, p.b) AS gt FROM c, p),
    e AS (SELECT r, g, b, idx, code, dr * dr * 0.95::DOUBLE + dg * dg * 1.18::DOUBLE + db * db * 1.05::DOUBLE + dl * dl * 0.85::DOUBLE
        + CASE WHEN ss < 28 AND st > 45 THEN (st - ss) * (st - ss) * 0.45::DOUBLE ELSE 0 END + CASE WHEN gs < 8 AND gt > 18 THEN gt * gt * 1.8::DOUBLE ELSE 0 END AS dist FROM d),
    m AS (SELECT r, g, b, arg_min(code, (dist, idx)) AS code FROM e GROUP BY r, g, b)"""


@query(_MATCH + " SELECT grid_id, code, count(*) AS count FROM px JOIN m USING (r, g, b) GROUP BY ALL")
def palette_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.code_counts(G.nearest_palette(pixels(spark, sf_dir), palette(spark)))


_STEPS = "CASE mode WHEN 'average' THEN CAST({0} AS BIGINT) WHEN 'smooth' THEN CAST(floor({0} / 13.0 + 0.5) * 13 AS BIGINT) ELSE CAST(floor({0} / 8.0 + 0.5) * 8 AS BIGINT) END AS {0}"


@query(
    f"""WITH o AS (SELECT *, 'row' || CAST("row" % 9 AS VARCHAR) AS part FROM ({PIXELS_SQL})), t AS (SELECT grid_id, "row", col, mode, CASE WHEN "row" % 9 = 4 THEN 0 ELSE a END AS a, {", ".join(_STEPS.format(c) for c in "rgb")} FROM o, (VALUES ('dominant'), ('average'), ('smooth'), ('palette')) m(mode)),
    """
    + _MATCH[_MATCH.index("WITH px AS") + 5 :].replace(f"px AS ({PIXELS_SQL})", "px AS (SELECT * FROM t WHERE a >= 24)")
    + """ SELECT mode, t.grid_id, t."row", t.col, m.code FROM t LEFT JOIN m ON t.r = m.r AND t.g = m.g AND t.b = m.b AND t.a >= 24"""
)
def raster_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels in each mode but dithering; every ninth row is background."""
    px = pixels(spark, sf_dir)
    made = [G.rasterise(px, palette(spark), mode, 40, px.filter("row % 9 = 4")).select(F.lit(mode).alias("mode"), *G.CELL, "code") for mode in G.MODES if mode != "dither"]
    return reduce(DataFrame.unionByName, made)


@query(
    f"""WITH px AS ({PIXELS_SQL}) SELECT grid_id, "row", col, CASE WHEN a >= 24 THEN CAST(floor(r / 8.0 + 0.5) * 8 AS INTEGER) END AS r, floor(g / 13.0 + 0.5) * 13 AS g,
    sqrt(CAST((r - 200) * (r - 200) + (g - 100) * (g - 100) + (b - 50) * (b - 50) AS DOUBLE)) AS far, (r + g + b) / 3.0::DOUBLE AS brightness, greatest(r, g, b) - least(r, g, b) AS chroma,
    0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b < 128 AS dark, '#' || upper(printf('%02x%02x%02x', r, g, b)) AS hex FROM px"""
)
def pixel_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = color.rgb()
    red = F.when(F.col("a") >= 24, color.snap(F.col("r"), 40))
    target = (F.lit(200), F.lit(100), F.lit(50))
    return pixels(spark, sf_dir).select(
        *G.CELL, red.alias("r"), color.snap(F.col("g"), 40, "smooth").cast("double").alias("g"), color.distance(c, target).alias("far"), color.brightness(c).alias("brightness"), color.chroma(c).alias("chroma"), color.is_dark(c).alias("dark"), color.to_hex(c).alias("hex")
    )


@query(f"SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY count DESC, code) AS rank FROM (SELECT grid_id, code, count(*) AS count FROM ({GRID_SQL}) WHERE code IS NOT NULL GROUP BY ALL)")
def grid_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ranked_counts(grid(spark, sf_dir))


@query(f"""SELECT grid_id, "row" // 12 * (max(max(col)) OVER (PARTITION BY grid_id) // 16 + 1) + col // 16 AS tile, code, count(*) AS count FROM ({GRID_SQL}) WHERE code IS NOT NULL GROUP BY grid_id, "row" // 12, col // 16, code""")
def grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.code_counts(G.tiles(grid(spark, sf_dir), 16, 12), ("grid_id", "tile"))


@query(f"""SELECT grid_id, min("row") AS min_row, max("row") AS max_row, min(col) AS min_col, max(col) AS max_col, max("row") - min("row") + 1 AS height, max(col) - min(col) + 1 AS width FROM ({GRID_SQL}) WHERE code IS NOT NULL GROUP BY 1""")
def grid_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bounds(grid(spark, sf_dir))


@query(
    f"""WITH s AS (SELECT grid_id, max(col) + 1 AS w, max("row") + 1 AS h FROM ({GRID_SQL}) GROUP BY 1), c AS (SELECT *, ceil(w / side::DOUBLE) * ceil(h / side::DOUBLE) AS n FROM s, (VALUES (52), (78), (104)) t(side)),
    d AS (SELECT grid_id, side, n + (n * side * side - w * h) / (n * side * side) + CASE WHEN side > greatest(w, h) THEN 0.12::DOUBLE ELSE 0 END AS score FROM c)
    SELECT grid_id, arg_min(side, (score, side)) AS side, min(score) AS score FROM d GROUP BY 1"""
)
def tile_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tile_choice(grid(spark, sf_dir))


@query(
    f"""WITH g AS ({GRID_SQL}), v AS (SELECT c.grid_id, c."row", c.col, n.code, count(*) AS n FROM g c JOIN g n ON c.grid_id = n.grid_id AND abs(c."row" - n."row") <= 1 AND abs(c.col - n.col) <= 1
    WHERE c.code IS NOT NULL AND n.code IS NOT NULL GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY grid_id, "row", col ORDER BY n DESC, code) AS k FROM v)
    SELECT g.grid_id, g."row", g.col, CASE WHEN t.n >= 4 AND t.n > o.n + 1 THEN t.code ELSE g.code END AS code FROM g LEFT JOIN t ON (g.grid_id, g."row", g.col) = (t.grid_id, t."row", t.col) AND t.k = 1 AND g.code IS NOT NULL
    LEFT JOIN v o ON (g.grid_id, g."row", g.col, g.code) = (o.grid_id, o."row", o.col, o.code)"""
)
def majority_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.majority_filter(grid(spark, sf_dir))


@query(f"""WITH g AS ({GRID_SQL}) SELECT DISTINCT c.grid_id, c."row" + i AS "row", c.col + j AS col FROM g c, range(-2, 3) a(i), range(-2, 3) b(j) WHERE i * i + j * j <= 4 AND c.code IS NULL AND c."row" + i BETWEEN 0 AND 49 AND c.col + j BETWEEN 0 AND 49""")
def mask_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dilate(grid(spark, sf_dir).filter("code is null"), 2, 50, 50)


@query(
    f"""SELECT grid_id, "row", col, code FROM ({GRID_SQL}) WHERE ("""
    + " + ".join(
        f"CASE WHEN ({y1}::DOUBLE > \"row\" + 0.5) <> ({y2}::DOUBLE > \"row\" + 0.5) AND col + 0.5::DOUBLE < ({x2}::DOUBLE - {x1}::DOUBLE) * (\"row\" + 0.5::DOUBLE - {y1}::DOUBLE) / ({y2}::DOUBLE - {y1}::DOUBLE) + {x1}::DOUBLE THEN 1 ELSE 0 END"
        for (x1, y1), (x2, y2) in zip(_LASSO, [*_LASSO[1:], _LASSO[0]], strict=True)
    )
    + ") % 2 = 1"
)
def lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.in_polygon(grid(spark, sf_dir), _LASSO)


@query(f"""WITH g AS ({GRID_SQL}) SELECT g.grid_id, g."row", g.col, coalesce(t.code, g.code) AS code FROM g LEFT JOIN (SELECT * FROM g WHERE "row" < 20 AND col < 10) t ON g.grid_id = t.grid_id AND g."row" = t."row" + 5 AND g.col = t.col + 7""")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return G.overlay(g, g.filter("row < 20 and col < 10"), 5, 7)


def _turned(row: str, col: str) -> str:
    return f"""SELECT grid_id, {row} AS "row", {col} AS col, code FROM (SELECT *, max("row") OVER (PARTITION BY grid_id) AS h, max(col) OVER (PARTITION BY grid_id) AS w FROM ({GRID_SQL}))"""


@query(_turned("col", 'h - "row"'))
def rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.transform(grid(spark, sf_dir), "rotate_right")


@query(_turned('"row"', "w - col"))
def mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.transform(grid(spark, sf_dir), "mirror")


@query(_turned('h - "row"', "col"))
def flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.transform(grid(spark, sf_dir), "flip")


@query(f"""SELECT grid_id, 2 * "row" + i AS "row", 2 * col + j AS col, code FROM ({GRID_SQL}), range(2) a(i), range(2) b(j)""")
def scale_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.scale(grid(spark, sf_dir), 2)


@query(f"""SELECT grid_id, "row" // 2 AS "row", col // 2 AS col, code FROM ({GRID_SQL}) WHERE "row" % 2 = 0 AND col % 2 = 0""")
def scale_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.scale(grid(spark, sf_dir), 0.5)


@query(f"""SELECT grid_id, "row", col, CASE WHEN code = 'C1' THEN 'C9' ELSE code END AS code FROM ({GRID_SQL})""")
def replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.replace_code(grid(spark, sf_dir), "C1", "C9")


@query(f"""WITH g AS ({GRID_SQL}), f AS (SELECT grid_id, "row", col, CASE WHEN "row" BETWEEN 6 AND 40 AND col BETWEEN 3 AND 44 THEN code END AS code FROM g), b AS (SELECT grid_id, min("row") AS r, min(col) AS c FROM f WHERE code IS NOT NULL GROUP BY 1),
    e AS (SELECT grid_id, max("row") AS r, max(col) AS c FROM f WHERE code IS NOT NULL GROUP BY 1)
    SELECT f.grid_id, f."row" - b.r AS "row", f.col - b.c AS col, code FROM f JOIN b USING (grid_id) JOIN e USING (grid_id) WHERE f."row" BETWEEN b.r AND e.r AND f.col BETWEEN b.c AND e.c""")
def trim_artwork(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of grids whose margins are blank."""
    inside = F.col("row").between(6, 40) & F.col("col").between(3, 44)
    return G.trim(grid(spark, sf_dir).withColumn("code", F.when(inside, F.col("code"))))


@query(f"""SELECT grid_id, "row", col, code, "row" BETWEEN 5 AND 20 AND col BETWEEN 8 AND 30 AS copied, CASE WHEN NOT ("row" BETWEEN 5 AND 20 AND col BETWEEN 8 AND 30) THEN code END AS rest FROM ({GRID_SQL})""")
def cut_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cut_rectangle(grid(spark, sf_dir), 5, 8, 20, 30)


@query(f"""WITH g AS ({GRID_SQL}), s AS (SELECT grid_id, "row", col FROM g WHERE ("row" * 50 + col) % 97 = 0), i AS (SELECT * FROM s UNION SELECT grid_id, "row", 49 - col FROM s UNION SELECT grid_id, 49 - "row", col FROM s UNION SELECT grid_id, 49 - "row", 49 - col FROM s)
    SELECT g.grid_id, g."row", g.col, CASE WHEN i.grid_id IS NOT NULL THEN 'P1' ELSE code END AS code FROM g LEFT JOIN i ON (g.grid_id, g."row", g.col) = (i.grid_id, i."row", i.col)""")
def paint_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return G.paint(g, G.symmetric(g.filter((F.col("row") * 50 + F.col("col")) % 97 == 0).select(*G.CELL), 50, 50), "P1")


_RUNS = f"""WITH g AS (SELECT grid_id, "row", col, CAST(floor(r / 10.0 + 0.5) AS INTEGER) AS key FROM ({PIXELS_SQL})), m AS (SELECT *, CASE WHEN lag(key) OVER w = key AND lag(col) OVER w = col - 1 THEN 0 ELSE 1 END AS new FROM g WINDOW w AS (PARTITION BY grid_id, "row" ORDER BY col)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY grid_id, "row" ORDER BY col) AS run FROM m), runs AS (SELECT grid_id, "row", min(col) AS start, count(*) AS length, min(key) AS key FROM s GROUP BY grid_id, "row", run)"""


def _pixel_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = pixels(spark, sf_dir).withColumn("key", color.half_up(F.col("r") / F.lit(10.0)).cast("int"))
    return G.runs(keyed, "key", "col", "row")


@query(_RUNS + " SELECT * FROM runs")
def pixel_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixel_runs(spark, sf_dir)


@query(
    f"""WITH l AS (SELECT grid_id, 3 + (\"row\" * 7 + col * 3) % 30 AS length FROM ({GRID_SQL})), c AS (SELECT grid_id, length, count(*) AS n FROM l GROUP BY ALL),
    v AS (SELECT grid_id, size, round(sum(CASE WHEN abs(length - t * size) <= greatest(1.0, size * 0.08::DOUBLE) THEN n * least(3, t) * sqrt(size::DOUBLE) ELSE 0 END), 6) AS score FROM (SELECT *, greatest(1, floor(length / size::DOUBLE + 0.5)) AS t FROM c, range(3, 25) s(size)) GROUP BY ALL)
    SELECT grid_id, CAST(arg_max(size, (score, size)) AS INTEGER) AS size, max(score) AS score, (SELECT sum(n) FROM c WHERE c.grid_id = v.grid_id) AS runs FROM v GROUP BY 1 HAVING max(score) >= 80 AND (SELECT sum(n) FROM c WHERE c.grid_id = v.grid_id) >= 18"""
)
def cell_size_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = grid(spark, sf_dir).select("grid_id", (F.lit(3) + (F.col("row") * 7 + F.col("col") * 3) % 30).alias("length"))
    return G.cell_size(lengths, 24)


_DONE = '("row" * 3 + col) % 4 = 0'


@query(f"""SELECT grid_id, count(*) AS total, count(*) FILTER ({_DONE}) AS done, CAST(floor(count(*) FILTER ({_DONE}) * 100.0::DOUBLE / count(*) + 0.5) AS INTEGER) AS percent FROM ({GRID_SQL}) WHERE code IS NOT NULL GROUP BY 1""")
def completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return G.progress(g, g.filter("(row * 3 + col) % 4 = 0"))


@query(f"""WITH g AS (SELECT *, max("row") OVER (PARTITION BY grid_id) + 1 AS h FROM ({GRID_SQL})) SELECT grid_id, arg_min("row", k) AS "row", arg_min(col, k) AS col FROM (SELECT *, ("row" * 50 + col - 1007 - 1 + h * 50) % (h * 50) AS k FROM g WHERE code IS NOT NULL AND NOT ({_DONE})) GROUP BY 1""")
def next_open_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return G.next_open(g, g.filter("(row * 3 + col) % 4 = 0"), 20, 7)


@query(
    f"""WITH g AS ({GRID_SQL}), m AS (SELECT grid_id, "row", col, 'C' || ((length(code) + "row" + col) % 3) AS code FROM g WHERE code IS NOT NULL)
    SELECT coalesce(g.grid_id, m.grid_id) AS grid_id, coalesce(g."row", m."row") AS "row", coalesce(g.col, m.col) AS col, g.code AS a, m.code AS b FROM g FULL JOIN m ON (g.grid_id, g."row", g.col) = (m.grid_id, m."row", m.col) WHERE g.code IS DISTINCT FROM m.code OR g.grid_id IS NULL OR m.grid_id IS NULL"""
)
def grid_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    m = g.filter("code is not null").withColumn("code", F.concat(F.lit("C"), ((F.length("code") + F.col("row") + F.col("col")) % 3).cast("string")))
    return G.same_cells(g, m)


@query(
    f"""WITH c AS (SELECT grid_id, code, count(*) AS n FROM ({GRID_SQL}) WHERE code IS NOT NULL GROUP BY ALL), t AS (SELECT grid_id, sum(n)::BIGINT AS cells, count(*) AS colours, max(n) AS most FROM c GROUP BY 1),
    z AS (SELECT grid_id, (max("row") + 1) * (max(col) + 1) AS area, greatest(max("row"), max(col)) + 1 AS side FROM ({GRID_SQL}) GROUP BY 1),
    s AS (SELECT *, (cells > 2200)::INT + (cells > 5200)::INT + (cells > 10000)::INT + (cells > 18000)::INT + (colours > 18)::INT + (colours > 36)::INT + (colours > 60)::INT
        + CASE WHEN most / cells::DOUBLE > 0.42 AND cells > 1500 THEN 0.7 ELSE 0 END::DOUBLE + CASE WHEN most / cells::DOUBLE < 0.16 AND colours > 24 THEN 0.7 ELSE 0 END::DOUBLE
        + CASE WHEN cells / area::DOUBLE > 0.82 AND cells > 4000 THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN side > 130 THEN 0.7 ELSE 0 END::DOUBLE AS score FROM t JOIN z USING (grid_id)),
    h AS (SELECT *, cells / greatest(360, 900 - score * 78) AS hours FROM s)
    SELECT grid_id, cells, colours, score, CASE WHEN score < 1.5 THEN '入门' WHEN score < 3 THEN '标准' WHEN score < 4.6 THEN '进阶' WHEN score < 6.2 THEN '困难' ELSE '大师' END AS label,
        CASE WHEN hours < 1 THEN '<1h' WHEN hours < 3 THEN CAST(ceil(hours)::INT AS VARCHAR) || 'h' WHEN hours < 8 THEN CAST(ceil(hours)::INT AS VARCHAR) || 'h+' ELSE CAST((ceil(hours / 2) * 2)::INT AS VARCHAR) || 'h+' END AS time FROM h"""
)
def difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.difficulty(grid(spark, sf_dir))


@query(f"""SELECT grid_id, CAST(value_row AS INTEGER) AS "row", CAST(value_col AS INTEGER) AS col FROM (SELECT user_id % 7 AS grid_id, event_id % 11 AS value_row, floor(value) % 13 AS value_col FROM events) GROUP BY ALL HAVING count(*) % 2 = 1""")
def toggled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.plans.derived import table

    log = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("grid_id"), (F.col("event_id") % 11).cast("int").alias("row"), (F.floor("value") % 13).cast("int").alias("col"))
    return G.toggled(log)


@query("""WITH p AS (SELECT p_partkey AS idx, left(p_type, 1 + p_size % 2) || p_partkey AS code, left(p_type, 1 + p_size % 2) AS letters FROM part) SELECT letters, min(idx) OVER w AS first, count(*) OVER w AS n, idx, code FROM p WINDOW w AS (PARTITION BY letters)""")
def palette_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as colours: codes are letters of the type, and the key."""
    from tesserae.plans.derived import table

    code = F.concat(F.expr("left(p_type, 1 + p_size % 2)"), F.col("p_partkey").cast("string"))
    return G.palette_groups(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), code.alias("code")))


@query(f"""SELECT idx, code, CASE WHEN idx < 25 THEN 'N' || n_nationkey ELSE 'X' || lpad(CAST(idx + 1 AS VARCHAR), 3, '0') END AS brand_code FROM ({PALETTE_SQL}) LEFT JOIN nation ON idx = n_nationkey""")
def brand_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.plans.derived import table

    p = palette(spark)
    mapping = table(spark, sf_dir, "nation").join(p, F.col("n_nationkey") == F.col("idx")).select(F.col("code").alias("source"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("target"))
    return G.brand_codes(p, mapping, "X")


@query(f"""SELECT grid_id, ceil(50 / 16.0)::INT * ceil((max("row") + 1) / 12.0)::INT AS pages, ceil((max("row") + 1) * 0.26::DOUBLE * 10) / 10 AS height_cm FROM ({GRID_SQL}) GROUP BY 1""")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.max("row") + 1
    pages = F.ceil(F.lit(50 / 16.0)) * F.ceil(rows / F.lit(12.0))
    return grid(spark, sf_dir).groupBy("grid_id").agg(pages.cast("int").alias("pages"), (F.ceil(rows * F.lit(0.26) * 10).cast("double") / 10).alias("height_cm"))


@query(
    f"""WITH s AS (SELECT grid_id, "row" // 10 AS "row", col // 10 AS col, r, g, b, r + g + b AS k FROM ({PIXELS_SQL}) WHERE a >= 24 AND "row" % 10 IN (2, 5, 7) AND col % 10 IN (2, 5, 7)),
    n AS (SELECT *, row_number() OVER (PARTITION BY grid_id, "row", col ORDER BY k, r, g, b) - 1 AS i, count(*) OVER (PARTITION BY grid_id, "row", col) AS n FROM s)
    SELECT grid_id, "row", col, r, g, b FROM n WHERE i = n // 2 AND NOT (r >= 248 AND g >= 248 AND b >= 248)"""
)
def median_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.median_cells(pixels(spark, sf_dir), 10, 10)


@query(
    f"""WITH g AS ({GRID_SQL}), r AS (SELECT grid_id, "row" // 6 AS k, "row" AS y, string_agg(CASE WHEN code = 'C1' THEN 'x' ELSE '-' END, '' ORDER BY col) AS cells FROM g GROUP BY ALL),
    m AS (SELECT *, CASE WHEN lag(cells) OVER w = cells THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY grid_id ORDER BY y)), s AS (SELECT *, sum(new) OVER (PARTITION BY grid_id ORDER BY y) AS run FROM m)
    SELECT grid_id, min(y) AS y, count(*) AS times, min(cells) AS bytes FROM s GROUP BY grid_id, run"""
)
def repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("code") == "C1", "x").otherwise("-")
    rows = grid(spark, sf_dir).groupBy("grid_id", F.col("row").alias("y")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", mark.alias("m")))), lambda s: s["m"]), "").alias("bytes"))
    return G.repeated_rows(rows)


@query(
    f"""SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY "row", col) AS by_row, row_number() OVER (PARTITION BY grid_id ORDER BY code, "row", col) AS by_colour, row_number() OVER (PARTITION BY grid_id ORDER BY "row" // 13, col // 13, "row", col) AS by_block
    FROM ({GRID_SQL}) WHERE code IS NOT NULL"""
)
def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.walk_index(grid(spark, sf_dir), 13)


@query(f"""SELECT grid_id, string_agg(line, ';' ORDER BY "row") AS text FROM (SELECT grid_id, "row", string_agg(coalesce(code || '|#0000' || upper(printf('%02x', col)), '.'), ',' ORDER BY col) AS line FROM ({GRID_SQL}) GROUP BY 1, 2) GROUP BY 1""")
def grid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.sources import boards

    coloured = grid(spark, sf_dir).withColumn("hex", F.concat(F.lit("#0000"), F.lpad(F.hex("col"), 2, "0")))
    return boards.to_text(coloured)


@query(f"""SELECT grid_id, "row", col, code, CASE WHEN code IS NOT NULL THEN '#0000' || upper(printf('%02x', col)) END AS hex FROM ({GRID_SQL})""")
def grid_text_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.sources import boards

    return boards.from_text(grid_text(spark, sf_dir))


@query(
    f"""WITH px AS ({PIXELS_SQL}), c AS (SELECT grid_id, y, x, 2.5::DOUBLE * y AS y0, 1.6666666666666667::DOUBLE * x + 8.333333333333334::DOUBLE AS x0 FROM (SELECT DISTINCT grid_id FROM px), range(20) a(y), range(20) b(x)),
    w AS (SELECT c.grid_id, y, x, r, g, b, greatest(0, least(px."row" + 1, y0 + 2.5::DOUBLE) - greatest(px."row", y0)) * greatest(0, least(px.col + 1, x0 + 1.6666666666666667::DOUBLE) - greatest(px.col, x0)) * a AS weight
        FROM c LEFT JOIN px ON c.grid_id = px.grid_id AND px."row" BETWEEN floor(y0) AND ceil(y0 + 2.5::DOUBLE) AND px.col BETWEEN floor(x0) AND ceil(x0 + 1.67::DOUBLE)),
    s AS (SELECT grid_id, y AS "row", x AS col, coalesce(sum(weight), 0) AS weight, sum(weight * r) AS r, sum(weight * g) AS g, sum(weight * b) AS b FROM w GROUP BY ALL)
    SELECT grid_id, "row", col, CASE WHEN weight > 0 THEN CAST(floor(r / weight + 0.500000001::DOUBLE) AS INTEGER) ELSE 0 END AS r, CASE WHEN weight > 0 THEN CAST(floor(g / weight + 0.500000001::DOUBLE) AS INTEGER) ELSE 0 END AS g,
        CASE WHEN weight > 0 THEN CAST(floor(b / weight + 0.500000001::DOUBLE) AS INTEGER) ELSE 0 END AS b, CAST(floor(weight / (2.5::DOUBLE * 1.6666666666666667::DOUBLE) + 0.500000001::DOUBLE) AS INTEGER) AS a FROM s"""
)
def resampled_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.sources import boards

    return boards.resample_area(pixels(spark, sf_dir), boards.crop_window(50, 50, 20, 30)[:1] + (0.0, 33.333333333333336, 50.0), 20, 20)


@query(f"""SELECT g.grid_id, y AS "row", x AS col, coalesce(p.r, 0) AS r, coalesce(p.g, 0) AS g, coalesce(p.b, 0) AS b, coalesce(p.a, 0) AS a FROM (SELECT DISTINCT grid_id FROM ({PIXELS_SQL})) g, range(30) a(y), range(20) b(x)
    LEFT JOIN ({PIXELS_SQL}) p ON p.grid_id = g.grid_id AND p."row" = floor((y + 0.5) * (50 / 30.0::DOUBLE)) AND p.col = floor(8.333333333333332::DOUBLE + (x + 0.5) * (33.333333333333336::DOUBLE / 20))""")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.sources import boards

    return boards.resample(pixels(spark, sf_dir), boards.crop_window(50, 50, 20, 30), 20, 30)


@query(
    """SELECT p_partkey AS id, CAST(floor(p_size * 300.0::DOUBLE / 25.4::DOUBLE + 0.5) AS INTEGER) AS px, greatest(0, least(86400, CAST(p_retailprice * 100 AS BIGINT))) AS seconds, CAST(greatest(10, least(1000, floor(p_size * (p_retailprice / 1000) + 0.5))) AS INTEGER) AS height,
    CAST(p_size AS VARCHAR) || 'x' || CAST(p_size + 1 AS VARCHAR) AS preset, p_size AS w, p_size + 1 AS h, CAST(ceil(p_size / 7.0) * ceil((p_size + 3) / 5.0) AS INTEGER) AS pages, CASE WHEN p_size * 9 <= 60 THEN 64 WHEN p_size * 9 <= 120 THEN 40 WHEN p_size * 9 <= 240 THEN 24 ELSE 12 END AS cell,
    greatest(1, p_size * 20 // 150)::INT AS legend_columns, ceil(p_size / greatest(1, p_size * 20 // 150)::DOUBLE)::INT AS legend_rows, upper(p_brand) || ' ' || CAST(p_size AS VARCHAR) || ' colours' AS label FROM (SELECT * REPLACE (replace(p_brand, '-', '') AS p_brand) FROM part)"""
)
def board_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.functions import layout as L
    from tesserae.plans.derived import table

    size = F.col("p_size")
    preset = F.concat(size.cast("string"), F.lit("x"), (size + 1).cast("string"))
    w, h = L.board_size(preset)
    columns, rows = L.legend(size * 20, size)
    label = L.palette_label(L.palette_key(F.replace("p_brand", F.lit("-"), F.lit("")), size))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), L.mm_to_px(size).alias("px"), L.seconds(F.round(F.col("p_retailprice") * 100)).alias("seconds"), L.board_height(size, F.col("p_retailprice") / 1000).alias("height"), preset.alias("preset"), w.alias("w"), h.alias("h"),
        L.page_count(size, size + 3, 7, 5).alias("pages"), L.export_cell(size * 9).alias("cell"), columns.alias("legend_columns"), rows.alias("legend_rows"), label.alias("label"),
    )


@query(
    f"""WITH p AS (SELECT 1 AS priority, idx, r, g, b, code FROM ({PALETTE_SQL}) UNION ALL SELECT 0, 100 + idx, b, g, r, CASE WHEN idx % 2 = 0 THEN 'C0' || CAST(idx % 6 AS VARCHAR) ELSE code END FROM ({PALETTE_SQL}) WHERE idx < 12),
    n AS (SELECT *, upper(regexp_replace(code, '(?i)^([A-Z]+)0+([0-9]+)$', '\\1\\2')) AS k FROM p), f AS (SELECT k, arg_min(r, (priority, idx)) AS r, arg_min(g, (priority, idx)) AS g, arg_min(b, (priority, idx)) AS b FROM n GROUP BY 1)
    SELECT c.grid_id, c."row", c.col, c.code, CASE WHEN code IS NOT NULL THEN coalesce(r, 153) END AS r, CASE WHEN code IS NOT NULL THEN coalesce(g, 153) END AS g, CASE WHEN code IS NOT NULL THEN coalesce(b, 153) END AS b
    FROM (SELECT grid_id, "row", col, CASE WHEN "row" % 7 = 0 THEN 'zz9' WHEN "row" % 7 = 1 THEN lower(code) ELSE code END AS code FROM ({GRID_SQL})) c LEFT JOIN f ON upper(regexp_replace(c.code, '(?i)^([A-Z]+)0+([0-9]+)$', '\\1\\2')) = f.k"""
)
def colour_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes in a small palette of higher priority, a large one, or none."""
    base = palette(spark)
    code = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("C0"), (F.col("idx") % 6).cast("string"))).otherwise(F.col("code"))
    small = base.filter("idx < 12").select(F.lit(0).alias("priority"), (F.col("idx") + 100).alias("idx"), F.col("b").alias("r"), "g", F.col("r").alias("b"), code.alias("code"))
    both = small.unionByName(base.withColumn("priority", F.lit(1)))
    typed = F.when(F.col("row") % 7 == 0, "zz9").when(F.col("row") % 7 == 1, F.lower("code")).otherwise(F.col("code"))
    return G.look_up_colours(grid(spark, sf_dir).withColumn("code", typed), both)


@query(
    f"""SELECT grid_id, "row", col, CASE WHEN n THEN 100 ELSE r END AS r, CASE WHEN n THEN 120 ELSE g END AS g, CASE WHEN n THEN 90 ELSE b END AS b FROM (SELECT *, a >= 24 AND col % 10 <> 0 AND sqrt(CAST((r - 100) * (r - 100) + (g - 120) * (g - 120) + (b - 90) * (b - 90) AS DOUBLE)) <= 80 AS n FROM ({PIXELS_SQL}))"""
)
def denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth column is masked."""
    from tesserae.operators import segment as S

    return S.denoise(pixels(spark, sf_dir).withColumn("masked", F.col("col") % 10 == 0), (100, 120, 90), 80).select("grid_id", "row", "col", "r", "g", "b")


@query("""WITH n AS (SELECT o_orderkey AS old, row_number() OVER (ORDER BY o_orderkey DESC) AS new FROM orders WHERE o_orderkey % 3 > 0) SELECT new AS l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN n ON l_orderkey = old""")
def remapped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders numbered anew from the last one on, and the lines that point to them."""
    from tesserae.plans.derived import table

    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("l_orderkey"), (-F.col("o_orderkey")).alias("at"))
    return G.remap(orders, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "at")[1]
