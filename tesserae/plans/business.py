"""Queries on prices, sessions and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import clock, money, text
from tesserae.operators import pricing as P
from tesserae.operators import sessions as S
from tesserae.plans.derived import NOW, table
from tesserae.session import scratch
from tesserae.sources import sheets

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


_SETTINGS = P.Settings.of_month(6000, 160, 3000, 0, 1000, labor_hours=0.5, tool_cost=1.5, shipping=4.0, packaging=1.2, other_cost=0.3, fee_rate=0.06, target_margin=0.35, round_rule="nine")
_UP = "CASE WHEN raw_price <= 0 THEN 0 WHEN floor(raw_price) + 0.9::DOUBLE >= raw_price THEN round(floor(raw_price) + 0.9::DOUBLE, 2) ELSE round(floor(raw_price) + 1.9::DOUBLE, 2) END"


@query(
    f"""WITH a AS (SELECT p_partkey AS id, CASE WHEN p_size > 0 THEN p_size ELSE 1 END::DOUBLE AS quantity, CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE p_retailprice / 10 END AS material_cost,
        CASE WHEN p_partkey % 3 = 0 THEN 2.5::DOUBLE ELSE 1.5::DOUBLE END AS tool_cost FROM part),
    b AS (SELECT *, material_cost + tool_cost + 4.0::DOUBLE + 1.2::DOUBLE + 0.5::DOUBLE * 37.5::DOUBLE + 3.0::DOUBLE + 0.3::DOUBLE AS fixed_cost FROM a), c AS (SELECT *, fixed_cost / (1 - 0.06::DOUBLE) AS break_even, fixed_cost / (1 - 0.06::DOUBLE - 0.35::DOUBLE) AS raw_price FROM b),
    d AS (SELECT *, {_UP} AS price FROM c), e AS (SELECT *, price * 0.06::DOUBLE AS fee, price - fixed_cost - price * 0.06::DOUBLE AS profit FROM d), f AS (SELECT *, CASE WHEN price > 0 THEN profit / price ELSE 0 END AS margin FROM e)
    SELECT id, quantity, fixed_cost, break_even, price, fee, profit, margin, profit * quantity AS batch_profit, material_cost * quantity AS purchase_total, material_cost / fixed_cost AS material_share,
        CASE WHEN material_cost = 0 THEN 'no cost' WHEN price <= 0 THEN 'not computed' WHEN margin + 0.0001::DOUBLE < 0.35::DOUBLE THEN 'margin short' ELSE 'ok' END AS status FROM f"""
)
def cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("double")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("quantity"), F.when(F.col("p_partkey") % 50 == 0, 0.0).otherwise(F.col("p_retailprice") / 10).alias("unit_cost"), F.when(F.col("p_partkey") % 3 == 0, 2.5).alias("tool_cost"),
        *[null.alias(c) for c in ("shipping", "packaging", "labor_hours", "other_cost")],
    )
    return P.cost_model(rows, _SETTINGS).select("id", "quantity", "fixed_cost", "break_even", "price", "fee", "profit", "margin", "batch_profit", "purchase_total", "material_share", "status")


@query(
    """SELECT o_orderkey AS id, ceil(x) AS whole, ceil(x * 2) / 2 AS half, ceil(x / 5) * 5 AS five, round(CASE WHEN floor(x) + 0.9::DOUBLE >= x THEN floor(x) + 0.9::DOUBLE ELSE floor(x) + 1.9::DOUBLE END, 2) AS nine,
    round(CASE WHEN floor(x) + 0.99::DOUBLE >= x THEN floor(x) + 0.99::DOUBLE ELSE floor(x) + 1.99::DOUBLE END, 2) AS ninetynine FROM (SELECT o_orderkey, o_totalprice / 1000 AS x FROM orders)"""
)
def price_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice") / 1000
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *[money.round_price(x, r).alias(r) for r in ("whole", "half", "five", "nine", "ninetynine")])


@query("""WITH x AS (SELECT event_id, (value - 40) * event_id AS v, value / 7.77 - 3 AS s FROM events)
    SELECT event_id, CASE WHEN v < 0 AND round(v, 2) <> 0 THEN '-' ELSE '' END || printf('{:,}', CAST(floor(round(abs(CAST(v AS DECIMAL(30,12))), 2)) AS BIGINT)) || '.' || lpad(CAST(CAST(round(abs(CAST(v AS DECIMAL(30,12))), 2) * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0') AS money, printf('%.1f%%', s * 100) AS share FROM x""".replace("printf('{:,}',", "format('{:,}',"))
def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, share = (F.col("value") - 40) * F.col("event_id"), F.col("value") / 7.77 - 3
    return table(spark, sf_dir, "events").select("event_id", money.money_text(v).alias("money"), money.percent_text(share).alias("share"))


@query("""SELECT p_partkey AS component_id, coalesce(used, 0) AS used, CASE WHEN used > 0 THEN CAST(floor(greatest(p_size * 10, 0) / used) AS BIGINT) END AS buildable FROM part LEFT JOIN (SELECT l_partkey, sum(greatest(floor(l_quantity) % 4, 0)) AS used FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def component_buildable(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("component_id"), (F.col("p_size") * 10).cast("double").alias("stock"))
    return P.buildable_by_component(_composition(spark, sf_dir), stock)


def _composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("product"), F.col("l_partkey").alias("component_id"), (F.floor("l_quantity") % 4).cast("double").alias("usage_qty"))


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth part stands under another id, so that items name components which are not there."""
    component = F.when(F.col("p_partkey") % 9 == 0, -F.col("p_partkey") - 1).otherwise(F.col("p_partkey"))
    return table(spark, sf_dir, "part").select(component.alias("component_id"), F.col("p_name").alias("name"), (F.col("p_size") * 3).cast("double").alias("stock"), F.col("p_retailprice").alias("unit_cost"))


_BOM = """c AS (SELECT l_orderkey AS product, l_partkey AS component_id, CAST(floor(l_quantity) % 4 AS DOUBLE) AS usage_qty FROM lineitem),
    p AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN -p_partkey - 1 ELSE p_partkey END AS component_id, p_name AS name, CAST(p_size * 3 AS DOUBLE) AS stock, p_retailprice AS unit_cost FROM part),
    u AS (SELECT product, component_id, sum(CASE WHEN usage_qty > 0 THEN usage_qty ELSE 1 END) AS used FROM c GROUP BY ALL)"""


@query(f"""WITH {_BOM} SELECT product, min(CAST(floor(stock / used) AS BIGINT)) AS buildable, sum(used * unit_cost) AS material_cost, string_agg(name || ' x ' || CAST(CAST(used AS BIGINT) AS VARCHAR), ' + ' ORDER BY component_id) AS recipe FROM u JOIN p USING (component_id) GROUP BY 1""")
def bom_buildable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.buildable(_composition(spark, sf_dir), _components(spark, sf_dir))


@query(f"WITH {_BOM} SELECT product, component_id, used FROM u")
def component_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.usage(_composition(spark, sf_dir))


@query(f"WITH {_BOM} SELECT product, component_id, usage_qty FROM c WHERE component_id IN (SELECT component_id FROM p)")
def valid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.valid_items(_composition(spark, sf_dir), _components(spark, sf_dir)).select("product", "component_id", "usage_qty")


_ROLES = "CASE WHEN component_id % 4 = 0 THEN 'main' ELSE 'accessory' END"


@query(
    f"""WITH {_BOM}, k AS (SELECT DISTINCT component_id % 50 AS product, component_id FROM c), d AS (SELECT DISTINCT product, CASE WHEN product % 2 = 0 THEN 'main' ELSE 'accessory' END AS role FROM k),
    o AS (SELECT product, component_id, {_ROLES} = role AS same FROM d, p WHERE (product, component_id) NOT IN (SELECT (product, component_id) FROM k))
    SELECT product, coalesce(min(component_id) FILTER (same), min(component_id)) AS component_id FROM o GROUP BY 1"""
)
def first_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = lambda n: F.when(n, "main").otherwise("accessory")
    used = _composition(spark, sf_dir).select((F.col("component_id") % 50).alias("product"), "component_id").distinct()
    components = _components(spark, sf_dir).withColumn("type", role(F.col("component_id") % 4 == 0))
    return P.first_unused(components, used.withColumn("role", role(F.col("product") % 2 == 0)))


@query(f"WITH {_BOM} SELECT count(*) AS n, sum(stock) AS quantity, sum(stock * unit_cost) AS purchase FROM p")
def stock_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.totals(_components(spark, sf_dir))


@query("SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey - 1 ELSE c_custkey END FROM customer) GROUP BY 1")
def unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third customer stands under another key."""
    known = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 == 0, -F.col("c_custkey") - 1).otherwise(F.col("c_custkey")).alias("known"))
    return table(spark, sf_dir, "orders").select("o_custkey").distinct().join(known, F.col("o_custkey") == F.col("known"), "left_anti")


@query("SELECT s_suppkey AS id, s_name AS name, 'supplier' AS kind FROM supplier UNION ALL SELECT c_custkey, c_name, 'customer' FROM customer")
def component_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return s.unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind")))


@query("SELECT p_partkey AS id, CASE WHEN regexp_matches(p_name, '1|2|3') THEN 'main' WHEN regexp_matches(p_name, '4|5') THEN 'accessory' WHEN length(trim(p_name)) > 0 THEN trim(p_name) ELSE 'accessory' END AS type FROM part")
def component_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), P.component_type(F.col("p_name"), [("1|2|3", "main"), ("4|5", "accessory")], "accessory").alias("type"))


_ALIASES = {"type": ["kind"], "name": ["item", "product"], "quantity": ["qty"], "unit_cost": ["unit cost"], "total_cost": ["total"]}


@query(
    f"""WITH p AS (SELECT *, coalesce(length(source) % 3, 2) AS form, doc_id = min(doc_id) OVER (PARTITION BY source) AS first, n_chars % 40 AS n, CASE WHEN n_chars % 40 = 0 THEN 1 ELSE n_chars % 40 END AS qty, CAST(doc_id % 977 AS DOUBLE) AS price FROM documents)
    SELECT source AS path, doc_id + 10 AS line, CASE WHEN form = 1 AND lang IS NOT NULL THEN lang WHEN first THEN '{P.MAIN}' ELSE '{P.ACCESSORY}' END AS type, 'sheet of ' || doc_id AS name, CAST(qty AS DOUBLE) AS quantity,
        CASE WHEN form = 1 THEN price / qty ELSE price END AS unit_cost FROM p"""
)
def sheet_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each source: a title, a blank line, a heading in one of two orders, or none of these, and a line for each document."""
    docs = table(spark, sf_dir, "documents").withColumn("form", F.coalesce(F.length("source") % 3, F.lit(2)))
    name, count = F.concat(F.lit("sheet of "), F.col("doc_id").cast("string")), (F.col("n_chars") % 40).cast("string")
    price = F.concat(F.lit("¥ "), (F.col("doc_id") % 977).cast("string"))
    line = F.when(F.col("form") == 1, F.array(count, name, "lang", price)).otherwise(F.array(name, count, price))
    data = docs.select(F.col("source").alias("path"), (F.col("doc_id") + 10).alias("line"), line.alias("cells"))
    words = lambda *w: F.array(*map(F.lit, w))
    heading = F.when(F.col("form") == 1, words("QTY (pcs)", "Product-name", "Kind", "Total")).otherwise(words("Item", "Qty", "Unit cost"))
    tops = F.array(F.struct(F.lit(1).alias("line"), words(" ", "").alias("cells")), F.struct(F.lit(2).alias("line"), heading.alias("cells")))
    top = docs.filter("form < 2").select(F.col("source").alias("path"), "form").distinct().select("path", F.explode(tops).alias("top")).select("path", F.col("top.line").cast("long").alias("line"), "top.cells")
    return P.typed_rows(top.unionByName(data), _ALIASES).select("path", "line", "type", "name", "quantity", "unit_cost")


@query("SELECT doc_id, lang, length(coalesce(text, '')) AS n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as delimited text, texts with their line breaks in quotes, written and read back in blocks."""
    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "sheets")
    sheets.with_mark(docs.select("doc_id", "text", "lang")).write.text(path)
    cell = lambda i: F.get("cells", F.lit(i))
    return sheets.read_delimited(spark, path, ",").select(cell(0).cast("long").alias("doc_id"), F.nullif(cell(2), F.lit("")).alias("lang"), F.length(cell(1)).cast("long").alias("n_chars"), F.sha2(cell(1), 256).alias("text_sha256"))


@query("""SELECT event_id, coalesce(TRY_CAST(nullif(regexp_extract(regexp_replace(t, '[%￥¥,\\s]', '', 'g'), '-?\\d+(\\.\\d+)?', 0), '') AS DOUBLE), 0) AS number FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props ELSE '¥ ' || CAST(event_id AS VARCHAR) || ',5' || CAST(event_id % 7 AS VARCHAR) || '.25 %' END AS t FROM events)""")
def lenient_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    t = F.when(n % 3 == 0, F.col("props")).otherwise(F.concat(F.lit("¥ "), n.cast("string"), F.lit(",5"), (n % 7).cast("string"), F.lit(".25 %")))
    return table(spark, sf_dir, "events").select("event_id", text.lenient_number(t).alias("number"))


_SESSIONS = """s AS (SELECT event_id, CAST(user_id % 30 + 1 AS INTEGER) AS desk, ts AS opened_at, CASE event_type WHEN 'click' THEN 'morning' WHEN 'error' THEN 'day' WHEN 'purchase' THEN '2h' WHEN 'signup' THEN 'night' ELSE 'other' END AS session_type FROM events),
    p AS (SELECT *, CASE session_type WHEN 'day' THEN 'countup' ELSE 'countdown' END AS mode, CASE session_type WHEN 'morning' THEN 14 WHEN 'day' THEN 21 WHEN 'night' THEN 21 END AS fixed_hour, CASE session_type WHEN '2h' THEN 120 WHEN 'other' THEN 60 END AS minutes, session_type IN ('morning', 'night') AS weekday_only FROM s),
    b AS (SELECT *, CASE WHEN mode = 'countdown' THEN opened_at + INTERVAL 10 MINUTE ELSE opened_at END AS start FROM p), e AS (SELECT *, CASE WHEN mode = 'countup' OR minutes IS NULL THEN date_trunc('day', start)::TIMESTAMP + fixed_hour * INTERVAL 1 HOUR ELSE start + minutes * INTERVAL 1 MINUTE END AS "end" FROM b)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "click", "morning").when(kind == "error", "day").when(kind == "purchase", "2h").when(kind == "signup", "night").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 30 + 1).cast("int").alias("desk"), F.col("ts").alias("opened_at"), name.alias("session_type"))


def _now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


@query(
    f"""WITH {_SESSIONS}, n AS (SELECT *, CAST(trunc(date_diff('microsecond', TIMESTAMP '{NOW}', "end") / 1000000.0) AS BIGINT) AS left_s FROM e)
    SELECT event_id, desk, mode, start, "end", NOT (weekday_only AND dayofweek(start) IN (0, 6)) AND (mode = 'countup' OR "end" > start) AS admissible,
    CASE WHEN TIMESTAMP '{NOW}' < start THEN 'preparing' WHEN mode = 'countup' THEN 'infinit' WHEN left_s <= 0 THEN 'timeout' WHEN left_s > 1800 THEN 'normal' WHEN left_s > 600 THEN 'ending' ELSE 'urgent' END AS status,
    CASE WHEN mode = 'countup' THEN 0 ELSE greatest(0, -left_s) END AS over_seconds, CASE WHEN desk <= 6 THEN 'window' WHEN desk <= 16 THEN 'table1' ELSE 'table2' END AS region FROM n"""
)
def desk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.desk_status(_sessions(spark, sf_dir), _now()).select("event_id", "desk", "mode", "start", "end", "admissible", "status", "over_seconds", "region")


@query(
    """WITH x AS (SELECT event_id, CAST(floor(value * 60) AS BIGINT) AS seconds, hour(ts) AS h FROM events), m AS (SELECT *, ceil(seconds / 60.0) AS m, ceil(ceil(seconds / 60.0) / 30.0) AS b FROM x)
    SELECT event_id, CASE WHEN seconds <= 600 THEN 0 ELSE floor(b / 2) * CASE WHEN h >= 21 THEN 50 ELSE 20 END + (b % 2) * CASE WHEN h >= 21 THEN 30 ELSE 10 END END::DOUBLE AS fee, CASE WHEN seconds <= 600 THEN 0 ELSE CAST(b * 30 AS INTEGER) END AS charged FROM m"""
)
def overtime_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    fee, charged = money.overtime(F.floor(F.col("value") * 60), F.hour("ts"))
    return table(spark, sf_dir, "events").select("event_id", fee.alias("fee"), charged.alias("charged"))


_CLOSE = f"""{_SESSIONS}, k AS (SELECT event_id, desk, start, "end", CASE WHEN event_id % 6 = 0 THEN start + INTERVAL 40 MINUTE ELSE start + INTERVAL 200 MINUTE END AS closed_at, event_id % 5 * 60 AS paused_seconds, CAST(event_id % 3 * 10 AS DOUBLE) AS extra_fee FROM e),
    o AS (SELECT *, greatest(0, CAST(trunc(date_diff('microsecond', "end", closed_at) / 1000000.0) AS BIGINT)) AS over_seconds FROM k), q AS (SELECT *, ceil(ceil(over_seconds / 60.0) / 30.0) AS b, hour("end") AS h FROM o),
    r AS (SELECT event_id, desk, closed_at, CAST(ceil(greatest(0, CAST(trunc(date_diff('microsecond', start, closed_at) / 1000000.0) AS BIGINT) - paused_seconds) / 60.0) AS INTEGER) AS minutes, over_seconds,
        CASE WHEN over_seconds <= 600 THEN 0 ELSE floor(b / 2) * CASE WHEN h >= 21 THEN 50 ELSE 20 END + (b % 2) * CASE WHEN h >= 21 THEN 30 ELSE 10 END END::DOUBLE AS timeout_fee, extra_fee FROM q)"""


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    s = S.with_preset(_sessions(spark, sf_dir))
    s = s.withColumn("start", S.start_at(F.col("opened_at"), F.col("mode")))
    s = s.withColumn("end", S.end_at(F.col("start"), F.col("mode"), F.col("fixed_hour"), F.col("minutes"))).drop("minutes")
    s = s.withColumns({"pause_start": F.when(n % 6 == 0, F.col("start") + F.expr("INTERVAL 40 MINUTES")), "paused_seconds": n % 5 * 60, "extra_fee": (n % 3 * 10).cast("double")})
    return S.checkout(s, F.col("start") + F.expr("INTERVAL 200 MINUTES"))


@query(f"WITH {_CLOSE} SELECT event_id, closed_at, minutes, over_seconds, timeout_fee, extra_fee + timeout_fee AS total_fee FROM r")
def checkout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closed(spark, sf_dir).select("event_id", "closed_at", "minutes", "over_seconds", "timeout_fee", "total_fee")


@query(
    f"""WITH {_SESSIONS}, a AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN start + INTERVAL 40 MINUTE ELSE TIMESTAMP '{NOW}' END AS anchor FROM e),
    o AS (SELECT *, CASE WHEN mode = 'countdown' THEN greatest(0, CAST(trunc(date_diff('microsecond', "end", anchor) / 1000000.0) AS BIGINT)) ELSE 0 END AS over_seconds, hour("end") AS h FROM a), q AS (SELECT *, ceil(ceil(over_seconds / 60.0) / 30.0) AS b FROM o)
    SELECT event_id, greatest(0, CAST(trunc(date_diff('microsecond', start, anchor) / 1000000.0) AS BIGINT) - event_id % 5 * 60) AS elapsed, CAST(over_seconds // 60 AS INTEGER) AS over_minutes,
        CASE WHEN over_seconds <= 600 THEN 0 ELSE floor(b / 2) * CASE WHEN h >= 21 THEN 50 ELSE 20 END + (b % 2) * CASE WHEN h >= 21 THEN 30 ELSE 10 END END::DOUBLE AS timeout_fee FROM q"""
)
def desk_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    s = S.with_preset(_sessions(spark, sf_dir))
    s = s.withColumn("start", S.start_at(F.col("opened_at"), F.col("mode")))
    s = s.withColumn("end", S.end_at(F.col("start"), F.col("mode"), F.col("fixed_hour"), F.col("minutes")))
    s = s.withColumns({"pause_start": F.when(n % 6 == 0, F.col("start") + F.expr("INTERVAL 40 MINUTES")), "paused_seconds": n % 5 * 60})
    return S.details(s, _now()).select("event_id", "elapsed", "over_minutes", "timeout_fee")


@query(f"WITH {_CLOSE}, d AS (SELECT CAST(closed_at AS DATE) AS date, count(DISTINCT desk) AS desks, sum(extra_fee + timeout_fee) AS revenue, count(*) AS records FROM r GROUP BY 1) SELECT *, sum(revenue) OVER (ORDER BY date) AS revenue_so_far FROM d")
def daily_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.daily_ledger(_closed(spark, sf_dir).select(F.to_date("closed_at").alias("date"), "desk", "total_fee"))


_LIVE = f"""t AS (SELECT event_id AS table_id, ts + INTERVAL 1 HOUR AS "end", event_id % 9 = 0 AS paused FROM events), c AS (SELECT table_id, CASE WHEN paused THEN 'paused' WHEN left_s <= 0 THEN 'overtime' WHEN left_s <= 600 THEN 'warning' ELSE 'running' END AS class FROM (SELECT *, date_diff('second', TIMESTAMP '{NOW}', "end") AS left_s FROM t))"""


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timer for each event."""
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("table_id"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("end"), (F.col("event_id") % 9 == 0).alias("paused"))
    return t.select("table_id", S.live_class(F.col("end"), _now(), F.col("paused")).alias("class"))


@query(f"WITH {_LIVE} SELECT class, table_id, row_number() OVER (PARTITION BY class ORDER BY table_id) AS rank FROM c")
def live_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.by_class(_live(spark, sf_dir))


@query(f"WITH {_LIVE} SELECT class, count(*) AS n FROM c GROUP BY 1")
def live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.class_counts(_live(spark, sf_dir))


_READ = """d AS (SELECT user_id AS table_id, ts, date_trunc('day', ts)::TIMESTAMP + INTERVAL 20 HOUR AS "end" FROM events), l AS (SELECT *, CAST(trunc(date_diff('microsecond', ts, "end") / 1000000.0) AS BIGINT) AS "left" FROM d)"""


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("table_id"), "ts", (F.date_trunc("day", "ts") + F.expr("INTERVAL 20 HOURS")).cast("timestamp_ntz").alias("end"))
    return r.withColumn("left", clock.seconds_between(F.col("ts"), F.col("end")))


@query(f"""WITH {_READ}, b AS (SELECT *, lag("left") OVER (PARTITION BY table_id, "end" ORDER BY ts) AS before FROM l), c AS (SELECT *, row_number() OVER (PARTITION BY table_id, "end" ORDER BY ts) AS k FROM b WHERE "left" <= 7200 AND "left" > 0 AND before > 7200) SELECT table_id, ts, "end", "left" FROM c WHERE k = 1""")
def ten_minute_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a bound of two hours: the events are too sparse for one of ten minutes."""
    return S.crossings(_readings(spark, sf_dir), 7200)


@query(f"""WITH {_READ}, s AS (SELECT table_id AS desk, ts, CASE WHEN "left" <= 0 THEN 'timeout' ELSE 'normal' END AS status FROM l), b AS (SELECT *, lag(status) OVER (PARTITION BY desk ORDER BY ts) AS before FROM s) SELECT desk, ts FROM b WHERE status = 'timeout' AND before IS DISTINCT FROM 'timeout'""")
def first_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir)
    return S.first_entries(r.select(F.col("table_id").alias("desk"), "ts", F.when(F.col("left") <= 0, "timeout").otherwise("normal").alias("status")))


@query(f"""WITH {_SESSIONS} SELECT CASE WHEN desk <= 6 THEN 'window' WHEN desk <= 16 THEN 'table1' ELSE 'table2' END AS region, count(*) FILTER (session_type <> 'other') AS "using", count(*) FILTER (session_type = 'other') AS empty, count(*) FILTER (session_type = '2h') AS timeout, count(*) FILTER (session_type = 'night') AS ending FROM s GROUP BY 1""")
def desk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("session_type")
    status = F.when(k == "other", "empty").when(k == "2h", "timeout").when(k == "night", "urgent").otherwise("normal")
    return S.desk_counts(_sessions(spark, sf_dir).select(S.region(F.col("desk")).alias("region"), status.alias("status")))


@query("""SELECT d.id, coalesce(s.status, 'empty') AS status, coalesce(s.fee, 0) AS fee FROM (SELECT range AS id FROM range(1, 31)) d FULL JOIN (SELECT user_id AS id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS fee FROM events GROUP BY 1) s ON d.id = s.id WHERE d.id IS NOT NULL
    UNION ALL SELECT user_id, arg_max(event_type, event_id), arg_max(value, event_id) FROM events WHERE user_id < 1 OR user_id > 30 GROUP BY 1""")
def saved_desks(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = spark.range(1, 31).select("id", F.lit("empty").alias("status"), F.lit(0.0).alias("fee"))
    saved = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("value").alias("fee"), F.col("event_id").alias("seq"))
    return S.overlay_saved(defaults, saved, "id")


_HOUSE = """d AS (SELECT s_suppkey AS id, s_nationkey % 2 AS house, 'r' || CAST(s_suppkey % 3 AS VARCHAR) AS region, CASE WHEN s_suppkey % 4 < 2 THEN 'empty' ELSE 'normal' END AS status, CASE WHEN s_suppkey % 4 = 2 THEN 'vip' END AS note, s_acctbal AS fee FROM supplier)"""


def _desks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        n.alias("id"), (F.col("s_nationkey") % 2).alias("house"), F.concat(F.lit("r"), (n % 3).cast("string")).alias("region"), F.when(n % 4 < 2, "empty").otherwise("normal").alias("status"), F.when(n % 4 == 2, "vip").alias("note"), F.col("s_acctbal").alias("fee")
    )


@query(f"WITH {_HOUSE} SELECT a.id AS source, b.id AS target FROM d a JOIN d b ON a.house = b.house AND a.status <> 'empty' AND b.status = 'empty'")
def move_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.move_pairs(_desks(spark, sf_dir))


@query(
    f"""WITH {_HOUSE}, m AS (SELECT s_suppkey AS source, s_suppkey + 1 + s_suppkey % 3 AS target FROM supplier), f AS (SELECT min(source) AS source, target FROM (SELECT source, min(target) AS target FROM m GROUP BY 1) GROUP BY target),
    v AS (SELECT f.source, f.target, a.note, a.status, a.fee, a.house FROM f JOIN d a ON a.id = f.source AND a.status <> 'empty' JOIN d b ON b.id = f.target AND b.status = 'empty')
    SELECT d.id, d.region, coalesce(v.status, CASE WHEN u.source IS NOT NULL THEN 'empty' ELSE d.status END) AS status, CASE WHEN v.source IS NOT NULL THEN substr(CASE WHEN coalesce(v.note, '') <> '' THEN v.note || '；' ELSE '' END || '由 ' || CAST(v.source AS VARCHAR) || ' 换至 ' || CAST(v.target AS VARCHAR), 1, 80) WHEN u.source IS NULL THEN d.note END AS note,
        CASE WHEN v.source IS NOT NULL THEN v.fee WHEN u.source IS NOT NULL THEN 0 ELSE d.fee END AS fee FROM d LEFT JOIN v ON v.target = d.id LEFT JOIN v u ON u.source = d.id"""
)
def desk_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    moves = table(spark, sf_dir, "supplier").select(n.alias("source"), (n + 1 + n % 3).alias("target"))
    return S.move(_desks(spark, sf_dir).drop("house"), moves, {"status": "empty", "fee": 0.0})
