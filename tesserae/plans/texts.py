"""Queries on texts, orders and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import clock, hashing, text
from tesserae.operators import orders as O
from tesserae.operators import claims as C
from tesserae.operators import textrules as R
from tesserae.plans.derived import NOW, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


#: Dictionaries for the invented language of the test documents; users bring their own.
RULES = R.Rules(
    instructional=("must ", "should "),
    marketing=("best", "offer"),
    negative=("idiot", "loser"),
    project_words={"src1": ("clown",)},
    claims={
        "unprovided_time": R.Claim(words=("tion on", "with the")),
        "unprovided_duration": R.Claim(pattern="[0-9]+ ?(min|h)"),
        "unprovided_package": R.Claim(words=("token",), gate="src2"),
        "unprovided_detail": R.Claim(words=("ing in",), projects=("src3", "src4")),
        "unprovided_staff": R.Claim(words=("er er",), gate="none", except_for=("src5",)),
    },
    formal=("^The .{0,40} the ", "of.{0,6}and.{0,6}to"),
    topics=(("the", "der", "la"), ("tion", "keit", "mente"), ("er",), ("and", "und"), ("on",), ("ing", "ung")),
    project_topics={"src6": ("was",)},
    signature=("thin", "thou", "ento", "eder", "tion", "sche"),
    aliases={"src7": "src8"},
    projects=tuple(f"src{i}" for i in range(12)),
)


def _strings(words: tuple[str, ...] | list[str], subject: str = "t") -> str:
    return "(" + " OR ".join(f"contains({subject}, '{w}')" for w in words) + ")" if words else "false"


_S = "\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


def _trimmed(sql: str) -> str:
    return f"regexp_replace({sql}, '^[{_S}]+|[{_S}]+$', '', 'g')"


_BARE = f"regexp_replace(regexp_replace({_trimmed('text')}, '^```(json|text)?', '', 'i'), '```$', '')"
_BARE = f"""regexp_replace(regexp_replace({_BARE}, '^["“”''‘’]+|["“”''‘’]+$', '', 'g'), '^(评价|点评|文案|输出|review)[{_S}]*[:：][{_S}]*', '', 'i')"""
_STRIP = _trimmed(f"regexp_replace({_BARE}, '[{_S}]*\\n[{_S}]*', ' ', 'g')")
_TOPICS = " + ".join(f"{_strings(g)}::INT" for g in RULES.topics) + f" + CASE WHEN source = 'src6' THEN {_strings(('was',))} ELSE contains(t, source) END::INT"


@query(
    f"""WITH d AS (SELECT doc_id, source, {_STRIP} AS t, CASE WHEN doc_id % 3 = 0 THEN lang || ' with the' ELSE lang END AS k FROM documents)
    SELECT doc_id, CASE WHEN t = '' THEN 'empty' WHEN length(trim(t)) NOT BETWEEN 75 AND 250 THEN 'length' WHEN {_strings(RULES.instructional)} THEN 'instructional'
    WHEN {_strings(RULES.marketing)} OR {_strings(RULES.negative)} OR length(t) - length(replace(t, '！', '')) + length(t) - length(replace(t, '!', '')) > 1 OR (source = 'src1' AND contains(t, 'clown')) THEN 'bad_words'
    WHEN (contains(t, 'tion on') AND NOT contains(k, 'tion on')) OR (contains(t, 'with the') AND NOT contains(k, 'with the')) THEN 'unprovided_time'
    WHEN regexp_matches(t, '[0-9]+ ?(min|h)') AND NOT regexp_matches(k, '[0-9]+ ?(min|h)') THEN 'unprovided_duration' WHEN contains(t, 'token') AND NOT regexp_matches(k, 'src2') THEN 'unprovided_package'
    WHEN contains(t, 'ing in') AND NOT contains(k, 'ing in') AND source IN ('src3', 'src4') THEN 'unprovided_detail' WHEN contains(t, 'er er') AND source <> 'src5' THEN 'unprovided_staff'
    WHEN regexp_matches(t, '^The .{{0,40}} the ') OR regexp_matches(t, 'of.{{0,6}}and.{{0,6}}to') THEN 'formal' WHEN {_TOPICS} < 3 THEN 'low_reference_value' ELSE '' END AS reason FROM d"""
)
def text_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit(" with the"))).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", R.first_reason(F.col("text"), F.col("source"), keywords, RULES).alias("reason"))


@query(f"SELECT doc_id, {_TOPICS} AS topics, ({_TOPICS}) >= 3 AS covered, length(t) - length(replace(t, ',', '')) AS commas, length(trim(t)) AS size FROM (SELECT doc_id, source, text AS t FROM documents)")
def text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.topics_hit(F.col("text"), F.col("source"), RULES)
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("topics"), (hits >= R.LEAST_TOPICS).alias("covered"), text.occurrences(F.col("text"), ",").alias("commas"), text.length(F.col("text")).alias("size"))


#: What documents are made to say, and the keywords that come with them; by doc_id, so that every claim meets every keyword.
_SAID = ("周末来", "拼了两个多小时", "３０分钟", "做成钥匙扣", "挂在包上", "送袋子", "免费", "全天套餐", "豆子平整又无孔", "灯光明亮", "打图纸", "大图 大作品", "没有什么")
_KEYWORDS = ("", "周末 大作品", "半小时", "钥匙扣 包装", "包 图纸", "质量 环境", "免费 袋子", "座位")


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(
    f"""WITH t AS (SELECT doc_id, coalesce(text, '') || {_sql_list(_SAID)}[doc_id % {len(_SAID)} + 1] AS t, {_sql_list(_KEYWORDS)}[doc_id // {len(_SAID)} % {len(_KEYWORDS)} + 1] AS k, CASE WHEN doc_id % 5 < 3 THEN '{C.QUALITY_PROJECT}' ELSE coalesce(source, '') END AS p FROM documents)
    SELECT doc_id, CASE WHEN len(list_filter({_sql_list(C.TIME_WORDS)}, lambda w: contains(t, w) AND NOT contains(k, w))) > 0 THEN 'unprovided_time'
        WHEN regexp_matches(t, '{C.DURATION}') AND NOT regexp_matches(k, '{C.DURATION}') THEN 'unprovided_duration'
        WHEN {" OR ".join(f"regexp_matches(t, '{said}') AND NOT regexp_matches(k, '{gate}')" for said, gate in C.USES)} THEN 'unsupported_use'
        WHEN NOT regexp_matches(k, '{C.PACKAGE_KEYWORDS}') AND len(list_filter({_sql_list(C.PACKAGE_WORDS)}, lambda w: contains(t, w))) > 0 THEN 'unprovided_package'
        WHEN p = '{C.QUALITY_PROJECT}' AND NOT regexp_matches(k, '{C.QUALITY_KEYWORDS}') AND len(list_filter({_sql_list(C.QUALITY_WORDS)}, lambda w: contains(t, w))) > 0 THEN 'unprovided_quality'
        WHEN NOT regexp_matches(k, '{C.PLACE_KEYWORDS}') AND len(list_filter({_sql_list(C.PLACE_WORDS)}, lambda w: contains(t, w))) > 0 THEN 'unprovided_environment'
        WHEN regexp_matches(t, '{C.PRINT}') AND NOT regexp_matches(k, '{C.PRINT_KEYWORDS}') THEN 'unprovided_print' ELSE '' END AS reason FROM t"""
)
def claim_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with something said at their end, against keywords that support some of it."""
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), (n % len(words)).cast("int"))
    n = F.col("doc_id")
    said = F.concat(F.coalesce("text", F.lit("")), pick(_SAID, n))
    project = F.when(n % 5 < 3, C.QUALITY_PROJECT).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", R.first_broken_claim(said, pick(_KEYWORDS, F.floor(n / len(_SAID))), project, C.PRESETS).alias("reason"))


@query(
    """WITH c AS (SELECT conv_id, turn, trim(text) AS t, list_filter(['thin', 'thou', 'ento', 'eder', 'tion', 'sche'], lambda w: contains(trim(text), w)) AS s FROM conversations),
    n AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS k FROM c)
    SELECT a.conv_id, a.turn, a.t = '' OR coalesce(bool_or(b.t = a.t OR (len(a.s) > 0 AND len(list_intersect(a.s, b.s)) >= 2)), false) AS similar FROM n a LEFT JOIN n b ON b.k BETWEEN a.k - 30 AND a.k - 1 GROUP BY a.conv_id, a.turn, a.t"""
)
def near_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns are one history."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("all").alias("history"), "text")
    return R.near_repeats(turns, ["history"], ["conv_id", "turn"], RULES).select("conv_id", "turn", "similar")


@query(
    """SELECT page_id, upper(regexp_replace(c, '(?i)^([A-Z]+)0+([0-9]+)$', '\\1\\2')) AS code, regexp_replace(lower(trim(u)), '[（）()【】\\[\\]\\s_\\-/:：,，.。]', '', 'g') AS header, regexp_extract(lower(url), '\\.([a-z0-9]+)$', 1) AS ext, right(lpad(d, greatest(2, length(d))::INT, '0'), 2) AS digits,
    regexp_replace(trim(url), '/+$', '') AS base, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, coalesce(nullif(substr(trim(u), 1, 20), ''), 'none') AS short FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN 'ab00' || CAST(page_id AS VARCHAR) WHEN 1 THEN 'Q0x' ELSE 'A0' || CAST(page_id AS VARCHAR) || 'x' END AS c, 'AB00' || CAST(page_id AS VARCHAR) || ' (x)' AS u, regexp_replace(url, '[^0-9]', '', 'g') AS d FROM pages)"""
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.concat(F.lit("AB00"), F.col("page_id").cast("string"), F.lit(" (x)"))
    n = F.col("page_id").cast("string")
    c = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("ab00"), n)).when(F.col("page_id") % 3 == 1, "Q0x").otherwise(F.concat(F.lit("A0"), n, F.lit("x")))
    return table(spark, sf_dir, "pages").select(
        "page_id", text.code(c).alias("code"), text.header(u).alias("header"), text.extension(F.col("url")).alias("ext"), text.last_digits(F.col("url")).alias("digits"), text.base_url(F.col("url")).alias("base"), text.escape_html(F.col("html")).alias("escaped"), text.clean(u, "none", 20).alias("short")
    )


_NOISY = "CASE page_id % 5 WHEN 0 THEN ' see ftp://x.y/z。' || html WHEN 1 THEN '复制所有描述#*ABC123x*#5@ ' || html WHEN 2 THEN '\u00a0\u200ba\u202e\tb\x07\n' || html || '#*zz99zz*#1' WHEN 3 THEN '  é각q̣̇ ' || replace(html, 'e', 'ë') ELSE regexp_replace(html, '[@:]', '', 'g') END"
_LINK = """"''<>，。！？、；：）)】\\]"""


@query(
    f"""WITH n AS (SELECT page_id, {_NOISY} AS t FROM pages), a AS (SELECT page_id, t, regexp_replace(regexp_replace(nfc_normalize(t), 'https?://[^{_S}{_LINK}]+', '', 'gi'), '(^|[{_S}])[0-9a-z][0-9a-z.+-]*://[^{_S}{_LINK}]+', ' ', 'gi') AS x FROM n),
    b AS (SELECT page_id, t, replace(regexp_replace(regexp_replace(x, '复制所有描述#\\*[a-z0-9]{{6,}}\\*#[0-9]?@?', '', 'gi'), '#\\*[a-z0-9]{{6,}}\\*#[0-9]?@?', '', 'gi'), chr(160), ' ') AS x FROM a),
    c AS (SELECT page_id, t, regexp_replace(regexp_replace(x, '[\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{FEFF}}]', '', 'g'), '[{_S.replace(chr(92) + "n", "").replace(chr(92) + "r", "")}]+', ' ', 'g') AS x FROM b)
    SELECT page_id, {_trimmed("regexp_replace(x, '[" + chr(92) + "x00-" + chr(92) + "x08" + chr(92) + "x0B" + chr(92) + "x0C" + chr(92) + "x0E-" + chr(92) + "x1F" + chr(92) + "x7F]', '', 'g')")} AS clean,
    {_trimmed("t")} <> '' AND NOT regexp_matches({_trimmed("t")}, '(?i)https?://|(^|[{_S}])[a-z][a-z0-9.+-]*://|复制所有描述|后到|#\\*[a-z0-9]{{6,}}\\*#|@[^{_S}]{{1,20}}') AS safe FROM c"""
)
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with links, share tokens, odd white space and nothing put in."""
    return table(spark, sf_dir, "pages").withColumn("t", F.expr(_NOISY.replace("regexp_replace(html, '[@:]', '', 'g')", "regexp_replace(html, '[@:]', '')"))).select("page_id", text.sanitize(F.col("t")).alias("clean"), text.safe_to_copy(F.col("t")).alias("safe"))


@query(
    """WITH d AS (SELECT doc_id, regexp_split_to_array(text, '[,，、;；|/\\r\\n]+') AS l FROM documents), t AS (SELECT doc_id, trim(unnest(l)) AS x, unnest(range(len(l))) AS i FROM d),
    u AS (SELECT doc_id, x, min(i) AS i FROM t WHERE x <> '' GROUP BY 1, 2), s AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM u)
    SELECT d.doc_id, coalesce(string_agg(x, ',' ORDER BY i) FILTER (n <= 100), '') AS tokens FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY 1"""
)
def keyword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.distinct_tokens(F.col("text")).alias("tokens"))


@query(
    """WITH t AS (SELECT doc_id, lang, list_sort(list_distinct(list_concat([lang, source], CASE WHEN doc_id % 2 = 0 THEN ['src1', lang] ELSE ['extra'] END))) AS pool FROM documents)
    SELECT doc_id, array_to_string(pool, ',') AS pool, array_to_string(list_filter(pool, lambda x: x <> lang), ',') AS without FROM t"""
)
def keyword_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("src1"), F.col("lang"))).otherwise(F.array(F.lit("extra")))
    pool = F.array_sort(F.array_distinct(F.concat(F.array("lang", "source"), more)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(pool, ",").alias("pool"), F.array_join(F.array_except(pool, F.array("lang")), ",").alias("without"))


@query("""SELECT c_custkey AS id, upper(lpad(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0')) AS fnv, sha256(c_name) AS sha FROM customer""")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), hashing.fnv1a(F.col("c_name")).alias("fnv"), F.sha2("c_name", 256).alias("sha"))


@query()
def crc_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL has no such function; a test holds it against zlib's."""
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32("text").alias("crc"))


@query("""SELECT doc_id, upper(lpad(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(concat_ws('|', lang, source, n_chars), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0')) AS fingerprint FROM documents""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hashing.fingerprint(F.col("lang"), F.col("source"), F.col("n_chars")).alias("fingerprint"))


@query("""SELECT o_orderkey // 800 AS y, o_orderkey % 800 // 8 AS byte, sum(CASE WHEN o_custkey % 3 = 0 THEN 1 << (7 - o_orderkey % 8)::INT ELSE 0 END) AS bits, count(*) FILTER (o_custkey % 3 = 0) AS black FROM orders GROUP BY ALL""")
def raster_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, black = F.col("o_orderkey"), F.col("o_custkey") % 3 == 0
    return table(spark, sf_dir, "orders").groupBy(F.floor(n / 800).alias("y"), F.floor(n % 800 / 8).alias("byte")).agg(hashing.packed_bits(n, black).alias("bits"), F.count_if(black).alias("black"))


@query(
    f"""WITH o AS (SELECT event_id, ts AS submitted_at, CAST(ts + INTERVAL 8 HOUR AS DATE) AS date FROM events) SELECT event_id, submitted_at, date FROM o
    WHERE date BETWEEN CAST(TIMESTAMP '{NOW}' + INTERVAL 8 HOUR AS DATE) - 6 AND CAST(TIMESTAMP '{NOW}' + INTERVAL 8 HOUR AS DATE) AND submitted_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY"""
)
def recent_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("submitted_at"))
    dated = events.withColumn("date", F.to_date(F.col("submitted_at") + F.expr("INTERVAL 8 HOURS")))
    now = F.lit(NOW).cast("timestamp_ntz")
    found = O.recent(dated.withColumn("submitted_at", F.col("submitted_at")), now)
    return found


@query("""WITH n AS (SELECT event_id, event_type || CAST(user_id AS VARCHAR) AS title, ts, row_number() OVER (PARTITION BY event_type || CAST(user_id AS VARCHAR) ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT event_id, title, ts FROM n WHERE k = 1 ORDER BY ts DESC, event_id DESC LIMIT 18""")
def latest_per_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.col("user_id").cast("string")).alias("title"), "ts")
    return O.latest(items, "title", [F.desc("ts"), F.desc("event_id")])


@query("""SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5""")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.bounded_history(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 5)


@query("""SELECT event_id, ts, coalesce(lag(event_type) OVER w = event_type AND date_diff('microsecond', lag(ts) OVER w, ts) < 3600 * 24 * 1000000::BIGINT, false) AS cached FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cached(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", "event_type", "ts", 24 * 3600).select("event_id", "ts", "cached")


def _magic(n: Column) -> Column:
    return F.when(n % 4 == 0, F.unhex(F.lit("FFD8FF00"))).when(n % 4 == 1, F.unhex(F.lit("89504E470D0A1A0A00"))).otherwise(F.unhex(F.lit("255044462D31")))


@query(
    """WITH f AS (SELECT event_id AS id, 'file.' || ['jpg', 'png', 'pdf', 'gif', 'jpeg'][1 + event_id % 5] AS name, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 < 4 THEN 'image/jpeg' ELSE 'application/pdf' END AS mime, CAST(floor(value * 4000000) AS BIGINT) % 25000000 - 100000 AS size,
        CASE event_id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' ELSE 'pdf' END AS magic FROM events), e AS (SELECT *, regexp_extract(name, '\\.([a-z]+)$', 1) AS ext FROM f)
    SELECT id, CASE WHEN ext NOT IN ('png', 'jpg', 'jpeg', 'pdf') THEN 'extension' WHEN size <= 0 THEN 'empty' WHEN size > 20971520 THEN 'size' WHEN mime <> '' AND mime <> CASE ext WHEN 'png' THEN 'image/png' WHEN 'pdf' THEN 'application/pdf' ELSE 'image/jpeg' END THEN 'type'
    WHEN magic <> CASE WHEN ext = 'jpeg' THEN 'jpg' ELSE ext END THEN 'content' ELSE '' END AS fault FROM e"""
)
def upload_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    name = F.concat(F.lit("file."), F.get(F.array(*map(F.lit, ("jpg", "png", "pdf", "gif", "jpeg"))), (n % 5).cast("int")))
    mime = F.when(n % 7 == 0, "").when(n % 7 < 4, "image/jpeg").otherwise("application/pdf")
    size = F.floor(F.col("value") * 4000000) % 25000000 - 100000
    return table(spark, sf_dir, "events").select(n.alias("id"), O.fault(name, mime, size, _magic(n)).alias("fault"))


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M') AS clock, dayofweek(ts) IN (0, 6) AS weekend, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS run,
    ((year(ts) - 1980) << 9) | (month(ts) << 5) | day(ts) AS dos_date, (hour(ts) << 11) | (minute(ts) << 5) | (second(ts) // 2) AS dos_time, date_trunc('day', ts)::TIMESTAMP + least(23, user_id % 40) * INTERVAL 1 HOUR + least(59, event_id % 70) * INTERVAL 1 MINUTE AS put FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) AS s FROM events)"""
)
def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    date, time = clock.dos_time(ts)
    typed = F.concat((F.col("user_id") % 40).cast("string"), F.lit(":"), (F.col("event_id") % 70).cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", clock.date_key(ts).alias("day"), clock.clock(ts).alias("clock"), clock.is_weekend(ts).alias("weekend"), clock.duration_clock(F.col("value") * 100).alias("run"), date.alias("dos_date"), time.alias("dos_time"), clock.at_time(ts, typed).cast("timestamp_ntz").alias("put")
    )


@query("""SELECT o_orderkey AS id, CAST(o_orderkey % 700 AS INTEGER) AS sheet_column FROM orders""")
def sheet_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings A to ZX of numbers below 700, and the numbers back from them."""
    n = F.col("o_orderkey") % 700
    letters = F.concat(F.when(n >= 26, F.chr(F.floor(n / 26) + 64)).otherwise(""), F.chr(n % 26 + 65))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.column_index(letters).alias("sheet_column"))


@query("""WITH v AS (SELECT label, vec_id, embedding FROM embeddings), m AS (SELECT label AS m_label, i, avg(embedding[i]::DOUBLE) AS x FROM v, range(1, 65) t(i) GROUP BY ALL), d AS (SELECT vec_id, m_label, sum((embedding[i]::DOUBLE - x) * (embedding[i]::DOUBLE - x)) AS d FROM v, m GROUP BY ALL) SELECT vec_id, arg_min(m_label, (d, m_label)) AS nearest FROM d GROUP BY 1""")
def embedding_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest mean of a label: the means are one row for each label."""
    v = table(spark, sf_dir, "embeddings")
    means = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    every = means.agg(F.array_sort(F.collect_list(F.struct("label", "mean"))).alias("means"))  # one row, labels x dimensions numbers
    far = lambda m: F.aggregate(F.zip_with("embedding", m["mean"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("means", lambda m: F.struct(far(m).alias("d"), m["label"].alias("label"))))
    return v.join(every, F.lit(True)).select("vec_id", best["label"].alias("nearest"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN lang || ' [' || source || ']' ELSE lang END AS title, CASE doc_id % 3 WHEN 0 THEN '（' || source || '）' WHEN 1 THEN '(' || source || ')' ELSE '' END AS sub, byte_size FROM (SELECT doc_id, lang, source, CASE WHEN n_chars < 1024 THEN CAST(n_chars AS VARCHAR) || ' B' ELSE printf('%.1f', floor(n_chars / 1024.0::DOUBLE * 10 + 0.5) / 10) || ' KB' END AS byte_size FROM documents)""")
def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 3
    title, sub = text.split_label(F.when(n == 0, F.concat("lang", F.lit("（"), "source", F.lit("）"))).when(n == 1, F.concat("lang", F.lit(" ("), "source", F.lit(")"))).otherwise(F.concat("lang", F.lit(" ["), "source", F.lit("]"))))
    return table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), sub.alias("sub"), text.byte_size(F.col("n_chars")).alias("byte_size"))


@query("""SELECT event_id, rank FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY (CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 1 END) DESC, event_id) AS rank FROM events) WHERE rank <= 3""")
def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows of one key, those of the sources of highest priority."""
    score = F.when(F.col("event_type") == "click", 3).when(F.col("event_type") == "view", 2).otherwise(1)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(score), "event_id"))
    return table(spark, sf_dir, "events").select("event_id", rank.alias("rank")).filter("rank <= 3")


@query(
    r"""SELECT c_custkey AS id, CASE WHEN e = 'png' THEN 'image/png' WHEN e IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN e = 'pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime,
    replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, regexp_replace(regexp_replace(trim(t), '[\\/:*?"<>|\s]+', '-', 'g'), '^-+|-+$', '', 'g') AS file_name, array_to_string(list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS list,
    CASE WHEN c_custkey % 3 = 0 THEN '10.0.0.' || CAST(c_custkey AS VARCHAR) WHEN c_custkey % 3 = 1 THEN 'real' ELSE 'unknown' END AS ip, c_name || '.' || e AS title_of, c_name AS title, c_custkey % 4 < 3 AS listed,
    greatest(3000, least(30000, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10 ELSE 15000 END)) AS timeout, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END AS number, NOT (c_custkey % 6 = 0) AS shown
    FROM (SELECT *, ' <' || c_name || ', "' || c_mktsegment || '" & ,, /x? ' AS t, ['png', 'jpg', 'jpeg', 'pdf', 'txt'][1 + c_custkey % 5] AS e FROM customer)"""
)
def import_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.functions import layout

    n = F.col("c_custkey")
    t = F.concat(F.lit(" <"), "c_name", F.lit(', "'), "c_mktsegment", F.lit('" & ,, /x? '))
    e = F.get(F.array(*map(F.lit, ("png", "jpg", "jpeg", "pdf", "txt"))), (n % 5).cast("int"))
    name = F.concat("c_name", F.lit("."), e)
    forwarded = F.when(n % 3 == 0, F.concat(F.lit(" 10.0.0."), n.cast("string"), F.lit(" , 1.1.1.1")))
    project = F.when(n % 4 == 0, "src7").when(n % 4 == 1, "src8").when(n % 4 == 2, " src1 ").otherwise("src99")
    classes = F.array(F.struct(F.lit("other").alias("class"), F.lit(0.99).alias("probability")), F.struct(F.lit("adult").alias("class"), F.when(n % 6 == 0, 0.8).otherwise(0.79).alias("probability")))
    return table(spark, sf_dir, "customer").select(
        n.alias("id"), text.content_type(text.extension(name)).alias("mime"), text.escape_html(t).alias("escaped"), text.file_name(t).alias("file_name"), F.array_join(text.csv_list(t), "|").alias("list"),
        text.client_ip(forwarded, F.when(n % 3 == 1, " real "), F.lit("")).alias("ip"), name.alias("title_of"), layout.title(F.lit(" "), name).alias("title"), R.known_project(project, RULES).isNotNull().alias("listed"),
        layout.timeout_ms(F.when(n % 2 == 0, (n * 10).cast("string")), F.lit("none")).alias("timeout"), layout.finite(F.when(n % 5 == 0, "x").otherwise(F.col("c_acctbal").cast("string"))).alias("number"), layout.safe_to_show(classes, {"adult": 0.8}).alias("shown"),
    )


@query(
    """WITH s AS (SELECT event_id, ts, ts + (user_id % 50) * INTERVAL 1 MINUTE AS "end", ts + INTERVAL 25 MINUTE AS now, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 7 MINUTE END AS pause, event_id % 3 = 0 AS up FROM events),
    t AS (SELECT *, CAST(trunc(date_diff('microsecond', coalesce(pause, now), "end") / 1000000.0) AS BIGINT) AS l, CAST(trunc(date_diff('microsecond', ts, coalesce(pause, now)) / 1000000.0) AS BIGINT) AS u FROM s), v AS (SELECT *, CASE WHEN up THEN u ELSE abs(l) END AS x FROM t)
    SELECT event_id, CASE WHEN NOT up AND l < 0 THEN '+' ELSE '' END || lpad(CAST(x // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(x % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(x % 60 AS VARCHAR), 2, '0') AS clock, CASE WHEN up THEN 'until ' ELSE 'ends ' END || strftime("end", '%H:%M') AS hint,
    strftime(ts - INTERVAL 45 MINUTE, '%H:%M') AS shifted, pause IS NULL AND NOT up AS pausable FROM v"""
)
def session_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.functions import layout

    n, ts = F.col("event_id"), F.col("ts")
    end = ts + F.make_dt_interval(mins=(F.col("user_id") % 50).cast("int"))
    pause = F.when(n % 4 == 0, ts + F.expr("INTERVAL 7 MINUTES"))
    up = n % 3 == 0
    status = F.when(up, "infinit").otherwise("normal")
    clock_ = layout.main_text(status, ts, end, ts + F.expr("INTERVAL 25 MINUTES"), pause)
    return table(spark, sf_dir, "events").select(
        "event_id", clock_.alias("clock"), layout.end_hint(F.when(up, "countup").otherwise("countdown"), end).alias("hint"), layout.shift_clock(clock.clock(ts), F.lit(-45)).alias("shifted"), (layout.pausable(status, pause.isNotNull()) & ~up).alias("pausable")
    )


@query(
    """WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '["a","b","a"]' WHEN 1 THEN '{"completed":["s' || CAST(user_id AS VARCHAR) || '"],"elapsedMs":' || CAST(user_id * 10 - 500 AS VARCHAR) || '}' WHEN 2 THEN '{"elapsedMs":7}' ELSE 'broken' END AS saved, user_id, props FROM events)
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN 's' || CAST(user_id AS VARCHAR) ELSE '' END AS completed, CASE event_id % 4 WHEN 1 THEN greatest(0, user_id * 10 - 500) WHEN 2 THEN 7 ELSE 0 END::DOUBLE AS elapsed, coalesce(json_extract_string(props, '$.k'), 'none') AS k, 'none' AS missing FROM p"""
)
def stored_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.functions import layout

    n, user = F.col("event_id") % 4, F.col("user_id")
    full = F.concat(F.lit('{"completed":["s'), user.cast("string"), F.lit('"],"elapsedMs":'), (user * 10 - 500).cast("string"), F.lit("}"))
    completed, elapsed = layout.progress(F.when(n == 0, '["a","b","a"]').when(n == 1, full).when(n == 2, '{"elapsedMs":7}').otherwise("broken"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(completed, ",").alias("completed"), elapsed.alias("elapsed"), layout.json_path(F.col("props"), "k", "none").alias("k"), layout.json_path(F.col("props"), "a.b[1]", "none").alias("missing"))


@query(
    """SELECT conv_id, turn, substr(replace(CASE WHEN text IS NULL OR text = '' THEN 'nothing' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END, chr(10), ' '), 1, 80) AS label,
    CASE turn % 4 WHEN 0 THEN '熨烫服务' WHEN 1 THEN '手作体验' WHEN 2 THEN '熨烫服务' ELSE '拼豆计时' END AS category FROM conversations"""
)
def label_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.functions import layout

    session = F.get(F.array(*map(F.lit, ("取件熨烫", "香囊一小时", "彩绘熨烫", "2h"))), (F.col("turn") % 4).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", layout.label_text(F.col("text"), "nothing").alias("label"), layout.session_category(session).alias("category"))
