"""Date-partitioned orders: listing, point lookup, file checks, and writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import clock
from tesserae.functions import text as T

#: Days that are listed, the largest file, the zone of the partitions, and the first bytes of each kind of file.
DAYS, MOST_BYTES, ZONE = 7, 20 * 1024 * 1024, "Asia/Shanghai"
MAGIC = (("jpg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("pdf", "255044462D"))
#: An order's number, a stored file's name, and files of an order at most.
ORDER_NO, FILE_NAME, MOST_FILES = r"^PB-[0-9]{4}-[A-Z0-9]{5}$", r"^file-[1-3]\.(jpg|png|pdf)$", 3
SCHEMA = "orderNo string, submittedAt string, contact string, note string, files array<struct<originalName:string,fileName:string,key:string,size:bigint,contentType:string>>"


def recent(orders: DataFrame, now: Column, days: int = DAYS, zone: str = ZONE) -> DataFrame:
    """Orders (date, submitted_at) of the last partitions, not over so many times 24 hours old; an unreadable instant is out, a future one is in.

    Both conditions count: the oldest hours of the window may lie in a partition that is not listed. The first
    one is on the partition column, so Spark reads only those folders.
    """
    today = clock.local_date(now, zone)
    in_time = F.coalesce(F.col("submitted_at") >= now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    return orders.filter((F.col("date") >= F.date_sub(today, days - 1)) & (F.col("date") <= today)).filter(in_time)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Orders under path/date=.../; a file that is no order is skipped."""
    found = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return found.withColumn("submitted_at", F.col("submittedAt").try_cast("timestamp"))


def _file_fault(f: Column, fields: Sequence[str]) -> Column:
    content = f["content"] if "content" in fields else None
    return F.when(~F.coalesce(f["fileName"].rlike(FILE_NAME), F.lit(False)), "stored name").otherwise(fault(f["originalName"], f["contentType"], f["size"], content))


def checked(orders: DataFrame) -> DataFrame:
    """orders with `fault`: the first thing wrong with the number, the instant, the count of files, or a file; empty if nothing is. Files that carry their `content` have its first bytes checked too."""
    fields = orders.schema["files"].dataType.elementType.names
    faults = F.filter(F.transform("files", lambda f: _file_fault(f, fields)), lambda x: x != "")
    count = F.coalesce(F.size("files"), F.lit(0))
    found = (
        F.when(~F.coalesce(F.col("orderNo").rlike(ORDER_NO), F.lit(False)), "order number")
        .when(F.col("submittedAt").try_cast("timestamp").isNull(), "instant")
        .when(~count.between(1, MOST_FILES), "number of files")
        .otherwise(F.coalesce(F.get(faults, F.lit(0)), F.lit("")))
    )
    return orders.withColumn("fault", found)


def write(orders: DataFrame, path: str, zone: str = ZONE) -> DataFrame:
    """Write the orders without a fault as JSON under path/date=.../ ; gives the others, with their fault."""
    every = checked(orders)
    dated = every.filter("fault = ''").withColumn("date", clock.local_date(F.col("submittedAt").try_cast("timestamp"), zone))
    files = F.transform("files", lambda f: F.struct(*[f[c].alias(c) for c in ("originalName", "fileName", "key", "size", "contentType")]))
    dated.withColumn("files", files).drop("fault").write.mode("append").partitionBy("date").json(path)
    return every.filter("fault <> ''")


def public(orders: DataFrame) -> DataFrame:
    """What may be shown: files without their storage keys."""
    files = F.transform("files", lambda f: F.struct(f["originalName"].alias("originalName"), f["fileName"].alias("fileName"), f["size"].alias("size"), f["contentType"].alias("contentType")))
    return orders.withColumn("files", files)


def find_file(orders: DataFrame, order_no: str, file_name: str) -> DataFrame:
    return orders.filter(F.col("orderNo") == order_no).select("orderNo", F.explode("files").alias("f")).select("orderNo", "f.*").filter(F.col("fileName") == file_name)


def fault(name: Column, mime: Column, size: Column, content: Column | None) -> Column:
    """The first thing wrong with a file; empty if it is fine. Without its content, the first bytes are not looked at."""
    ext = T.extension(name)
    group = F.when(ext == "jpeg", "jpg").otherwise(ext)
    kind = F.lower(F.coalesce(mime, F.lit("")))
    out = (
        F.when(~F.coalesce(ext.isin(*[e for e, _ in T.MIME]), F.lit(False)), "extension")
        .when(size.isNull() | (size <= 0), "empty")
        .when(size > MOST_BYTES, "size")
        .when((kind != "") & (kind != T.content_type(ext)), "type")
    )
    if content is None:
        return out.otherwise("")
    magic = F
    for k, bytes_ in MAGIC:
        magic = magic.when(F.startswith(F.hex(F.substring(content, 1, 8)), F.lit(bytes_)), k)
    return out.when(F.coalesce(magic.otherwise(""), F.lit("")) != group, "content").otherwise("")


def latest(items: DataFrame, key: str, order: Sequence[Column], most: int = 18) -> DataFrame:
    """The newest row of each key, and of those the newest `most`."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return items.withColumn("_nth", nth).filter("_nth = 1").drop("_nth").orderBy(*order).limit(most)


def bounded_history(log: DataFrame, by: str, order: Sequence[Column], most: int) -> DataFrame:
    """The last `most` entries of each key."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return log.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")
