"""A store of orders with their files: an order is there with all of its files, or not at all.

    path/files/<orderNo>/<fileName>          the files' bytes
    path/date=YYYY-MM-DD/part-....json       orders, one JSON object a line

A data source writer (format `orders`) runs in the tasks. A task stores an order's files first, under names that follow from the
order alone, so a task that runs again writes the same ones. Its orders go to a hidden folder of the job. Only when all tasks
are done are these files of orders, one for each task and date, moved to their dates by the driver, each in one step; a job that
fails takes its folder away. So a task that is killed leaves files that no order names, and no order; one that runs
twice leaves one set of orders.

Files are checked before anything is stored (tesserae.operators.orders.checked): orders with a fault are returned, not written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tesserae.functions import clock
from tesserae.operators import orders as O
from tesserae.session import materialise

#: What an order's record tells of a file.
FILE_FIELDS = ("originalName", "fileName", "key", "size", "contentType")


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(system: fs.FileSystem, path: str, data: bytes) -> None:
    """Write a file whole: under another name first, so that none is seen half written."""
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, path)


@dataclass
class _Written(WriterCommitMessage):
    parts: list[tuple[str, str]]  # (date, name) of what a task has put into the job's folder


class _Writer(DataSourceWriter):
    #: Orders whose records a task holds before it writes them to a file.
    HELD = 10_000

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _hidden(self, root: str) -> str:
        return f"{root}/_orders-{self.job}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, root = _system(self.path)
        parts, held, count = [], {}, 0

        def flush() -> None:
            for date, lines in held.items():
                name = f"part-{uuid.uuid4().hex}.json"
                _put(system, f"{self._hidden(root)}/{date}/{name}", "".join(lines).encode())
                parts.append((date, name))
            held.clear()

        for row in iterator:
            order = row.asDict(recursive=True)
            for f in order["files"]:
                if f.get("content") is not None:
                    _put(system, f"{root}/files/{order['orderNo']}/{f['fileName']}", bytes(f["content"]))
            files = [{k: f.get(k) for k in FILE_FIELDS if f.get(k) is not None} for f in order["files"]]
            record = {k: order.get(k) for k in ("orderNo", "submittedAt", "contact", "note") if order.get(k) is not None} | {"files": files}
            held.setdefault(str(order["date"]), []).append(json.dumps(record, ensure_ascii=False) + "\n")
            count += 1
            if count % self.HELD == 0:
                flush()
        flush()
        return _Written(parts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _system(self.path)
        for message in messages:
            for date, name in message.parts if message else ():
                system.create_dir(f"{root}/date={date}", recursive=True)
                system.move(f"{self._hidden(root)}/{date}/{name}", f"{root}/date={date}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _system(self.path)
        if system.get_file_info(self._hidden(root)).type == fs.FileType.Directory:
            system.delete_dir(self._hidden(root))


class OrderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orders"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write(orders: DataFrame, path: str, zone: str = O.ZONE) -> DataFrame:
    """Store the orders (orderNo, submittedAt, contact, note, files with content) without a fault; gives the others, with their fault.

    An order number that is there more than once in `orders` is stored once, as the earliest submitted, the smaller contact and note if
    equal. To run a job again adds nothing: orders that the store has are left out.
    """
    spark = orders.sparkSession
    spark.dataSource.register(OrderSource)
    every = O.checked(orders)
    good = every.filter("fault = ''")
    pick = F.struct("submittedAt", F.coalesce("contact", F.lit("")), F.coalesce("note", F.lit("")))
    columns = ("orderNo", "submittedAt", "contact", "note", "files")
    repeated = materialise(good.groupBy("orderNo").count().filter("count > 1").select("orderNo"), "repeated-orders")  # only these are grouped, with their bytes
    first = good.join(repeated, "orderNo", "left_semi").groupBy("orderNo").agg(F.min_by(F.struct(*columns), pick).alias("o")).select("o.*")
    dated = good.join(repeated, "orderNo", "left_anti").select(*columns).unionByName(first).withColumn("date", clock.local_date(F.col("submittedAt").try_cast("timestamp"), zone).cast("string"))
    system, root = _system(path)
    if any(x.base_name.startswith("date=") for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True))):
        dated = dated.join(O.read(spark, path_of_orders(path)).select("orderNo"), "orderNo", "left_anti")
    dated.write.format("orders").mode("append").option("path", path).save()
    return every.filter("fault <> ''")


def path_of_orders(path: str) -> str:
    return f"{path.rstrip('/')}/date=*"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The store's orders, with their date; the files' bytes are at `file_path` of each."""
    found = spark.read.schema(O.SCHEMA).option("basePath", path).option("mode", "DROPMALFORMED").json(path_of_orders(path))
    root = path.rstrip("/")
    files = F.transform("files", lambda f: F.struct(*[f[c].alias(c) for c in FILE_FIELDS], F.concat(F.lit(f"{root}/files/"), F.col("orderNo"), F.lit("/"), f["fileName"]).alias("file_path")))
    return found.withColumn("submitted_at", F.col("submittedAt").try_cast("timestamp")).withColumn("files", files)
