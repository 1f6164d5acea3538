import pytest

import __spark_entry__ as entry
from tesserae.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["grid_id", "code", "count"] and df.count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_the_comparison_sees_differences(spark):
    from oracle import differences

    query = catalogue.queries()["price_rounding"]
    assert differences(spark, "x", query, "SELECT o_orderkey AS id, 1.0 AS whole, 1.0 AS half, 1.0 AS five, 1.0 AS nine, 1.0 AS ninetynine FROM orders")
    assert differences(spark, "x", query, "SELECT o_orderkey AS id FROM orders")


def test_scratch_is_removed(tmp_path):
    """In a process of its own: it would remove what other tests read."""
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
from tesserae.session import clear_scratch, materialise
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
assert materialise(spark.range(5), "x").count() == 5
import os
assert os.listdir({str(tmp_path / "tesserae")!r})
clear_scratch(spark)
assert not os.listdir({str(tmp_path / "tesserae")!r})
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)


def test_checksums(spark):
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.crc for r in catalogue.queries()["crc_hash"](spark, SF).collect()}
    assert got == {i: zlib.crc32(t.encode()) for i, t in texts.items()}


def test_windows_on_a_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    from tesserae.streaming import state

    at = datetime(2024, 1, 1, 12)
    rows = [(at + timedelta(minutes=m), "window") for m in (1, 5, 11, 60, 61, 2)]
    source = str(tmp_path / "in")
    for i, part in enumerate((rows[:4], rows[4:5], rows[5:])):  # the last row comes two triggers after the watermark has passed its window
        spark.createDataFrame(part, "end timestamp, region string").coalesce(1).write.mode("append").parquet(f"{source}/batch={i}")
    stream = spark.readStream.schema("end timestamp, region string, batch int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    q = state.countdowns(stream).writeStream.format("memory").queryName("countdowns").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.window.start.minute, r.n) for r in spark.table("countdowns").collect()) == [(0, 2), (10, 1)]


def test_no_temporary_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from tesserae import session

    class Conf:
        def get(self, key, default):
            return default

    cluster = lambda master: SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            session.shared_dir(cluster(master))
    assert session.shared_dir(spark)
