import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tesserae.llm import exact_dedup


def _brute(rows):
    """(doc_id, text) -> sorted (doc_id, keep_id, group_size, kept) by comparing whole texts."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for ids in groups.values():
        ids.sort(key=lambda i: (i is not None, i or 0))
        out += [(i, ids[-1], len(ids), at == len(ids) - 1) for at, i in enumerate(ids)]
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.select("row.doc_id", "keep_id", "group_size", "kept").collect()), key=repr)


def test_groups_are_those_of_whole_texts(make, texts):
    long = "word " * 100  # longer than a prefix
    odd = [long + "a", long + "b", long + "a", long + "c ", "é" * 10, "é" * 10, "e" * 20, None, "", "A", "a", " a"]
    rows = texts + [(1000 + i, t) for i, t in enumerate(odd)]
    assert _got(exact_dedup.find(make(rows))) == _brute(rows)


def test_null_and_repeated_ids(make):
    rows = [(None, "x"), (None, "x"), (5, "y"), (5, "y"), (5, "y"), (4, "y"), (None, "y"), (7, "z"), (7, "w"), (-3, None), (None, "")]
    assert _got(exact_dedup.find(make(rows))) == _brute(rows)
    assert sorted(r.text or "" for r in exact_dedup.keep_one(make(rows)).collect()) == ["", "w", "x", "y", "z"]


def test_full_hashes_are_taken_of_survivors_only(make, monkeypatch):
    hashed = []
    write = exact_dedup.materialise
    monkeypatch.setattr(exact_dedup, "materialise", lambda df, name: (out := write(df, name), hashed.append((name, out)))[0])
    rows = [(1, "ab"), (2, "abc"), (3, "abd"), (4, "same words"), (5, "same words")]  # length, prefix and hash settle 1, 2 and 3, none
    exact_dedup.find(make(rows)).collect()
    full = dict(hashed)["full-hashes"]
    assert sorted(r.id for r in full.filter("full is not null").collect()) == [4, 5]


def test_crowded_bitmaps_only_cost_time(make, texts, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_BITS", 64)
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 64)
    assert _got(exact_dedup.find(make(texts))) == _brute(texts)


@pytest.mark.parametrize("names", [("word", "marks", "marked"), ("full", "number", "id"), ("n_bytes", "prefix", "group_size"), ("keep_id", "kept", "row"), ("bit", "whole", "count")])
def test_clashing_columns_and_no_rows(spark, names):
    df = spark.createDataFrame([(1, "a", 1, 2, 3), (2, "a", 4, 5, 6), (3, None, 7, 8, 9)], ["doc_id", "text", *names])
    assert sorted(map(tuple, exact_dedup.keep_one(df).collect())) == [(2, "a", 4, 5, 6), (3, None, 7, 8, 9)]
    none = df.filter("false")
    assert exact_dedup.find(none).count() == 0 and exact_dedup.keep_one(none).columns == df.columns


def test_one_text_in_most_rows(spark):
    docs = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 50)).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    found = exact_dedup.find(docs).groupBy("group_size", "kept").count().collect()
    n = len(range(0, 40_000, 3))
    assert sorted(map(tuple, found)) == sorted([(1, True, 40_000 - n), (n, True, 1), (n, False, n - 1)])


def test_query_hashes_the_text(spark, tmp_path):
    from tesserae.llm import catalogue

    spark.createDataFrame([(1, "é"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text_sha256 for r in catalogue.op13_exact_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256("é".encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
