"""Run a registered query on Spark and its SQL on DuckDB, and compare the rows."""

import math

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    if hasattr(x, "as_tuple"):
        return float(f"{float(x):.9g}")
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sql, sf=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(sql)
    return _rows([d[0] for d in got.description], got.fetchall())


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def differences(spark, name, query, sql, sf=SF):
    a, b = spark_rows(query(spark, sf)), duck(sql, sf)
    if a[0] != b[0]:
        return f"{name}: columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        odd = [(x, y) for x, y in zip(a[1], b[1], strict=False) if x != y][:2]
        return f"{name}: {len(a[1])} and {len(b[1])} rows, {odd}"
    return ""
