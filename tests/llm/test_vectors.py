import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import centroids, vector_codes

KIND = "vec_id long, embedding array<float>, label int, row string, codes int, cluster int"


def _fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def _rounds(vectors, entries, rounds):
    """Plain rounds over lists of Python integers; the entries, and each vector's (index, distance) with them."""
    for r in range(rounds + 1):
        found = [min((_square(v, e), i) for i, e in enumerate(entries)) for v in vectors]
        if r < rounds:
            for i in range(len(entries)):
                own = [v for v, (_, j) in zip(vectors, found, strict=True) if j == i]
                if own:
                    entries[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return entries, found


def _brute_codes(rows, length):
    kept = sorted((r for r in rows if _fine(r[1]) and len(r[1]) == length), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in kept]
    width, books, codes, errors = length // 16, [], [[] for _ in kept], [0] * len(kept)
    for p in range(16):
        parts = [v[p * width : (p + 1) * width] for v in whole]
        entries, found = _rounds(parts, [list(x) for x in parts[:64]], 2)
        books += entries
        for at, (d, i) in enumerate(found):
            codes[at].append(i)
            errors[at] += d
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for e in books for x in e).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in code), e, by_label[label], digest) for (i, _, label), code, e in zip(kept, codes, errors, strict=True)]


def _brute_clusters(rows):
    kept = sorted((r for r in rows if _fine(r[1]) and len(r[1]) == 64), key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    whole = [[math.floor(1024 * x) for x in v] for _, v, _ in kept]
    centres, found = _rounds(whole, [list(v) for v in whole[:8]], 10)
    sums = defaultdict(int)
    for d, i in found:
        sums[i] += d
    return [(r[0], i, d, sums[i], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[i])).encode()).hexdigest()) for r, (d, i) in zip(kept, found, strict=True)]


def _odd_rows(n, length, spread=1.0):
    rng = np.random.default_rng(n + length)
    middles = rng.normal(size=(5, length))
    rows = [(int(i), (middles[i % 5] * spread + rng.normal(size=length) * 0.3).astype("f4").tolist(), None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(n)]
    rows += [(n + i, rows[0][1], 1) for i in range(30)] + [rows[4], rows[4], (rows[4][0], rows[5][1], 2), (None, rows[6][1], None), (None, rows[7][1], 9)]
    rows += [(900, [0.0] * length, 0), (901, [-0.0] * length, 0), (902, [0.004] * length, 0), (903, [-0.004] * length, 0), (904, [1.0] * length, 0)]
    bad = [None, [], [math.nan] * length, [math.inf] + [0.0] * (length - 1), [None] + [1.0] * (length - 1), [1.0] * (length + 1), [1.0] * 16 if length != 16 else [1.0] * 32]
    return rows + [(950 + i, v, 1) for i, v in enumerate(bad)]


def _df(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", 5, 6) for r in rows], KIND).repartition(parts)


def _query(spark, tmp_path, name, df):
    from tesserae.llm import catalogue

    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize("n, length", [(300, 64), (200, 16), (40, 48)])
def test_codes_are_those_of_plain_rounds(spark, tmp_path, n, length):
    rows = _odd_rows(n, length)
    assert _query(spark, tmp_path, "op11_vector_codes", _df(spark, rows)) == sorted(_brute_codes(rows, length), key=repr)


@pytest.mark.parametrize("n, spread", [(300, 1.0), (120, 0.0), (2, 1.0)])
def test_clusters_are_those_of_plain_rounds(spark, tmp_path, n, spread):
    rows = _odd_rows(max(n, 8), 64, spread) if n > 2 else [(1, [0.5] * 64, 1), (2, [-0.5] * 64, 1), (3, None, 1)]
    assert _query(spark, tmp_path, "op12_centroids", _df(spark, rows)) == sorted(_brute_clusters(rows), key=repr)


def test_equal_average_search_is_exact_with_ties():
    rng = np.random.default_rng(4)
    for dim, high in ((1, 3), (4, 2), (4, 300), (7, 1 << 24)):
        entries, parts = rng.integers(-high, high, (64, dim)), rng.integers(-high, high, (500, dim))
        entries[40:50] = entries[:10]
        index, best = vector_codes.nearest(parts, entries)
        d = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_search_leaves_far_entries_unread(monkeypatch):
    entries = np.arange(64)[:, None] * np.array([[100, 100, 100, 100]])
    parts = entries + 3
    looked = []
    real = np.where
    monkeypatch.setattr(vector_codes.np, "where", lambda *a: (looked.append(len(a[0])), real(*a))[1])
    index, _ = vector_codes.nearest(parts, entries)
    assert (index == np.arange(64)).all() and sum(looked) < 3 * 64


def test_progressive_search_is_exact_with_ties():
    rng = np.random.default_rng(5)
    for high in (1, 2, 500, centroids.RANGE):
        x, c = rng.integers(-high, high + 1, (400, 64)), rng.integers(-high, high + 1, (8, 64))
        c[5] = c[1]
        x[:8] = c
        number, distance = centroids.nearest(centroids.transform(x), centroids.transform(c))
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        assert (centroids.restore(centroids.transform(x)) == x).all()
    assert centroids.COARSE_FIRST[0] == 0 and sorted(centroids.COARSE_FIRST) == list(range(64))


def test_codes_decode_to_their_entries(spark):
    df = _df(spark, _odd_rows(100, 32))
    books = vector_codes.fit(df)
    for r in vector_codes.encode(df, books).withColumn("near", vector_codes.decode(F.col("codes"), books)).collect():
        assert r.near == [x / 256 for p, c in enumerate(r.codes) for x in books[p][c].tolist()]
        whole = [math.floor(256 * x) for x in r.row.embedding]
        assert r.error == _square(whole, [int(256 * x) for x in r.near])


def test_no_vectors_and_extra_columns(spark, tmp_path):
    for i, df in enumerate((_df(spark, [], 1), _df(spark, [(1, None, 1), (2, [1.0, 2.0], 1)]))):
        assert _query(spark, tmp_path / f"a{i}", "op11_vector_codes", df) == [] and _query(spark, tmp_path / f"b{i}", "op12_centroids", df) == []
    df = _df(spark, [(1, [0.25] * 64, None)])
    assert vector_codes.encode(df, vector_codes.fit(df)).select("row.*").collect() == df.collect() == centroids.cluster(df).select("row.*").collect()


def test_components_beyond_the_range_fail(spark):
    df = _df(spark, [(1, [1e30] * 64, 1)])
    for fit in (vector_codes.fit, centroids.fit):
        with pytest.raises(ValueError, match="beyond"):
            fit(df)
