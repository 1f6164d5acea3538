import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import ann


def _brute(rows, queries, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v))
    out = {}
    for q in queries:
        if q in good:
            d = sorted((min(float(np.sqrt(((good[q][0] - x) ** 2).sum())) for x in vs), i) for i, vs in good.items() if i != q)
            out[q] = d[:k]
    return out


def test_exact_where_every_list_is_read(spark, monkeypatch):
    monkeypatch.setattr(ann, "_fitted", lambda index, sample, k: 1e9)
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=6).astype("f4").tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 340)] + [(340, None), (341, [0.0] * 6), (342, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (343, [math.nan] * 6), (344, [math.inf] + [0.0] * 5), (None, [1.0] * 6), (345, [1.0] * 4), rows[7]]
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3, 4, 5, 6) for i, v in rows], "vec_id long, embedding array<float>, label int, score string, list int, part int, block int, query_id int, rank int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = [r for r in rows if r[0] != 345]
    want = _brute(rows, [i for i, _ in rows if i is not None and i % 10 == 0], 10)
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [f[1] for f in found] == [i for _, i in want[q]] and np.allclose([f[2] for f in found], [d for d, _ in want[q]], rtol=1e-12, atol=0)


def test_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], kind), F.lit(True)).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0])], kind), F.lit(True)).count() == 0
    two = ann.search(spark.createDataFrame([(0, [1.0]), (1, [3.0])], kind), F.lit(True)).collect()
    assert sorted(map(tuple, two)) == [(0, 1, 1, 2.0), (1, 1, 0, 2.0)]


def test_recall_of_the_query(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = _brute([(i, v.tolist()) for i, v in x.items()], list(got), 10)
    assert np.mean([len(got[q] & {i for _, i in want[q]}) / 10 for q in got]) >= 0.9


@pytest.mark.parametrize("spread, most_read", [(0.3, 0.03), (1.0, 0.1), (None, 1.2)])
def test_recall_and_share_read(spread, most_read):
    """30,000 vectors at production parameters; without clusters (spread None) 64 dimensions leave little to prune. Replicas count in what is read."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30_000, 64))
    if spread is not None:
        x = 2 * rng.normal(size=(300, 64))[rng.integers(0, 300, len(x))] + spread * x
    index = ann.build(x[: ann.SAMPLE_ROWS], round(len(x) ** 0.5))
    lists = np.concatenate([ann._lists(index, x[lo : lo + 2048]) for lo in range(0, len(x), 2048)])
    held = [np.flatnonzero((lists == i).any(axis=1)) for i in range(len(index.centroids))]
    sizes = np.array([len(h) for h in held])
    queries = np.arange(0, len(x), 200)
    at, which = ann._read_by(index, x[queries], sizes, ann.LEAST_READ)
    found, read = [], []
    for i, q in enumerate(queries):
        some = np.unique(np.concatenate([held[j] for j in which[at == i]]))
        d = ann._squares(x[q : q + 1], x)[0]
        d[q] = np.inf
        found.append(np.isin(np.argsort(d, kind="stable")[:10], some).mean())
        read.append(sizes[which[at == i]].sum() / len(x))
    assert np.mean(found) >= 0.9 and np.mean(read) <= most_read
