"""Approximate nearest neighbours over balanced posting lists.

* Centroids come from a bounded sample, cut in halves again and again along the line between two means, always
  at the median: leaves of equal size, whose means are the centroids.
* Each vector goes to the list of its nearest centroid. Vectors near a boundary go to further lists as well:
  those not more than CLOSURE times as far, up to REPLICAS lists.
* Centroids are searched by a graph in memory: each is linked to its nearest ones in all directions and to a
  few at random, and a beam walks from fixed entries towards the vector.
* A query reads the lists whose centroids are at most `ratio` times as far as its nearest one, and so many that they
  must hold enough vectors. The ratio is fitted on the sample: some of its vectors are queries, their nearest others
  are found by brute force, and the ratio is the one within which TARGET of these are met. So vectors in clusters read
  a list or two; vectors without structure, whose lists are all about as far, read many, as they must.
* In each list the distances are computed in double precision on the original vectors; only the best k of a list
  and query go on.

There are about as many lists as vectors in each: both grow as the root of the number of vectors, until a centroid
has no more than FITTED vectors of the sample; beyond, lists get longer. Lists and the queries at a list are cut into parts of bounded size by a hash, so a list that holds a third of
all vectors is read by many tasks. Only the sample, the centroids, and the lists' sizes come to the driver; all
are bounded by parameters.

Defined results: vectors that are null, zero, or hold a null or a non-finite component take no part, nor do
those with a null vec_id or of another length than most (the shortest, if equally many); equal distances are ranked by
vec_id; repeated rows of a
vec_id count once, by the nearest of their vectors; no valid vectors, or no other one: no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.batches import column
from tesserae.session import materialise

#: Rows of the sample that centroids are fitted on, and floats in it, at most.
SAMPLE_ROWS, SAMPLE_FLOATS = 20_000, 4_000_000
#: Vectors of the sample for a centroid, at least.
FITTED = 8
CLOSURE, REPLICAS = 1.02, 2
#: Of the nearest vectors in the sample, those that the fitted ratio meets; and how many queries it is fitted on.
TARGET, TRIALS = 0.94, 256
#: Centroids that the walk keeps at first; twice as many, and so on, while all of them are within the ratio.
BEAM = 32
#: And as many when a vector looks for its own lists.
WIDE = 16
#: Vectors in the lists that a query reads, at least.
LEAST_READ = 400
#: Of the graph: links of a centroid to near ones, which are chosen among how many, links to any, and where walks begin.
LINKS, NEAR, LONG_LINKS, ENTRIES = 16, 96, 4, 32
#: Vectors of a list, and queries at it, that one group holds.
PART, QUERIES = 4096, 4096


class Index(NamedTuple):
    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    ratio: float


def _leaves(x: np.ndarray, count: int, rng: np.random.Generator) -> list[np.ndarray]:
    if count <= 1 or len(x) < 2:
        return [x.mean(axis=0)]
    a, b = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(6):
        near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
        if near.all() or not near.any():
            break
        a, b = x[near].mean(axis=0), x[~near].mean(axis=0)
    order = np.argsort(x @ (b - a), kind="stable")
    half = count // 2
    cut = min(max(1, len(x) * half // count), len(x) - 1)
    return _leaves(x[order[:cut]], half, rng) + _leaves(x[order[cut:]], count - half, rng)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T)


def build(sample: np.ndarray, lists: int, k: int = 10) -> Index:
    """Centroids of the sample, their graph, and the ratio within which the k nearest vectors are found."""
    centroids = np.array(_leaves(sample, max(1, min(lists, len(sample) // FITTED)), np.random.default_rng(7)))
    n = len(centroids)
    rng = np.random.default_rng(9)
    links = np.concatenate([_links(centroids, lo, min(lo + 256, n)) for lo in range(0, n, 256)])
    links = np.concatenate([links, rng.integers(0, n, (n, LONG_LINKS))], axis=1)
    index = Index(centroids, links, np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64)), 1.0)
    return index._replace(ratio=_fitted(index, sample, k))


def _links(centroids: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Up to LINKS of the nearest centroids of some, one for each direction: none that is nearer to one taken before. Missing ones link to themselves."""
    n, rows = len(centroids), np.arange(hi - lo)
    d = _squares(centroids[lo:hi], centroids)
    d[rows, np.arange(lo, hi)] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, : min(n - 1, NEAR)]
    taken = np.repeat(np.arange(lo, hi)[:, None], LINKS, axis=1)
    count = np.zeros(hi - lo, np.int64)
    for c in near.T:
        far = d[rows, c]
        to_taken = ((centroids[c][:, None, :] - centroids[taken]) ** 2).sum(axis=2)
        to_taken[np.arange(LINKS)[None, :] >= count[:, None]] = np.inf
        ok = (count < LINKS) & (to_taken.min(axis=1) > far)
        taken[rows[ok], count[ok]] = c[ok]
        count[ok] += 1
    return taken


def _fitted(index: Index, sample: np.ndarray, k: int) -> float:
    trials = np.random.default_rng(8).permutation(len(sample))[:TRIALS]
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1.0
    lists = np.concatenate([_lists(index, sample[lo : lo + 2048]) for lo in range(0, len(sample), 2048)])
    need = []
    for lo in range(0, len(trials), 32):
        some = trials[lo : lo + 32]
        d = _squares(sample[some], sample)
        d[np.arange(len(some)), some] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        far = np.sqrt(_squares(sample[some], index.centroids))
        holds = lists[near]  # -1 where a vector has fewer lists
        at = np.where(holds >= 0, np.take_along_axis(far[:, None, :], np.maximum(holds, 0), axis=2), np.inf).min(axis=2)
        need.append(at / np.maximum(far.min(axis=1), 1e-300)[:, None])
    return float(np.quantile(np.concatenate(need), TARGET))


def walk(index: Index, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, distances) found by the beam, nearest first; -1 and inf where there are fewer."""
    n, c = len(x), len(index.centroids)
    beam = min(beam, c)
    ids = np.full((n, beam + max(index.links.shape[1], len(index.entries))), -1)
    far = np.full(ids.shape, np.inf)
    open_ = np.zeros(ids.shape, bool)
    seen = np.zeros((n, c), bool)
    rows = np.arange(n)

    def add(at: np.ndarray, new: np.ndarray) -> None:
        """Take in the centroids `new` of the rows `at` that were not seen, and keep the best."""
        fresh = ~seen[at[:, None], new]
        seen[at[:, None], new] = True
        k = new.shape[1]
        d = np.where(fresh, np.sqrt(((index.centroids[new] - x[at][:, None, :]) ** 2).sum(axis=2)), np.inf)
        i, f, o = ids[at], far[at], open_[at]
        i[:, beam : beam + k], f[:, beam : beam + k], o[:, beam : beam + k] = new, d, fresh
        i[:, beam + k :], f[:, beam + k :], o[:, beam + k :] = -1, np.inf, False
        order = np.argsort(f, axis=1, kind="stable")
        ids[at], far[at], open_[at] = (np.take_along_axis(y, order, axis=1) for y in (i, f, o))

    add(rows, np.repeat(index.entries[None, :], n, axis=0))
    while True:
        ready = open_[:, :beam] & np.isfinite(far[:, :beam])
        at = rows[ready.any(axis=1)]
        if not len(at):
            break
        best = ready[at].argmax(axis=1)
        open_[at, best] = False
        add(at, index.links[ids[at, best]])
    return np.where(np.isfinite(far[:, :beam]), ids[:, :beam], -1), far[:, :beam]


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _lists(index: Index, x: np.ndarray) -> np.ndarray:
    """The lists of each vector, -1 where it has fewer."""
    ids, far = walk(index, x, WIDE)
    out = np.full((len(x), REPLICAS), -1)
    out[:, 0] = ids[:, 0]
    count = np.ones(len(x), np.int64)
    for j in range(1, ids.shape[1]):
        ok = (ids[:, j] >= 0) & (far[:, j] <= CLOSURE * far[:, 0]) & (count < REPLICAS)
        out[ok, count[ok]] = ids[ok, j]
        count[ok] += 1
    return out


def _post(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            rows = batch.slice(lo, 2048)
            lists = _lists(index, _matrix(column(rows, "embedding")))
            at, which = np.nonzero(lists >= 0)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(lists[at, which].astype(np.int32)), column(rows, "vec_id").take(take), column(rows, "embedding").take(take)], ["list", "vec_id", "embedding"])


def _read_by(index: Index, x: np.ndarray, sizes: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector, list) of the lists that each vector reads as a query."""
    at, which, rows, beam = [], [], np.arange(len(x)), BEAM
    while len(rows):
        ids, far = walk(index, x[rows], beam)
        have = np.cumsum(np.where(ids >= 0, sizes[ids], 0), axis=1)
        before = np.concatenate([np.zeros((len(ids), 1), np.int64), have[:, :-1]], axis=1)
        read = ((far <= index.ratio * far[:, :1]) | (before < enough)) & (ids >= 0)
        # Where the whole beam is to be read there may be more lists: a wider beam finds them.
        settled = ~read[:, -1] | (beam >= len(index.centroids))
        i, j = np.nonzero(read & settled[:, None])
        at.append(rows[i])
        which.append(ids[i, j])
        rows, beam = rows[~settled], 2 * beam
    return np.concatenate([*at, np.zeros(0, np.int64)]), np.concatenate([*which, np.zeros(0, np.int64)])


def _route(batches: Iterator[pa.RecordBatch], index: Index, sizes: np.ndarray, enough: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            rows = batch.slice(lo, 2048)
            at, lists = _read_by(index, _matrix(column(rows, "embedding")), sizes, enough)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), column(rows, "vec_id").take(take), column(rows, "embedding").take(take)], ["list", "query_id", "query"])


def _best(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """The k nearest of these vectors to each of these queries."""
    queries, vectors = queries.combine_chunks(), vectors.combine_chunks()
    out_q, out_v, out_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if queries.num_rows and vectors.num_rows:
        vec_id, query_id = vectors["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        v, q = (_matrix(t[c].chunk(0) if t[c].num_chunks == 1 else pa.concat_arrays(t[c].chunks)) for t, c in ((vectors, "embedding"), (queries, "query")))
        by_id = np.argsort(vec_id, kind="stable")
        vec_id, v = vec_id[by_id], v[by_id]
        first_of = np.flatnonzero(np.concatenate([[True], vec_id[1:] != vec_id[:-1]]))
        size = (v * v).sum(axis=1)
        for lo in range(0, len(q), 128):
            some, ids = q[lo : lo + 128], query_id[lo : lo + 128]
            rough = _squares(some, v)
            rough[ids[:, None] == vec_id[None, :]] = np.inf
            each = np.minimum.reduceat(rough, first_of, axis=1)  # repeated rows of a vec_id count once
            last = min(k, each.shape[1]) - 1
            most = np.partition(each, last, axis=1)[:, last]
            slack = 1e-9 * ((some * some).sum(axis=1) + size.max())  # beyond what the rough form can be off by
            at, which = np.nonzero((rough <= (most + slack)[:, None]) & np.isfinite(rough))
            exact = np.sqrt(((some[at] - v[which]) ** 2).sum(axis=1))
            order = np.lexsort((vec_id[which], exact, at))
            at, which, exact = at[order], which[order], exact[order]
            first = np.zeros(len(at), bool)
            first[np.unique(np.stack([at, vec_id[which]]), axis=1, return_index=True)[1]] = True
            if not first.all() and len(first):
                at, which, exact = at[first], which[first], exact[first]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            ok = rank < k
            out_q.append(ids[at[ok]])
            out_v.append(vec_id[which[ok]])
            out_d.append(exact[ok])
    return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_d)})


def _valid(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    return rows


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found to each row that is a query; score is the Euclidean distance."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = _valid(vectors)
    lengths = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return empty
    dim, n = lengths
    rows = rows.filter(F.size("embedding") == dim)
    most = max(2, min(SAMPLE_ROWS, SAMPLE_FLOATS // dim))
    spot = F.xxhash64("vec_id", "embedding")
    share = min(1.0, 2 * most / n)
    sample = rows.filter(F.pmod(spot, F.lit(1 << 20)) <= int(share * (1 << 20))).orderBy(spot, "vec_id").limit(most)
    found = sample.select("embedding").toArrow()["embedding"]
    if not len(found):
        found = rows.limit(most).select("embedding").toArrow()["embedding"]
    index = build(_matrix(found.combine_chunks() if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)), round(math.sqrt(n)), k)
    shared = spark.sparkContext.broadcast(index)
    kind = rows.schema["embedding"].dataType.simpleString()
    posted = materialise(rows.mapInArrow(lambda b: _post(b, shared.value), f"list int, vec_id long, embedding {kind}"), "postings")
    sizes = np.zeros(len(index.centroids), np.int64)
    for row in posted.groupBy("list").count().collect():  # a row for each centroid
        sizes[row[0]] = row[1]
    enough = min(max(LEAST_READ, (k + 1) * REPLICAS), int(sizes.sum()))
    routed = materialise(rows.filter(is_query).mapInArrow(lambda b: _route(b, shared.value, sizes, enough), f"list int, query_id long, query {kind}"), "routes")
    asked = dict(map(tuple, routed.groupBy("list").count().collect()))
    cuts = spark.createDataFrame([(i, max(1, -(-int(size) // PART)), max(1, -(-asked.get(i, 1) // QUERIES))) for i, size in enumerate(sizes)], "list int, parts int, blocks int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = routed.join(cuts, "list").select("list", every("parts").alias("part"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), "query_id", "query")
    right = posted.join(cuts, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), every("blocks").alias("block"), "vec_id", "embedding")
    key = ("list", "part", "block")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda q, v: _best(q, v, k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
