"""Centroid clustering: integer vectors, assigned by Walsh-Hadamard progressive search.

Components become integers floor(SCALE * x). K centroids start as the vectors whose vec_ids have the smallest hashes;
ROUNDS times every vector is assigned to its nearest centroid (squared distance, ties to the smaller number) and every
centroid that has vectors becomes their componentwise floor(sum / count); then vectors are assigned once more. All
arithmetic is exact.

Walsh-Hadamard progressive search: the transform of DIM components into as many coefficients, each a sum with signs,
multiplies every squared distance by DIM; so the squared differences of the first coefficients, added up, never exceed
DIM times the distance, and all of them give exactly that. Coefficients are ordered from coarse to fine (by the sign
changes of their pattern), where vectors that vary slowly have most of their difference, and are taken in groups of
doubling size. The centroid that looks nearest after the first few is finished at once, for a bound; a centroid
whose sum strictly exceeds the bound is out, and those that are left finish all DIM coefficients.

The transform is linear: a task adds up coefficients by centroid, and the driver transforms the K * DIM sums back. Nothing
else of the vectors reaches it. Each round is one scan.

Defined results: only vectors of exactly DIM components, none of them null or non-finite, take part. Repeated rows count
as often as they are there; where vec_ids are equal (null is one more) the smaller vector comes first at the start. Fewer vectors
than K make as many centroids. No valid vectors: no rows. Extra columns are carried along. A component whose integer is
beyond RANGE fails the job: DIM times a squared distance might not fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tesserae.llm.batches import column
from tesserae.llm.vector_codes import finite, integers
from tesserae.session import materialise

SCALE, DIM, K, ROUNDS, SEED = 1024, 64, 8, 10, 3
#: Greatest magnitude of an integer component.
RANGE = 1 << 24
#: Vectors that one step of a task works on.
STEP = 4096
#: Coefficients that have been added up when centroids are compared with the bound; the first of these also gives the bound.
STAGES = (4, 8, 16, 32, DIM)


def _signed_sums(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, coefficients in the natural order."""
    n, half = len(x), 1
    while half < DIM:
        pairs = x.reshape(n, -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, DIM)
        half *= 2
    return x


#: Coefficients from coarse to fine: by the number of sign changes of the pattern they are sums over.
COARSE_FIRST = np.argsort((np.diff(_signed_sums(np.eye(DIM, dtype=np.int64)), axis=1) != 0).sum(axis=1))


def transform(x: np.ndarray) -> np.ndarray:
    return _signed_sums(x)[:, COARSE_FIRST]


def restore(y: np.ndarray) -> np.ndarray:
    """The rows whose transform is y; division is exact."""
    natural = np.empty_like(y)
    natural[:, COARSE_FIRST] = y
    return _signed_sums(natural) // DIM


def nearest(y: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the centroid nearest to each vector, ties to the smaller number; both sides are transforms."""
    first = STAGES[0]
    sums = ((y[:, None, :first] - centres[None, :, :first]) ** 2).sum(axis=2)
    bound = ((y - centres[sums.argmin(axis=1)]) ** 2).sum(axis=1)
    alive = sums <= bound[:, None]
    for lo, hi in zip(STAGES, STAGES[1:], strict=False):
        at, of = np.nonzero(alive)
        sums[at, of] += ((y[at, lo:hi] - centres[of, lo:hi]) ** 2).sum(axis=1)
        alive[at, of] = sums[at, of] <= bound[at]
    sums[~alive] = np.iinfo(np.int64).max
    number = sums.argmin(axis=1)
    return number, sums[np.arange(len(y)), number] // DIM


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP):
            rows = batch.slice(lo, STEP)
            yield rows, transform(integers(column(rows, "embedding"), SCALE, RANGE))


def _sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This task's (cluster, place, total, n): sums of the coefficients of the vectors assigned to each centroid."""
    total, count = np.zeros(centres.shape, np.int64), np.zeros(len(centres), np.int64)
    for _, y in _steps(batches):
        number, _ = nearest(y, centres)
        np.add.at(total, number, y)
        count += np.bincount(number, minlength=len(centres))
    cluster, place = np.nonzero(np.repeat(count[:, None], DIM, axis=1))
    if len(cluster):
        found = (cluster.astype(np.int32), place.astype(np.int32), total[cluster, place], count[cluster])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["cluster", "place", "total", "n"])


def _assign(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for rows, y in _steps(batches):
        number, distance = nearest(y, centres)
        yield pa.RecordBatch.from_arrays([column(rows, "row"), pa.array(number.astype(np.int32)), pa.array(distance)], ["row", "cluster", "distance"])


def _valid(vectors: DataFrame) -> DataFrame:
    return vectors.filter(finite() & (F.size("embedding") == DIM))


def fit(vectors: DataFrame) -> np.ndarray:
    """The centroids, (number, component) as longs; none if there are no valid vectors."""
    rows = _valid(vectors)
    start = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(start.alias("hash"), "embedding").orderBy("hash", "embedding").limit(K).select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(first):
        return np.zeros((0, DIM), np.int64)
    centres = integers(first, SCALE, RANGE)
    for _ in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast(transform(centres))
        sums = rows.select("embedding").mapInArrow(lambda b: _sums(b, shared.value), "cluster int, place int, total long, n long")
        whole = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
        total, count = np.zeros(centres.shape, object), [0] * len(centres)
        for cluster, place, value, n in sums.groupBy("cluster", "place").agg(whole, F.sum("n").alias("n")).collect():  # K * DIM rows at most
            total[cluster, place], count[cluster] = int(value), n
        sums_of = restore(total)
        centres = np.array([[x // n for x in row] if n else old.tolist() for row, n, old in zip(sums_of, count, centres, strict=True)], np.int64)
    return centres


def assign(vectors: DataFrame, centres: np.ndarray, row: Column | None = None) -> DataFrame:
    """(row, cluster, distance) of each valid vector; `row` is a struct made from its columns, all of them if None."""
    chosen = vectors.select((F.struct("*") if row is None else row).alias("row"), "embedding")
    schema = StructType([chosen.schema["row"], StructField("cluster", IntegerType()), StructField("distance", LongType())])
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(transform(centres))
    return _valid(chosen).mapInArrow(lambda b: _assign(b, shared.value), schema)


def cluster(vectors: DataFrame, row: Column | None = None) -> DataFrame:
    """`assign` with the centroids of `fit`, and (centroid array<long>, cluster_inertia, inertia): distances summed over the cluster and over all."""
    centres = fit(vectors)
    found = materialise(assign(vectors, centres, row), "clusters")
    each = dict(map(tuple, found.groupBy("cluster").agg(F.sum("distance")).collect()))  # K rows at most
    of = [(i, centre, each[i], sum(each.values())) for i, centre in enumerate(centres.tolist()) if i in each]
    return found.join(F.broadcast(vectors.sparkSession.createDataFrame(of, "cluster int, centroid array<long>, cluster_inertia long, inertia long")), "cluster")


def digest(centroid: Column) -> Column:
    """SHA-256 of the components in decimal, with commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)
