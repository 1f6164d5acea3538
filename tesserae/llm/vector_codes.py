"""Vector codes: parts of vectors replaced by the nearest entries of small codebooks, found by equal-average search.

Components become integers floor(SCALE * x), vectors are cut into PARTS equal parts, and each part position has a codebook
of up to ENTRIES integer entries. All arithmetic is exact.

* start: the parts of the vectors with the ENTRIES smallest vec_ids;
* ROUNDS times: every part is assigned to its nearest entry, and each entry that has parts becomes their componentwise
  floor(sum / count); then parts are assigned once more.

Equal-average search: the entries of a codebook are sorted by the sum of their components. By Cauchy and Schwarz the
squared distance of a part to an entry is at least the squared difference of their sums over the number of components; so
the search starts where the part's own sum would stand, takes the entry of the nearer sum on either side each time, and
ends when that bound is strictly greater than the best distance. Equal bounds are still looked at, for ties go to the
lower index.

Each round is one scan of the vectors in which a task adds up its parts by entry; only these sums, PARTS * ENTRIES *
(components of a part) numbers at most, reach the driver, which divides them.

Defined results: vectors that are null, or hold a null or a non-finite component, take no part, nor do those whose length
is not a multiple of PARTS, or not the most frequent such length (the shortest, if equally many). Repeated rows count as
often as they are there; of equal vec_ids the one with the smaller vector is the earlier entry, and a null vec_id is
smaller than any. Fewer vectors than ENTRIES make as many entries. No valid vectors: no rows. Extra columns are carried
along. A component whose integer is beyond RANGE over the components of a part fails the job: a sum of squares might not
fit in a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tesserae.llm.batches import column

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Greatest magnitude of an integer component, times the components of a part.
RANGE = 1 << 28
#: Vectors that one step of a task works on.
STEP = 4096
#: Beyond every difference of sums that RANGE admits, and still with a square that fits in a long.
_FAR = 1 << 31


def finite(vector: str = "embedding") -> Column:
    """The vector is there, and so are all of its components, none of them NaN or infinite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def integers(vectors: pa.Array, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length, as rows of longs; a greater magnitude than `most` is an error."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * scale)
    if len(whole) and np.abs(whole).max() > most:
        raise ValueError(f"a component is beyond {most / scale:g}: distances might not fit in a long")
    return whole.astype(np.int64).reshape(len(vectors), -1)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each part, ties to the lower index."""
    n, dim = parts.shape
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    ladder = np.concatenate([[-_FAR], sums[order], [_FAR]])  # rung k + 1 is that of order[k]
    own = parts.sum(axis=1)
    up = np.searchsorted(sums[order], own) + 1
    down = up - 1
    index, best = np.full(n, len(entries)), np.full(n, (1 << 60) // dim)
    at = np.arange(n)
    while len(at):
        above, below = ladder[up[at]] - own[at], own[at] - ladder[down[at]]
        gap, rising = np.minimum(above, below), above < below
        open_ = gap * gap <= best[at] * dim
        at, rising = at[open_], rising[open_]
        entry = order[np.where(rising, up[at], down[at]) - 1]
        distance = ((parts[at] - entries[entry]) ** 2).sum(axis=1)
        better = (distance < best[at]) | ((distance == best[at]) & (entry < index[at]))
        index[at[better]], best[at[better]] = entry[better], distance[better]
        up[at[rising]] += 1
        down[at[~rising]] -= 1
    return index, best


def _steps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of some vectors, and their parts: (vector, part position, component)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP):
            rows = batch.slice(lo, STEP)
            yield rows, integers(column(rows, "embedding"), SCALE, RANGE // width).reshape(rows.num_rows, PARTS, width)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This task's (part, entry, place, total, n): sums of the parts assigned to each entry."""
    total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    for _, parts in _steps(batches, books.shape[2]):
        for p in range(PARTS):
            index, _ = nearest(parts[:, p], books[p])
            np.add.at(total[p], index, parts[:, p])
            count[p] += np.bincount(index, minlength=books.shape[1])
    part, entry, place = np.nonzero(np.repeat(count[:, :, None], books.shape[2], axis=2))
    if len(part):
        found = (part.astype(np.int32), entry.astype(np.int32), place.astype(np.int32), total[part, entry, place], count[part, entry])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["part", "entry", "place", "total", "n"])


def _assign(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for rows, parts in _steps(batches, books.shape[2]):
        found = [nearest(parts[:, p], books[p]) for p in range(PARTS)]
        index = np.stack([i for i, _ in found], axis=1).astype(np.int32)
        codes = pa.ListArray.from_arrays(pa.array(np.arange(0, index.size + 1, PARTS, dtype=np.int32)), pa.array(index.ravel()))
        yield pa.RecordBatch.from_arrays([column(rows, "row"), codes, pa.array(sum(d for _, d in found))], ["row", "codes", "error"])


def _length(vectors: DataFrame) -> int | None:
    """The most frequent length that can be cut into parts."""
    sizes = vectors.filter(finite()).groupBy(F.size("embedding").alias("n")).count().filter((F.col("n") > 0) & (F.col("n") % PARTS == 0))
    found = sizes.orderBy(F.desc("count"), "n").first()
    return found and found.n


def _valid(vectors: DataFrame, length: int) -> DataFrame:
    return vectors.filter(finite() & (F.size("embedding") == length))


def fit(vectors: DataFrame) -> np.ndarray | None:
    """The codebooks, (part, entry, component) as longs; None if there are no valid vectors."""
    length = _length(vectors)
    if length is None:
        return None
    width, rows = length // PARTS, _valid(vectors, length).select("vec_id", "embedding")
    first = rows.orderBy("vec_id", "embedding").limit(ENTRIES).select("embedding").toArrow()["embedding"].combine_chunks()
    books = integers(first, SCALE, RANGE // width).reshape(-1, PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast(books)
        sums = rows.select("embedding").mapInArrow(lambda b: _sums(b, shared.value), "part int, entry int, place int, total long, n long")
        whole = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
        for part, entry, place, total, n in sums.groupBy("part", "entry", "place").agg(whole, F.sum("n").alias("n")).collect():  # PARTS * ENTRIES * width rows at most
            books[part, entry, place] = int(total) // n
    return books


def encode(vectors: DataFrame, books: np.ndarray | None, row: Column | None = None) -> DataFrame:
    """(row, codes array<int>, error) of each valid vector; `row` is a struct made from its columns, all of them if None."""
    chosen = vectors.select((F.struct("*") if row is None else row).alias("row"), "embedding")
    schema = StructType([chosen.schema["row"], StructField("codes", ArrayType(IntegerType())), StructField("error", LongType())])
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    return _valid(chosen, PARTS * books.shape[2]).mapInArrow(lambda b: _assign(b, shared.value), schema)


def decode(codes: Column, books: np.ndarray) -> Column:
    """The vector that codes stand for, as doubles: their entries side by side, over SCALE."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in entry]) for entry in book]) for book in books])
    return F.flatten(F.transform(codes, lambda code, part: table[part][code]))


def code_text(codes: Column) -> Column:
    """Two hex digits for each part."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, with commas."""
    return hashlib.sha256(b"" if books is None else ",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded (label, error, ...) with the sum of errors over rows of an equal label, null being a label."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
