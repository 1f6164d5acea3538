"""Quality classification by importance resampling.

Two generative models over hashed words and word pairs, one of target text and one of raw text, each with
BUCKETS buckets: a document's log weight is the sum over its n-grams of log(target) - log(raw). Documents are
sampled without replacement in proportion to their weights by Gumbel top-k: to each log weight a Gumbel variate
is added, and the k largest sums are taken. The variate comes from a hash of the document, so a run can be
repeated.

The counts of both models are sums over all documents: each step of a task counts into a fixed number of
buckets, and only buckets are shuffled. The k-th largest sum is found exactly by narrowing down its 64 bits, 16 at
a time, from counts of at most 65,536 buckets, so nothing is sorted as a whole.

Defined results: a text that is null or has no words has weight 0 and is never taken; equal sums are taken
in the order of doc_id, rows of one doc_id together; an empty target gives a uniform model;
a fraction of 0, or an empty table, takes nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import words as W
from tesserae.llm.batches import column, text_steps
from tesserae.session import materialise

BUCKETS = 1 << 14
SMOOTHING = 1.0


def _ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and pair of neighbouring words."""
    data = W.lower_ascii(data)
    found = W.split(data, offsets, W.NON_SPACE)
    hashed = W.hashes(data, found)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(found.first))
    at, pairs = W.runs(hashed, found.first, 2)
    return np.concatenate([owner, owner[at]]), (np.concatenate([hashed, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, BUCKETS), np.int64)
    for rows, data, offsets in text_steps(batches):
        owner, bucket = _ngrams(data, offsets)
        target = column(rows, "target").to_numpy(zero_copy_only=False).astype(bool)
        sums[0] += np.bincount(bucket, minlength=BUCKETS)
        sums[1] += np.bincount(bucket[target[owner]], minlength=BUCKETS)
    some = np.flatnonzero(sums[0])
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[0][some]), pa.array(sums[1][some])], ["bucket", "raw", "target"])


def fit(docs: DataFrame) -> np.ndarray:
    """The log ratio of each bucket, from the columns text and target (boolean) of docs."""
    counts = docs.select("text", F.coalesce("target", F.lit(False)).alias("target")).mapInArrow(_count, "bucket int, raw long, target long")
    sums = np.full((2, BUCKETS), SMOOTHING)
    for bucket, raw, target in counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # at most BUCKETS rows
        sums[:, bucket] += raw, target
    raw, target = np.log(sums / sums.sum(axis=1, keepdims=True))
    return target - raw


def _weigh(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_steps(batches):
        owner, bucket = _ngrams(data, offsets)
        n = len(offsets) - 1
        yield pa.RecordBatch.from_arrays([column(rows, "row"), pa.array(np.bincount(owner, minlength=n)), pa.array(np.bincount(owner, weights=ratio[bucket], minlength=n))], ["row", "n_grams", "log_weight"])


def weigh(docs: DataFrame, ratio: np.ndarray, keep: Column) -> DataFrame:
    """(row, n_grams, log_weight) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers
    rows = docs.select(keep.alias("row"), F.col("text"))
    return rows.mapInArrow(lambda b: _weigh(b, shared.value), f"row {rows.schema['row'].dataType.simpleString()}, n_grams long, log_weight double")


def _threshold(bits: DataFrame, k: int) -> tuple[int, int]:
    """(the k-th largest of the unsigned 64-bit values in the column bits, how many rows of that value are within the first k)."""
    low, left = 0, k
    for shift in (48, 32, 16, 0):
        same = F.lit(True) if shift == 48 else F.shiftrightunsigned("bits", shift + 16) == (low >> (shift + 16))
        digit = F.shiftrightunsigned("bits", shift).bitwiseAND(F.lit(0xFFFF))
        counts = bits.filter(same).groupBy(digit.alias("digit")).count().collect()  # at most 65,536 rows
        for d, n in sorted(counts, reverse=True):
            if left <= n:
                low |= d << shift
                break
            left -= n
    return low, left


def resample(docs: DataFrame, fraction: float = 0.5, seed: int = 42) -> DataFrame:
    """(doc_id, n_grams, log_weight, key, selected) of every row of docs (doc_id, text, target).

    selected marks the `fraction` of the documents with words that is sampled.
    """
    ratio = fit(docs)
    spot = F.xxhash64(F.lit(seed), F.col("row.doc_id"), F.col("row.h"))
    uniform = (F.shiftrightunsigned(spot, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    key = F.when(F.col("n_grams") > 0, F.col("log_weight") - F.log(-F.log(uniform)))
    rows = weigh(docs, ratio, F.struct("doc_id", F.xxhash64("text").alias("h"))).select("row.doc_id", "n_grams", "log_weight", key.alias("key"))
    rows = materialise(rows, "weights")
    some = rows.filter(F.col("key").isNotNull())
    k = int(some.count() * fraction)
    if not k:
        return rows.withColumn("selected", F.lit(False))
    # Sums as fixed-point numbers above 0; what is equal there is told apart by key, then doc_id.
    place = F.floor(F.col("key") * F.lit(float(1 << 24))).cast("long") + F.lit(1 << 62)
    least, within = _threshold(some.select(place.alias("bits")), k)
    edge = some.filter(place == least).groupBy("key", "doc_id").count()
    upto = F.sum("count").over(Window.orderBy(F.desc("key"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    last = edge.withColumn("before", F.coalesce(upto, F.lit(0))).filter(F.col("before") < within).orderBy("key", F.desc("doc_id")).first()
    beyond = (F.col("key") > F.lit(last.key)) | ((F.col("key") == F.lit(last.key)) & (F.coalesce(F.col("doc_id") <= F.lit(last.doc_id), F.lit(True))))
    return rows.withColumn("selected", F.coalesce((place > least) | ((place == least) & beyond), F.lit(False)))
