"""Benchmark decontamination by a prefix-filtered set join.

Words: the text's A-Z lower-cased, then runs [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A window is WINDOW consecutive
words of a benchmark item, or all words of a shorter one. A window is the set of its shingles (GRAM words, or
all of a shorter window). It can only be contained in a document that holds every one of them, so the
necessary prefix of a window is one shingle: its rarest, in an order by the shingles' counts over all documents.

1. count: one pass over the documents counts the shingles that any window has;
2. prefix: each distinct window keeps its rarest shingle, and that shingle's position in the window;
3. join: a second pass emits the documents' shingles that are some window's prefix, with the words around
   them; an equi-join on the shingle finds the windows;
4. bounds: the window, laid so that its shingle is on the document's, must begin and end in the document;
5. verification: the words in that place must equal the window's.

Both passes drop shingles by a Bloom filter of the wanted ones, with at least BITS bits for each and PROBES probes, so
that about one unwanted shingle in 400 gets through; its size is bounded by MOST_BITS (32 MB), which is reached at 16
million shingles of benchmark text, and the join decides in any case. The windows are never broadcast by this code:
Spark does so where it has measured them small.

Defined results: a null text has no words, neither as a document nor as an item; items without words have no
window; repeated items each count in n_items; null item_ids are left out; repeated rows give repeated results;
an empty benchmark or table of documents is allowed; very long texts are read whole; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import words as W
from tesserae.llm.batches import column, text_steps
from tesserae.session import materialise

WINDOW = 10
GRAM = 4
BITS, PROBES = 16, 4
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Bits of the filter that one task builds at a time.
PAGE = 1 << 16


_MULTIPLIERS = [np.uint64(1 + 2 * (0x9E3779B97F4A7C15 * i >> 3 & (1 << 62) - 1)) for i in range(PROBES)]


def _slot(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The place of each hash in a filter of that many bits, a power of two."""
    return ((h * _MULTIPLIERS[probe]) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def _in(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the filter."""
    at = np.arange(len(h))
    for probe in range(PROBES):
        slot = _slot(h[at], probe, 8 * len(bitmap))
        at = at[bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1]
    return at


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, words, n, grams): each window of each item; grams in the order of their places."""
    for rows, data, offsets in text_steps(batches):
        data = W.lower_ascii(data)
        found = W.split(data, offsets, W.ALNUM)
        hashed = W.hashes(data, found)
        by_size = {}
        for g in range(1, GRAM + 1):
            at, h = W.runs(hashed, found.first, g)
            by_size[g] = dict(zip(at.tolist(), h.view(np.int64).tolist(), strict=True))
        raw, out = data.tobytes(), ([], [], [], [])
        ids = column(rows, "item_id").to_pylist()
        for item, lo, hi in zip(ids, found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
            n = min(WINDOW, hi - lo)
            g = min(GRAM, n)
            for at in range(lo, hi - n + 1) if n else ():
                out[0].append(item)
                out[1].append(" ".join(raw[a:b].decode() for a, b in zip(found.start[at : at + n].tolist(), found.end[at : at + n].tolist(), strict=True)))
                out[2].append(n)
                out[3].append([by_size[g][at + j] for j in range(n - g + 1)])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], column(rows, "item_id").type), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int64()))], ["item_id", "words", "n", "grams"])


def _hits(data: np.ndarray, offsets: np.ndarray, sizes: list[int], bitmap: np.ndarray) -> tuple[np.ndarray, W.Words, np.ndarray, np.ndarray]:
    data = W.lower_ascii(data)
    found = W.split(data, offsets, W.ALNUM)
    hashed = W.hashes(data, found)
    places, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for g in sizes:
        at, h = W.runs(hashed, found.first, g)
        ok = _in(h, bitmap)
        places.append(at[ok])
        grams.append(h[ok])
    return data, found, np.concatenate(places), np.concatenate(grams)


def _count(batches: Iterator[pa.RecordBatch], sizes: list[int], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in text_steps(batches):
        h, n = np.unique(_hits(data, offsets, sizes, bitmap)[3], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["gram", "n"])


_CANDIDATE = pa.struct([("gram", pa.int64()), ("place", pa.int64()), ("before", pa.int32()), ("words", pa.string())])


def _candidates(batches: Iterator[pa.RecordBatch], sizes: list[int], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(row, n_words, found): found holds the shingles that pass the bitmap, with the words that a window on them can cover."""
    for rows, data, offsets in text_steps(batches):
        low, found, places, grams = _hits(data, offsets, sizes, bitmap)
        raw, start, end = low.tobytes(), found.start, found.end
        by = np.argsort(places, kind="stable")
        places, grams = places[by], grams[by]
        owner = np.searchsorted(found.first, places, side="right") - 1
        lo = np.maximum(found.first[owner], places - WINDOW + 1)
        hi = np.minimum(found.first[owner + 1], places + WINDOW)
        items = [
            {"gram": g, "place": p - f, "before": p - a, "words": " ".join(raw[x:y].decode() for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True))}
            for g, p, f, a, b in zip(grams.view(np.int64).tolist(), places.tolist(), found.first[owner].tolist(), lo.tolist(), hi.tolist(), strict=True)
        ]
        cut = np.searchsorted(owner, np.arange(len(offsets)))
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(items, _CANDIDATE))
        yield pa.RecordBatch.from_arrays([column(rows, "row"), pa.array(np.diff(found.first)), lists], ["row", "n_words", "found"])


def _slots(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = column(batch, "gram").to_numpy().view(np.uint64)
        slot = np.unique(np.concatenate([_slot(h, probe, bits) for probe in range(PROBES)]))
        yield pa.RecordBatch.from_arrays([pa.array((slot // PAGE).astype(np.int32)), pa.array((slot % PAGE).astype(np.int32))], ["page", "slot"])


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page, slot), sorted by page; a page may be given in parts."""
    for batch in batches:
        page, slot = column(batch, "page").to_numpy(), column(batch, "slot").to_numpy()
        names, blobs = np.unique(page), []
        for p in names.tolist():
            bits = np.zeros(PAGE, bool)
            bits[slot[page == p]] = True
            blobs.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], ["page", "bits"])


def _bitmap(grams: DataFrame) -> np.ndarray:
    """The filter of the column gram, built in pages by the tasks; only pages come to the driver."""
    grams = grams.select("gram").distinct()
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << (BITS * grams.count()).bit_length()))
    slots = grams.mapInArrow(lambda b: _slots(b, bits), "page int, slot int")
    out = np.zeros(bits // 8, np.uint8)
    for page, raw in slots.repartition("page").sortWithinPartitions("page").mapInArrow(_pages, "page int, bits binary").toLocalIterator():
        out[page * PAGE // 8 : (page + 1) * PAGE // 8] |= np.frombuffer(raw, np.uint8)
    return out


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, h, n_words, n_hit, item_ids) of every row of docs; h is the text's xxhash64, item_ids are strings, sorted."""
    spark = docs.sparkSession
    every = materialise(items.select("item_id", "text").mapInArrow(_windows, f"item_id {items.schema['item_id'].dataType.simpleString()}, words string, n int, grams array<long>"), "windows")
    distinct = every.dropDuplicates(["words"]).select("words", "n", F.posexplode("grams").alias("place", "gram"))
    sizes = sorted({min(GRAM, row.n) for row in every.select("n").distinct().collect()})  # 1 to GRAM
    all_slots = spark.sparkContext.broadcast(_bitmap(distinct))
    row = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("row"), "text")
    counts = row.select("text").mapInArrow(lambda b: _count(b, sizes, all_slots.value), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("seen"))
    rarest = F.min_by(F.struct("gram", "place"), F.struct(F.coalesce("seen", F.lit(0)), "gram", "place"))
    prefix = materialise(distinct.join(counts, "gram", "left").groupBy("words", "n").agg(rarest.alias("p")).select("words", "n", "p.gram", F.col("p.place").alias("offset")), "prefixes")
    few_slots = spark.sparkContext.broadcast(_bitmap(prefix))
    kind = row.schema["row"].dataType.simpleString()
    marked = materialise(row.mapInArrow(lambda b: _candidates(b, sizes, few_slots.value), f"row {kind}, n_words long, found array<struct<gram:long,place:long,before:int,words:string>>").select("row.*", "n_words", "found"), "candidates")
    seen = marked.filter(F.size("found") > 0).select("doc_id", "h", F.explode("found").alias("c")).select("doc_id", "h", "c.gram", "c.place", "c.before", F.col("c.words").alias("around"))
    pairs = seen.join(prefix, "gram").filter(F.col("before") >= F.col("offset"))  # it begins in the document
    around = F.slice(F.split("around", " "), F.col("before") - F.col("offset") + 1, F.col("n"))  # fewer words if it ends outside
    hits = pairs.filter(F.array_join(around, " ") == F.col("words")).select("doc_id", "h", (F.col("place") - F.col("offset")).alias("start"), "n", "words")
    hits = materialise(hits.distinct(), "hits")
    covered = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end")))),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n")),
        lambda acc: acc["n"],
    )
    words_hit = hits.groupBy("doc_id", "h").agg(covered.alias("n_hit"))
    # Items with the same set of windows are one class: documents are matched with classes, then given their ids.
    classes = every.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.array_sort(F.collect_set("words")).alias("all")).groupBy("all").agg(F.collect_list(F.col("item_id").cast("string")).alias("ids"))
    classes = classes.withColumn("class", F.xxhash64("ids"))
    of_class = hits.select("doc_id", "h", "words").join(classes.select("class", F.explode("all").alias("words")), "words").select("doc_id", "h", "class").distinct()
    ids = of_class.join(classes.select("class", "ids"), "class").groupBy("doc_id", "h").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("item_ids"))
    found = words_hit.join(ids, words_hit["doc_id"].eqNullSafe(ids["doc_id"]) & words_hit["h"].eqNullSafe(ids["h"]), "left").select(words_hit["doc_id"].alias("d"), words_hit["h"].alias("k"), "n_hit", "item_ids")
    return marked.join(found, marked["doc_id"].eqNullSafe(found["d"]) & marked["h"].eqNullSafe(found["k"]), "left").select(
        "doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without any word in an occurrence of a benchmark window."""
    bad = find(docs, items).filter("n_hit > 0").select(F.col("doc_id").alias("d"), F.col("h").alias("k")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["d"]) & (F.xxhash64(docs["text"]) == bad["k"]), "left_anti")
