"""Substring deduplication by relative Lempel-Ziv parsing.

A word of a document goes if a run of WINDOW words over it also starts earlier: in a document of smaller
doc_id, or in the same one before. Documents are parsed greedily into factors, runs of words that the reference
(all that is earlier) holds too; factors of at least WINDOW words are duplicate spans.

The reference is indexed in blocks, and a document is parsed against every block that can hold one of its factors:

1. copies: of documents with one text, the first is parsed. The others repeat it word by word, so they lose all words
   that are in windows, and are never an earlier start than it is.
2. anchors: the least of the hashes of a window's GRAM-word shingles is its anchor. Equal windows have equal
   anchors, and neighbouring windows mostly share theirs, so a document is a sequence of segments, each under one
   anchor. A block is what stands under one anchor, in all documents.
3. shared: anchors are counted over all of these documents. What stands under an anchor that occurs once cannot repeat, and goes
   no further; so most of a corpus is never moved.
4. route: the words of the other segments go to their blocks. Windows that a step of a task has had already are
   factors at once, and do not travel.
5. parse: a block's segments come in the order of doc_id and place. Its index knows where each WINDOW words began
   first. A factor begins at the first window that the index holds, and goes on as long as the reference does. At its
   end, the windows over the boundary are looked up as well, so that none is lost between two factors.
6. a document's factors are gathered; overlapping ones are one span, and the text is written without them.

Words are compared, not hashes of them (texts are known for copies by 128 bits). An anchor of over HOT segments is no block of its own: its windows are dealt
out one by one by a 128-bit BLAKE2 digest, which stands for their words there. No task has to index more than HOT
segments, nor receive more than one row of each step for a window, however common.

Defined results: null text has no words; a null doc_id comes before all others; rows of the same doc_id and the
same start are none earlier than the other, so repeated rows keep what the first of them keeps; a very long text is a
step of its own and is parsed whole; an empty table gives an empty result; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import words as W
from tesserae.llm.batches import column, text_steps

WINDOW = 20
GRAM = 6
#: Segments that are indexed under one anchor, at most.
HOT = 10_000


class _Anchored(NamedTuple):
    words: W.Words
    grams: np.ndarray
    #: Of each segment: its text, first word, windows, anchor.
    doc: np.ndarray
    at: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray


def _anchored(data: np.ndarray, offsets: np.ndarray) -> _Anchored:
    found = W.split(data, offsets, W.NON_SPACE)
    hashed = W.hashes(data, found)
    room = np.repeat(found.first[1:], np.diff(found.first)) - np.arange(len(hashed))
    at = np.flatnonzero(room >= WINDOW)
    if not len(at):
        none = np.zeros(0, np.int64)
        return _Anchored(found, none, none, none, none, none)
    # A shingle that reaches into the next text is in no window, so those may be hashed as they come.
    grams = W.runs(hashed, np.array([0, len(hashed)]), GRAM)[1]
    least = W.sliding_min(grams, WINDOW - GRAM + 1)[at]
    doc = np.searchsorted(found.first, at, side="right") - 1
    edge = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]))
    return _Anchored(found, grams.view(np.int64), doc[edge], at[edge], np.diff(np.append(edge, len(at))), least[edge].view(np.int64))


def _occurrences(x: _Anchored) -> np.ndarray:
    """How often each segment's anchor stands in it: 1, or 2 for more; only then can one of its windows repeat within it."""
    reach = WINDOW - GRAM + 1
    n = np.zeros(len(x.at), np.int64)
    for j in range(2 * reach - 1):
        some = np.flatnonzero(x.windows + reach - 1 > j)
        n[some] += x.grams[x.at[some] + j] == x.anchor[some]
    n[x.windows > reach] = 2  # one place is in no more windows than that
    return np.minimum(n, 2)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in text_steps(batches):
        x = _anchored(data, offsets)
        anchor, which = np.unique(x.anchor, return_inverse=True)
        n = np.bincount(which, weights=_occurrences(x), minlength=len(anchor)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], ["anchor", "n"])


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_steps(batches):
        _, _, doc, _, _, anchor = _anchored(data, offsets)
        take = pa.array(doc)
        yield pa.RecordBatch.from_arrays([column(rows, "doc_id").take(take), column(rows, "h").take(take), pa.array(anchor)], ["doc_id", "h", "anchor"])


class _Factors:
    """Rows (doc of a batch, start, words, source) of factors, as they are found."""

    def __init__(self) -> None:
        self.row: list[int] = []
        self.start: list[int] = []
        self.n: list[int] = []
        self.source: list[tuple | None] = []

    def parse(self, row: int, start: int, sources: list[tuple | None]) -> None:
        """Factors of the windows from start on; sources: where each is in the reference, if it is."""
        at, top = 0, len(sources)
        while at < top:
            if (source := sources[at]) is None:
                at += 1
                continue
            end, (doc, place) = at + 1, source
            while end < top and sources[end] == (doc, place + end - at):
                end += 1
            self.row.append(row)
            self.start.append(start + at)
            self.n.append(end - at + WINDOW - 1)
            self.source.append(source)
            at = end  # the first window over the boundary of this factor


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, bucket, start, words, source_id, source_start, n): segments for the blocks, or (words null) factors found already."""
    for rows, data, offsets in text_steps(batches):
        found, _, doc, at, windows, anchor = _anchored(data, offsets)
        if not len(doc):
            continue
        text, begin, end = W.spaced(data, found)
        ids = column(rows, "doc_id").to_pylist()
        shared = column(rows, "anchors").to_pylist()
        cut = np.searchsorted(doc, np.arange(len(ids) + 1)).tolist()
        at, windows, anchor, first = at.tolist(), windows.tolist(), anchor.tolist(), found.first.tolist()
        seen: dict[bytes, tuple] = {}
        known = _Factors()
        out: tuple[list, ...] = ([], [], [], [])  # row, bucket, start, words
        for i in sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0)):
            hot_of = {s["anchor"]: s["hot"] for s in shared[i]}
            for k in range(cut[i], cut[i + 1]):
                hot = hot_of.get(anchor[k])
                if hot is None:
                    continue
                sources, lo = [], at[k] - first[i]
                new = -1  # the first of the windows at hand that are new
                for j in range(windows[k]):
                    w = text[begin[at[k] + j] : end[at[k] + j + WINDOW - 1]]
                    place = (ids[i], lo + j)
                    was = seen.setdefault(w, place)
                    again = was != place
                    sources.append(was if again else None)
                    if hot and not again:
                        digest = hashlib.blake2b(w, digest_size=16).digest()
                        for x, y in zip(out, (i, int.from_bytes(digest[:8], "little", signed=True), lo + j, digest), strict=True):
                            x.append(y)
                    elif not hot and new < 0 and not again:
                        new = j
                    if new >= 0 and (again or j == windows[k] - 1):
                        stop = j - again  # the last new one
                        for x, y in zip(out, (i, anchor[k], lo + new, text[begin[at[k] + new] : end[at[k] + stop + WINDOW - 1]]), strict=True):
                            x.append(y)
                        new = -1
                known.parse(i, lo, sources)
        kind, h = column(rows, "doc_id").type, column(rows, "h")
        # Known factors are spread over all tasks; they only pass through.
        spread = W.mix(np.array([ids[i] or 0 for i in known.row], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array(known.start, np.uint64)).view(np.int64)
        moved, n = pa.array(out[0] + known.row, pa.int64()), len(out[0])
        yield pa.RecordBatch.from_arrays(
            [
                column(rows, "doc_id").take(moved), h.take(moved), pa.array(np.concatenate([np.array(out[1], np.int64), spread])), pa.array(out[2] + known.start, pa.int32()),
                pa.array(out[3] + [None] * len(known.row), pa.binary()), pa.array([None] * n + [s[0] for s in known.source], kind), pa.array([None] * n + [s[1] for s in known.source], pa.int32()), pa.array([0] * n + known.n, pa.int32()),
            ],
            ["doc_id", "h", "bucket", "start", "words", "source_id", "source_start", "n"],
        )


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, doc_id and start; gives (doc_id, h, start, n, source_id, source_start) of factors."""
    bucket, index = None, {}
    for batch in batches:
        ids, buckets, starts = (column(batch, c).to_pylist() for c in ("doc_id", "bucket", "start"))
        words = column(batch, "words")
        plain = words.is_null().to_numpy(zero_copy_only=False)
        found = _Factors()
        for i in np.flatnonzero(~plain).tolist():
            if buckets[i] != bucket:
                bucket, index = buckets[i], {}
            doc, start, raw = ids[i], starts[i], words[i].as_py()
            if len(raw) == 16:  # a digest; WINDOW words are longer
                keys = [raw]
            else:
                parts = raw.split(b" ")
                keys, lo = [], 0
                hi = sum(map(len, parts[:WINDOW])) + WINDOW - 1
                for j in range(len(parts) - WINDOW + 1):
                    keys.append(raw[lo:hi])
                    lo += len(parts[j]) + 1
                    hi += len(parts[j + WINDOW]) + 1 if j + WINDOW < len(parts) else 0
            sources = []
            for j, key in enumerate(keys):
                place = (doc, start + j)
                was = index.setdefault(key, place)
                sources.append(was if was != place else None)
            found.parse(i, start, sources)
        row = pa.array(found.row, pa.int64())
        new = [column(batch, "doc_id").take(row), column(batch, "h").take(row), pa.array(found.start, pa.int32()), pa.array(found.n, pa.int32()), pa.array([s[0] for s in found.source], column(batch, "doc_id").type), pa.array([s[1] for s in found.source], pa.int32())]
        names = ["doc_id", "h", "start", "n", "source_id", "source_start"]
        yield pa.RecordBatch.from_arrays(new, names)
        yield batch.filter(pa.array(plain)).select(names)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text")


def _of_document(texts: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Texts joined with what was found of them. The texts' side is the same at every use, so Spark deals them out once."""
    other = found.withColumnsRenamed({"doc_id": "d", "h": "k"})
    return texts.join(other.hint("merge"), texts["doc_id"].eqNullSafe(other["d"]) & (texts["h"] == other["k"]), how).drop("d", "k")


def _marked(docs: DataFrame) -> DataFrame:
    """The texts with `first`: whether no document of smaller doc_id has the same text. Copies meet as hashes only, summed up before they are dealt out."""
    texts = _texts(docs)
    least = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("doc_id")
    firsts = texts.select("doc_id", "h", F.xxhash64(F.lit(1), "text").alias("h2")).groupBy("h", "h2").agg(least).select("doc_id", "h").distinct()
    return _of_document(texts, firsts.withColumn("first", F.lit(True)), "left").withColumn("first", F.coalesce("first", F.lit(False)))


def factors(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, h, start, n, source_id, source_start) of every factor: n words from start on stand in the document source_id, from source_start on, too; h is the text's xxhash64.

    Copies of a whole text have no factors of their own.
    """
    return _factors_of(_marked(docs), hot)


def _factors_of(marked: DataFrame, hot: int) -> DataFrame:
    kind = marked.schema["doc_id"].dataType.simpleString()
    firsts = marked.filter("first").drop("first")
    counts = firsts.select("text").mapInArrow(_count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    often = counts.filter("n > 1").select("anchor", (F.col("n") > hot).alias("hot"))
    placed = firsts.mapInArrow(_place, f"doc_id {kind}, h long, anchor long")
    shared = placed.join(often.hint("merge"), "anchor").groupBy("doc_id", "h").agg(F.collect_set(F.struct("anchor", "hot")).alias("anchors"))
    routed = _of_document(firsts, shared, "inner").mapInArrow(_segments, f"doc_id {kind}, h long, bucket long, start int, words binary, source_id {kind}, source_start int, n int")
    blocks = routed.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "start")
    return blocks.mapInArrow(_parse, f"doc_id {kind}, h long, start int, n int, source_id {kind}, source_start int")


def _remove(batches: Iterator[pa.RecordBatch], text: bool) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_steps(batches):
        found = W.split(data, offsets, W.NON_SPACE)
        spans = column(rows, "spans")
        owner = np.repeat(np.arange(len(spans)), np.array(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64))
        flat = spans.flatten()
        cover = np.zeros(len(found.start) + 1, np.int32)
        if len(flat):
            lo = found.first[owner] + flat.field("start").to_numpy(zero_copy_only=False)
            np.add.at(cover, lo, 1)
            np.add.at(cover, lo + flat.field("n").to_numpy(zero_copy_only=False), -1)
        count = np.diff(found.first)
        copy = ~column(rows, "first").to_numpy(zero_copy_only=False) & (count >= WINDOW)
        keep = (np.cumsum(cover)[:-1] == 0) & ~np.repeat(copy, count)
        kept = W.joined(data, found, keep)
        left = np.diff(np.concatenate([[0], np.cumsum(keep)])[found.first])
        what = pa.array([k.decode() for k in kept], pa.string()) if text else pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
        yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(count), pa.array(count - left), what], ["doc_id", "n_words", "n_removed", "kept"])


def _removed(docs: DataFrame, hot: int, text: bool) -> DataFrame:
    marked = _marked(docs)
    spans = _factors_of(marked, hot).groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _of_document(marked, spans, "left").select("doc_id", "text", "first", "spans")
    return rows.mapInArrow(lambda b: _remove(b, text), f"doc_id {kind}, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document: kept is the text of the words left, joined by one space."""
    return _removed(docs, hot, True)


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """As remove_repeats, with the SHA-256 of the words left instead of them."""
    return _removed(docs, hot, False).withColumnRenamed("kept", "kept_sha256")
