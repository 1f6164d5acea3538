"""Near-duplicate detection on 64-bit SimHash fingerprints, with pigeonring filtering.

Fingerprint: the text's A-Z lower-cased, its words [^\\x20\\x09-\\x0D]+, all runs of SHINGLE words joined by a
space (fewer words: the whole sequence), each hashed by XXH64 with seed 42; a bit is set if it is in over half
of the hashes. No words: fingerprint 0.

Candidates: the 64 bits are cut into SEGMENTS = 5 segments in a ring. If two fingerprints differ in at most 4
bits, there is a segment from which on every chain of l consecutive segments holds at most l * 4 / 5
differences, rounded down: none in the first, one in the first two, two in the first three, three in the first
four. So pairs are searched among fingerprints that share the first segment of such a chain, and of the following
segments those halves that so few differences must leave alone. A chain of two segments gives keys of 19 or 20 bits,
one of three 26, one of four 32 or 33; the more fingerprints there are, the longer the chain (`depth`), so buckets do not
fill up. Members of a key's bucket are compared along the whole chain; only those that pass have all 64 bits compared.

Equal fingerprints are one node, whatever the number of their documents. Within a bucket only a spanning
forest of its links is written, so the rows stay in proportion to the fingerprints; a bucket with over
`block` members is dealt out to pairs of blocks, so no task has to hold an unbounded bucket.

Defined results: null text has no words; rows of null doc_id are linked like others but give no component id;
repeated rows share a fingerprint; of a group with equal smallest doc_ids any is the same id; a very long text is
hashed whole; an empty table gives an empty result; extra columns are ignored, or kept by keep_one, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import words as W
from tesserae.llm.batches import column, text_steps
from tesserae.operators.components import Forest, components
from tesserae.session import materialise

SHINGLE = 4
MAX_BITS = 4
WIDTHS = (13, 13, 13, 13, 12)
#: Bytes of text whose shingles are hashed at once: each byte takes some 200 while they are.
STEP = 1 << 20
#: Members of a bucket that one task compares with one another.
BLOCK = 20_000
SMALL = 48
#: Fingerprints up to which chains of two, and of three, segments make the keys.
DEPTHS = (1 << 22, 1 << 29)


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints, as unsigned 64-bit integers, of the texts in data."""
    data = W.lower_ascii(data)
    found = W.split(data, offsets, W.NON_SPACE)
    first, n = found.first, len(offsets) - 1
    out = np.zeros(n, np.uint64)
    if not len(found.start):
        return out
    keep = W.NON_SPACE[data]
    at = found.end[:-1]  # one space after every word but the last
    at = at[at < found.start[1:]]
    keep[at] = True
    data[at] = 0x20
    place = np.cumsum(keep) - 1
    text = data[keep].tobytes()
    start, end = place[found.start], place[found.end - 1] + 1
    count = np.diff(first)
    shingles = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(n), shingles)
    lead = first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    tail = np.minimum(lead + SHINGLE, first[1:][owner]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], 42) for a, b in zip(start[lead].tolist(), end[tail].tolist(), strict=True)), ">u8", len(lead))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    some = np.flatnonzero(shingles)
    sums = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[some], axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * sums > shingles[some][:, None], axis=1).view(">u8").ravel()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_steps(batches, size=STEP):
        yield pa.RecordBatch.from_arrays([column(rows, "row"), pa.array(fingerprints_of(data, offsets).view(np.int64))], ["row", "fp"])


def fingerprints(docs: DataFrame, keep: Column) -> DataFrame:
    """(row, fp): fp is the fingerprint's 64 bits as a long."""
    rows = docs.select(keep.alias("row"), F.col("text"))
    return rows.mapInArrow(_fingerprint, f"row {rows.schema['row'].dataType.simpleString()}, fp long")


def _segments() -> list[tuple[int, int]]:
    """(shift, width) of each segment, from the high bits down."""
    left, out = 64, []
    for w in WIDTHS:
        left -= w
        out.append((left, w))
    return out


def depth_for(n: int) -> int:
    """Segments in a key's chain, so that n fingerprints, were they random, would be a few to a bucket."""
    return 2 if n <= DEPTHS[0] else 3 if n <= DEPTHS[1] else 4


def _intact(depth: int) -> list[tuple[int, ...]]:
    """Sets of halves, numbered from the second segment's first on, one of which any differences within the budgets leave alone."""
    halves = range(2 * (depth - 1))
    sets: set[frozenset[int]] = set()
    for damage in product(range(4), repeat=depth - 1):  # differences in the second segment, the third, ...
        if any(sum(damage[: i + 1]) > i + 1 for i in range(depth - 1)):
            continue
        hit = [list(combinations((2 * i, 2 * i + 1), min(2, d))) for i, d in enumerate(damage)]
        sets |= {frozenset(halves) - {h for pair in choice for h in pair} for choice in product(*hit)}
    return sorted(tuple(sorted(s)) for s in sets if not any(t < s for t in sets))


def _keys(depth: int) -> list[Column]:
    """One key for each chain and set of halves: the number of both (7 bits), the chain's first segment, and those halves."""
    segments, out = _segments(), []
    bits = lambda s, w: F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1))
    for i, (shift, width) in enumerate(segments):
        halves = []
        for s, w in (segments[(i + j) % len(segments)] for j in range(1, depth)):
            halves += [(s, w // 2), (s + w // 2, w - w // 2)]
        for chosen in _intact(depth):
            key = F.lit(len(out)).cast("long")
            for s, w in [(shift, width), *(halves[h] for h in chosen)]:
                key = F.shiftleft(key, w).bitwiseOR(bits(s, w))
            out.append(F.struct(key.alias("key"), F.lit(i).alias("chain")))
    return out


def _masks() -> list[list[np.uint64]]:
    """For each chain, the bits of its first two, three and four segments."""
    one = [((1 << w) - 1) << s for s, w in _segments()]
    return [[np.uint64(sum(one[(i + j) % 5] for j in range(l))) for l in (2, 3, 4)] for i in range(5)]


_MASKS = _masks()


def linked(x: np.ndarray, y: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Which pairs keep to every budget along the chain, and to the whole one at its end."""
    differ = x ^ y
    ok = np.arange(len(differ))
    for l in (0, 1, 2):
        mask = np.array([m[l] for m in _MASKS], np.uint64)[chain[ok]]
        ok = ok[np.bitwise_count(differ[ok] & mask) <= l + 1]
    return ok[np.bitwise_count(differ[ok]) <= MAX_BITS]


def _spread(fps: np.ndarray, chain: int, forest: Forest) -> None:
    """Join a large bucket's members, walking from member to linked members: each leaves the rest as it is reached."""
    rest = fps
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            hit = linked(np.full(len(rest), x), rest, np.full(len(rest), chain))
            if len(hit):
                for y in rest[hit].tolist():
                    forest.join(int(x), y)
                reached.extend(rest[hit])
                rest = np.delete(rest, hit)


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, chain, fp), sorted by bucket; a bucket may go on in the next batch."""
    held: tuple[np.ndarray, ...] | None = None

    def solve(bucket: np.ndarray, chain: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        forest = Forest()
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        size = np.diff(np.append(edge, len(bucket)))
        for at, n in zip(edge[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            _spread(fps[at : at + n], int(chain[at]), forest)
        small = np.repeat(size <= SMALL, size)
        left = np.flatnonzero(small)
        ends = np.repeat(edge + size, size)
        for step in range(1, SMALL):
            left = left[left + step < ends[left]]
            if not len(left):
                break
            hit = left[linked(fps[left], fps[left + step], chain[left])]
            for x, y in zip(fps[hit].tolist(), fps[hit + step].tolist(), strict=True):
                forest.join(x, y)
        a, b = forest.links()
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        new = (column(batch, "bucket").to_numpy(zero_copy_only=False), column(batch, "chain").to_numpy(), column(batch, "fp").to_numpy().view(np.uint64))
        held = new if held is None else tuple(map(np.concatenate, zip(held, new, strict=True)))
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if cut:
            yield solve(*(x[:cut] for x in held))
            held = tuple(x[cut:] for x in held)
    if held is not None and len(held[0]):
        yield solve(*held)


def links(fps: DataFrame, block: int = BLOCK, depth: int = 2) -> DataFrame:
    """(a, b): links that connect whatever fingerprints of fps (distinct, column fp) are within MAX_BITS of one another."""
    keys = fps.select("fp", F.explode(F.array(*_keys(depth))).alias("k")).select("fp", "k.key", "k.chain")
    hot = keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(mine, other), F.greatest(mine, other)).cast("struct<lo:int,hi:int>"))
    dealt = (
        keys.join(hot, "key", "left")
        .select("key", "chain", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(F.array_distinct(pairs))).alias("pair"))
        .select(F.xxhash64("key", "pair.lo", "pair.hi").alias("bucket"), "chain", "fp", "key")
    )
    sorted_rows = dealt.repartition("bucket").sortWithinPartitions("bucket", "key", "fp").select("bucket", "chain", "fp")
    return sorted_rows.mapInArrow(_bucket_links, "a long, b long").distinct()


def _rooted(nodes: DataFrame, block: int) -> DataFrame:
    """nodes (distinct, column fp) with root, the same for all fingerprints of a group."""
    stars = components(links(nodes.select("fp"), block, depth_for(nodes.count())))
    return nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id reachable by links."""
    marked = materialise(fingerprints(docs, F.struct("doc_id")).select("row.doc_id", "fp"), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = materialise(_rooted(nodes, block), "roots")
    # Written down, so that Spark can split a root with many fingerprints, and a fingerprint with many documents, in the joins.
    ids = materialise(roots.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    by_fp = materialise(roots.join(ids, "root").select("fp", "component_id"), "classes")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs with one document of each group: the one of least (doc_id, hash of text), a null doc_id last (of repeated rows, one).

    A document is known by doc_id and text, so neither null ids nor an id with several texts make groups lose theirs.
    """
    marked = materialise(fingerprints(docs, F.struct("doc_id", F.xxhash64("text").alias("h"))).select("row.doc_id", "row.h", "fp"), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("head")
    nodes = materialise(marked.groupBy("fp").agg(least), "nodes")
    heads = _rooted(nodes, block).groupBy("root").agg(F.min("head").alias("head")).select(F.col("head.doc_id").alias("head"), F.col("head.h").alias("head_h"))
    named = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("h"))
    same = named["doc_id"].eqNullSafe(F.col("head")) & (named["h"] == F.col("head_h"))
    kept = named.join(materialise(heads, "heads"), same, "left_semi")
    again = materialise(marked.groupBy("doc_id", "h").count().filter("count > 1").select(F.col("doc_id").alias("twin"), F.col("h").alias("twin_h")), "repeated-rows")
    if again.isEmpty():
        return kept.select("row.*")
    # Only rows that are there more than once are grouped, and each task first leaves one of its own.
    twin = kept["doc_id"].eqNullSafe(F.col("twin")) & (kept["h"] == F.col("twin_h"))
    once = kept.join(again, twin, "left_anti").select("row")
    one = kept.join(again, twin, "left_semi").groupBy("doc_id", "h").agg(F.first("row").alias("row")).select("row")
    return once.unionAll(one).select("row.*")
