"""Exact duplicates by progressive refinement.

1. length: texts are grouped by their number of bytes; a length that one text has is settled;
2. prefix: of the others, the hash of the first PREFIX characters is counted by length; a pair of length and prefix hash
   that one text has is settled;
3. full: only of what is left the whole text is hashed (SHA-256), and rows with one hash are a group.

The first scan takes lengths and prefix hashes into a narrow table, from which both of the first steps are counted. What
survives a step is marked in a bitmap, held as rows (word, marks) that are broadcast: at most MOST_BITS bits, whatever
the number of texts. Two keys that share a bit only cause a full hash that was not needed, never a wrong group, so texts
themselves are not shuffled, except by `keep_one`, which returns them.

Rows are numbered as they are written; groups are counted with partial aggregates, and rows meet their group in a plain
join of two written tables, which Spark splits where one group holds a large part of all rows.

Defined results: a null text is empty, and empty texts are a group like any other; of a group the row with the largest
doc_id stays, a null doc_id being smaller than any; of repeated rows with that doc_id one stays, the one written last; an
empty table gives no rows; extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import materialise

#: Characters of a text that the second step hashes.
PREFIX = 256
#: Bits of a bitmap: SPARE for each marked key, within these bounds. MOST_BITS makes 2^20 rows of 16 bytes.
LEAST_BITS, MOST_BITS, SPARE = 1 << 16, 1 << 26, 16


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    """The word of a bitmap that holds a key's bit, and the bit's number in it."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    return F.shiftright(at, 6), (at % 64).cast("int")


def _marks(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    word, bit = _place(key, bits)
    return keys.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("mark")).groupBy("word").agg(F.bit_or("mark").alias("marks"))


def _marked(rows: DataFrame, key: Column, marks: DataFrame, bits: int) -> DataFrame:
    """`rows` with a boolean column `marked`: the bit of its key is set. `marks` has at most bits / 64 rows."""
    word, bit = _place(key, bits)
    rows = rows.withColumn("word", word).withColumn("bit", bit)
    met = rows.join(F.broadcast(marks), "word", "left")
    return met.withColumn("marked", F.coalesce(F.getbit("marks", F.col("bit")) == 1, F.lit(False))).drop("word", "bit", "marks")


def _bits(count: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (SPARE * count).bit_length()))


def find(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(row, keep_id, group_size, kept) of every row of docs; `row` is a struct made from its columns, all of them if None."""
    text = F.coalesce(F.col("text"), F.lit(""))
    length, prefix = F.octet_length(text), F.xxhash64(F.substring(text, 1, PREFIX))
    narrow = materialise(docs.select(length.alias("n_bytes"), prefix.alias("prefix")), "prefixes")
    lengths = narrow.groupBy("n_bytes").count().filter("count > 1")
    by_length = _marks(lengths, F.col("n_bytes"), 1 << 22)
    shared = _marked(narrow, F.col("n_bytes"), by_length, 1 << 22).filter("marked").groupBy("n_bytes", "prefix").count().filter("count > 1")
    shared = materialise(shared.select("n_bytes", "prefix"), "shared-prefixes")
    bits, key = _bits(shared.count()), F.struct("n_bytes", "prefix")

    rows = docs.select((F.struct("*") if row is None else row).alias("row"), F.col("doc_id").alias("id"), text.alias("whole"), length.alias("n_bytes"), prefix.alias("prefix"))
    rows = _marked(rows, key, _marks(shared, key, bits), bits)
    full = F.when(F.col("marked"), F.unhex(F.sha2("whole", 256)))
    rows = materialise(rows.select("row", "id", full.alias("full"), F.monotonically_increasing_id().alias("number")), "full-hashes")
    settled, open_ = rows.filter("full is null"), rows.filter("full is not null")
    groups = materialise(open_.groupBy("full").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "number")).alias("keep")), "groups")
    alone = settled.select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return alone.unionAll(open_.join(groups, "full").select("row", "keep.id", "group_size", F.col("keep.number") == F.col("number")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns."""
    return find(docs).filter("kept").select("row.*")
