"""Price sheets: delimited text and workbooks, as (path, line, cells), and the delimited sink."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.session import materialise

#: Separators in the order in which they are tried.
SEPARATORS = ("\t", ",", ";")
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sniff(text: str) -> str:
    """The separator with most parts in the first line; of equal ones the first tried."""
    first = re.split("\r\n|\r|\n", text.lstrip("﻿").strip(), maxsplit=1)[0]
    return max(SEPARATORS, key=lambda s: (first.count(s), -SEPARATORS.index(s)))


def parse_delimited(text: str, separator: str | None = None) -> list[list[str]]:
    """Rows of a delimited text. A quote anywhere in a cell switches quoting and is dropped, two in a quoted part are one; rows end with CR, LF or both."""
    text = text.lstrip("﻿").strip()
    sep = separator or sniff(text)
    rows, row, cell, quoted, i = [], [], [], False, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                cell.append('"')
                i += 1
            else:
                quoted = not quoted
        elif c == sep and not quoted:
            row.append("".join(cell))
            cell = []
        elif c in "\r\n" and not quoted:
            if text[i : i + 2] == "\r\n":
                i += 1
            rows.append([*row, "".join(cell)])
            row, cell = [], []
        else:
            cell.append(c)
        i += 1
    if text:
        rows.append([*row, "".join(cell)])
    return rows


def column_index(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def parse_workbook(content: bytes) -> list[list[str]]:
    """The rows of a workbook's first sheet; cells that are not there are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        sheet = "xl/worksheets/sheet1.xml" if "xl/worksheets/sheet1.xml" in names else next((n for n in sorted(names) if re.match(r"xl/worksheets/[^/]+\.xml$", n)), None)
        if sheet is None:
            raise ValueError("the workbook has no sheet")
        rows = []
        for r in ElementTree.fromstring(z.read(sheet)).iter(f"{_NS}row"):
            cells: list[str] = []
            for c in r.iter(f"{_NS}c"):
                at = column_index(re.match("[A-Z]+", c.get("r", "A1"))[0]) if c.get("r") else len(cells)
                cells += [""] * (at + 1 - len(cells))
                if c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                else:
                    v = c.findtext(f"{_NS}v") or ""
                    cells[at] = shared[int(v)] if c.get("t") == "s" and v else v
            rows.append(cells)
        return rows


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            content = bytes(content)
            rows = parse_workbook(content) if content[:2] == b"PK" else parse_delimited(content.decode("utf-8", "replace"))
            out += [(path, i, r) for i, r in enumerate(rows)]
        yield pd.DataFrame(out, columns=["path", "line", "cells"])


def cells_of(record: str, separator: str) -> list[str]:
    """The cells of one row of a delimited text, without the line break that ends it."""
    if '"' not in record:
        return record.split(separator)
    cells, cell, quoted = [], [], False
    for i, part in enumerate(re.split(r'("+)', record)):  # odd ones are runs of quotes
        if i % 2:
            run = len(part)
            if quoted:  # pairs are quotes, a single one left over closes
                cell.append('"' * (run // 2))
                quoted = run % 2 == 0
            else:  # one opens, of the others pairs are quotes, and a single one left over closes
                cell.append('"' * ((run - 1) // 2))
                quoted = run % 2 == 1
        elif quoted:
            cell.append(part)
        else:
            first, *others = part.split(separator)
            cell.append(first)
            for x in others:
                cells.append("".join(cell))
                cell = [x]
    return [*cells, "".join(cell)]


_PIECES = "path string, block long, n long, text string, end string, quotes int, before int, even long, odd long, blank boolean"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (path, block, value) in the order of their block, cut at lone CRs as well, with counts that hold whatever the state at the block's start.

    `before` is the parity of the block's quotes before the piece; `even` and `odd` count the pieces up to it, itself included, at whose
    start that parity is 0 and 1: the rows that begin so far if the block starts outside, and inside, a quoted part.
    """
    at, n, before, starts = None, 0, 0, [0, 0]
    for batch in batches:
        out: list[list] = [[] for _ in range(10)]
        for path, block, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (path, block) != at:
                at, n, before, starts = (path, block), 0, 0, [0, 0]
            line = raw.decode("utf-8", "replace")
            if not block and not n:
                line = line.lstrip("\ufeff")
            end = "\n"
            if line.endswith("\r"):
                line, end = line[:-1], "\r\n"
            parts = line.split("\r")
            for k, text in enumerate(parts):
                starts[before] += 1
                quotes = text.count('"') % 2
                for column, x in zip(out, (path, block, n, text, end if k == len(parts) - 1 else "\r", quotes, before, *starts, not text.strip()), strict=True):
                    column.append(x)
                before ^= quotes
                n += 1
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["path", "block", "n", "text", "end", "quotes", "before", "even", "odd", "blank"])


def _sniffed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sniff(t if only else f"{t.lstrip()}\n.") for t, only in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["path", "separator"])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (path, line, block, n, text, end, separator, final, starts, closes), sorted by path, block and n, with those of one row put together where they follow each other."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
    row, texts, upto = None, [], 0
    for batch in batches:
        out = []
        for piece in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
            path, line, block, n, text, end, _, final, _, closes = piece
            if row and row[:3] == [path, line, block] and n == upto + 1:
                texts += [row[5], text]
                row[5], row[7], row[9] = end, final, closes
            else:
                if row:
                    out.append([*row[:4], "".join(texts), *row[5:]])
                row, texts = list(piece), [text]
            upto = n
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(batch.schema.names))
    if row:
        last = [*row[:4], "".join(texts), *row[5:]]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(last, kinds, strict=True)], list(batch.schema.names))


def _split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, line, text, separator, final) with their cells; line 0 begins, and the final one ends, with no white space."""
    for batch in batches:
        cells = []
        for line, text, separator, final in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            text = text if line else text.lstrip()
            cells.append(cells_of(text.rstrip() if final else text, separator))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.string()))], ["path", "line", "cells"])


def read_delimited(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(path, line, cells) of delimited texts of any size, the rows of `parse_delimited`, read in parallel though cells hold line breaks.

    Spark reads byte ranges (blocks) of the files and cuts them at line feeds. Each block counts its quotes; the running parity of the
    counts tells each block whether it starts within a quoted part, and a running sum at which row. Rows are put together within each
    block; only the pieces of those that lie in several blocks are shuffled.

    Defined results: files without a character that is not white space have no rows; bytes that are no UTF-8 are replaced; where a
    quote is never closed the rest of the file is one row, as it is for parse_delimited.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary"))
    pieces = materialise(lines.mapInArrow(_pieces, _PIECES), "pieces")
    place = F.struct("block", "n")
    # A row for each file: where its text begins and ends, and its separator.
    ends = materialise(pieces.filter("not blank").groupBy("path").agg(F.min(F.struct("block", "n", "text", "even")).alias("first"), F.max(place).alias("last")), "ends-of-files")
    first = F.struct("first.block", "first.n")
    separators = ends.select("path", F.lit(separator).alias("separator")) if separator else ends.select("path", "first.text", (first == F.col("last")).alias("only")).mapInArrow(_sniffed, "path string, separator string")
    # A row for each block: the parity at its start, and the number of its first row.
    blocks = pieces.groupBy("path", "block").agg(F.sum("quotes").alias("quotes"), F.max("even").alias("even"), F.max("odd").alias("odd"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd"))
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).withColumn("rows", F.coalesce(F.sum(begun).over(earlier), F.lit(0)))
    blocks = blocks.join(ends.select("path", first.alias("first"), "first.even", "last").withColumnRenamed("even", "skipped"), "path").join(separators, "path")
    lead = F.max(F.when(F.col("block") == F.col("first.block"), F.col("rows") + F.col("skipped"))).over(Window.partitionBy("path"))
    blocks = materialise(blocks.select("path", "block", "inside", (F.col("rows") - lead).alias("rows"), "first", "last", "separator"), "blocks")

    lines = pieces.join(blocks, ["path", "block"]).filter((place >= F.col("first")) & (place <= F.col("last")))
    state = (F.col("before") + F.col("inside")) % 2
    final = place == F.col("last")
    flags = [final.alias("final"), (state == 0).alias("starts"), (((state + F.col("quotes")) % 2 == 0) | final).alias("closes")]
    lines = lines.select("path", (F.col("rows") + begun).alias("line"), "block", "n", "text", "end", "separator", *flags)
    rows = lines.sortWithinPartitions("path", "block", "n").mapInArrow(_assembled, lines.schema)
    # Assembled twice, for the whole rows and for the others, rather than written once more.
    columns = ("path", "line", "text", "separator", "final")
    whole = rows.filter("starts and closes").select(*columns)
    parts = F.array_sort(F.collect_list(F.struct("block", "n", "text", "end")))
    several = rows.filter("not (starts and closes)").groupBy("path", "line").agg(parts.alias("parts"), F.first("separator").alias("separator"), F.max("final").alias("final"))
    joined = F.concat_ws("", F.transform("parts", lambda x, i: F.when(i < F.size("parts") - 1, F.concat(x["text"], x["end"])).otherwise(x["text"])))
    several = several.withColumn("text", joined).select(*columns)
    return whole.unionByName(several).mapInArrow(_split_rows, "path string, line long, cells array<string>")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, cells) of every sheet, text or workbook; a file is one unit of work. For texts of any size there is read_delimited."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_lines, "path string, line int, cells array<string>")


def read_plain(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Large delimited files that quote whole cells only, with a heading: split and read in parallel by Spark."""
    return spark.read.option("header", True).option("sep", separator).option("quote", '"').option("escape", '"').csv(path)


def write(df: DataFrame, path: str, separator: str = ",") -> None:
    """A heading, and quotes around cells with a separator, a quote or a line break, doubled within."""
    df.write.option("header", True).option("sep", separator).option("quote", '"').option("escape", '"').option("lineSep", "\n").csv(path)


def with_mark(df: DataFrame) -> DataFrame:
    """One text column `line` as spreadsheet programs like it: each row joined by commas, quoted where needed."""
    from tesserae.functions.text import quote_csv

    return df.select(F.concat_ws(",", *[quote_csv(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]).alias("line"))
