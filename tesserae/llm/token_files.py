"""Token ids in binary files with shuffled bit or byte planes.

A file holds the ids of a contiguous range of documents, in ascending doc_id order:

    magic "TIDS0001"
    chunks: CHUNK ids each (the last fewer), as unsigned 32-bit integers, transposed into 4 byte planes or 32
            bit planes; each plane is a zstandard frame of its own
    index:  a zstandard frame of: u32 planes, u64 chunks, u64 documents; per chunk u32 ids and the u32 size of
            each of its planes; per document i64 doc_id, u8 whether it is null, u64 ids
    u64 size of the index, magic

So any chunk can be read alone: the index gives its place. Files go to the shared folder, whole or not at all
(each is written under a name of its attempt, then renamed), so a task that is run again leaves the same file.
Workers write through Arrow's file systems (file, hdfs, s3, gs, abfss), to the place that Spark resolves the folder to.

Texts are encoded by the tokenizers library, which sees every distinct word once while it is remembered, as the rules
of the public vocabulary never join two words; with other rules it is given whole texts.

Defined results: null text is empty; a null doc_id comes first; rows of the same doc_id are put in the order of their
texts; a very long text may make its file longer than FILE_IDS, and spans chunks; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.batches import column, strings_of, text_steps
from tesserae.llm.recent import Recent
from tesserae.session import materialise, scratch

MAGIC = b"TIDS0001"
CHUNK = 1 << 16
#: Ids in one file at most, save for one longer document.
FILE_IDS = 1 << 24
CACHED = 150_000
#: Words that the tokenizer library gets at once.
JOINED = 300
#: Words whose ids are gathered at once.
GATHERED = 1 << 18
#: Letters of ASCII and Latin-1, digits, signs and white space, without apostrophes and angle brackets (contractions, special tokens); and the words of such a text in lower case.
_PLAIN_TEXT = re.compile(r"[\t-\r -&(-;=-~À-ÖØ-öø-ÿ]*")
_WORD = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: The same for columns, in Arrow's dialect: a text of such signs that is not blank, and what is a word of its own within a run.
_PLAIN_COLUMN = r"\A[\t-\r ]*[!-&(-;=-~À-ÖØ-öø-ÿ][\t-\r -&(-;=-~À-ÖØ-öø-ÿ]*\z"
_SIGNS = r"[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+"
#: The rules of the vocabulary file for which words may be encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_ODD = [chr(c) for c in range(0x1C, 0x20)]  # white space for str.split only


def default_vocabulary() -> str:
    """The path of the public word-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gather(pool: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The parts of pool, which have these sizes one after another, in the order that `at` names them."""
    starts, n = np.cumsum(sizes) - sizes, sizes[at]
    return pool[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]


class WordEncoder:
    """A tokenizer whose rules never join what white space parts.

    Texts of plain signs are cut, as a column, where the tokenizer's own rule cuts them. New words, which are in normal
    form then, go many at a time to a tokenizer of the same file that normalizes nothing and cuts at white space only:
    each word's last token, and no other, is one that ends a word.
    """

    def __init__(self, content: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        size = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.known, self.words = Recent(CACHED // 4), Recent(CACHED)
        spec = json.loads(content)
        suffix = spec["model"].get("end_of_word_suffix")
        #: Whether texts may be cut into words here; by any other rules than these, the library gets whole texts.
        self.cuts = spec.get("normalizer") == _NORMALIZER and (spec.get("pre_tokenizer") or {}).get("pretokenizers", [None])[0] == _SPLIT
        self.suffixed = bool(suffix) and self.cuts
        if self.suffixed:
            later = spec["pre_tokenizer"]["pretokenizers"][1:]
            bare = spec | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *later]}, "padding": None, "truncation": None}
            self.bare = Tokenizer.from_str(json.dumps(bare))
        self.ends = np.zeros(size, bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True

    def forget(self) -> None:
        """Drop what was remembered of texts."""
        self.known.forget()
        self.words.forget()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(words), JOINED):
            some = words[lo : lo + JOINED]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(some) or cut[-1] != len(ids):
                out += self._ids(some)
                continue
            raw, at = ids.tobytes(), [0, *(cut * ids.itemsize).tolist()]
            out += [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return out

    def _run_ids(self, runs: list[str]) -> list[bytes]:
        if not self.suffixed:
            return self._ids(runs)
        parts = [_WORD.findall(r.lower()) if _PLAIN_TEXT.fullmatch(r) else [] for r in runs]
        get = self.words.of(parts, self._word_ids).__getitem__
        rest = iter(self._ids([r for r, p in zip(runs, parts, strict=True) if not p]))
        return [b"".join(map(get, p)) if p else next(rest) for p in parts]

    def _plain_ids(self, texts: pa.Array, tail: bytes) -> list[bytes]:
        """The ids of texts of plain signs: each distinct word is looked up once, its ids are gathered for all places."""
        spaced = pc.replace_substring_regex(pc.utf8_lower(texts), _SIGNS, r" \0 ")
        runs = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))
        coded = runs.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self.words.each(words, (np.bincount(at, minlength=len(words)) > 1).tolist(), self._word_ids)
        pool = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // pool.itemsize
        raw = b"".join(_gather(pool, sizes, at[lo : lo + GATHERED]).tobytes() for lo in range(0, len(at), GATHERED))
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        cuts = (ends[runs.offsets.to_numpy()] * pool.itemsize).tolist()
        return [raw[a:b] + tail for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_batch(self, texts: list[str] | pa.Array, end: int) -> list[bytes]:
        """The ids of each text, and the end id after them.

        A text of plain signs is cut into words at once; any other at its white space, and one with signs that
        only Python takes for white space is given to the library as it is.
        """
        tail = np.array([end], self.dtype).tobytes()
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        plain = pc.match_substring_regex(col, _PLAIN_COLUMN) if self.suffixed else pa.array([False] * len(col), pa.bool_())
        from_words = iter(self._plain_ids(col.filter(plain), tail))
        others = col.filter(pc.invert(plain)).to_pylist()
        odd = [not self.cuts or any(c in t for c in _ODD) for t in others]
        runs = [t.split() for t, o in zip(others, odd, strict=True) if not o]
        get = self.known.of(runs, self._run_ids).__getitem__
        from_runs = iter([b"".join(map(get, r)) + tail for r in runs])
        from_library = iter([ids + tail for ids in self._ids([t for t, o in zip(others, odd, strict=True) if o])])
        rest = iter([next(from_library if o else from_runs) for o in odd])
        return [next(from_words if p else rest) for p in plain.to_pylist()]


@lru_cache(maxsize=2)
def _encoder(content: str) -> WordEncoder:
    return WordEncoder(content)


def pack(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The compressed planes of one chunk."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if bits:
        planes = np.concatenate([np.packbits(plane[None, :] >> np.arange(8, dtype=np.uint8)[:, None] & 1, axis=1) for plane in planes])
    squeeze = zstandard.ZstdCompressor(level=1)
    return [squeeze.compress(p.tobytes()) for p in planes]


def unpack(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of one chunk."""
    plain = [np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.uint8) for p in planes]
    if len(plain) == 32:
        plain = [np.sum([np.unpackbits(plain[8 * i + j])[:n] << j for j in range(8)], axis=0, dtype=np.uint8) for i in range(4)]
    return np.stack(plain, axis=1).reshape(-1).view("<u4")


class Writer:
    """One file: documents go in one by one, chunks out as they fill."""

    def __init__(self, out, bits: bool) -> None:
        self.out, self.bits = out, bits
        self.held: list[np.ndarray] = []
        self.n_held = self.ids = 0
        self.chunks: list[tuple[int, list[int]]] = []
        self.docs: list[tuple[int | None, int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.ids += len(ids)
        if self.n_held >= CHUNK:
            self._flush(CHUNK)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.held)
        while len(ids) >= max(1, least):
            planes = pack(ids[:CHUNK], self.bits)
            for p in planes:
                self.out.write(p)
            self.chunks.append((min(CHUNK, len(ids)), [len(p) for p in planes]))
            ids = ids[CHUNK:]
        self.held, self.n_held = [ids], len(ids)

    def close(self) -> None:
        if self.held:
            self._flush(1)
        index = struct.pack("<IQQ", 32 if self.bits else 4, len(self.chunks), len(self.docs))
        index += np.array([[n, *sizes] for n, sizes in self.chunks], "<u4").tobytes()
        index += np.array([0 if d is None else d for d, _ in self.docs], "<i8").tobytes()
        index += np.array([d is None for d, _ in self.docs], "u1").tobytes() + np.array([n for _, n in self.docs], "<u8").tobytes()
        packed = zstandard.ZstdCompressor(level=3).compress(index)
        self.out.write(packed + struct.pack("<Q", len(packed)) + MAGIC)


class Reader:
    """The documents of one file's content."""

    def __init__(self, content: bytes) -> None:
        if content[:8] != MAGIC or content[-8:] != MAGIC:
            raise ValueError("not a whole token file")
        self.content = content
        (size,) = struct.unpack("<Q", content[-16:-8])
        index = zstandard.ZstdDecompressor().decompress(content[-16 - size : -16])
        planes, chunks, docs = struct.unpack_from("<IQQ", index)
        at = struct.calcsize("<IQQ")
        self.chunks = np.frombuffer(index, "<u4", chunks * (1 + planes), at).reshape(chunks, 1 + planes)
        at += self.chunks.nbytes
        ids = np.frombuffer(index, "<i8", docs, at)
        null = np.frombuffer(index, "u1", docs, at + 8 * docs)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.sizes = np.frombuffer(index, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.places = len(MAGIC) + np.concatenate([[0], np.cumsum(self.chunks[:, 1:].sum(axis=1, dtype=np.int64))])

    def chunk(self, k: int) -> np.ndarray:
        ends = self.places[k] + np.cumsum(self.chunks[k, 1:].astype(np.int64))
        starts = [self.places[k], *ends[:-1]]
        return unpack([self.content[a:b] for a, b in zip(starts, ends, strict=True)], int(self.chunks[k, 0]))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, k = np.zeros(0, "<u4"), 0
        for doc_id, n in zip(self.doc_ids, self.sizes.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, held[:n]
            held = held[n:]


def _uri(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and host of its file system, as Spark resolves it, in the names that Arrow knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    full = str(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString())
    return re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", full))


def _write(batches: Iterator[pa.RecordBatch], content: str, end: int, uri: str, bits: bool, file_ids: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    writer, name, made = None, "", []

    def close() -> None:
        writer.close()
        writer.out.close()
        temporary, target = f"{path}/_{name}.{context.taskAttemptId()}", f"{path}/{name}"
        if fs.get_file_info(target).type == pafs.FileType.NotFound:
            fs.move(temporary, target)
        else:  # another attempt of this task has written the same
            fs.delete_file(temporary)
        made.append((name, len(writer.docs), writer.ids))

    encoder = _encoder(content)
    try:
        for rows, data, offsets in text_steps(batches, size=4 << 20):
            for doc_id, ids in zip(column(rows, "doc_id").to_pylist(), encoder.encode_batch(strings_of(data, offsets), end), strict=True):
                if writer is None:
                    name = f"ids-{context.partitionId():06d}-{len(made):04d}.tids"
                    writer = Writer(fs.open_output_stream(f"{path}/_{name}.{context.taskAttemptId()}"), bits)
                writer.add(doc_id, np.frombuffer(ids, encoder.dtype).astype("<u4"))
                if writer.ids >= file_ids:
                    close()
                    writer = None
    finally:
        encoder.forget()  # the worker goes on to other tasks
    if writer is not None:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "n_docs", "n_ids"])


def write(docs: DataFrame, folder: str, end: int = 1, bits: bool = False, vocabulary: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of every document, and `end` after each, to files in folder; returns (file, n_docs, n_ids).

    Names ascend with the doc_ids. Rows are numbered, and dealt out by ranges of doc_id and that number, so rows of one id, or
    of none, are spread over tasks. `bits`: bit planes instead of byte planes. A file ends
    with the document that brings it to `file_ids` ids.
    """
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file, whatever the corpus
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("number"))
    dealt = rows.repartitionByRange("doc_id", "number").sortWithinPartitions("doc_id", "number").drop("number")
    uri = _uri(docs.sparkSession, folder)
    return materialise(dealt.mapInArrow(lambda b: _write(b, shared.value, end, uri, bits, file_ids), "file string, n_docs long, n_ids long"), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(column(batch, "path").to_pylist(), column(batch, "content"), strict=True):
            reader = Reader(content.as_buffer().to_pybytes())
            starts = np.cumsum(reader.sizes) - reader.sizes
            crcs = [zlib.crc32(ids.tobytes()) for _, ids in reader.documents()]
            arrays = [pa.array([path.rsplit("/", 1)[-1]] * len(crcs), pa.string()), pa.array(reader.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(reader.sizes), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["file", "doc_id", "place", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.tids").load(folder).select("path", "content")
    docs = materialise(files.mapInArrow(_read, "file string, doc_id long, place long, n_tokens long, ids_crc32 long"), "documents")
    totals = docs.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = totals.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return docs.join(before, "file").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, end: int = 1, bits: bool = False, vocabulary: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files to the shared folder, and read them back."""
    folder = scratch(docs.sparkSession, "token-files")
    made = write(docs, folder, end, bits, vocabulary, file_ids)
    if made.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(docs.sparkSession, folder)
