"""Byte-pair encoding of words along a prefix-sharing trie, and decoding.

The distinct words of a step form a trie. Each of its nodes is given the last token of the encoding of the bytes
on its path: the longest token t that ends there, such that t may follow the last token of the node len(t) bytes
up. Two tokens may follow one another if no merge across their seam comes before the merges that made them; an
encoding is right if all its neighbours may. So a node needs only the states of its ancestors, and a prefix shared
by many words is encoded once. A word's ids are read from its node back to the root.

The trie is kept implicitly: its nodes are prefixes of sorted words. All nodes of one depth are visited together, as
columns: an Aho-Corasick automaton over the vocabulary names the longest token that ends at each, its links the
shorter ones. Where FEW words go deeper, they are visited depth first, and the stack of states is cut back to the
prefix that a word shares with the one before it.

Texts are cut into words by the tokenizer file's rule: 's 't 're 've 'm 'll 'd, letters, numbers or other signs,
each with at most one space before, or white space. Special tokens of the file that stand in a text are encoded
as their ids, as the tokenizers library does by default. Within a step of TRIE_BYTES of text, what lies between two
spaces is cut into words once, and each word encoded once. Of texts nothing is remembered from step to step but
which tokens may follow one another, in tables of bounded size, so a worker's memory does not grow with what it has read.

Other vocabulary files than byte-level ones of this rule are refused, rather than encoded wrongly; so are texts with a
byte for which the file has no token.

Defined results: null text is empty: no ids; repeated rows give repeated results; a very long text is a step, and a
trie, of its own; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.batches import column, text_steps

#: Pairs of tokens whose seam is remembered: words visited depth first, and places (a power of two) for all others.
FOLLOWS = 200_000
PLACES = 1 << 19
#: Bytes of text whose words make one trie.
TRIE_BYTES = 4 << 20
#: Words of one depth that are visited one by one.
FEW = 64
_SPACE = r"\t-\r \x85\xa0  -     　"
_KINDS = regex.compile(rf"([{_SPACE}])|(\p{{L}})|(\p{{N}})|.", regex.DOTALL)
_BLANK, _LETTER, _OTHER, _UNSEEN = 1, 2, 0, 255
#: The bytes that white space begins with.
_BLANK_BYTES = np.isin(np.arange(256), list({c.encode()[0] for c in map(chr, range(0x3001)) if regex.match(f"[{_SPACE}]", c)}))
#: Steps of a multiplicative hash.
_HASH = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    """The path of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary file writes for each byte, and its byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _unlike(spec: dict) -> str:
    """What of a tokenizer file asks for other ids than this encoder's, if anything does."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer"):
        return "a normalizer is set"
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return "texts are cut by another rule"
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return "the model has other rules"
    if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        return "special tokens take in what is beside them"
    return ""


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The parts of pool that have these starts and sizes, in the order that `at` names them."""
    n = sizes[at]
    return pool[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _distinct(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Which of the distinct parts stands between each two cuts, and these parts."""
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
    return parts.indices.to_numpy(), parts.dictionary


def _bytes_of(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of byte strings, and where each begins and the last ends."""
    cuts = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
    data = np.frombuffer(parts.buffers()[2] or b"", np.uint8)
    return data[cuts[0] : cuts[-1]], cuts - cuts[0]


def _levels(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, few: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The trie of ascending words, by depth: (depth, words with a byte there, that byte, whether the word is the first of its node), while there are more than `few`."""
    rows, same, depth = np.arange(len(sizes)), np.arange(len(sizes)) > 0, 0
    while True:
        there = sizes[rows] > depth
        if not there.all():
            rows, same = rows[there], same[there]
        if len(rows) <= few:
            return
        byte = flat[starts[rows] + depth]
        same[0] = False
        same[1:] &= (byte[1:] == byte[:-1]) & (rows[1:] == rows[:-1] + 1)
        yield depth, rows, byte, ~same
        depth += 1


class Encoder:
    """One vocabulary: merges in order of rank, and the ids of its tokens."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        if fault := _unlike(spec):
            raise ValueError(f"this encoder follows byte-level vocabulary files only; here {fault}")
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in {a["content"] for a in spec["added_tokens"]}}
        self.bytes_of = {i: raw(t) for t, i in vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        #: Per token: when it is made (-1: a byte), and of which two.
        self.made, self.left, self.right = ([-1] * (max(self.bytes_of) + 1) for _ in range(3))
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            self.merge[x, y] = rank
            if self.made[t] < 0:
                self.made[t], self.left[t], self.right[t] = rank, x, y
        self.ids = {b: i for i, b in self.bytes_of.items() if i not in self.special.values() and (len(b) == 1 or self.made[i] >= 0)}
        #: The bytes that no token of the file stands for.
        self.missing = np.array([bytes([b]) not in self.ids for b in range(256)])
        self.follows: dict[int, bool] = {}
        sized = [self.bytes_of.get(i, b"") for i in range(len(self.made))]
        self.sizes = np.array([len(b) for b in sized], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(sized), np.uint8)
        self.marks = regex.compile(b"|".join(regex.escape(m.encode()) for m in sorted(self.special, key=len, reverse=True))) if self.special else None
        #: The same as columns; merges by their pair, ascending.
        self.made_of, self.left_of, self.right_of = (np.array(x, np.int64) for x in (self.made, self.left, self.right))
        pairs = np.array([x << 32 | y for x, y in self.merge], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], np.array(list(self.merge.values()), np.int64)[order]
        self.places = np.full(PLACES, -1, np.int64)
        #: What each sign is: white space, a letter, a number or another; found when it is first seen.
        self.kinds = np.full(0x110000, _UNSEEN, np.uint8)
        # A token that its own merges do not lead to is never in an encoding.
        made = np.array([i for b, i in self.ids.items() if len(b) > 1], np.int64)
        stays = self._may_follow(self.left_of[made], self.right_of[made], self.made_of[made])
        never = set(made[~stays].tolist())
        self.ids = {b: i for b, i in self.ids.items() if i not in never}
        self._make_automaton()

    def _make_automaton(self) -> None:
        """Finds the longest token that ends at each byte of a word, and the shorter ones."""
        tokens = sorted(self.ids)
        ids, sizes = np.array([self.ids[b] for b in tokens]), np.array([len(b) for b in tokens])
        flat, starts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes
        at, count, levels = np.zeros(len(tokens), np.int64), 1, []
        for depth, rows, byte, first in _levels(flat, starts, sizes):
            node = count + np.cumsum(first) - 1
            ends = sizes[rows] == depth + 1
            levels.append((at[rows[first]], byte[first].astype(np.int64), node[ends], ids[rows[ends]]))
            at[rows] = node
            count += int(first.sum())
        edges = np.concatenate([above << 8 | byte for above, byte, _, _ in levels])
        order = np.argsort(edges)
        self.edges, self.below = edges[order], order + 1  # nodes are numbered as they were met
        self.fail, self.longest = np.zeros(count, np.int64), np.full(count, -1, np.int64)
        self.shorter = np.full(len(self.made), -1, np.int64)
        node = 1
        for above, byte, ends, tokens_there in levels:
            nodes = np.arange(node, node + len(above))
            node += len(above)
            if above.any():
                self.fail[nodes] = self._advance(self.fail[above], byte)
            self.longest[nodes] = self.longest[self.fail[nodes]]
            self.shorter[tokens_there] = self.longest[ends]
            self.longest[ends] = tokens_there
        #: The same for words that are visited depth first: all tokens that end at each byte, longest first; bytes as the letters of Latin-1.
        self.ending = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.ending.add_word(b.decode("latin-1"), (i, len(b)))
        self.ending.make_automaton()

    def _advance(self, nodes: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes of the automaton after one more byte each."""
        out, live = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        while len(live):
            edge = nodes << 8 | byte
            found = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            hit = self.edges[found] == edge
            out[live[hit]] = self.below[found[hit]]
            on = ~hit & (nodes > 0)
            live, nodes, byte = live[on], self.fail[nodes[on]], byte[on]
        return out

    def forget(self) -> None:
        """Drop what was remembered of texts."""
        self.follows.clear()
        self.places.fill(-1)

    def may_follow(self, a: int, b: int, last: int | None = None) -> bool:
        """Whether the seam between tokens a and b stays: their makings are undone from the latest on, and no merge over the seam may come before."""
        bound = float("inf") if last is None else last
        while True:
            rank = self.merge.get((a, b))
            if rank is not None and rank < bound:
                return False
            ra, rb = self.made[a], self.made[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                bound, a = ra, self.right[a]
            else:  # of equal merges the left one is made first
                bound, b = rb + 1, self.left[b]

    def _may_follow(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The same for pairs of tokens, as columns."""
        out, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            pair = a << 32 | b
            found = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            gone = (self.pairs[found] == pair) & (self.ranks[found] < bound)
            out[live[gone]] = False
            ra, rb = self.made_of[a], self.made_of[b]
            on = ~gone & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[on], a[on], b[on], ra[on], rb[on]
            later = ra > rb
            bound = np.where(later, ra, rb + 1)
            a, b = np.where(later, self.right_of[a], a), np.where(later, b, self.left_of[b])
        return out

    def _follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each token b may follow its token a; what was found last is kept in the place of its pair."""
        pair = a << 32 | b
        place = (pair.astype(np.uint64) * _HASH >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)
        kept = self.places[place]
        out = (kept & 1).astype(bool)
        new = np.flatnonzero(kept >> 1 != pair)
        if len(new):
            out[new] = self._may_follow(a[new], b[new], np.full(len(new), 1 << 40))
            self.places[place[new]] = pair[new] << 1 | out[new]
        return out

    def learn(self, words: list[bytes]) -> list[bytes]:
        """The ids, as little-endian 32-bit integers, of each of these distinct words, which ascend, depth first."""
        follows = self.follows
        if len(follows) > FOLLOWS:
            follows.clear()
        out, states, before = [], [], b""
        for word in words:
            shared, top = 0, min(len(before), len(word))
            while shared < top and before[shared] == word[shared]:
                shared += 1
            del states[shared:]
            for at, (t, size) in self.ending.iter(word.decode("latin-1")):
                if at < shared:  # known from the word before, or from a longer token
                    continue
                if size <= at:
                    pair = states[at - size] << 32 | t
                    ok = follows.get(pair)
                    if ok is None:
                        ok = follows[pair] = self.may_follow(states[at - size], t)
                    if not ok:
                        continue
                states.append(t)
                shared += 1
            tokens, end = [], len(word)
            while end:
                tokens.append(states[end - 1])
                end -= len(self.bytes_of[tokens[-1]])
            tokens.reverse()
            out.append(struct.pack(f"<{len(tokens)}I", *tokens))
            before = word
        return out

    def learn_all(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after another, and how many each has; the words ascend, and have these starts and sizes."""
        base = np.cumsum(sizes) - sizes
        states, at, done = np.zeros(int(sizes.sum()), np.int32), np.zeros(len(sizes), np.int64), 0
        for depth, rows, byte, first in _levels(flat, starts, sizes, FEW):
            heads = rows[first]
            nodes = self._advance(at[heads], byte[first].astype(np.int64))
            found, live, tokens = np.zeros(len(heads), np.int64), np.arange(len(heads)), self.longest[nodes]
            while len(live):
                size = self.sizes[tokens]
                fits = size > depth  # a token that begins the word follows none
                inner = np.flatnonzero(~fits)
                fits[inner] = self._follow(states[base[heads[inner]] + depth - size[inner]].astype(np.int64), tokens[inner])
                found[live[fits]] = tokens[fits]
                live, heads, tokens = live[~fits], heads[~fits], self.shorter[tokens[~fits]]
            node = np.cumsum(first) - 1
            states[base[rows] + depth], at[rows], done = found[node], nodes[node], depth + 1
        # Words that end within these levels are read backwards, all side by side.
        rows = np.flatnonzero(sizes <= done)
        end, read = sizes[rows] - 1, []
        while len(rows):
            tokens = states[base[rows] + end]
            read.append((rows, tokens))
            end = end - self.sizes[tokens]
            rows, end = rows[end >= 0], end[end >= 0]
        deep = np.flatnonzero(sizes > done)
        rest = [np.frombuffer(x, "<u4") for x in self.learn([flat[a : a + n].tobytes() for a, n in zip(starts[deep], sizes[deep], strict=True)])]
        counts = np.bincount(np.concatenate([r for r, _ in read] or [deep[:0]]), minlength=len(sizes))
        counts[deep] = [len(x) for x in rest]
        ends = np.cumsum(counts)
        ids = np.zeros(int(counts.sum()), np.uint32)
        for back, (rows, tokens) in enumerate(read, 1):
            ids[ends[rows] - back] = tokens
        for i, x in zip(deep, rest, strict=True):
            ids[ends[i] - len(x) : ends[i]] = x
        return ids, counts

    def _word_starts(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Where the words of pieces begin; the pieces lie between the cuts, and are cut each by itself."""
        signs = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        heads = np.zeros(len(data) + 1, bool)
        heads[cuts] = True
        heads = heads[lead]
        kinds = self.kinds[signs]
        if (kinds == _UNSEEN).any():
            new = np.unique(signs[kinds == _UNSEEN])
            self.kinds[new] = [_KINDS.match(chr(c)).lastindex or _OTHER for c in new.tolist()]
            kinds = self.kinds[signs]
        begins = heads.copy()
        begins[1:] |= kinds[1:] != kinds[:-1]
        # The last of white space before another sign is parted from the rest; if it is a space, the sign goes with it.
        after = np.flatnonzero((kinds[1:] != _BLANK) & (kinds[:-1] == _BLANK) & ~heads[1:]) + 1
        begins[after - 1] = True
        begins[after[signs[after - 1] == ord(" ")]] = False
        # 's 't 'm 'd and 're 've 'll, where a word would begin with the apostrophe.
        marks = np.flatnonzero(begins & (signs == ord("'")))
        if len(marks):
            inside = np.append(~heads, [False, False])  # whether a sign goes on with its piece
            signs = np.append(signs, np.zeros(2, np.uint32))
            one, two = signs[marks + 1], signs[marks + 2]
            short = inside[marks + 1] & np.isin(one, [ord(c) for c in "stmd"])
            long = inside[marks + 1] & inside[marks + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            taken = short | long
            begins[marks[taken] + 1] = False
            ends = marks[taken] + np.where(short[taken], 2, 3)
            begins[ends[ends < len(begins)]] = True
        return lead[begins]

    def _piece_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces of text, one after another, and how many each has; their distinct words make one trie."""
        data, cuts = _bytes_of(pieces)
        begins = self._word_starts(data, cuts)
        word, words = _distinct(data, np.append(begins, len(data)))
        order = pc.array_sort_indices(words).to_numpy().astype(np.int64)
        flat, ends = _bytes_of(words)
        ids, counts = self.learn_all(flat, ends[:-1][order], np.diff(ends)[order])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        word = place[word]
        sums = np.concatenate([[0], np.cumsum(counts[word])])
        at = np.searchsorted(begins, cuts)
        return _gather(ids, np.cumsum(counts) - counts, counts, word), np.diff(sums[at])

    def _marked(self, raw: bytes, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where special tokens begin and end in texts that lie side by side."""
        if not self.marks or not self.marks.search(raw):
            return []
        return [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.marks.finditer(raw, a, b)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie side by side, and where each text's begin and the last text's end.

        A space with a sign after it begins a word. So texts are cut there, and around special tokens, and the distinct
        pieces (each with the space before it) encoded once. A space that may have white space after it is no cut.
        """
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.missing.any() and self.missing[data].any():
            raise ValueError("a text has a byte for which the vocabulary file has no token")
        spans = self._marked(data.tobytes(), offsets)
        ends = np.zeros(len(data) + 1, bool)
        ends[offsets] = True
        for span in spans:
            ends[list(span)] = True
        spaces = np.flatnonzero(data[:-1] == ord(" "))
        spaces = spaces[~_BLANK_BYTES[data[spaces + 1]] & ~ends[spaces + 1]]
        ends[spaces] = True
        cuts = np.flatnonzero(ends)
        piece, pieces = _distinct(data, cuts)
        ids, counts = self._piece_ids(pieces)
        starts = np.cumsum(counts) - counts
        for mark in {data[a:b].tobytes() for a, b in spans}:
            at = pc.index(pieces, pa.scalar(mark, pa.large_binary())).as_py()
            starts[at], counts[at] = len(ids), 1
            ids = np.append(ids, np.uint32(self.special[mark.decode()]))
        sums = np.concatenate([[0], np.cumsum(counts[piece])])
        return _gather(ids, starts, counts, piece), sums[np.searchsorted(cuts, offsets)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        raw = [t.encode() for t in texts]
        ids, at = self.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        return _cut_up(ids.tobytes(), at * 4)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of ids that lie side by side; bytes that are no UTF-8 become replacement characters."""
        sizes = self.sizes[ids]
        raw = _gather(self.flat, self.starts[ids], sizes).tobytes()
        return [x.decode("utf-8", "replace") for x in _cut_up(raw, np.concatenate([[0], np.cumsum(sizes)])[at])]

    def decode_batch(self, ids: list[bytes]) -> list[str]:
        """The texts of ids, which are little-endian 32-bit integers."""
        return self.decode(np.frombuffer(b"".join(ids), "<u4"), np.cumsum([0, *(len(x) // 4 for x in ids)]))


def _cut_up(raw: bytes, at: np.ndarray) -> list[bytes]:
    cuts = at.tolist()
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def _encoder(content: str) -> Encoder:
    return Encoder(content)


def _encode(batches: Iterator[pa.RecordBatch], content: str, digest: bool) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(content)
    try:
        for rows, data, offsets in text_steps(batches, size=TRIE_BYTES):
            flat, at = encoder.encode(data, offsets)
            ids = _cut_up(flat.tobytes(), at * 4)
            arrays = [column(rows, "row"), pa.array(np.diff(at), pa.int64())]
            if digest:
                arrays += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in encoder.decode(flat, at)])]
            else:
                arrays.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, ["row", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids"])])
    finally:
        encoder.forget()  # the worker goes on to other tasks


def _over(docs: DataFrame, keep: Column, vocabulary: str | None, digest: bool, out: str) -> DataFrame:
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file, whatever the corpus
    rows = docs.select(keep.alias("row"), F.col("text"))
    return rows.mapInArrow(lambda batches: _encode(batches, shared.value, digest), f"row {rows.schema['row'].dataType.simpleString()}, n_tokens long, {out}")


def encode(docs: DataFrame, keep: Column | None = None, vocabulary: str | None = None) -> DataFrame:
    """(row, n_tokens, ids) of every document: ids are little-endian 32-bit integers."""
    return _over(docs, F.struct("*") if keep is None else keep, vocabulary, False, "ids binary")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: its ids, and its text decoded from them again."""
    return _over(docs, F.struct("doc_id"), vocabulary, True, "ids_sha256 string, decoded_sha256 string").select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def _decode(batches: Iterator[pa.RecordBatch], content: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(content)
    for batch in batches:
        texts = encoder.decode_batch([x or b"" for x in column(batch, "ids").to_pylist()])
        yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(texts, pa.string())], ["row", "text"])


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(row, text) of every row of encode()'s result."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    rows = encoded.select("row", "ids")
    return rows.mapInArrow(lambda batches: _decode(batches, shared.value), f"row {rows.schema['row'].dataType.simpleString()}, text string")
