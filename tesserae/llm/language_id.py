"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language answers, letter by letter, whether the phrase read so far
still occurs in that language's text. A document is cut greedily into longest phrases that do; the language
that needs the fewest phrases, each weighted by log2 of its text's length (the bits of a pointer into it) and
divided by the document's length, wins.

Defined results
* null text, or a text without any letter: `und`, score 0, phrase length 0;
* equal figures: the smaller language name;
* score: 1 - best / second best (1 with a single language), between 0 and 1;
* an empty table gives an empty result; with no labelled row at all every document is `und`;
* extra columns are ignored, or carried along in `row` where asked for, whatever their names;

* a very long text is parsed whole, phrases and all, across the blocks described below.

Only the training sample is bounded: whole rows, at most `rows_per_lang` of a language and of at most
`chars_per_row` characters each those of smallest hash (where a language has longer rows only, its
shortest one). Predictions read whole texts: blocks of BLOCK letters are parsed side by side, each as if a phrase
began there; then the phrase that reaches into a block is followed until its parse meets the one that is known.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.batches import column, text_steps, texts_of

BLOCK = 1024
#: Letters of a block within which the parse that enters it mostly meets the one from its start.
MEET = 64
UNDETERMINED = "und"
_GAP, _PAD, _RARE = 0, 1, 2  # classes: anything but letters, the end of a block, a byte not in the samples


class Model(NamedTuple):
    langs: list[str]
    bits: list[float]  # log2 of the length of each language's text
    classes: np.ndarray  # byte to class
    width: int  # number of classes
    steps: np.ndarray  # [state * width + class]: 2 * next state * width, plus 1 if a phrase begins
    roots: np.ndarray  # first index of each language


class _Automaton:
    """A suffix automaton over small integers, grown letter by letter."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0

    def add(self, c: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        p = self.last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = copy
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
        self.last = cur


def _squeezed(text: str) -> bytes:
    """Lower case, with every run of ASCII bytes that are no letters as one space."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    letter = _letters()[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = np.where(letter, data, 0x20)[keep]
    return out.astype(np.uint8).tobytes()


def _letters() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x61:0x7B] = True
    table[0x80:] = True
    return table


def build(samples: dict[str, list[str]]) -> Model:
    """The model of labelled texts; small, and made on the driver from the bounded sample."""
    langs = sorted(samples)
    texts = {lang: [_squeezed(t) for t in samples[lang]] for lang in langs}
    used = sorted({b for ts in texts.values() for t in ts for b in t} - {0x20})
    classes = np.full(256, _RARE, np.int32)
    classes[:0x80][~_letters()[:0x80]] = _GAP
    classes[used] = np.arange(3, 3 + len(used))
    width = 3 + len(used)
    parts, roots, bits, base = [], [], [], 0
    for lang in langs:
        auto = _Automaton()
        for t in texts[lang]:
            auto.last = 0
            for c in classes[np.frombuffer(t, np.uint8)].tolist():
                auto.add(c)
        n = len(auto.next)
        go = np.zeros((n, width), np.int64)
        for s, edges in enumerate(auto.next):
            for c, to in edges.items():
                go[s, c] = to
        # A state without an edge begins a new phrase at the root; the root is never a target, so 0 means no edge.
        begins = go == 0
        begins[0] = True
        go = np.where(begins, go[0][None, :], go)
        table = ((go * width + base) << 1) | begins
        table[:, _PAD] = base << 1
        parts.append(table.astype(np.int32).ravel())
        roots.append(base)
        base += n * width
        bits.append(math.log2(max(2, sum(map(len, texts[lang])))))
    return Model(langs, bits, classes.astype(np.uint8), width, np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(roots, np.int32))


def fit(docs: DataFrame, rows_per_lang: int = 24, chars_per_row: int = 2000) -> Model:
    """Learn from the columns text and lang of docs, on a bounded sample of whole rows of each language."""
    rows = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text")
    order = Window.partitionBy("lang").orderBy(F.length("text") > chars_per_row, F.when(F.length("text") > chars_per_row, F.length("text")), F.xxhash64("text"), "text")
    # The rank is cut task by task first, so a language's texts never meet in one task.
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows_per_lang)
    # A longer text, the shortest, stands in only for a language without others.
    picked = ranked.filter((F.length("text") <= chars_per_row) | (F.col("rank") == 1)).select("lang", "text")
    samples: dict[str, list[str]] = {}
    for row in sorted(map(tuple, picked.collect())):
        samples.setdefault(row[0], []).append(row[1])
    return build(samples)


def _count(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters of each text, phrases of each language and text)."""
    n, k = len(offsets) - 1, len(model.langs)
    cls = model.classes[data]
    gap = cls == _GAP
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    at = offsets[:-1][offsets[1:] > offsets[:-1]]
    keep[at] = ~gap[at]
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    cls = cls[keep]
    sizes = np.diff(kept)
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(n), blocks)
    total = len(owner)
    phrases = np.zeros((k, n), np.int64)
    if not total or not k:
        return sizes, phrases
    order = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    lo = kept[:-1][owner] + order * BLOCK
    length = np.minimum(BLOCK, kept[1:][owner] - lo)
    by = np.argsort(-length, kind="stable")  # so that blocks still being read are the first ones
    lo, length, owner = lo[by], length[by], owner[by]
    place = np.empty(total, np.int64)
    place[by] = np.arange(total)  # of each block, in the order of the texts
    state = np.repeat(model.roots[:, None], total, axis=1)
    count = np.zeros((k, total), np.int32)
    known = np.zeros((MEET, k, total), np.int32)
    live = np.searchsorted(-length, -np.arange(BLOCK), side="left")
    for t in range(int(length[0])):
        m = int(live[t])
        got = model.steps[state[:, :m] + cls[lo[:m] + t]]
        if t < MEET:
            known[t, :, :m] = got
        count[:, :m] += got & 1
        state[:, :m] = got >> 1
    _join(model, cls, (lo[place], length[place], owner[place]), state[:, place], count, known, place)
    for j in range(k):
        phrases[j] = np.bincount(owner, weights=count[j], minlength=n).astype(np.int64)
    return sizes, phrases


def _join(model: Model, cls: np.ndarray, blocks: tuple[np.ndarray, np.ndarray, np.ndarray], state: np.ndarray, count: np.ndarray, known: np.ndarray, place: np.ndarray) -> None:
    """Make `count` that of a parse across blocks; blocks and the states at their ends are in the order of the texts."""
    lo, length, owner = blocks
    follows = np.flatnonzero(np.concatenate([[False], owner[1:] == owner[:-1]]))
    lang, block = (x.ravel() for x in np.meshgrid(np.arange(len(model.langs)), follows, indexing="ij"))
    now = state[lang, block - 1]
    fresh = np.zeros(len(lang), np.int32)  # phrases begun before the parses meet: of the one that enters, less of the other
    left = np.flatnonzero(now != model.roots[lang])
    for t in range(MEET):
        left = left[length[block[left]] > t]
        if not len(left):
            break
        was = known[t, lang[left], place[block[left]]]
        got = model.steps[now[left] + cls[lo[block[left]] + t]]
        fresh[left] += (got & 1) - (was & 1)
        now[left] = got >> 1
        left = left[got >> 1 != was >> 1]
    met = np.ones(len(lang), bool)
    met[left] = False
    count[lang[met], place[block[met]]] += fresh[met]
    # What has not met by then is parsed on letter by letter.
    last = np.searchsorted(owner, owner, side="right") - 1
    done: dict[tuple[int, int], int] = {}
    for i in left[np.lexsort((block[left], lang[left]))].tolist():
        j, b = int(lang[i]), int(block[i])
        if done.get((j, int(last[b])), -1) < b:
            done[j, int(last[b])] = _parse_on(model, cls, lo, length, j, b, int(last[b]), state, count, place)


def _parse_on(model: Model, cls: np.ndarray, lo: np.ndarray, length: np.ndarray, j: int, b: int, last: int, state: np.ndarray, count: np.ndarray, place: np.ndarray) -> int:
    """Parse language j's blocks from b on, until the state at a block's end is the one that was taken for it; gives that block."""
    steps, now = model.steps, int(state[j, b - 1])
    while True:
        n = 0
        for c in cls[lo[b] : lo[b] + length[b]].tolist():
            got = int(steps[now + c])
            n += got & 1
            now = got >> 1
        count[j, place[b]] = n
        same = now == int(state[j, b])
        state[j, b] = now
        if same or b == last:
            return b
        b += 1


def _predict(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.array(model.bits)
    for rows, data, offsets in text_steps(batches, within="row"):
        texts = texts_of(data, offsets)
        known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        low = [t.lower().encode() for t in texts]
        sizes, phrases = _count(model, np.frombuffer(b"".join(low), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int64))
        known &= bool(model.langs)
        lang = np.full(len(texts), UNDETERMINED, object)
        score, length = np.zeros(len(texts)), np.zeros(len(texts))
        if model.langs:
            cost = phrases * bits[:, None] / np.maximum(1, sizes)[None, :]
            best = cost.argmin(axis=0)  # languages ascend, so the smaller name wins a tie
            low2 = np.sort(cost, axis=0)
            lang[known] = np.array(model.langs, object)[best[known]]
            score[known] = (1 - low2[0] / np.maximum(low2[1], 1e-300))[known] if len(bits) > 1 else 1.0
            length[known] = (sizes / np.maximum(1, phrases[best, np.arange(len(texts))]))[known]
        yield pa.RecordBatch.from_arrays([column(rows, "row"), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(length)], ["row", "lang_pred", "score", "phrase_chars"])


def identify(docs: DataFrame, model: Model, keep: Column | None = None) -> DataFrame:
    """(row, lang_pred, score, phrase_chars) of every document: row is `keep`, a struct with `text`, by default all its columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by fit's two parameters and the number of languages
    rows = docs.select((F.struct("*") if keep is None else keep).alias("row"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, phrase_chars double"
    return rows.mapInArrow(lambda batches: _predict(shared.value, batches), schema)
