"""Words of many texts at once, as NumPy arrays of byte positions and 64-bit hashes."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import xxhash

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_ALT_BASE = 0xA0761D6478BD642F
_SPAN = 1 << 20
_LONG = 256


class Words(NamedTuple):
    start: np.ndarray  # byte of the first letter
    end: np.ndarray  # byte after the last one
    first: np.ndarray  # per text, the index of its first word; one more entry for the end


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table over 256 byte values that is true inside the ranges, ends included."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Bytes of [^\x20\x09-\x0D]+ ; every byte of a longer UTF-8 sequence is one of them.
NON_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ .
ALNUM = ~byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes in `inside`; no run crosses from one text to the next."""
    if not len(data):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    w = inside[data]
    opens, closes = w.copy(), w.copy()
    opens[1:] &= ~w[:-1]
    closes[:-1] &= ~w[1:]
    full = offsets[1:] > offsets[:-1]
    at = offsets[:-1][full]
    opens[at] |= w[at]
    at = offsets[1:][full] - 1
    closes[at] |= w[at]
    start = np.flatnonzero(opens)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _poly(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of the ranges [start, end) of values; start ascends."""
    out = np.zeros(len(start), dtype=np.uint64)
    lo = 0
    while lo < len(start):
        origin = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(end, origin + _SPAN, side="right")))
        top = int(end[hi - 1])
        n = max(top - origin, 1)
        up, down = _powers(base, _SPAN) if n <= _SPAN else _powers.__wrapped__(base, n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values[origin:top] * up[: top - origin], out=sums[1 : top - origin + 1])
        out[lo:hi] = (sums[end[lo:hi] - origin] - sums[start[lo:hi] - origin]) * down[start[lo:hi] - origin]
        lo = hi
    return out


def hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """64-bit hashes of words; long ones, of which polynomials modulo 2**64 take some patterns for equal, by XXH64."""
    out = mix(_poly(data.astype(np.uint64) + np.uint64(1), words.start, words.end, _BYTE_BASE))
    for i in np.flatnonzero(words.end - words.start > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[words.start[i] : words.end[i]].tobytes(), 1)
    return out


def runs(hashed: np.ndarray, first: np.ndarray, n: int, alt: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of n words that lies in one text."""
    if len(hashed) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(len(hashed))
    at = np.flatnonzero(room >= n)
    return at, mix(_poly(hashed, at, at + n, _ALT_BASE if alt else _WORD_BASE) + np.uint64(n))


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours: the result is n - 1 shorter."""
    out, have = values, 1
    while 2 * have <= n:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(values) - n + 1], out[n - have : len(values) - have + 1]) if have < n else out


def joined(data: np.ndarray, words: Words, keep: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by one space."""
    start, size = words.start[keep], (words.end - words.start)[keep] + 1
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
    spaces = ends[1:] - 1
    at[spaces] = 0
    out = data[at] if len(at) else np.zeros(0, np.uint8)
    out[spaces] = 0x20
    cut = ends[np.concatenate([[0], np.cumsum(keep)])[words.first]].tolist()
    raw = out.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def spaced(data: np.ndarray, words: Words) -> tuple[bytes, list[int], list[int]]:
    """All words joined by one space, and where each begins and ends in that."""
    size = words.end - words.start + 1
    ends = np.cumsum(size)
    at = np.repeat(words.start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    spaces = ends - 1
    at[spaces] = 0
    out = data[at] if len(at) else np.zeros(0, np.uint8)
    out[spaces] = 0x20
    return out.tobytes(), (ends - size).tolist(), spaces.tolist()
