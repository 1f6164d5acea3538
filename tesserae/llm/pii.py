"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits, schemes and
identifier cues. Deterministic local parsers expand each anchor to the left and right, and validate what they
find:

* email: from an at-sign, left over local characters, right over a domain with at least one dot;
* ip: from the first digit of a run, four runs of digits with dots between, parts at most 255;
* card: from a digit, on over single spaces or hyphens, 16 to 19 digits that pass Luhn's check;
* phone: from a plus sign, on over digits, spaces, brackets, dots and hyphens, 8 to 15 digits;
* url: from a scheme, on to white space or a quote, without closing punctuation;
* account: from an identifier cue (account, iban, token, ...), over a separator, an identifier with a digit.

Spans of one kind do not overlap, and the leftmost is taken first; a candidate that fails its check still uses
up its characters. Spans are in code points, ends exclusive. url and account spans come on top of the others.

Defined results: null text is empty and has no spans; repeated rows give repeated results; a very long text is scanned
whole; an empty table gives no rows; extra columns are ignored or carried along in `row`, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.batches import column, text_steps, texts_of

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = 4  # the first so many kinds are the base
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "acct", "iban", "ssn", "passport", "api_key", "apikey", "secret", "token", "password", "customer id", "member id")

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOCAL = _DIGITS | _LETTERS | frozenset("._%+-")
_PHONE = _DIGITS | frozenset(" ().-")
_LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9]+")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_URL_REST = re.compile(r"[^\s\"'<>\x00-\x1f]+")
_ACCOUNT_REST = re.compile(r"(?:\s?(?:number|no\.?|id|code|#))?\s?[:=#]?\s?[\"']?([A-Za-z0-9][A-Za-z0-9_-]{5,})")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for s in "@+":
        found.add_word(s, (s, 0))
    for s in "0123456789":
        found.add_word(s, ("0", 0))
    for s in SCHEMES:
        found.add_word(s, ("url", len(s) - 1))
    for s in CUES:
        found.add_word(s, ("account", len(s) - 1))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _email(text: str, at: int, free: int) -> tuple[int, int] | None:
    lo = at
    while lo > free and text[lo - 1] in _LOCAL:
        lo -= 1
    found = lo < at and _LABELS.match(text, at + 1)
    return (lo, found.end()) if found else None


def _ip(text: str, at: int) -> tuple[int, int, bool] | int:
    """The span and whether its parts are small enough, or the end of the digits looked at."""
    end = first = _RUN.match(text, at).end()
    digits = text[at:end].lstrip("0")
    fine = len(digits) < 4 and int(digits or 0) <= 255
    for _ in range(3):
        if end + 1 >= len(text) or text[end] != "." or text[end + 1] not in _DIGITS:
            return first
        part, end = end + 1, _RUN.match(text, end + 1).end()
        digits = text[part:end].lstrip("0")
        fine &= len(digits) < 4 and int(digits or 0) <= 255
    return at, end, fine


def _card(text: str, at: int) -> tuple[int, int, bool] | int:
    found = _SPACED.match(text, at)
    if not found:
        return at + 1
    digits = found[0].replace(" ", "").replace("-", "")
    return at, found.end(), 16 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int) -> tuple[int, int, bool] | None:
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = at + 2
    while end < len(text) and text[end] in _PHONE:
        end += 1
    while end > at + 2 and text[end - 1] not in _DIGITS:
        end -= 1
    if end < at + 4:
        return None
    return at, end, 8 <= sum(c in _DIGITS for c in text[at:end]) <= 15


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(index of the kind, start, end), sorted."""
    out: list[tuple[int, int, int]] = []
    free = dict.fromkeys(KINDS, 0)  # per kind, where the next span may begin
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: fold letter by letter
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for last, (kind, back) in _anchors().iter(low):
        at = last - back
        if kind == "0":
            if at >= free["ip"]:
                got = _ip(text, at)
                if isinstance(got, int):
                    free["ip"] = got
                else:
                    free["ip"] = got[1]
                    if got[2]:
                        out.append((1, got[0], got[1]))
            if at >= free["card"]:
                got = _card(text, at)
                if isinstance(got, int):
                    free["card"] = got
                else:
                    free["card"] = got[1]
                    if got[2]:
                        out.append((2, got[0], got[1]))
        elif kind == "@":
            if at >= free["email"] and (got := _email(text, at, free["email"])):
                out.append((0, *got))
                free["email"] = got[1]
        elif kind == "+":
            if at >= free["phone"] and (got := _phone(text, at)):
                free["phone"] = got[1]
                if got[2]:
                    out.append((3, got[0], got[1]))
        elif kind == "url":
            if at >= free["url"] and (got := _URL_REST.match(text, last + 1)):
                end = last + 1 + len(got[0].rstrip(".,;:!?)]}"))
                if end > last + 1:
                    out.append((4, at, end))
                    free["url"] = end
        elif at >= free["account"] and not (at and (text[at - 1] in _LETTERS or text[at - 1] in _DIGITS)):
            got = _ACCOUNT_REST.match(text, last + 1)
            if got and any(c in _DIGITS for c in got[1]):
                out.append((5, *got.span(1)))
                free["account"] = got.end()
    out.sort()
    return out


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by the kind of its first."""
    parts, done = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= done:
            parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join(parts) + text[done:]


def _scan(batches: Iterator[pa.RecordBatch], redacted: bool, within: str | None) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for rows, data, offsets in text_steps(batches, within):
        found, clean = [], []
        for t in texts_of(data, offsets):
            s = spans_of(t)
            found.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in s])
            if redacted:
                clean.append(redact(t, s) if s else None)
        arrays = [column(rows, "row"), pa.array(found, kind)] + ([pa.array(clean, pa.string())] if redacted else [])
        yield pa.RecordBatch.from_arrays(arrays, ["row", "spans", "clean"][: len(arrays)])


def find(docs: DataFrame, keep: Column | None = None, redacted: bool = False) -> DataFrame:
    """(row, spans[, clean]) of every document: spans by kind, then start; clean is the redacted text, null where nothing changes."""
    rows = docs.select(F.struct("*").alias("row")) if keep is None else docs.select(keep.alias("row"), "text")  # a text goes to Python once
    within = "row" if keep is None else None
    schema = f"row {rows.schema['row'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>" + ", clean string" * redacted
    return rows.mapInArrow(lambda batches: _scan(batches, redacted, within), schema)


def redacted_documents(docs: DataFrame) -> DataFrame:
    """docs, with the columns it has, its texts redacted and n_chars, where there is such a column, counted anew."""
    fields = [F.coalesce("clean", "row.text").alias("text") if c == "text" else F.when(F.col("clean").isNull(), F.col("row.n_chars")).otherwise(F.length("clean").cast(t)).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c, t in docs.dtypes]
    return find(docs, redacted=True).select(*fields)
