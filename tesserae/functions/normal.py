"""Unicode's composed form (NFC) of texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Below this, no sign is changed by composing, nor composed with one before it.
_FIRST = "\u0300"


#: Texts that are composed at a time.
STEP = 8


def composed(texts: pa.Array) -> pa.Array:
    """The texts composed: beside Arrow's buffers, of what comes and what goes, only STEP of them are held."""
    one = lambda t: None if t is None else unicodedata.normalize("NFC", t)
    parts = [pa.array([one(t.as_py()) for t in texts.slice(i, STEP)], pa.string()) for i in range(0, len(texts), STEP)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _composed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for some in texts:
        yield composed(some)


def nfc(text: Column) -> Column:
    """The text in composed form. Texts without a sign from U+0300 on are in it and stay as they are; only the others are sent to Python."""
    marked = text.rlike(f"[^\\x00-{chr(ord(_FIRST) - 1)}]")
    return F.when(marked, _composed(F.when(marked, text))).otherwise(text)
