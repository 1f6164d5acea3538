import random

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))



@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with the other columns, and one more."""

    def of(rows, parts=3):
        rows = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(parts)

    return of


@pytest.fixture(scope="session")
def texts():
    """Invented texts with copies, shared passages, odd signs, nulls and a very long one."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgÄéñß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(45)]
    out = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        if i % 7 == 0 and len(words) > 40:
            words += words[5:35]
        out.append(rng.choice([" ", "  ", "\n", "\t "]).join(words))
    out += [out[3], out[3], out[8].upper(), "", " ", None, "one", "one two three", "a\x1cb　c", " ".join(rng.choice(vocabulary) for _ in range(30_000)), "x" * 50_000]
    return list(enumerate(out))
