import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import language_id as L


def _squeezed(text):
    """Lower case, each run of ASCII signs that are no letters as one space, none at the start."""
    return re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode()).removeprefix(b" ")


def _phrases(text, samples):
    """Greedy longest phrases of a text that stand in one of the samples."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and any(text[i : j + 1] in s for s in samples):
            j += 1
        n, i = n + 1, j
    return n


def _brute(text, samples):
    """(language, score) of a text with letters."""
    squeezed, cost = _squeezed(text), {}
    for lang, ts in samples.items():
        ts = [_squeezed(t) for t in ts]
        cost[lang] = _phrases(squeezed, ts) * math.log2(max(2, sum(map(len, ts)))) / max(1, len(squeezed))
    best, second = sorted(cost.values())[:2]
    return min(sorted(cost), key=cost.get), 1 - best / second


@pytest.mark.parametrize("block, meet", [(1024, 64), (64, 5), (8, 2)])
def test_phrases_are_those_of_a_search(spark, block, meet, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "MEET", meet)
    rng = random.Random(1)
    samples = {lang: [" ".join("".join(rng.choice(abc) for _ in range(5)) for _ in range(60)) + "h" * 40 for _ in range(2)] for lang, abc in (("a", "abcdeé"), ("b", "defghi"), ("c", "ahijkß"))}
    texts = [" ".join("".join(rng.choice("abcdefghijkéß") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 400))) for _ in range(25)] + ["a", "É. É", "1é2", "h" * 5000, "h" * 3000 + " abc dé" * 200, "ab " * 2000]
    texts.append(" ".join(texts))
    model = L.build(samples)
    rows = pa.RecordBatch.from_pylist([{"row": {"doc_id": i, "text": t}} for i, t in enumerate(texts)])
    got = [r for b in L._predict(model, iter([rows])) for r in b.to_pylist()]
    for r, t in zip(got, texts, strict=True):
        lang, score = _brute(t, samples)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.row.doc_id: r.lang_pred for r in L.identify(docs, L.build(samples)).collect()} == {i: r["lang_pred"] for i, r in enumerate(got)}


def test_samples_are_whole_rows(spark):
    rows = [("a", "x" * 30), ("a", "y" * 50), ("a", "z" * 8), ("b", "v" * 90), ("b", "w" * 70), (None, "u"), ("c", "")]
    model = L.fit(spark.createDataFrame(rows, "lang string, text string"), 2, 40)
    assert model.langs == ["a", "b"] and model.bits == [math.log2(38), math.log2(70)]


def test_odd_texts(spark):
    model = L.build({"a": ["abc abc"], "b": ["xyz xyz"]})
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in [(1, None), (2, ""), (3, "12 !?"), (None, "abc"), (4, "世界"), (4, "世界")]], "doc_id long, text string, score double, row string")
    rows = sorted((str(r.row.doc_id), r.lang_pred, round(r.score, 9)) for r in L.identify(docs, model).collect())
    assert rows == [("1", "und", 0.0), ("2", "und", 0.0), ("3", "und", 0.0), ("4", "a", 0.0), ("4", "a", 0.0), ("None", "a", round(2 / 3, 9))]
    assert L.identify(docs.limit(0), model).count() == 0
    none = L.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in L.identify(docs, none).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from tesserae.llm.catalogue import op2_language_id

    sf = "/root/testdata/sf0.01"
    both = op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right = both.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right / n >= 0.98
