import hashlib
import re

import numpy as np
import public_tokenizers
from test_decontamination import brute as contaminated
from test_pii import base
from test_simhash import brute as classes
from tokenizers import Tokenizer

import corpus_pipeline
from tesserae.llm import pii

SF = "/root/testdata/sf0.001"
BYTE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_000, "1234 !!", "en", "s", 7), (10_001, None, None, "s", None), (10_002, "漢字仮名交文一二三四五六", None, "s", 12)], docs.schema)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    columns, now = docs.columns, docs.union(odd)
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.select("doc_id", "text").collect()]
        out = stage(spark, now, SF)
        if name != "bpe":
            assert out.columns == columns
            now = spark.createDataFrame(out.collect(), docs.schema)
        kept = {r.doc_id for r in now.collect()}
        if name == "language_id":
            assert kept == {i for i, _ in before if i < 10_000}
        elif name == "simhash_near_dedup":
            assert kept == {c for _, _, c in classes(before)}
        elif name == "decontamination":
            assert kept == {int(i) for i, _, hit, _ in contaminated(before, items) if not hit}
        elif name == "pii":
            texts = dict(before)
            for r in now.collect():
                assert r.n_chars == len(r.text) and not base(re.sub(r"\[[A-Z]+\]", "\n", r.text))
                if not pii.spans_of(texts[r.doc_id]):
                    assert r.text == texts[r.doc_id]
        else:
            ids = {i: np.array(BYTE.encode(t or "", add_special_tokens=False).ids, "<u4") for i, t in before}
            sha = lambda b: hashlib.sha256(b).hexdigest()
            want = [(i, len(ids[i]), sha(ids[i].tobytes()), sha((t or "").encode())) for i, t in before]
            assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == sorted(want)


def test_stages_of_odd_tables(spark):
    """No rows, null and repeated ids, null columns, and extra columns with names that stages use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ("row", "h", "fp", "spans", "clean", "score", "n_tokens", "head")
    text = docs.filter("lang = 'en' and length(text) > 400").orderBy("doc_id").first().text
    odd = spark.createDataFrame([(None, text, None, None, None), (None, text, None, None, None), (1, text[: len(text) // 2], None, "s", 1), (1, text[len(text) // 2 :] + " a@b.cd", "en", None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0)], docs.schema)
    for table in (docs.limit(0), odd):
        now = table.selectExpr("*", *[f"'x' AS {c}" for c in names])
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF)
            if name == "bpe":
                assert out.count() == now.count()
            else:
                assert out.columns == now.columns
                now = spark.createDataFrame(out.collect(), now.schema)
        # Of the copies with null ids one stays; both halves under id 1 do; texts without letters go.
        assert sorted((str(r.doc_id), "[EMAIL]" in r.text) for r in now.collect()) == ([] if table is not odd else [("1", False), ("1", True), ("None", False)])


def test_run_ends_with_tokens(spark):
    assert set(corpus_pipeline.run(spark, SF).columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
