import hashlib
import re

import numpy as np
import pytest

from tesserae.llm import substring_dedup as D
from tesserae.llm import words as W


def brute(docs):
    key = lambda i: (i is not None, i or 0)
    first, out = {}, []
    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    for i, w in cut:
        for k in range(len(w) - 19):
            at = (key(i), k)
            first[tuple(w[k : k + 20])] = min(at, first.get(tuple(w[k : k + 20]), at))
    for i, w in cut:
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (key(i), k):
                gone |= set(range(k, k + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def clashing(df):
    """Extra columns with the names that the operator uses itself."""
    return df.withColumns({c: D.F.lit("x") for c in ("h", "anchor", "anchors", "hot", "bucket", "start", "n", "words", "spans", "d", "k", "first", "h2")})


@pytest.mark.parametrize("parts, hot", [(1, D.HOT), (5, D.HOT), (4, 1), (4, 3)])
def test_documents(make, texts, parts, hot):
    docs = [*texts, (4, texts[4][1]), (None, texts[4][1]), (200, "same " * 100), (201, "same " * 30), (202, "a b " * 25)]
    assert rows(D.digests(clashing(make(docs, parts)), hot)) == brute(docs)


@pytest.mark.parametrize("hot", [D.HOT, 2])
def test_small_steps_and_batches(spark, make, texts, hot):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        docs = [*texts, (-5, texts[8][1]), (-5, texts[8][1]), (-5, texts[9][1])]
        assert rows(D.digests(make(docs, 2), hot)) == brute(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_common_lines_in_unlike_texts(make):
    """A short line in every document makes its anchors hot, without a repeated window; some texts repeat a longer passage."""
    line, passage = "a line of eight words stands here often", " ".join(f"p{i}" for i in range(25))
    docs = [(i, " ".join(f"u{i}x{j}" for j in range(15)) + f" {line} " + " ".join(f"v{i}x{j}" for j in range(15)) + (f" {line} {passage}" if i % 3 == 0 else "")) for i in range(60)]
    for hot in (D.HOT, 10):
        assert rows(D.digests(make(docs, 4), hot)) == brute(docs)


def test_factors_are_in_their_sources(make, texts):
    docs = [(i, t) for i, t in texts if i != 3] + [(500, " ".join(f"{texts[0][1]} new {texts[4][1]}".split()[:90]))]
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    found = D.factors(make(docs), 10_000).collect()
    assert found
    for f in found:
        assert f.n >= D.WINDOW and (f.source_id, f.source_start) < (f.doc_id, f.start)
        assert words[f.doc_id][f.start : f.start + f.n] == words[f.source_id][f.source_start : f.source_start + f.n]


def test_equal_hashes_are_not_equal_words(make, texts, monkeypatch):
    """Were all anchors equal, results would be the same: words decide."""
    monkeypatch.setattr(D.W, "runs", lambda hashed, first, n: (np.zeros(0), np.full(max(0, len(hashed) - n + 1), 7, np.uint64)))
    batch = D.pa.RecordBatch.from_pylist([{"doc_id": i, "h": i, "text": t, "anchors": [{"anchor": 7, "hot": False}]} for i, t in texts])
    segments = sorted((r for b in D._segments(iter([batch])) for r in b.to_pylist()), key=lambda r: (r["bucket"], r["doc_id"], r["start"]))
    gone = {}
    for b in D._parse(iter([D.pa.RecordBatch.from_pylist(segments, D.pa.schema([("doc_id", D.pa.int64()), ("h", D.pa.int64()), ("bucket", D.pa.int64()), ("start", D.pa.int32()), ("words", D.pa.binary()), ("source_id", D.pa.int64()), ("source_start", D.pa.int32()), ("n", D.pa.int32())]))])):
        for r in b.to_pylist():
            gone.setdefault(str(r["doc_id"]), set()).update(range(r["start"], r["start"] + r["n"]))
    assert {i: n for i, _, n, _ in brute(texts) if n} == {i: len(x) for i, x in gone.items()}


def test_empty_table(make, texts):
    assert D.digests(make(texts).limit(0)).count() == 0


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 1 << 60, 100).astype(np.uint64)
    for n in (1, 2, 3, 7, 8, 15):
        assert W.sliding_min(x, n).tolist() == [int(x[i : i + n].min()) for i in range(len(x) - n + 1)]


def test_hashes_do_not_depend_on_the_place():
    data = np.frombuffer(b"ab cd ab\nlonger ab", np.uint8)
    w = W.split(data, np.array([0, 9, 18]), W.NON_SPACE)
    h = W.hashes(data, w)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
    assert [data[a:b].tobytes() for a, b in zip(w.start, w.end)] == [b"ab", b"cd", b"ab", b"longer", b"ab"]
    assert w.first.tolist() == [0, 3, 5]
