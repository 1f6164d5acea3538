import hashlib
import json
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesserae.llm import bpe
from tesserae.llm import token_files as T

BYTE = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
WORD = Tokenizer.from_file(P.path("word_bpe_49k.json"))
ODD = st.text(st.one_of(st.sampled_from("  \n\t\x1c\x85 　'st<|>aéßÉ19²½一😀́.-ΣİÀ"), st.characters(exclude_categories=["Cs"])), max_size=40)


COLUMNS = bpe.Encoder(open(bpe.default_vocabulary(), encoding="utf-8").read())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(open(bpe.default_vocabulary(), encoding="utf-8").read())


@pytest.fixture(scope="module")
def word_encoder():
    return T.WordEncoder(open(T.default_vocabulary(), encoding="utf-8").read())


def _ids(text):
    return np.array(BYTE.encode(text, add_special_tokens=False).ids, "<u4")


@settings(max_examples=400, deadline=None)
@given(text=ODD)
def test_byte_tokens_of_any_text(encoder, text):
    ids = encoder.encode_batch([text])[0]
    assert ids == _ids(text).tobytes()
    assert encoder.decode_batch([ids]) == [BYTE.decode(_ids(text).tolist(), skip_special_tokens=False)] == [text]


@settings(max_examples=400, deadline=None)
@given(text=ODD)
def test_word_tokens_of_any_text(word_encoder, text):
    want = np.array([*WORD.encode(text, add_special_tokens=False).ids, 1], word_encoder.dtype)
    assert word_encoder.encode_batch([text], 1)[0] == want.tobytes()


def test_plain_words_are_not_normalized_again(monkeypatch):
    """Columns of plain texts, in pieces, with blank texts and every plain sign: right without the tokenizer that normalizes."""
    encoder = T.WordEncoder(open(T.default_vocabulary(), encoding="utf-8").read())
    signs = "".join(c for c in map(chr, range(256)) if T._PLAIN_TEXT.fullmatch(c))
    texts = [signs, signs[::-1], " \x0b " + " ".join(signs) + "\x0c", "ÀÉ.É1É--É", "", " \t", "ab\x0bAB\x0cab\r\nZZ9", "a" * 300, *(f"Word{i % 7} wörd{i}, (x)" for i in range(500))]
    want = [np.array([*WORD.encode(t, add_special_tokens=False).ids, 1], encoder.dtype).tobytes() for t in texts]
    monkeypatch.setattr(T, "GATHERED", 5, raising=False)
    monkeypatch.setattr(encoder, "tokenizer", None)
    monkeypatch.setattr(encoder, "_ids", lambda texts: [b""] * len(texts))  # wrong for any that come here
    assert [encoder.encode_batch(texts, 1) for _ in range(2)] == [want] * 2
    assert encoder.encode_batch(texts[:1], 1) == want[:1]


def test_bytes_that_are_no_text(encoder):
    ids = np.array([BYTE.token_to_id("Ã"), BYTE.token_to_id("a"), BYTE.token_to_id("ð")], "<u4")
    assert encoder.decode_batch([ids.tobytes(), b""]) == [BYTE.decode(ids.tolist(), skip_special_tokens=False), ""]


def test_special_tokens_and_long_words(encoder):
    for text in ("<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "a" * 3000, " " * 2000, "=" * 700):
        assert encoder.encode_batch([text])[0] == _ids(text).tobytes()


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(ODD, st.text(st.sampled_from(" '\n\u3000stmdrevlLé19.")), st.just("a<|endoftext|> 's  <|endoftext|>")), max_size=6))
def test_byte_tokens_of_columns(texts):
    """Words of any texts, all visited together; and one by one where at most three go as deep."""
    for few in (0, 3):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(bpe, "FEW", few, raising=False)
            ids = COLUMNS.encode_batch(texts)
            assert ids == [_ids(t).tobytes() for t in texts] and COLUMNS.decode_batch(ids) == texts


def test_words_are_visited_together(monkeypatch):
    """Of thousands of new words, only the few longest are visited one by one."""
    encoder = bpe.Encoder(open(bpe.default_vocabulary(), encoding="utf-8").read())
    one_by_one, learn = [], encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda words: one_by_one.extend(words) or learn(words))
    rng = np.random.default_rng(7)
    texts = ["".join(map(chr, rng.choice([32, *range(97, 117), 233], 4000))) for _ in range(10)] + ["x" * 400, "y" * 300 + " z"]
    assert encoder.encode_batch(texts) == [_ids(t).tobytes() for t in texts]
    assert 2 <= len(one_by_one) <= 64 < len({w for t in texts for w in t.split()}) / 10


def test_bytes_without_a_token():
    """A vocabulary file that lacks a byte encodes texts without it, and refuses texts with it."""
    spec = json.loads(BYTE.to_str())
    spec["model"]["merges"], spec["added_tokens"] = [], []
    spec["model"]["vocab"] = {t: i for t, i in spec["model"]["vocab"].items() if len(t) == 1 and t != "q"}
    encoder, small = bpe.Encoder(json.dumps(spec)), Tokenizer.from_str(json.dumps(spec))
    assert encoder.encode_batch(["a b"]) == [np.array(small.encode("a b").ids, "<u4").tobytes()]
    with pytest.raises(ValueError, match="no token"):
        encoder.encode_batch(["a b", "q"])


def test_digests(make, texts):
    docs = [*texts, (3, texts[3][1]), (None, "x <|endoftext|> y")]
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(make(docs)).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((str(i), len(_ids(t or "")), sha(_ids(t or "").tobytes()), sha((t or "").encode())) for i, t in docs)
    assert bpe.digests(make(docs).limit(0)).count() == 0
    back = bpe.decode(bpe.encode(make(docs)))
    assert all((r.row.text or "") == r.text for r in back.collect())


@pytest.mark.parametrize(("bits", "file_ids"), [(False, T.FILE_IDS), (True, T.FILE_IDS), (False, 500)])
def test_files(make, texts, bits, file_ids):
    """Files of 500 ids: several of a task, and documents longer than a file."""
    docs = [*texts, (None, "no id"), (500, None)]
    want, at = [], 0
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array([*WORD.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((str(i), at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = T.round_trip(make(docs), bits=bits, file_ids=file_ids)
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == sorted(want)
    assert T.round_trip(make(docs).limit(0)).count() == 0


def test_one_id_is_spread_over_files(spark, tmp_path):
    docs = spark.createDataFrame([(None if i % 3 else 7, f"text {i}", 1) for i in range(600)], "doc_id long, text string, number int").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        made = T.write(docs, str(tmp_path / "ids")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(made) > 2 and max(r.n_docs for r in made) < 400 and sum(r.n_docs for r in made) == 600
    found = T.read(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None] * 400 + [7] * 200 and found[-1].start + found[-1].n_tokens == sum(r.n_tokens for r in found)


def test_clashing_columns(spark):
    names = ("row", "file", "place", "start", "n_tokens", "number", "n_docs")
    df = spark.createDataFrame([(1, "a b", *"xxxxxxx"), (2, None, *"yyyyyyy")], ["doc_id", "text", *names])
    assert [r.n_tokens for r in T.round_trip(df).orderBy("doc_id").collect()] == [3, 1]
    assert [r.n_tokens for r in bpe.digests(df).orderBy("doc_id").collect()] == [2, 0]


@pytest.mark.parametrize("bits", [False, True])
def test_chunks(tmp_path, bits):
    rng = np.random.default_rng(1)
    docs = [(None if i == 0 else i, rng.integers(0, 1 << 32, n).astype("<u4")) for i, n in enumerate((5, 0, T.CHUNK, 3 * T.CHUNK + 7, 1))]
    path = tmp_path / "x.tids"
    with path.open("wb") as f:
        w = T.Writer(f, bits)
        for d in docs:
            w.add(*d)
        w.close()
    r = T.Reader(path.read_bytes())
    assert [(i, x.tolist()) for i, x in r.documents()] == [(i, x.tolist()) for i, x in docs]
    assert r.chunk(2).tolist() == np.concatenate([x for _, x in docs])[2 * T.CHUNK : 3 * T.CHUNK].tolist()
    with pytest.raises(ValueError):
        T.Reader(path.read_bytes()[:-3])
