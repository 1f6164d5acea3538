import re

from conftest_llm import LOWER

from tesserae.llm import decontamination as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        out.append((str(i), len(w), len(hit), sorted(str(x) for x in ids if x is not None)))
    return sorted(out)


def test_documents(spark, make, texts):
    items = [(1, " ".join(words(texts[5][1])[3:30])), (2, "One two"), (3, None), (4, ""), (5, "  !! "), (6, " ".join(words(texts[12][1])[10:20])), (7, "one two THREE"), (8, "ä"), (9, texts[0][1]), (9, texts[0][1]), (10, texts[0][1]), (None, texts[7][1]), (11, "one two three four")]
    docs = [*texts, (0, texts[0][1]), (1, "one one two two three"), (None, "one two"), (2, "xonE-two.three four!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids) for r in D.find(make(docs), bench).collect())
    assert got == brute(docs, items)
    kept = sorted(str(r.doc_id) for r in D.drop_contaminated(make(docs), bench).collect())
    assert kept == sorted(i for i, _, hit, _ in brute(docs, items) if not hit)


def test_empty_tables(spark, make, texts):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in D.find(make(texts[:5]), none).collect()} == {0}
    assert D.find(make(texts[:2]).limit(0), none).count() == 0


def test_the_filter_grows_with_what_it_holds(spark):
    import numpy as np

    for n in (10, 30_000):
        grams = spark.range(n).selectExpr("xxhash64(id) AS gram")
        bitmap = D._bitmap(grams)
        held = np.array([r.gram for r in grams.collect()]).view(np.uint64)
        others = np.array([r.gram for r in spark.range(n, n + 40_000).selectExpr("xxhash64(id) AS gram").collect()]).view(np.uint64)
        assert len(D._in(held, bitmap)) == n and len(D._in(others, bitmap)) < 400
        assert 8 * len(bitmap) == max(D.LEAST_BITS, 1 << (D.BITS * n).bit_length())


def test_clashing_names(spark, make, texts):
    items = [(1, " ".join(words(texts[5][1])[3:30]), "x"), (2, "one two", "y")]
    docs = make(texts).selectExpr("*", *[f"'z' AS {c}" for c in ("words", "gram", "h", "n", "place", "row", "found", "n_hit", "d", "k")])
    bench = spark.createDataFrame(items, "item_id long, text string, words string")
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids) for r in D.find(docs, bench).collect()) == brute(texts, [i[:2] for i in items])
    assert D.drop_contaminated(docs, bench).columns == docs.columns


def test_a_bitmap_that_lets_everything_through(spark, make, texts, monkeypatch):
    import numpy as np

    monkeypatch.setattr(D, "_bitmap", lambda grams: np.full(1 << 13, 255, np.uint8))
    items = [(1, " ".join(words(texts[5][1])[3:30])), (2, "one two")]
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids) for r in D.find(make(texts), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == brute(texts, items)
