import random
import re

import numpy as np
import pytest
import xxhash
from conftest_llm import LOWER

from tesserae.llm import simhash as S
from tesserae.operators.components import components


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """The smallest fingerprint reachable from each one."""
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    fps = sorted(up)
    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= 4:
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
    return {f: root(f) for f in fps}


def brute(rows):
    fps = [(i, fingerprint(t)) for i, t in rows]
    root = classes({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return sorted((str(i), f"{f:016x}", least.get(root[f])) for i, f in fps)


def test_documents(make, texts):
    rows = [*texts, (3, texts[3][1]), (None, "nobody else has this text"), (None, texts[8][1])]
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in S.near_duplicates(make(rows)).collect())
    assert got == brute(rows)
    assert S.near_duplicates(make(rows).limit(0)).count() == 0


def test_sets_of_halves_that_stay():
    assert S._intact(2) == [(0,), (1,)]
    assert S._intact(3) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]
    assert {len(x) for x in S._intact(4)} == {3} and len(S._intact(4)) == 14
    assert [S.depth_for(n) for n in (0, 1 << 22, (1 << 22) + 1, 1 << 29, 1 << 36)] == [2, 2, 3, 3, 4]


@pytest.mark.parametrize("block, depth", [(S.BLOCK, 2), (7, 2), (S.BLOCK, 3), (7, 4)])
def test_links_connect_what_is_near(spark, block, depth):
    rng = random.Random(block + depth)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(fps)[:3]:  # large groups, some members of which are over 4 bits apart
        for _ in range(150):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    for f in list(fps)[:60]:
        fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.choice([4, 5]))))
    fps |= {0, 15, (1 << 64) - 1, (1 << 64) - 16}
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    found = components(S.links(spark.createDataFrame(signed, "fp long"), block, depth)).collect()
    un = lambda x: int(np.int64(x).view(np.uint64))
    groups, want = {}, {}
    for r in found:
        groups.setdefault(r.root, set()).add(un(r.node))
    for f, r in classes(fps).items():
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_one_of_each_group_stays(make, texts):
    rows = [*texts, (3, texts[3][1])]
    kept = sorted(r.doc_id for r in S.keep_one(make(rows)).collect())
    assert kept == sorted({c for _, _, c in brute(rows)})


@pytest.mark.parametrize("parts", [1, 5])
def test_null_and_repeated_ids_keep_every_group(make, parts):
    unlike = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(6)]
    rows = [(None, unlike[0]), (None, unlike[1]), (None, unlike[1]), (None, None), (1, unlike[2]), (1, unlike[3]), (1, unlike[3]), (7, unlike[3]), (8, unlike[4]), (None, unlike[4]), (9, unlike[5]), (4, unlike[5])]
    kept = [(r.doc_id, r.text) for r in S.keep_one(make(rows, parts)).collect()]
    want = [(None, unlike[0]), (None, unlike[1]), (None, None), (1, unlike[2]), (1, unlike[3]), (8, unlike[4]), (4, unlike[5])]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_many_repeated_rows_and_clashing_columns(spark):
    names = ("row", "h", "fp", "root", "head", "twin", "least", "key")
    rows = [(1, "one two three four five six", *"aaaaaaaa")] * 400 + [(2, "one two three four five six", *"bbbbbbbb"), (3, "other words altogether here", *"cccccccc"), (None, "other words altogether here", *"dddddddd")] + [(4, None, *"eeeeeeee")] * 50
    df = spark.createDataFrame(rows, ["doc_id", "text", *names]).repartition(6)
    assert sorted(map(tuple, S.keep_one(df).collect())) == sorted({r for r in rows if r[0] in (1, 3, 4)}, key=lambda r: r[0])
    assert S.near_duplicates(df).groupBy("doc_id", "component_id").count().count() == 5


def test_buckets_are_solved_as_they_end():
    batch = lambda bucket, fps: S.pa.RecordBatch.from_arrays([S.pa.array(bucket, S.pa.int64()), S.pa.array([0] * len(bucket), S.pa.int32()), S.pa.array(fps, S.pa.int64())], ["bucket", "chain", "fp"])
    read = []

    def batches():
        for b in (batch([-5, 2, 2], [0, 8, 9]), batch([2, 3], [11, 64]), batch([3, 4], [65, 1])):
            read.append(b)
            yield b

    out = S._bucket_links(batches())
    next(out)
    assert len(read) == 1
    pairs = {tuple(sorted(p)) for b in out for p in zip(*b.to_pydict().values(), strict=True)}
    assert len(pairs) == 3 and (64, 65) in pairs


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 160), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
