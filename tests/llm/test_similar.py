"""Near copies of the pipeline's stage against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from terrafuse.llm import similar


def sets_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    sets = [(i, sets_of(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return {i for i in top if find(i) == i}


def texts(seed):
    rng = random.Random(seed)
    out = []
    for g in range(12):
        base = [f"w{g}x{rng.randrange(10**6)}" for _ in range(300)]
        for _ in range(rng.choice((1, 4, 30))):
            words = list(base)
            for at in rng.sample(range(300), rng.choice((0, 2, 4, 6, 8, 12))):
                words[at] = f"v{rng.randrange(10**9)}"
            out.append(" ".join(words))
    out += [None, "", " ", "A short text", "a short text", "two words"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small", [8, 64])
def test_kept_as_by_all_pairs(spark, small):
    rows = list(enumerate(texts(small)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in similar.keep_one(df, small=small).collect()} == brute_kept(rows)


def test_stage_drops_copies_of_similarity_of_085(spark):
    base = [f"word{i}" for i in range(400)]
    copy = [f"other{i}" if i % 67 == 30 else w for i, w in enumerate(base)]
    a, b = " ".join(base), " ".join(copy)
    assert 0.8 <= len(sets_of(a) & sets_of(b)) / len(sets_of(a) | sets_of(b)) < 0.9
    df = spark.createDataFrame([(4, a, "x"), (2, b, "y"), (9, "alone", "z"), (None, a, "x"), (9, "alone", "z")], "doc_id long, text string, source string")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id or 0 for r in got.collect()) == [0, 2, 9]
    assert corpus_pipeline.drop_near_duplicates(spark, df.where("false"), "").count() == 0


def test_similarity_is_exact(spark):
    sets = [np.arange(n, dtype=np.uint64) for n in (8, 10, 11)]
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "node long, items array<long>")
    got = {(r.u, r.v): r.alike for r in similar.judge(spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "u long, v long"), df).collect()}
    assert got == {(0, 1): True, (0, 2): False, (1, 2): True}


def test_pairs_of_similarity_of_080_share_strongest_bits_of_their_simhash():
    rng = np.random.default_rng(7)
    for n, common in ((9, 8), (45, 40), (360, 320)):
        sets = [rng.integers(0, 1 << 63, 2 * n - common, np.uint64) for _ in range(100)]
        (a, x), (b, y) = similar.sketches([s[:n] for s in sets]), similar.sketches([s[n - common :] for s in sets])
        assert (a == b).any(axis=1).all() and (np.bitwise_count(x ^ y).sum(axis=1) <= similar.DISTANCE).all()
        assert (np.bitwise_count(x ^ y[::-1]).sum(axis=1) > similar.DISTANCE).all()


def test_candidates_within_four_bits_need_no_common_key(spark):
    rows = [(n, f, 0, [k * similar.KEYS + i for i in range(similar.KEYS)]) for k, (n, f) in enumerate([(10, 1 << 40), (20, (1 << 40) + 0b1111), (30, -1), (40, -1)])]
    df = spark.createDataFrame(rows, "node long, f0 long, f1 long, keys array<int>")
    assert {tuple(sorted((r.u, r.v))) for r in similar.candidates(df, passes=1).collect()} == {(10, 20), (30, 40)}
