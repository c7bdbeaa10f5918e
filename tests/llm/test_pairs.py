"""SimHash, neighbours and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terrafuse.llm import neighbours, simhash
from terrafuse.operators import graph


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, close):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if close(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", [None, "", "  \n", "one", "One two\tTHREE", "a b c d e f g h", "Über É x\x0by z\x1cw", "x " * 70000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("segments,chain", [(10, 4), (10, 7), (5, 1), (16, 7)])
def test_every_close_pair_shares_a_key_and_passes_its_chain(segments, chain):
    ring, rng = simhash.Ring(4, segments, chain), random.Random(segments)
    spans = ring.spans
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(5)):
            b ^= 1 << bit
        x, hit = a ^ b, False
        for number, (_, kept) in enumerate(ring.keys):
            if not any(x >> spans[i][0] & ((1 << spans[i][1]) - 1) for i in kept):
                at = ring.close(np.array([a], np.uint64), np.array([b], np.uint64), ring.start[[number]])
                hit = hit or len(at) == 1
        assert hit
    far = ring.close(np.array([0], np.uint64), np.array([0b11111], np.uint64), np.array([0]))
    assert len(far) == 0


@pytest.mark.parametrize("block", [4, 2048])
def test_links_join_what_brute_force_joins(spark, block):
    rng = random.Random(block)
    values = {0}
    for _ in range(40):
        center = rng.getrandbits(64)
        values.add(center)
        for _ in range(rng.randrange(30)):
            x = center
            for bit in rng.sample(range(64), rng.randrange(7)):
                x ^= 1 << bit
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.close_links(spark.createDataFrame([(v,) for v in signed], "fp long"), block=block)
    got = {r.node: r.component for r in graph.connected_components(links).collect()}
    mine = [got.get(v, v) for v in signed]
    want = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 4)
    groups = lambda labels: {frozenset(np.flatnonzero(np.array(labels, dtype=object) == x)) for x in set(labels)}
    assert groups(mine) == groups(want)


def test_documents_and_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(5, base), (3, base), (9, base.upper()), (2, "something else entirely here"), (7, None), (8, ""), (8, ""), (None, base), (None, "alone of its kind in the table")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id long")
    got = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 3), (2, 2), (3, 3), (5, 3), (7, 7), (8, 7), (8, 7), (9, 3)]
    assert {r.fingerprint for r in got if r.doc_id in (7, 8)} == {"0" * 16}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 2, 3, 7]
    empty = df.where("false")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    twice = spark.createDataFrame([(1, base), (1, base), (4, base)], "doc_id long, text string")
    assert simhash.keep_one(twice).count() == 1


def test_components_of_strings(spark):
    rng = random.Random(1)
    links = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(180)] + [("hub", f"n{i}") for i in range(50)] + [(None, "hub")]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(links, "u string, v string")).collect()}
    names = sorted({x for e in links if None not in e and e[0] != e[1] for x in e})
    pairs = {frozenset(e) for e in links if None not in e}
    want = brute_components(names, lambda a, b: frozenset((a, b)) in pairs)
    assert got == {n: names[w] for n, w in zip(names, want, strict=True)}


def exact(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]
    return [(int(ids[j]), float(d[j])) for j in order]


@pytest.mark.parametrize("n,clusters", [(4000, 40), (3000, 0), (7, 0)])
def test_neighbours_recall(spark, n, clusters):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 32)).astype(np.float32)
    if clusters:
        x += 4 * rng.standard_normal((clusters, 32)).astype(np.float32)[rng.integers(0, clusters, n)]
    x[: n // 4] = x[0]  # a vector that is repeated very often
    ids = np.arange(n) * 3
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, block=512).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    asked = [i for i in range(n) if ids[i] % 100 == 0]
    assert set(got) == {int(ids[i]) for i in asked}
    hits = total = 0
    for i in asked:
        want = exact(ids, x.astype(float), i)
        mine = got[int(ids[i])]
        assert len(mine) == len(want) and mine == sorted(mine, key=lambda p: (p[1], p[0]))
        hits += len({v for v, _ in mine} & {v for v, _ in want})
        total += len(want)
    assert hits >= 0.9 * total


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 1.0, 1.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0, 1.0]), (7, [1.0, 1.0]), (None, [1.0, 0.0]), (8, [1.0, -1.0])]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df).orderBy("rank").collect()]
    assert sorted(got) == [(0, 1, 7, 1.0), (0, 2, 8, 1.0), (100, 1, 6, 0.0)]
    assert neighbours.nearest(df.where("false")).count() == 0
    assert neighbours.nearest(df.where(F.col("vec_id") == 0)).count() == 0


def test_repeated_rows_and_crowded_queries_get_all_their_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 16))
    ids = np.arange(60)
    x[1] = x[0] + 1e-3
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(1, x[1].tolist())] * 400 + [(0, x[0].tolist())] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (16, 4096):
        got = [(r.vec_id, r.score) for r in neighbours.nearest(df, block=block).orderBy("rank").collect()]
        assert got == exact(ids, x, 0)


def test_a_query_far_from_all_lists_is_filled_up(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 8))
    x[0] = 100
    # the query's own id holds most of its list
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(0, (x[0] + rng.standard_normal(8) * 1e-6).tolist()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df).groupBy("query_id").count().collect()
    assert len(got) == 60 and {r["count"] for r in got} == {10}


def test_scan_abandons_far_pairs_and_keeps_near_ones():
    rng = np.random.default_rng(0)
    q, v = rng.standard_normal((20, 64)), rng.standard_normal((500, 64))
    v[:20] = q + 0.01
    i, j = neighbours.scan(q, np.full(20, 1.0), v)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(k, k) for k in range(20)}
