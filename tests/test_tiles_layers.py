"""Rings by tiles against brute force (findings F2, F5, F10 of round 3)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafuse.operators import layers

rng = np.random.default_rng(6)
SCHEMA = "id long, ring array<struct<x:double,y:double>>"


@pytest.fixture(scope="module")
def boxes():
    x, y, w = rng.integers(0, 60, 90), rng.integers(0, 60, 90), rng.integers(1, 9, 90)
    return [(i, float(a), float(b), float(a + c), float(b + 3)) for i, (a, b, c) in enumerate(zip(x, y, w, strict=True))]


def ring(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def test_chains_of_touching_rings(spark, boxes):
    rows = spark.createDataFrame([(i, ring(*b)) for i, *b in boxes], SCHEMA).withColumn("key", F.col("id") % 2)
    top = {i: i for i, *_ in boxes}
    for _ in boxes:
        for i, *p in boxes:
            for j, *q in boxes:
                if i % 2 == j % 2 and p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]:
                    top[i] = top[j] = min(top[i], top[j])
    assert {r.id: r["first"] for r in layers.merge_touching(rows, "key", 8.0).collect()} == top


def test_a_triangle_between_others(spark):
    # boxes that overlap although the shapes do not, one inside another, and two that touch in a point
    rows = [(1, [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]), (2, [(4.0, 4.0), (4.0, 1.0), (1.0, 4.0), (4.0, 4.0)]), (3, [(3.5, 3.5), (3.8, 3.5), (3.5, 3.8), (3.5, 3.5)]), (4, [(4.0, 0.0), (6.0, 0.0), (6.0, -1.0), (4.0, 0.0)])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1))
    assert {r.id: r["first"] for r in layers.merge_touching(df, "key", 8.0).collect()} == {1: 1, 2: 2, 3: 2, 4: 1}


def test_inner_rings_and_lines_in_rings(spark, boxes):
    rows = spark.createDataFrame([(i, ring(*b)) for i, *b in boxes], SCHEMA)
    lines = [(x + 0.5, y + 0.5, x + 1.5, y + 1.0) for _, x, y, *_ in boxes[:40]]
    got = {r.id for r in layers.holding(rows, spark.createDataFrame(lines, "x double, y double, u double, v double")).collect()}
    assert got == {i for i, a, b, c, d in boxes if any(a < x and u < c and b < y and v < d for x, y, u, v in lines)}
    inner = {r.id: r.inner for r in layers.inner_rings(rows, 8.0).collect()}
    first = {}
    for i, *b in boxes:
        first.setdefault(tuple(b), i)
    held = lambda x, y, q: q[0] <= x < q[2] and q[1] <= y < q[3]
    assert inner == {i: any(held(x, y, q) for q, j in first.items() if i != j for x, y in ring(*p)) for p, i in first.items()}
