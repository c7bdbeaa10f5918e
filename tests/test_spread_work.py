"""Small tables with much work are dealt to all cores (findings F17 to F32 of round 3), and what is picked inside tiles equals brute force."""

import numpy as np
from pyspark.sql import functions as F

from terrafuse.operators import buildings, cleaning, polygons, tiles


def test_one_partition_is_dealt(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 0))])
    one = spark.range(100).coalesce(1).withColumn("ring", ring)
    assert one.rdd.getNumPartitions() == 1
    assert polygons.repair(one, 0.0).rdd.getNumPartitions() == tiles.spread(one).rdd.getNumPartitions() > 8


def test_orphans_and_rings_inside(spark):
    rng = np.random.default_rng(11)
    rows = [(i, int(rng.integers(3)), None if i % 4 == 0 else "s", float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 60, (300, 2)))]
    got = {r.orphan: (r.distance, r.near) for r in buildings.orphan_neighbours(spark.createDataFrame(rows, "id long, number int, street string, x double, y double"), 4.0).collect()}
    want = {}
    for i, n, s, x, y in rows:
        fit = [(round(float(np.hypot(x - u, y - v)), 9), j) for j, m, t, u, v in rows if s is None and t and m == n and np.hypot(x - u, y - v) <= 4]
        if fit:
            want[i] = min(fit)
    assert got == want
    low, size = rng.integers(0, 20, (60, 2)), rng.integers(1, 12, (60, 2))
    boxes = [(i, *map(float, (*a, *(a + b)))) for i, (a, b) in enumerate(zip(low, size, strict=True))]
    rings = [(i, [(a, b), (c, b), (c, d), (a, d), (a, b)], a, b, c, d) for i, a, b, c, d in boxes]
    df = spark.createDataFrame(rings, "id long, ring array<struct<x:double,y:double>>, x0 double, y0 double, x1 double, y1 double")
    inside = {(i, j) for i, *p in boxes for j, *q in boxes if p[0] > q[0] and p[1] > q[1] and p[2] < q[2] and p[3] < q[3]}
    assert {tuple(r) for r in cleaning.inside_ways(df, 4.0).collect()} == inside
