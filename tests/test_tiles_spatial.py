"""Points and boxes by tiles against brute force (findings F7, F8, F12 of round 3)."""

import numpy as np

from terrafuse.operators import spatial, tiles

rng = np.random.default_rng(5)
BOX = "id long, x0 double, y0 double, x1 double, y1 double"


def boxes(n, first=0):
    x, y = rng.integers(0, 40, n) / 2, rng.integers(0, 40, n) / 2
    return [(first + i, float(a), float(b), float(a + w), float(b + h)) for i, (a, b, w, h) in enumerate(zip(x, y, rng.integers(1, 9, n) / 2, rng.integers(1, 9, n) / 2, strict=True))]


def test_pairs_of_a_tile():
    px, py = rng.random(400) * 9, rng.random(400) * 9
    a, b = rng.random((2, 300)) * 9
    w, h = rng.random((2, 300)) * 3
    got = [(i, j) for s in tiles.pairs(px, py, a, b, a + w, b + h) for i, j in zip(*s, strict=True)]
    inside = (px[:, None] >= a) & (px[:, None] <= a + w) & (py[:, None] >= b) & (py[:, None] <= b + h)
    assert sorted(got) == list(zip(*np.nonzero(inside), strict=True))


def test_boxes_by_tiles(spark):
    a, b = boxes(150), boxes(150, 1000)
    one, two = spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)
    share = {}
    for i, *p in a:
        for j, *q in b:
            w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
            if w > 0 and h > 0:
                share.setdefault(i, []).append((w * h / max((p[2] - p[0]) * (p[3] - p[1]), (q[2] - q[0]) * (q[3] - q[1])), -j))
    for r in spatial.overlap_classes(one, two, 4.0).collect():
        own = sorted(share.get(r.id, []), reverse=True)
        assert (r["class"] == "OK") == (not own)
        assert r.partner is None if r["class"] in ("OK", "NoFusion") else r.partner == -own[0][1]
    points = [(i, p[0], p[1]) for i, *p in a]
    got = {tuple(r) for r in spatial.points_in_boxes(spark.createDataFrame(points, "id long, x double, y double"), two, 4.0).collect()}
    assert got == {(i, j) for i, x, y in points for j, x0, y0, x1, y1 in b if x0 <= x <= x1 and y0 <= y <= y1}
    area = lambda p: (p[2] - p[0]) * (p[3] - p[1])
    for r in spatial.best_limits(one, two, 4.0).collect():
        p = a[r.id][1:]
        x, y = (p[0] + p[2]) / 2, (p[1] + p[3]) / 2
        fit = [(max(abs(u - v) for u, v in zip(p, q, strict=True)), j) for j, *q in b if q[0] <= x <= q[2] and q[1] <= y <= q[3] and abs(area(p) - area(q)) < 10]
        best = min((f for f in fit if f[0] < 1), default=(None, None))
        assert (r["diff"], r["limit"]) == best
