"""Pairs of touching buildings: their common run and the classifier's features."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = 46
#: A pair whose common run is shorter than this share of both outer parts has no features.
LEAST_RATIO = 0.05

Ring = list[tuple[float, float]]


def common_run(ring1: Ring, ring2: Ring) -> tuple[Ring, Ring, int]:
    """Both closed rings turned so that they begin with the run of points that they share, and its length.

    The run begins at a point of the longer ring that the other has, after one that it has not. If the
    other ring runs the opposite way it is reversed. Rings that share no point, or all points, come back as they are with 0, or all, in common.
    """
    swap = len(ring1) < len(ring2)
    a, b = (ring2[:-1], ring1[:-1]) if swap else (ring1[:-1], ring2[:-1])
    in_b = {p: i for i, p in reversed(list(enumerate(b)))}
    for i, p in enumerate(a):
        if p in in_b and a[i - 1] not in in_b:
            a = a[i:] + a[:i]
            j = in_b[p]
            b = b[j:] + b[:j]
            if len(a) > 1 and b[-1] == a[1]:
                b = [b[0], *b[:0:-1]]
            break
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    a, b = [*a, a[0]], [*b, b[0]]
    return (b, a, n) if swap else (a, b, n)


def _angle(a, b, c) -> float:
    u, v = np.subtract(a, b), np.subtract(c, b)
    norm = math.hypot(*u) * math.hypot(*v)
    return math.degrees(math.acos(max(-1.0, min(1.0, float(u @ v) / norm)))) if norm else 0.0


def _angles(before, line: Ring, after) -> np.ndarray:
    path = [before, *line, after]
    return np.array([_angle(*path[i : i + 3]) for i in range(len(line))])


def _length(line: Ring) -> float:
    return sum(math.dist(p, q) for p, q in zip(line[:-1], line[1:], strict=True))


def _off_90(angles: np.ndarray) -> np.ndarray:
    return np.abs(45 - np.abs(45 - np.mod(angles, 90)))


def _block(outer1, outer2, common1, common2) -> list[float]:
    """Mean, deviation, least and largest of the outer parts, then of the common run relative to them."""
    stats = lambda v: np.array([v.mean(), v.std(), v.min(), v.max()])
    o1, o2, c1, c2 = map(stats, (outer1, outer2, common1, common2))
    relative = lambda c, o: c - np.where([True, False, True, True], o, 0)
    return [*o1, *o2, *relative(c1, o1), *relative(c2, o2)]


def features(ring1: Ring, ring2: Ring) -> list[float] | None:
    """The 46 features of two closed rings with a common run of two points or more; None for other pairs.

    Six angles where the run begins and ends, their distances from right angles, two length
    ratios, and statistics of all angles of the outer parts (seen without the cut) and of the run (seen from either side).
    """
    if len(ring1) < 4 or len(ring2) < 4 or ring1[0] != ring1[-1] or ring2[0] != ring2[-1]:
        return None
    one, two, n = common_run(ring1, ring2)
    if n < 2 or n >= len(one) - 1 or n >= len(two) - 1:
        return None
    run, outer1, outer2 = one[:n], one[n - 1 :], two[n - 1 :]
    start, end, second, last = run[0], run[-1], run[1], run[-2]
    near1, near2, far1, far2 = outer1[-2], outer2[-2], outer1[1], outer2[1]
    corners = [(near1, start, near2), (far1, end, far2), (near1, start, second), (last, end, far1), (near2, start, second), (last, end, far2)]
    v = np.array([_angle(*c) for c in corners])
    ratios = [_length(run) / length if (length := _length(o)) else math.inf for o in (outer1, outer2)]
    if max(ratios) < LEAST_RATIO:
        return None
    parts = [_angles(far2, outer1, near2), _angles(far1, outer2, near1), _angles(near1, run, far1), _angles(near2, run, far2)]
    return [*v, *(4 * _off_90(v)), *(math.atan(r) / (math.pi / 2) * 180 for r in ratios), *_block(*parts), *_block(*map(_off_90, parts))]


def _ring(points) -> Ring:
    return [(p["x"], p["y"]) for p in points]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def pair_features(ring1: pd.Series, ring2: pd.Series) -> pd.Series:
    """features() of two columns of rings (arrays of x, y)."""
    return pd.Series([features(_ring(a), _ring(b)) if a is not None and b is not None else None for a, b in zip(ring1, ring2, strict=True)])


def training_pairs(rings, touching):
    """Pairs of touching rings (way1, way2) with both rings and label 1 for two equal, given `segmented` tags, 0 for none; ambiguous ones go."""
    side = lambda k: rings.select(F.col("id").alias(f"way{k}"), F.col("ring").alias(f"ring{k}"), F.coalesce("segmented", F.lit("no")).alias(f"s{k}"))
    rows = touching.join(side(1), "way1").join(side(2), "way2").where("s1 <> '?' and s2 <> '?'")
    label = ((F.col("s1") == F.col("s2")) & (F.col("s1") != "no")).cast("int")
    return rows.select("way1", "way2", "ring1", "ring2", label.alias("label"))
