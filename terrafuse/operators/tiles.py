"""Joins of points with boxes, sides and rings inside the tiles of a grid: each tile is one call's work, on arrays, a slice of pairs at a time.

Tiles hold some thousands of rows, so their size follows the table's density. What an operator picks for a point (its nearest side, any ring that
holds it) it picks inside the tile, so that pairs need not be written down where there are many more of them than rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a tile holds on average, and pairs that are looked at at once.
ROWS, SLICE = 3000, 1 << 19


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to all cores several times over, by keys or evenly: tables of few bytes and much work would else stay in one or two tasks."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def tile_size(points: DataFrame, boxes: DataFrame, rows: int = ROWS) -> float:
    """The side of square tiles that hold `rows` points and boxes on average, and that boxes are not much larger than."""
    p = points.agg(F.count("x"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    b = boxes.agg(F.count("x0"), F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("y1") - F.col("y0"))).first()
    if not p[0] or not b[0]:
        return 1.0
    wide, high = p[2] - p[1], p[4] - p[3]
    least = max(wide, high) * 1e-6 or 1.0
    return max(math.sqrt(max(wide, least) * max(high, least) * rows / (p[0] + b[0])), (b[1] + b[2]) / 2, least)


def placed(df: DataFrame, size: float) -> DataFrame:
    """df with cx, cy: points (x, y) are in one tile each, boxes (x0, y0, x1, y1) in all that they cover."""
    if "x0" not in df.columns or "x" in df.columns:
        return df.where("x is not null and y is not null").withColumn("cx", _cell(F.col("x"), size)).withColumn("cy", _cell(F.col("y"), size))
    over = lambda a, b: F.explode(F.sequence(_cell(F.col(a), size), _cell(F.col(b), size)))
    return df.where("x0 <= x1 and y0 <= y1").withColumn("cx", over("x0", "x1")).withColumn("cy", over("y0", "y1"))


def by_tiles(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, keys: tuple[str, ...] = (), size: float | None = None) -> DataFrame:
    """run(left, right) of the points or boxes of each tile (and of each value of the keys); points have x and y, boxes x0, y0, x1, y1 and no x."""
    size = size or tile_size(left, right)
    by = [*keys, "cx", "cy"]
    sides = [spread(placed(df, size), *by).groupBy(*by) for df in (left, right)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)


def column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def expanded(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position): for each owner k the positions start[k] .. start[k] + count[k] - 1."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]


class Grid:
    """Boxes by the cells of a local grid over some points; the cell's side is the one that costs least."""

    def __init__(self, px, py, x0, y0, x1, y1):
        self.low = px.min(), py.min()
        wide, high = px.max() - self.low[0], py.max() - self.low[1]
        ax, ay, bx, by = np.maximum(x0, self.low[0]), np.maximum(y0, self.low[1]), np.minimum(x1, px.max()), np.minimum(y1, py.max())
        there = np.flatnonzero((ax <= bx) & (ay <= by))
        ax, ay, bx, by = ax[there], ay[there], bx[there], by[there]
        w, h, span = bx - ax, by - ay, max(wide, high) or 1.0

        def cost(s):  # repeating and sorting boxes, then testing points
            return 3 * ((w / s + 1) * (h / s + 1)).sum() + ((w + s) * (h + s)).sum() * len(px) / (max(wide, s) * max(high, s))

        self.size = min((span / (1 << k) for k in range(12)), key=cost) if len(w) else span
        at = lambda v, k: ((v - self.low[k]) / self.size).astype(np.int64)
        self.across = int(wide / self.size) + 1
        cx, cy = at(ax, 0), at(ay, 1)
        nx, ny = at(bx, 0) - cx + 1, at(by, 1) - cy + 1
        own, k = expanded(np.zeros(len(cx), np.int64), nx * ny)
        cells = (cy[own] + k // nx[own]) * self.across + cx[own] + k % nx[own]
        order = np.argsort(cells, kind="stable")
        self.cells, self.boxes = cells[order], there[own[order]]

    def of(self, px, py) -> tuple[np.ndarray, np.ndarray]:
        """(start, count) of each point's boxes in self.boxes."""
        at = lambda v, k: ((v - self.low[k]) / self.size).astype(np.int64)
        c = at(py, 1) * self.across + at(px, 0)
        start = np.searchsorted(self.cells, c, "left")
        return start, np.searchsorted(self.cells, c, "right") - start


def slices(count: np.ndarray, most: int = SLICE) -> Iterator[slice]:
    """Runs of owners with at most `most` positions together, or one owner with more."""
    ends, at = np.cumsum(count), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def pairs(px, py, x0, y0, x1, y1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices (i, j) of all points i in boxes j, edges included, by i; all boxes of a point are in one slice."""
    if not len(px) or not len(x0):
        return
    grid = Grid(px, py, x0, y0, x1, y1)
    start, count = grid.of(px, py)
    for s in slices(count):
        i, k = expanded(start[s], count[s])
        i, j = i + s.start, grid.boxes[k]
        x, y = px[i], py[i]
        ok = (x >= x0[j]) & (x <= x1[j]) & (y >= y0[j]) & (y <= y1[j])
        yield i[ok], j[ok]


def rounded(v: np.ndarray, decimals: int) -> np.ndarray:
    """v to some decimals, halves away from zero."""
    t = v * 10.0**decimals
    r = np.trunc(t)
    return (r + np.copysign(np.abs(t - r) >= 0.5, t)) / 10.0**decimals


def first_of(i: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Positions of the first row of each i in the given order, by i."""
    at = np.lexsort((*order[::-1], i))
    s = i[at]
    return at[np.flatnonzero(np.r_[True, s[1:] != s[:-1]])] if len(at) else at


class Rings:
    """The sides of rings (lists of x, y points), one after another."""

    def __init__(self, rings: pa.ChunkedArray):
        column = rings.combine_chunks() if isinstance(rings, pa.ChunkedArray) else rings
        flat = column.flatten()
        x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        size = np.array(column.value_lengths().fill_null(0), np.int64)
        first = np.cumsum(size) - size
        self.count = np.maximum(size - 1, 0)
        _, k = expanded(first, self.count)
        self.ax, self.ay, self.bx, self.by = (x[k], y[k], x[k + 1], y[k + 1]) if len(k) else (np.empty(0),) * 4
        self.start = np.cumsum(self.count) - self.count
        has = size > 0
        self.x0, self.x1, self.y0, self.y1 = (self._ends(f, v, first, has) for v in (x, y) for f in (np.minimum, np.maximum))
        self.px, self.py = (self._firsts(v, first, has) for v in (x, y))

    @staticmethod
    def _ends(f, v, first, has):
        out = np.full(len(has), np.nan)
        if has.any():
            out[has] = f.reduceat(v, first[has])
        return out

    @staticmethod
    def _firsts(v, first, has):
        out = np.full(len(has), np.nan)
        out[has] = v[first[has]]
        return out

    def _any(self, j: np.ndarray, of: Callable, join=np.logical_or) -> np.ndarray:
        """of(pair, side) of each pair's sides of its ring j, joined; rings without sides give False."""
        out = np.zeros(len(j), bool)
        for s in slices(self.count[j]):
            n = self.count[j[s]]
            own, k = expanded(self.start[j[s]], n)
            if len(own):
                there = n > 0
                out[np.flatnonzero(there) + s.start] = join.reduceat(of(own + s.start, k), (np.cumsum(n) - n)[there])
        return out

    def hold(self, j: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Even-odd test of the points (x, y) against the rings j, as ring_contains."""

        def crosses(p, k):
            ax, ay, bx, by, v = self.ax[k], self.ay[k], self.bx[k], self.by[k], y[p]
            with np.errstate(divide="ignore", invalid="ignore"):
                return ((ay > v) != (by > v)) & (x[p] < (bx - ax) * (v - ay) / (by - ay) + ax)

        return self._any(j, crosses, np.logical_xor)

    def edge(self, j: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """True for points on a side of their ring."""
        return self._any(j, lambda p, k: _on(self.ax[k], self.ay[k], self.bx[k], self.by[k], x[p], y[p]))

    def meet(self, j: np.ndarray, i: np.ndarray, other: Rings) -> np.ndarray:
        """True where a side of ring j touches or crosses one of the other rings' ring i."""

        def side(p, k):
            a, b, c, d = self.ax[k], self.ay[k], self.bx[k], self.by[k]

            def two(q, m):
                e, f, g, h = other.ax[m], other.ay[m], other.bx[m], other.by[m]
                s = (a[q], b[q], c[q], d[q])
                turns = _side(*s, e, f) * _side(*s, g, h) < 0, _side(e, f, g, h, s[0], s[1]) * _side(e, f, g, h, s[2], s[3]) < 0
                return (turns[0] & turns[1]) | _on(*s, e, f) | _on(*s, g, h) | _on(e, f, g, h, s[0], s[1]) | _on(e, f, g, h, s[2], s[3])

            return other._any(i[p], two)

        return self._any(j, side)


def _side(ax, ay, bx, by, px, py):
    return np.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def _on(ax, ay, bx, by, px, py):
    return (_side(ax, ay, bx, by, px, py) == 0) & (px >= np.minimum(ax, bx)) & (px <= np.maximum(ax, bx)) & (py >= np.minimum(ay, by)) & (py <= np.maximum(ay, by))


def nearest_sides(px, py, ax, ay, bx, by, reach: float, rank: tuple, place: Callable, allowed: Callable | None = None) -> tuple:
    """(i, j, d, x, y): for each point that has one its nearest side j within reach, ties by the rank columns of the sides.

    place(i, j) gives (x, y, ok), where point i falls on side j. The search widens, until the best side is nearer than all that was not looked at.
    """
    x0, x1, y0, y1 = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)
    left, found = np.arange(len(px)), []
    if len(px) and len(ax):
        area = max(np.ptp(px), 1e-9) * max(np.ptp(py), 1e-9)
        r = min(reach, 4 * area / max(((x1 - x0) + (y1 - y0)).sum(), 1e-9))  # some four sides are as near, where they lie even
        while len(left):
            done = []
            for i, j in pairs(px[left], py[left], x0 - r, y0 - r, x1 + r, y1 + r):
                i = left[i]
                if allowed is not None:
                    ok = allowed(i, j)
                    i, j = i[ok], j[ok]
                x, y, ok = place(i, j)
                i, j, x, y = i[ok], j[ok], x[ok], y[ok]
                d = rounded(np.sqrt((px[i] - x) ** 2 + (py[i] - y) ** 2), 9)
                near = d <= r - 1e-8 if r < reach else d <= reach
                i, j, d, x, y = (v[near] for v in (i, j, d, x, y))
                at = first_of(i, d, *(v[j] for v in rank))
                found.append(tuple(v[at] for v in (i, j, d, x, y)))
                done.append(i[at])
            if r >= reach:
                break
            left = np.setdiff1d(left, np.concatenate(done) if done else left[:0], assume_unique=True)
            r = min(reach, 3 * r)
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0))
    return tuple(map(np.concatenate, zip(none, *found, strict=True)))


def any_held(x, y, own, rings: Rings, names) -> np.ndarray:
    """True for points that a ring of another name than their own holds; a point is done with the first such ring."""
    held = np.zeros(len(x), bool)
    if not len(x) or not len(names):
        return held
    grid = Grid(x, y, rings.x0, rings.y0, rings.x1, rings.y1)
    start, count = grid.of(x, y)
    left, k, width = np.arange(len(x)), 0, 4
    while len(left := left[(count[left] > k) & ~held[left]]):
        n = np.minimum(count[left] - k, width)
        for s in slices(n):
            i, at = expanded(start[left[s]] + k, n[s])
            i, j = left[s][i], grid.boxes[at]
            ok = (own[i] != names[j]) & (x[i] >= rings.x0[j]) & (x[i] <= rings.x1[j]) & (y[i] >= rings.y0[j]) & (y[i] <= rings.y1[j])
            i, j = i[ok], j[ok]
            held[i[rings.hold(j, x[i], y[i])]] = True
        k, width = k + width, 2 * width
    return held


def chains(rings: Rings) -> np.ndarray:
    """For each ring the first one of those that a chain of touching rings connects it with."""
    n = len(rings.x0)
    label = np.arange(n)
    there = np.flatnonzero(~np.isnan(rings.x0))
    if len(there) < 2:
        return label
    ends = [v[there] for v in (rings.x0, rings.y0, rings.x1, rings.y1)]
    # cells as large as the boxes on average
    size = max((ends[2] - ends[0]).mean(), (ends[3] - ends[1]).mean(), 1e-9, (ends[2].max() - ends[0].min()) / 4096, (ends[3].max() - ends[1].min()) / 4096)
    low = ends[0].min(), ends[1].min()
    cx, cy, nx, ny = ((v - low[k % 2]) / size for k, v in enumerate(ends))
    cx, cy = cx.astype(np.int64), cy.astype(np.int64)
    nx, ny = nx.astype(np.int64) - cx + 1, ny.astype(np.int64) - cy + 1
    own, k = expanded(np.zeros(len(cx), np.int64), nx * ny)
    cell = (cy[own] + k // nx[own]) * 8192 + cx[own] + k % nx[own]
    order = np.argsort(cell, kind="stable")
    cell, own, step = cell[order], there[own[order]], 1
    while len(cell) > step:
        # cells whose rings are all of one chain are done with
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        count = np.diff(np.r_[first, len(cell)])
        mixed = (np.minimum.reduceat(label[own], first) != np.maximum.reduceat(label[own], first)) & (count > step)
        stay = np.repeat(mixed, count)
        cell, own = cell[stay], own[stay]
        at = np.flatnonzero(cell[step:] == cell[:-step])
        i, j = own[at], own[at + step]
        ok = (label[i] != label[j]) & (rings.x0[i] <= rings.x1[j]) & (rings.x0[j] <= rings.x1[i]) & (rings.y0[i] <= rings.y1[j]) & (rings.y0[j] <= rings.y1[i])
        i, j = i[ok], j[ok]
        touch = rings.hold(i, rings.px[j], rings.py[j]) | rings.hold(j, rings.px[i], rings.py[i])
        far = np.flatnonzero(~touch)
        touch[far] = rings.meet(i[far], j[far], rings)
        i, j = i[touch], j[touch]
        while (label[i] != label[j]).any():
            a, b = label[i], label[j]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
        step += 1
    return label
