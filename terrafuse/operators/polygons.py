"""Polygons made of others (A06, G06, G17, G24, G25, P24, A23, F06): union along shared sides, repair, joining, copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafuse.functions.geometry import let, rings_intersect, signed_area
from terrafuse.operators import tiles as T

_RINGS = "array<array<struct<x:double,y:double>>>"


def _points(column: pa.Array) -> list[np.ndarray]:
    """Each ring as an array of points."""
    flat = column.flatten()
    xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1) if len(flat) else np.empty((0, 2))
    ends = np.cumsum([0, *(len(v) if v.is_valid else 0 for v in column)])
    return [xy[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _struct_rings(rings: list[list[np.ndarray]]) -> pa.Array:
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    return pa.array([[[{"x": float(x), "y": float(y)} for x, y in r] for r in own] for own in rings], kind)


def area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """The ring with those points alone that bend it by over the tolerance; its ends stay."""
    keep = np.zeros(len(ring), bool)
    keep[[0, -1]] = True
    far = int(((ring - ring[0]) ** 2).sum(axis=1).argmax())
    keep[far] = True
    todo = [(0, far), (far, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = ring[a + 1 : b], ring[b] - ring[a]
        norm = np.hypot(*d)
        away = np.abs((p - ring[a]) @ np.array([-d[1], d[0]])) / norm if norm else np.hypot(*(p - ring[a]).T)
        if away.max() > tolerance:
            at = a + 1 + int(away.argmax())
            keep[at] = True
            todo += [(a, at), (at, b)]
    return ring[keep]


def chained(start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Closed rings of directed sides; at a point where several go on, the leftmost turn is taken, so rings that touch stay apart."""
    out: dict[tuple, list[int]] = {}
    for i, p in enumerate(map(tuple, start)):
        out.setdefault(p, []).append(i)
    rings = []
    while out:
        first = next(iter(out))
        ring, here, back = [first], first, None
        while True:
            ways = out[here]
            if back is not None and len(ways) > 1:
                turn = lambda i: np.arctan2(*(end[i] - start[i])[::-1]) - back  # noqa: B023, E731
                i = max(ways, key=lambda i: (turn(i) + np.pi) % (2 * np.pi))
            else:
                i = ways[-1]
            ways.remove(i)
            if not ways:
                del out[here]
            back = np.arctan2(*(end[i] - start[i])[::-1])
            here = tuple(end[i])
            ring.append(here)
            if here == first or here not in out:
                break
        rings.append(np.array(ring))
    return rings


def dissolve(parcels: DataFrame, key: str, decimals: int = 3, tolerance: float = 0.5) -> DataFrame:
    """(key, rings, area): the outline of the parcels (key, ring) of each place, simplified; outer rings run anticlockwise, holes clockwise.

    Parcels share their sides, so a side that two of them run in opposite directions is inside and goes. Only sides of the outline come to
    the task that chains a place's rings.
    """
    ring = F.transform("ring", lambda p: F.struct(F.round(p["x"], decimals).alias("x"), F.round(p["y"], decimals).alias("y")))
    rows = parcels.select(F.col(key).alias("k"), let(ring, lambda r: F.when(signed_area(r) < 0, F.reverse(r)).otherwise(r)).alias("r"))
    pairs = F.zip_with(F.slice("r", F.lit(1), F.size("r") - 1), F.slice("r", F.lit(2), F.size("r") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    sides = rows.select("k", F.explode(pairs).alias("s")).where("s.a <> s.b")
    ahead = F.col("s.a") < F.col("s.b")
    low, high = F.when(ahead, F.col("s.a")).otherwise(F.col("s.b")), F.when(ahead, F.col("s.b")).otherwise(F.col("s.a"))
    net = sides.groupBy("k", low.alias("low"), high.alias("high")).agg(F.sum(F.when(ahead, 1).otherwise(-1)).alias("net")).where("net <> 0")
    a, b = F.when(F.col("net") > 0, F.col("low")).otherwise(F.col("high")), F.when(F.col("net") > 0, F.col("high")).otherwise(F.col("low"))
    outline = net.select("k", a.alias("a"), b.alias("b")).select("k", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    kind = dict(outline.dtypes)["k"]

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([("ax", "ascending"), ("ay", "ascending"), ("bx", "ascending"), ("by", "ascending")])
        col = lambda c: batch[c].to_numpy()
        rings = chained(np.stack([col("ax"), col("ay")], axis=1), np.stack([col("bx"), col("by")], axis=1))
        whole = sum(area(r) for r in rings)
        return pa.table({"k": batch["k"][:1], "rings": _struct_rings([[simplified(r, tolerance) for r in rings]]), "area": pa.array([whole])})

    return outline.groupBy("k").applyInArrow(run, f"k {kind}, rings {_RINGS}, area double").withColumnRenamed("k", key)


def simple_loops(ring: np.ndarray) -> list[np.ndarray]:
    """The simple closed loops that a ring falls into where it crosses or touches itself."""
    a, b = ring[:-1], ring[1:]
    n = len(a)
    if n < 3:
        return []
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    d = b - a
    between, den = a[None, :, :] - a[:, None, :], cross(d[:, None, :], d[None, :, :])
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross(between, d[None, :, :]) / den, cross(between, d[:, None, :]) / den
    hit = (np.abs(den) > 1e-12) & (t > 1e-9) & (t < 1 - 1e-9) & (u > -1e-9) & (u < 1 + 1e-9)
    path: list[tuple] = []
    for i in range(n):
        path.append(tuple(np.round(a[i], 9)))
        path += [tuple(np.round(a[i] + t[i, j] * d[i], 9)) for j in sorted(np.flatnonzero(hit[i]), key=lambda j: t[i, j])]  # noqa: B023
    loops, stack, at = [], [], {}
    for p in [*path, path[0]]:
        if p in at:
            loop = [*stack[at[p] :], p]
            for q in stack[at[p] + 1 :]:
                del at[q]
            stack = stack[: at[p] + 1]
            if len(loop) > 3:
                loops.append(np.array(loop))
        else:
            at[p] = len(stack)
            stack.append(p)
    return loops


def repair(rings: DataFrame, least: float, share: float = 0.99) -> DataFrame:
    """(id, parts, area, valid) of rings (id, ring): a ring that crosses itself falls into its simple loops, those of at least the area `least`.

    If one loop has at least `share` of the area it stands for the whole, the rest being noise. A sound ring stays as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, areas, valid = [], [], []
            for ring in _points(batch.column("ring")):
                loops = simple_loops(ring)
                sizes = [abs(area(r)) for r in loops]
                valid.append(len(loops) == 1 and len(loops[0]) == len(ring))
                whole = sum(sizes)
                if whole and max(sizes) >= share * whole:
                    loops = [loops[int(np.argmax(sizes))]]
                else:
                    loops = [r for r, s in zip(loops, sizes, strict=True) if s >= least]
                parts.append(loops)
                areas.append(sum(abs(area(r)) for r in loops))
            yield pa.RecordBatch.from_arrays([batch.column("id"), _struct_rings(parts), pa.array(areas, pa.float64()), pa.array(valid, pa.bool_())], ["id", "parts", "area", "valid"])

    return T.spread(rings.select("id", "ring")).mapInArrow(run, f"id {dict(rings.dtypes)['id']}, parts {_RINGS}, area double, valid boolean")


def junctions(pairs: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """(way1, way2, nodes): the common nodes of each pair of ways, in the first one's order."""
    a = pairs.join(way_nodes.withColumnRenamed("way_id", "way1"), "way1")
    b = way_nodes.select(F.col("way_id").alias("way2"), "node_id").distinct()
    rows = a.join(b, ["way2", "node_id"]).groupBy("way1", "way2").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("l"))
    return rows.select("way1", "way2", F.array_distinct(F.transform("l", lambda x: x["node_id"])).alias("nodes"))


def barycentres(joined: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way1, way2, x, y): the mean place of the common nodes."""
    rows = joined.select("way1", "way2", F.explode("nodes").alias("id")).join(nodes, "id")
    return rows.groupBy("way1", "way2").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def join_runs(first: Column, second: Column) -> Column:
    """(outer1, common, outer2) of two closed node lists that share one run of nodes: the first's own nodes from its end of the run to
    its start, the run, and the second's own nodes; null if they share fewer than two nodes or more than one run."""
    opened = lambda r: F.slice(r, F.lit(1), F.size(r) - 1)
    turn = lambda r, n: F.concat(F.slice(r, n + 1, F.size(r)), F.slice(r, F.lit(1), n))

    def of(a: Column, b: Column) -> Column:
        shared = lambda r, o: F.transform(r, lambda x: F.array_contains(o, x))
        starts = lambda flags: F.filter(F.transform(F.sequence(F.lit(0), F.size(flags) - 1), lambda i: F.when(flags[i] & ~flags[F.pmod(i - 1, F.size(flags))], i)), lambda i: i.isNotNull())
        fa, fb = shared(a, b), shared(b, a)

        def cut(sa: Column, sb: Column) -> Column:
            ta, tb = turn(a, sa[0]), turn(b, sb[0])
            return let(F.filter(ta, lambda x: F.array_contains(b, x)), lambda run: F.struct(
                F.slice(ta, F.size(run) + 1, F.size(ta)).alias("outer1"), run.alias("common"), F.slice(tb, F.size(run) + 1, F.size(tb)).alias("outer2"),
            ))

        return let(fa, lambda x: let(fb, lambda y: let(starts(x), lambda sa: let(starts(y), lambda sb: F.when((F.size(sa) == 1) & (F.size(sb) == 1) & (F.size(F.array_intersect(a, b)) > 1), cut(sa, sb))))))

    return let(opened(first), lambda a: let(opened(second), lambda b: of(a, b)))


def joined_ways(pairs: DataFrame, ways: DataFrame, way_nodes: DataFrame, tagged: DataFrame) -> DataFrame:
    """(way1, way2, nds, deleted): the ring of two joined buildings, and the nodes inside the common run that no other way uses and that bear no tags.

    ways is (way_id, nds), closed; tagged is (node_id). The second's own nodes run on from the end of the first's, whichever way they are listed.
    Pairs that do not share just one run are left out.
    """
    side = lambda n, c: ways.select(F.col("way_id").alias(n), F.col("nds").alias(c))
    rows = pairs.join(side("way1", "n1"), "way1").join(side("way2", "n2"), "way2").withColumn("j", join_runs(F.col("n1"), F.col("n2"))).where("j is not null")
    common, last = F.col("j.common"), F.element_at(F.col("j.common"), -1)
    # on from the run's end come the first's own nodes, back to its start; the second's lead from the start to the end
    ahead = F.get(F.col("n2"), F.array_position(F.slice("n2", F.lit(1), F.size("n2") - 1), common[0]).cast("int")) == F.get(F.col("j.outer2"), F.lit(0))
    second = F.when(F.coalesce(ahead, F.lit(True)), F.col("j.outer2")).otherwise(F.reverse("j.outer2"))
    ring = F.concat(F.array(last), F.col("j.outer1"), F.array(common[0]), second, F.array(last))
    rows = rows.withColumn("ring", ring).withColumn("inner", F.slice(common, F.lit(2), F.greatest(F.size(common) - 2, F.lit(0))))
    uses = way_nodes.select("way_id", "node_id").distinct().groupBy("node_id").agg(F.count("*").alias("uses"))
    free = rows.select("way1", "way2", F.explode("inner").alias("node_id")).join(uses, "node_id").where("uses <= 2").join(tagged, "node_id", "left_anti")
    gone = free.groupBy("way1", "way2").agg(F.array_sort(F.collect_list("node_id")).alias("deleted"))
    empty = F.slice("ring", F.lit(1), F.lit(0))
    return rows.join(gone, ["way1", "way2"], "left").select("way1", "way2", F.col("ring").alias("nds"), F.coalesce("deleted", empty).alias("deleted"))


def copied(wanted: DataFrame, way_nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(kind, ref, id): what goes with the wanted ways (way_id) into another document: every multipolygon that a way is an outer ring of, all ways of
    these, and their nodes, each with a new negative id. members is (relation, way_id, role)."""
    relations = members.where("role = 'outer'").join(wanted, "way_id", "left_semi").select("relation").distinct()
    ways = members.join(relations, "relation", "left_semi").select("way_id").union(wanted.select("way_id")).distinct()
    nodes = way_nodes.join(ways, "way_id", "left_semi").select("node_id").distinct()
    part = lambda df, c, kind: df.select(F.lit(kind).alias("kind"), F.col(c).alias("ref"))
    rows = part(relations, "relation", "relation").union(part(ways, "way_id", "way")).union(part(nodes, "node_id", "node"))
    return rows.withColumn("id", -F.row_number().over(Window.partitionBy("kind").orderBy("ref")).cast("long"))


def tiles_in_limit(tiles: DataFrame, limits: DataFrame) -> DataFrame:
    """Tiles (seq, x0, y0, x1, y1) that are kept while a city's limit is looked for: all up to the first file (seq) that shows a limit, then those that meet it.

    limits is (seq, ring); all rings of that first file count, none of later ones. If no file shows a limit all tiles stay.
    """
    first = limits.agg(F.min("seq").alias("first"))
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    box = F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"), at("x0", "y0"))
    # one row, and the rings of one file
    rows = tiles.crossJoin(F.broadcast(first))
    early = rows.where(F.col("first").isNull() | (F.col("seq") <= F.col("first"))).select(tiles.columns)
    shown = limits.join(F.broadcast(first), F.col("seq") == F.col("first")).select("first", "ring")
    late = rows.where(F.col("seq") > F.col("first")).join(shown, "first").where(rings_intersect(box, F.col("ring"))).select(tiles.columns).distinct()
    return early.unionByName(late)


def flattened(commands: str, points: np.ndarray, steps: int = 8) -> list[np.ndarray]:
    """The sub-paths of a path of M, L, C and Z commands as polygons; curves become `steps` sides each, and Z closes a sub-path."""
    out, now, at = [], [], 0
    for c in commands:
        if c == "M":
            if len(now) > 1:
                out.append(np.array(now))
            now, at = [points[at]], at + 1
        elif c == "L":
            now.append(points[at])
            at += 1
        elif c == "C":
            a, (b, d, e) = now[-1], points[at : at + 3]
            t = np.linspace(0, 1, steps + 1)[1:, None]
            now += list((1 - t) ** 3 * a + 3 * (1 - t) ** 2 * t * b + 3 * (1 - t) * t**2 * d + t**3 * e)
            at += 3
        elif c == "Z" and now:
            if tuple(now[0]) != tuple(now[-1]):
                now.append(now[0])
            out.append(np.array(now))
            now = [now[0]]
        else:
            raise ValueError(f"unknown command {c}")
    if len(now) > 1:
        out.append(np.array(now))
    return out
