"""Geometry as Column expressions: points, segments, rings and boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafuse.functions.core import let

EARTH = 6371000.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """C11: metres between two points in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def course(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in radians, 0 to 2 pi."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.atan2(y, x), F.lit(2 * math.pi))


def cross_track(lon1: Column, lat1: Column, lon2: Column, lat2: Column, lon: Column, lat: Column) -> Column:
    """Metres of a point from the great circle through two others."""
    far = haversine(lon1, lat1, lon, lat) / EARTH
    turn = course(lon1, lat1, lon, lat) - course(lon1, lat1, lon2, lat2)
    return F.abs(F.asin(F.sin(far) * F.sin(turn))) * EARTH


def linear_transform(v: Column, a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """V of the interval a mapped to the interval b."""
    return b0 + (v - a0) * (b1 - b0) / (a1 - a0)


def project(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """(x, y, t) of the orthogonal projection on a segment; null beyond its ends or if it is a point."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy

    def at(t: Column) -> Column:
        return F.when((t >= 0) & (t <= 1), F.struct((ax + t * dx).alias("x"), (ay + t * dy).alias("y"), t.alias("t")))

    return F.when(square > 0, let(((px - ax) * dx + (py - ay) * dy) / square, at))


def project_along(px: Column, py: Column, angle: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """C17: (x, y, t) where the line through a point in a direction meets a segment; null if it does not."""
    ux, uy, dx, dy = F.cos(angle), F.sin(angle), bx - ax, by - ay
    cross = ux * dy - uy * dx

    def at(t: Column) -> Column:
        return F.when((t >= 0) & (t <= 1), F.struct((ax + t * dx).alias("x"), (ay + t * dy).alias("y"), t.alias("t")))

    return F.when(F.abs(cross) > 1e-12, let(((px - ax) * uy - (py - ay) * ux) / -cross, at))


def incidence(angle: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """How far from perpendicular a direction meets a segment, in radians."""
    return F.abs(math.pi / 2 - F.pmod(angle - F.atan2(by - ay, bx - ax), F.lit(math.pi)))


def diff_to_90(angle: Column) -> Column:
    """Degrees to the next multiple of 90."""
    return F.abs(45 - F.abs(45 - F.pmod(angle, F.lit(90.0))))


def angle_at(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """C20: degrees between the two segments that meet in b, 0 to 180; null if one is a point."""
    ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
    norm = F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy))
    return F.when(norm > 0, F.degrees(F.acos(F.greatest(F.least((ux * vx + uy * vy) / norm, F.lit(1.0)), F.lit(-1.0)))))


def polyline_length(points: Column) -> Column:
    """Length of a list of (x, y)."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def signed_area(points: Column) -> Column:
    """Shoelace area of a closed ring, positive if it runs anticlockwise."""
    n = F.size(points)
    terms = F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, d: s + d) / 2


def ring_contains(points: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a closed ring; points on the edge may fall on either side."""
    n = F.size(points)
    crosses = F.zip_with(
        F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]),
    )
    return F.aggregate(crosses, F.lit(False), lambda s, c: s != c)


def box_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a box, 0 inside."""
    dx, dy = F.greatest(x0 - x, F.lit(0.0), x - x1), F.greatest(y0 - y, F.lit(0.0), y - y1)
    return F.sqrt(dx * dx + dy * dy)


def wkt_points(text: Column) -> Column:
    """P10: the points of a WKT point, line, or polygon's outer ring; null for other texts."""
    body = F.regexp_extract(text, r"^\s*(?:POINT|LINESTRING|POLYGON)\s*\(+([^()]*)\)", 1)
    point = lambda p: let(F.split(F.trim(p), " +"), lambda c: F.struct(c[0].cast("double").alias("x"), c[1].cast("double").alias("y")))
    return F.when(body != "", F.transform(F.split(body, ","), point))


def wkt_polygon(points: Column) -> Column:
    """POLYGON text of a ring with seven decimals."""
    seven = lambda v: F.format_string("%.7f", v)
    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", seven(p["x"]), seven(p["y"]))), ","), F.lit("))"))


def same_points(a: Column, b: Column, tolerance: float = 1e-7) -> Column:
    """Equal lists of points within a tolerance."""
    near = F.zip_with(a, b, lambda p, q: (F.abs(p["x"] - q["x"]) <= tolerance) & (F.abs(p["y"] - q["y"]) <= tolerance))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda x: F.coalesce(x, F.lit(False)))


def rotate(values: Column, n: Column) -> Column:
    """A list that begins with its n-th element (from 0)."""
    return F.concat(F.slice(values, n + 1, F.size(values)), F.slice(values, F.lit(1), n))


def canonical_ring(values: Column) -> Column:
    """An open ring of distinct values from its smallest one on, in the direction of the smaller neighbour."""

    def of(v: Column) -> Column:
        at = F.array_position(v, F.array_min(v)).cast("int") - 1
        ahead = rotate(v, at)
        return let(ahead, lambda r: F.when((F.size(r) > 2) & (r[1] > F.element_at(r, -1)), F.concat(F.slice(r, F.lit(1), F.lit(1)), F.reverse(F.slice(r, F.lit(2), F.size(r))))).otherwise(r))

    return let(values, lambda v: F.when(F.size(v) < 2, v).otherwise(of(v)))


def polar(x: Column, y: Column) -> tuple[Column, Column]:
    """C14: length and angle of a vector, the angle from -pi to pi."""
    return F.sqrt(x * x + y * y), F.atan2(y, x)


def direction_end(x: Column, y: Column, angle: Column, size: Column) -> Column:
    """The far end of the mark that shows a drawn text's direction, `size` back along the angle."""
    return F.struct((x - size * F.cos(angle)).alias("x"), (y - size * F.sin(angle)).alias("y"))


def _steps(points: Column, pair) -> Column:
    n = F.size(points)
    return F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), pair)


def geodesic_area(points: Column) -> Column:
    """Square metres of a closed ring in degrees on the sphere, whichever way it runs."""
    term = lambda a, b: (F.radians(b["x"]) - F.radians(a["x"])) * (2 + F.sin(F.radians(a["y"])) + F.sin(F.radians(b["y"])))
    return F.abs(F.aggregate(_steps(points, term), F.lit(0.0), lambda s, d: s + d)) * (EARTH * EARTH / 2)


def closest_point(points: Column, x: Column, y: Column) -> Column:
    """(d, x, y): the point of a line or ring that is nearest to a point, and how far it is."""

    def of(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.least(F.greatest(((x - a["x"]) * dx + (y - a["y"]) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        at = lambda p: F.struct(F.sqrt((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y)).alias("d"), p["x"].alias("x"), p["y"].alias("y"))
        return let(F.struct((a["x"] + t * dx).alias("x"), (a["y"] + t * dy).alias("y")), at)

    return F.array_min(_steps(points, of))


def _side(a: Column, b: Column, p: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def _on(a: Column, b: Column, p: Column) -> Column:
    within = lambda c: p[c].between(F.least(a[c], b[c]), F.greatest(a[c], b[c]))
    return (_side(a, b, p) == 0) & within("x") & within("y")


def lines_meet(first: Column, second: Column) -> Column:
    """True if two lists of points share a place on their lines, touching included."""
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    def meet(s: Column, t: Column) -> Column:
        a, b, c, d = s["a"], s["b"], t["a"], t["b"]
        apart = (_side(a, b, c) * _side(a, b, d) < 0) & (_side(c, d, a) * _side(c, d, b) < 0)
        return apart | _on(a, b, c) | _on(a, b, d) | _on(c, d, a) | _on(c, d, b)

    return let(_steps(second, pair), lambda other: F.exists(_steps(first, pair), lambda s: F.exists(other, lambda t: meet(s, t))))


def rings_intersect(first: Column, second: Column) -> Column:
    """True if two polygons (closed rings) share a point."""
    inside = lambda ring, p: ring_contains(ring, p["x"], p["y"])
    return lines_meet(first, second) | inside(first, second[0]) | inside(second, first[0])


def ring_holds(ring: Column, points: Column) -> Column:
    """True if a line lies inside a ring and nowhere on its edge."""
    return F.forall(points, lambda p: ring_contains(ring, p["x"], p["y"])) & ~lines_meet(ring, points)


def wkt_polygons(text: Column) -> Column:
    """P10: the rings of each polygon of a POLYGON or MULTIPOLYGON text, outer ring first; null for other texts."""
    point = lambda p: let(F.split(F.trim(p), " +"), lambda c: F.struct(c[0].cast("double").alias("x"), c[1].cast("double").alias("y")))
    ring = lambda r: F.transform(F.split(r, ","), point)
    rings = lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"\(([^()]+)\)"), F.lit(1)), ring)
    bodies = F.regexp_extract_all(text, F.lit(r"(\((?:\s*\([^()]+\)\s*,?)+\))"), F.lit(1))
    return F.when(text.rlike(r"^\s*(MULTI)?POLYGON"), F.transform(bodies, rings))


# The ellipsoid GRS 80 and the national conic projections (origin and parallels in degrees, false origin in metres).
_AXIS, _ECCENTRICITY = 6378137.0, math.sqrt(0.00669438002290)
CONIC = {"LAMB93": (46.5, 3.0, 44.0, 49.0, 700000.0, 6600000.0)} | {
    f"RGF93CC{z}": (float(z), 3.0, z - 0.75, z + 0.75, 1700000.0, (z - 41) * 1000000.0 + 200000.0) for z in range(42, 51)
}


def _cone(code: str) -> tuple[float, float, float, float, float]:
    """Exponent, constant, pole's radius at the origin, and false origin of a conic projection with two parallels."""
    lat0, _, lat1, lat2, x0, y0 = CONIC[code]
    e = _ECCENTRICITY
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    return n, f, _AXIS * f * t(p0) ** n, x0, y0


def to_projection(lon: Column, lat: Column, code: str) -> Column:
    """(x, y) in metres of a point in degrees, in a conic projection of the land registry."""
    (n, f, r0, x0, y0), e = _cone(code), _ECCENTRICITY
    p = F.radians(lat)
    t = F.tan(math.pi / 4 - p / 2) / F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2))
    r, a = _AXIS * f * F.pow(t, F.lit(n)), n * F.radians(lon - CONIC[code][1])
    return F.struct((x0 + r * F.sin(a)).alias("x"), (y0 + r0 - r * F.cos(a)).alias("y"))


def from_projection(x: Column, y: Column, code: str) -> Column:
    """(lon, lat) in degrees of a point in a conic projection of the land registry."""
    (n, f, r0, x0, y0), e = _cone(code), _ECCENTRICITY
    dx, dy = x - x0, r0 - (y - y0)
    t = F.pow(F.sqrt(dx * dx + dy * dy) / (_AXIS * f), F.lit(1 / n))
    p = math.pi / 2 - 2 * F.atan(t)
    for _ in range(6):  # each step gains over two digits
        p = let(e * F.sin(p), lambda s: math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(e / 2))))
    return F.struct((F.degrees(F.atan2(dx, dy)) / n + CONIC[code][1]).alias("lon"), F.degrees(p).alias("lat"))


def to_metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """(x, y) in metres around a centre, degrees of longitude as wide as there."""
    k = EARTH * math.pi / 180
    return F.struct(((lon - lon0) * k * F.cos(F.radians(lat0))).alias("x"), ((lat - lat0) * k).alias("y"))


def from_metres(x: Column, y: Column, lon0: Column, lat0: Column) -> Column:
    """(lon, lat) of metres around a centre."""
    k = EARTH * math.pi / 180
    return F.struct((lon0 + x / (k * F.cos(F.radians(lat0)))).alias("lon"), (lat0 + y / k).alias("lat"))
