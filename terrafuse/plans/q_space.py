"""Queries on points, boxes and segments."""

from pyspark.sql import functions as F

from terrafuse.functions import geometry as G
from terrafuse.operators import spatial as S
from terrafuse.plans.registry import BX, CUR, NEAR, PT, SPT, query


@query(f"WITH {PT} SELECT id, round(1000 + (x - 0) * (2000.0::DOUBLE - 1000) / (100.07::DOUBLE - 0), 6) AS x2, round(500 - (y - 0) * 500.0::DOUBLE / 99.73::DOUBLE, 6) AS y2 FROM pt")
def linear_transform(t):
    num = lambda v: F.lit(float(v))
    x = G.linear_transform(F.col("x"), num(0), num(100.07), num(1000), num(2000))
    y = G.linear_transform(F.col("y"), num(0), num(99.73), num(500), num(0))
    return t.pt.select("id", F.round(x, 6).alias("x2"), F.round(y, 6).alias("y2"))


_NEXT = "n AS (SELECT a.id, a.x / 20 + 1 AS lon1, a.y / 4 + 40 AS lat1, b.x / 20 + 1 AS lon2, b.y / 4 + 40 AS lat2, c.x / 20 + 1 AS lon3, c.y / 4 + 40 AS lat3 FROM pt a JOIN pt b ON b.id = a.id + 1 JOIN pt c ON c.id = a.id + 2)"


def _triples(t):
    p = lambda k: t.pt.select((F.col("id") - (k - 1)).alias("id"), (F.col("x") / 20 + 1).alias(f"lon{k}"), (F.col("y") / 4 + 40).alias(f"lat{k}"))
    return p(1).join(p(2), "id").join(p(3), "id")


_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians(lat{b}) - radians(lat{a})) / 2), 2) + cos(radians(lat{a})) * cos(radians(lat{b})) * pow(sin(radians(lon{b} - lon{a}) / 2), 2))))"


@query(f"WITH {PT}, {_NEXT} SELECT id, round({_HAV.format(a=1, b=2)}, 3) AS metres FROM n")
def haversine_pairs(t):
    return _triples(t).select("id", F.round(G.haversine(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")), 3).alias("metres"))


_COURSE = "atan2(sin(radians(lon{b} - lon{a})) * cos(radians(lat{b})), cos(radians(lat{a})) * sin(radians(lat{b})) - sin(radians(lat{a})) * cos(radians(lat{b})) * cos(radians(lon{b} - lon{a})))"


@query(f"WITH {PT}, {_NEXT} SELECT id, round(abs(asin(sin({_HAV.format(a=1, b=3)} / 6371000.0::DOUBLE) * sin({_COURSE.format(a=1, b=3)} - {_COURSE.format(a=1, b=2)}))) * 6371000.0::DOUBLE, 3) AS metres FROM n")
def cross_track(t):
    c = [F.col(f"{v}{k}") for k in (1, 2, 3) for v in ("lon", "lat")]
    return _triples(t).select("id", F.round(G.cross_track(*c), 3).alias("metres"))


_SEG = f"""{NEAR}, {BX}, s AS (SELECT near.id, x, y, x0, y0, x1, y1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS t FROM near JOIN bx USING (id))"""


@query(
    f"""WITH {_SEG} SELECT id, round(t, 6) AS t, round(x0 + t * (x1 - x0), 6) AS px, round(y0 + t * (y1 - y0), 6) AS py,
  round(abs(pi() / 2 - (((0.3::DOUBLE - atan2(y1 - y0, x1 - x0)) % pi()) + pi()) % pi()), 6) AS incidence FROM s WHERE t BETWEEN 0 AND 1"""
)
def segment_projection(t):
    rows = t.near.join(t.bx, "id")
    p = G.project(*[F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")])
    slant = G.incidence(F.lit(0.3), *[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    rows = rows.select("id", p.alias("p"), slant.alias("a")).where("p is not null")
    return rows.select("id", F.round("p.t", 6).alias("t"), F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"), F.round("a", 6).alias("incidence"))


@query(
    f"""WITH {NEAR}, {BX}, s AS (SELECT near.id, x, y, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy, cos(0.7::DOUBLE) AS ux, sin(0.7::DOUBLE) AS uy FROM near JOIN bx USING (id)),
c AS (SELECT *, ux * dy - uy * dx AS c FROM s), v AS (SELECT *, ((x - x0) * uy - (y - y0) * ux) / -c AS t FROM c WHERE abs(c) > 1e-12)
SELECT id, round(x0 + t * dx, 6) AS px, round(y0 + t * dy, 6) AS py FROM v WHERE t BETWEEN 0 AND 1"""
)
def directional_projection(t):
    p = G.project_along(F.col("x"), F.col("y"), F.lit(0.7), *[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    rows = t.near.join(t.bx, "id").select("id", p.alias("p")).where("p is not null")
    return rows.select("id", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


@query(
    f"""WITH {PT}, {_NEXT}, a AS (SELECT id, lon1 - lon2 AS ux, lat1 - lat2 AS uy, lon3 - lon2 AS vx, lat3 - lat2 AS vy FROM n),
d AS (SELECT id, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (ux * vx + uy * vy) / sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy)))))) AS angle FROM a WHERE (ux * ux + uy * uy) * (vx * vx + vy * vy) > 0)
SELECT id, round(angle, 4) AS angle, round(abs(45 - abs(45 - angle % 90)), 4) AS off FROM d"""
)
def vertex_angles(t):
    a = G.angle_at(*[F.col(f"{v}{k}") for k in (1, 2, 3) for v in ("lon", "lat")])
    rows = _triples(t).select("id", a.alias("a")).where("a is not null")
    return rows.select("id", F.round("a", 4).alias("angle"), F.round(G.diff_to_90(F.col("a")), 4).alias("off"))


@query(f"WITH {BX} SELECT p_brand, count(*) AS n, round(min(x0), 6) AS x0, round(min(y0), 6) AS y0, round(max(x1), 6) AS x1, round(max(y1), 6) AS y1 FROM bx JOIN part ON id = p_partkey GROUP BY p_brand")
def bbox_aggregate(t):
    rows = t.bx.join(t.part.select(F.col("p_partkey").alias("id"), "p_brand"), "id")
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), *[F.round(f(c), 6).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])


_PAIRS = f"""{BX}, {CUR}, o AS (SELECT a.id AS a_id, b.id AS b_id, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h,
  greatest((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS area FROM bx a JOIN cur b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
pairs AS (SELECT a_id, b_id, w * h / area AS share FROM o WHERE w > 0 AND h > 0)"""


@query(
    f"""WITH {_PAIRS}, g AS (SELECT a_id, count(*) AS n, max(share) AS most, sum(CASE WHEN share > 0.8 THEN 1 ELSE 0 END) AS high,
  sum(CASE WHEN share > 0.5 AND share <= 0.8 THEN 1 ELSE 0 END) AS middle, arg_max(b_id, {{'s': share, 'i': -b_id}}) AS partner FROM pairs GROUP BY a_id),
k AS (SELECT id, partner, CASE WHEN n IS NULL THEN 'OK' WHEN n = 1 AND most > 0.8 THEN 'Fusion' WHEN n > 1 AND most <= 0.1 THEN 'NoFusion'
  WHEN n > 1 AND high = 1 AND middle = 0 THEN 'Fusion' ELSE 'Conflict' END AS class FROM bx LEFT JOIN g ON id = a_id)
SELECT id, class, CASE WHEN class IN ('Fusion', 'Conflict') THEN partner END AS partner FROM k"""
)
def boxes_overlap_fuse(t):
    return S.overlap_classes(t.bx, t.cur, 4.0)


@query(
    f"""WITH {BX}, {CUR}, c AS (SELECT a.id, b.id AS box, round(greatest(abs(b.x0 - a.x0), abs(b.y0 - a.y0), abs(b.x1 - a.x1), abs(b.y1 - a.y1)), 9) AS diff
  FROM bx a JOIN cur b ON (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1
  AND abs((b.x1 - b.x0) * (b.y1 - b.y0) - (a.x1 - a.x0) * (a.y1 - a.y0)) < 10),
m AS (SELECT id, min({{'d': diff, 'b': box}}) AS m FROM c GROUP BY id)
SELECT bx.id, CASE WHEN m.d < 1 THEN m.b END AS "limit", CASE WHEN m.d < 1 THEN m.d END AS diff FROM bx LEFT JOIN m USING (id)"""
)
def best_limit_argmin(t):
    return S.best_limits(t.bx, t.cur, 4.0)


@query(f"WITH {PT} SELECT a.id AS id1, b.id AS id2, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM pt a JOIN pt b ON a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1")
def radius_neighbours(t):
    return S.radius_pairs(t.pt, 1.0).select("id1", "id2", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH {PT}, {SPT}, m AS (SELECT pt.id, min({{'d': sqrt((pt.x - spt.x) * (pt.x - spt.x) + (pt.y - spt.y) * (pt.y - spt.y)), 's': spt.id}}) AS m FROM pt, spt GROUP BY pt.id)
SELECT id, m.s AS site, round(m.d, 6) AS distance FROM m"""
)
def nearest_one(t):
    return S.nearest(t.pt, t.spt).select("id", "site", F.round("distance", 6).alias("distance"))


@query(f"WITH {PT}, {BX} SELECT pt.id AS point, bx.id AS box FROM pt JOIN bx ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def points_in_boxes(t):
    return S.points_in_boxes(t.pt, t.bx, 4.0)


_STEPS = "[" + ", ".join(map(str, S.LADDER)) + "]"


@query(
    f"""WITH {NEAR}, {BX}, d AS (SELECT near.id, sqrt(pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2)) AS distance FROM near JOIN bx USING (id))
SELECT id, round(distance, 6) AS distance, list_filter({_STEPS}, lambda s: s >= distance)[1] AS step FROM d"""
)
def expanding_ladder_bucket(t):
    d = G.box_distance(*[F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")])
    return t.near.join(t.bx, "id").select("id", F.round(d, 6).alias("distance"), S.ladder_step(d).alias("step"))


@query()
def ladder_greedy(t):
    """House numbers to parcels over the whole ladder, nearest step first; tested against the sequential pass."""
    return S.ladder_pairs(t.near, t.bx)


@query(
    f"""WITH {BX}, b AS (SELECT p_brand, min(x0) - 10 AS ax, min(y0) - 10 AS ay, max(x1) + 10 AS bx, max(y1) + 10 AS byy FROM bx JOIN part ON id = p_partkey GROUP BY p_brand),
w AS (SELECT *, unnest(generate_series(0, CAST(floor((bx - ax - 1) / 25) AS INTEGER))) AS i FROM b), v AS (SELECT *, unnest(generate_series(0, CAST(floor((byy - ay - 1) / 25) AS INTEGER))) AS j FROM w)
SELECT p_brand, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(ax + i * 25, 6) AS x1, round(ay + j * 25, 6) AS y1, round(least(ax + i * 25 + 25, bx), 6) AS x2, round(least(ay + j * 25 + 25, byy), 6) AS y2 FROM v"""
)
def tile_grid(t):
    rows = S.tiles(bbox_aggregate(t).drop("n"), 25.0)
    return rows.select("p_brand", "i", "j", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


_BITS = " || ".join(
    f"CASE WHEN gx & {1 << (7 - k)} > 0 THEN 'D' ELSE 'G' END || CASE WHEN gy & {1 << (7 - k)} > 0 THEN 'H' ELSE 'B' END" for k in range(8)
)


@query(
    f"""WITH {PT}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt),
g AS (SELECT CAST(least(floor((x - x0) / (x1 - x0) * 256), 255) AS INTEGER) AS gx, CAST(least(floor((y - y0) / (y1 - y0) * 256), 255) AS INTEGER) AS gy FROM pt, b),
p AS (SELECT {_BITS} AS path FROM g), c AS (SELECT left(path, n) AS path, count(*) AS n FROM p, generate_series(0, 16) s(n) GROUP BY ALL)
SELECT path, n FROM c WHERE (n < 100 OR length(path) = 16) AND (length(path) = 0 OR left(path, length(path) - 1) IN (SELECT path FROM c WHERE n >= 100))"""
)
def kd_split_counts(t):
    return S.kd_leaves(t.pt, 100)


@query(f"WITH {PT} SELECT min(id) AS node, round(x, 0) AS x, round(y, 0) AS y, count(*) AS n FROM pt GROUP BY 2, 3")
def node_dedupe_id(t):
    return S.node_ids(t.pt, 0)


@query(f"WITH {PT} SELECT c_mktsegment, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM pt JOIN customer ON id = c_custkey GROUP BY c_mktsegment")
def place_centroids(t):
    rows = t.pt.join(t.customer.select(F.col("c_custkey").alias("id"), "c_mktsegment"), "id")
    return rows.groupBy("c_mktsegment").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


@query(
    f"""WITH {BX} SELECT id, printf('POLYGON((%.7f %.7f,%.7f %.7f,%.7f %.7f,%.7f %.7f,%.7f %.7f))', x0, y0, x1, y0, x1, y1, x0, y1, x0, y0) AS wkt,
  round((x1 - x0) * (y1 - y0), 4) AS area, round(2 * (x1 - x0) + 2 * (y1 - y0), 4) AS length, true AS same FROM bx"""
)
def wkt_roundtrip(t):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(*[corner(*c) for c in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    rows = t.bx.select("id", ring.alias("ring")).withColumn("wkt", G.wkt_polygon(F.col("ring"))).withColumn("back", G.wkt_points(F.col("wkt")))
    return rows.select("id", "wkt", F.round(G.signed_area(F.col("back")), 4).alias("area"), F.round(G.polyline_length(F.col("back")), 4).alias("length"), G.same_points(F.col("ring"), F.col("back")).alias("same"))


@query(f"WITH {NEAR}, {BX} SELECT near.id, x > x0 AND y > y0 AND (x - x0) / (x1 - x0) + (y - y0) / (y1 - y0) < 1 AS inside FROM near JOIN bx USING (id)")
def triangle_contains(t):
    """A point against the triangle below a box's diagonal."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x0", "y1"), corner("x0", "y0"))
    return t.near.join(t.bx, "id").select("id", G.ring_contains(ring, F.col("x"), F.col("y")).alias("inside"))
