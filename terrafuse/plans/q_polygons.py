"""Queries on polygons made of others, and on sets of elements."""

from pyspark.sql import functions as F

from terrafuse.functions import geometry as G
from terrafuse.operators import classify as C
from terrafuse.operators import layers as L
from terrafuse.operators import graph as R
from terrafuse.operators import polygons as P
from terrafuse.operators import spatial as S
from terrafuse.plans.q_layers import shared_folder
from terrafuse.plans.q_projections import _ring
from terrafuse.plans.registry import BX, PT, WAY, query

_CELLS = "c AS (SELECT p_partkey AS id, p_partkey % 40 // 10 AS place, p_partkey % 40 AS x, p_partkey // 40 AS y FROM part WHERE p_size % 6 <> 0)"


def _cells(t):
    k = F.col("p_partkey")
    x, y = (k % 40).cast("double"), F.expr("p_partkey div 40").cast("double")
    boxes = t.part.where("p_size % 6 <> 0").select(k.alias("id"), F.expr("p_partkey % 40 div 10").alias("place"), x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), (y + 1).alias("y1"))
    return _ring(boxes)


@query(
    f"""WITH {_CELLS}, s AS (SELECT place, count(*) AS area FROM c GROUP BY place),
e AS (SELECT a.place, count(*) FILTER (b.id IS NULL) AS sides FROM (SELECT *, unnest([1, -1, 0, 0]) AS dx, unnest([0, 0, 1, -1]) AS dy FROM c) a
  LEFT JOIN c b ON a.place = b.place AND b.x = a.x + a.dx AND b.y = a.y + a.dy GROUP BY a.place)
SELECT place, area::DOUBLE AS area, sides::DOUBLE AS outline FROM s JOIN e USING (place)"""
)
def place_limits(t):
    """Outlines of the grid cells of four places."""
    rows = P.dissolve(_cells(t), "place", tolerance=1e-9)
    length = F.aggregate(F.transform("rings", lambda r: G.polyline_length(r)), F.lit(0.0), lambda a, b: a + b)
    return rows.select("place", F.round("area", 6).alias("area"), F.round(length, 6).alias("outline"))


@query(
    f"""WITH {BX} SELECT id, CAST(CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS parts, round((x1 - x0) * (y1 - y0) * CASE WHEN id % 2 = 0 THEN 1 ELSE 0.5 END, 4) AS area, id % 2 = 0 AS valid FROM bx"""
)
def polygon_repair(t):
    """Sound boxes, and boxes whose sides cross, which are two triangles."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    crossed = F.array(at("x0", "y0"), at("x1", "y1"), at("x1", "y0"), at("x0", "y1"), at("x0", "y0"))
    rows = _ring(t.bx).withColumn("ring", F.when(F.col("id") % 2 == 0, F.col("ring")).otherwise(crossed))
    got = P.repair(rows, 1e-9)
    return got.select("id", F.size("parts").alias("parts"), F.round("area", 4).alias("area"), "valid")


@query(
    f"""WITH {WAY}, p AS (SELECT DISTINCT a.way_id AS way1, b.way_id AS way2 FROM way_nodes a JOIN way_nodes b ON b.way_id = a.way_id + 1 AND a.node_id = b.node_id),
n AS (SELECT way1, way2, a.node_id FROM p JOIN way_nodes a ON a.way_id = way1 JOIN way_nodes b ON b.way_id = way2 AND a.node_id = b.node_id)
SELECT way1, way2, array_to_string(list(node_id ORDER BY node_id), ',') AS nodes, round(avg(p_size), 6) AS x FROM n JOIN part ON node_id = p_partkey GROUP BY way1, way2"""
)
def pair_junctions(t):
    """Common nodes of neighbouring ways and their mean place."""
    ways = t.way_nodes
    pairs = ways.select(F.col("way_id").alias("way1"), (F.col("way_id") + 1).alias("way2")).distinct()
    found = P.junctions(pairs, ways)
    places = P.barycentres(found, t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("x"), F.col("p_size").alias("y")))
    return found.join(places, ["way1", "way2"]).select("way1", "way2", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"), F.round("x", 6).alias("x"))


@query(
    """WITH p AS (SELECT p_partkey * 100 AS k, p_size % 3 AS m FROM part WHERE p_partkey % 2 = 0)
SELECT k + 1 AS way1, k + 2 AS way2, array_to_string(CASE m WHEN 0 THEN [k + 2, k + 3, k + 4, k + 1, k + 6, k + 5, k + 2] ELSE [k + 12, k + 2, k + 3, k + 4, k + 1, k + 6, k + 5, k + 12][2:7] || [k + 2] END, ',') AS nds,
  CASE WHEN m = 1 THEN (k + 12)::VARCHAR ELSE '' END AS deleted FROM p"""
)
def joined_buildings(t):
    """Two buildings with a common wall; a node inside the wall goes unless it bears tags."""
    rows = t.part.where("p_partkey % 2 = 0").select((F.col("p_partkey") * 100).alias("k"), (F.col("p_size") % 3).alias("m"))
    at = lambda *n: F.array(*[F.col("k") + i for i in n])
    first = F.when(F.col("m") == 0, at(1, 2, 3, 4, 1)).otherwise(at(1, 12, 2, 3, 4, 1))
    second = F.when(F.col("m") == 0, at(2, 1, 6, 5, 2)).otherwise(F.when(F.col("k") % 400 == 0, at(2, 12, 1, 6, 5, 2)).otherwise(at(5, 6, 1, 12, 2, 5)))
    ways = rows.select((F.col("k") + 1).alias("way_id"), first.alias("nds")).union(rows.select(F.col("k") + 2, second))
    nodes = ways.select("way_id", F.posexplode("nds").alias("pos", "node_id"))
    pairs = rows.select((F.col("k") + 1).alias("way1"), (F.col("k") + 2).alias("way2"))
    tagged = rows.where("m = 2").select((F.col("k") + 12).alias("node_id"))
    got = P.joined_ways(pairs, ways, nodes, tagged)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return got.select("way1", "way2", text("nds").alias("nds"), text("deleted").alias("deleted"))


@query(
    f"""WITH {WAY}, m AS (SELECT o_custkey AS relation, o_orderkey AS way_id, CASE WHEN o_orderkey % 3 = 0 THEN 'inner' ELSE 'outer' END AS role FROM orders),
w AS (SELECT DISTINCT way_id FROM way_nodes WHERE way_id % 50 = 7), r AS (SELECT DISTINCT relation FROM m JOIN w USING (way_id) WHERE role = 'outer'),
ways AS (SELECT way_id FROM m WHERE relation IN (SELECT relation FROM r) UNION SELECT way_id FROM w), n AS (SELECT DISTINCT node_id FROM way_nodes WHERE way_id IN (SELECT way_id FROM ways)),
u AS (SELECT 'relation' AS kind, relation AS ref FROM r UNION ALL SELECT 'way', way_id FROM ways UNION ALL SELECT 'node', node_id FROM n)
SELECT kind, ref, -row_number() OVER (PARTITION BY kind ORDER BY ref) AS id FROM u"""
)
def copied_ways(t):
    """Orders as ways, customers as multipolygons."""
    role = F.when(F.col("o_orderkey") % 3 == 0, "inner").otherwise("outer")
    members = t.orders.select(F.col("o_custkey").alias("relation"), F.col("o_orderkey").alias("way_id"), role.alias("role"))
    return P.copied(t.way_nodes.where("way_id % 50 = 7").select("way_id").distinct(), t.way_nodes, members)


@query(
    f"""WITH {BX} SELECT id AS seq, x0, y0, x1, y1 FROM bx WHERE id <= 20 OR (x0 <= 60 AND x1 >= 30 AND y0 <= 70 AND y1 >= 20)"""
)
def tiles_in_limit(t):
    """Files 20 and 90 show limits; the first counts."""
    ring = lambda seq, x0, y0, x1, y1: (seq, [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])
    limits = t.spark.createDataFrame([ring(20, 30.0, 20.0, 60.0, 70.0), ring(90, 0.0, 0.0, 99.0, 99.0)], "seq long, ring array<struct<x:double,y:double>>")
    return P.tiles_in_limit(t.bx.withColumnRenamed("id", "seq"), limits)


@query(
    f"""WITH {PT}, r AS (SELECT id, CASE WHEN id % 12 < 8 THEN id // 4 ELSE 50000 + id // 3 END AS a, 1000000 + id AS b FROM pt), e AS (SELECT id, a AS p, b AS q FROM r UNION ALL SELECT id, b, a FROM r),
c AS (SELECT p, count(*) AS n FROM e GROUP BY p), s AS (SELECT id, sum(n - 1) AS meets, count(*) FILTER (n > 1) AS places, arg_max(p, n) AS p FROM e JOIN c USING (p) GROUP BY id)
SELECT DISTINCT p::DOUBLE AS x, 0.0::DOUBLE AS y FROM s WHERE meets = 3 AND places = 1"""
)
def church_crosses(t):
    """Lines that meet by fours or threes at one end."""
    k = F.col("id")
    start = F.when(k % 12 < 8, F.expr("id div 4")).otherwise(F.expr("50000 + id div 3"))
    rails = t.pt.select("id", start.cast("double").alias("ax"), F.lit(0.0).alias("ay"), (k + 1000000).cast("double").alias("bx"), F.lit(0.0).alias("by"))
    return L.churches(rails)


@query(
    f"""WITH {BX}, r AS (SELECT DISTINCT ON (x0, y0, x1, y1) * FROM bx ORDER BY id)
SELECT a.id, EXISTS (SELECT 1 FROM r b WHERE a.id <> b.id AND ((a.x0 >= b.x0 AND a.x0 < b.x1) OR (a.x1 >= b.x0 AND a.x1 < b.x1)) AND ((a.y0 >= b.y0 AND a.y0 < b.y1) OR (a.y1 >= b.y0 AND a.y1 < b.y1))) AS inner FROM r a"""
)
def inner_limits(t):
    """A ring with a corner inside another one is inner."""
    return L.inner_rings(_ring(t.bx).select("id", "ring"), 8.0)


@query("SELECT round(sum(CASE WHEN predicted = actual THEN w ELSE 0 END) / sum(w), 9) AS accuracy FROM (SELECT label % 3 AS actual, vec_id % 3 AS predicted, 1.0::DOUBLE + label % 3 AS w FROM embeddings)")
def weighted_accuracy(t):
    """A28"""
    rows = t.embeddings.select((F.col("label") % 3).alias("actual"), (F.col("vec_id") % 3).alias("predicted"))
    weights = rows.select("actual").distinct().withColumn("weight", F.col("actual") + F.lit(1.0))
    return C.weighted_accuracy(rows, weights).select(F.round("accuracy", 9).alias("accuracy"))


@query("SELECT vec_id AS id, len(embedding) AS n, CAST(label AS BIGINT) AS label FROM embeddings")
def training_table(t):
    """The training vectors saved and loaded."""
    folder = shared_folder(t.spark)
    C.save_training(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label")), folder)
    return C.load_training(t.spark, folder).select("id", F.size("vector").cast("long").alias("n"), "label")


@query(
    """WITH s AS (SELECT l_orderkey AS way_id, list_sort(list(DISTINCT l_partkey % 7)) AS l FROM lineitem GROUP BY l_orderkey), g AS (SELECT way_id, min(way_id) OVER (PARTITION BY l, way_id % 2) AS new FROM s),
t AS (SELECT new, 'name' AS k, repeat('n', (way_id % 5 + 1)::INTEGER) AS v FROM g UNION ALL SELECT new, 'kind', CASE WHEN way_id % 3 = 0 THEN 'b' ELSE 'a' END FROM g),
b AS (SELECT new, k, arg_min(v, {'n': -length(v), 'v': v}) AS v FROM t GROUP BY new, k)
SELECT new AS way_id, array_to_string(list(k || '=' || v ORDER BY k), ';') AS tags FROM b GROUP BY new"""
)
def identical_way_tags(t):
    """Closed (even) and open (odd) ways of the same nodes turned about, and the tags of each group."""
    ways = t.lineitem.groupBy(F.col("l_orderkey").alias("way_id")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 7)).alias("l"))
    turned = F.when(F.col("way_id") % 4 < 2, F.col("l")).otherwise(F.reverse("l"))
    nds = F.when((F.col("way_id") % 2 == 0) & (F.size("l") > 0), F.concat(turned, F.slice(turned, F.lit(1), F.lit(1)))).otherwise(turned)
    ways = ways.select("way_id", nds.alias("nds"), L.tag_map(name=F.repeat(F.lit("n"), (F.col("way_id") % 5 + 1).cast("int")), kind=F.when(F.col("way_id") % 3 == 0, "b").otherwise("a")).alias("tags"))
    got = R.merged_tags(R.identical_ways(ways), ways.select("way_id", "tags"))
    return got.select("way_id", F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("tags"))


@query(
    f"""WITH {BX}, b AS (SELECT min(x0) - 10 AS ax, min(y0) - 10 AS ay, max(x1) + 10 AS bx, max(y1) + 10 AS byy FROM bx), g AS (SELECT *, unnest(range(3)) AS i FROM b), h AS (SELECT *, unnest(range(3)) AS j FROM g)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(ax + (bx - ax) / 3 * i, 6) AS x1, round(ay + (byy - ay) / 3 * j, 6) AS y1, round(ax + (bx - ax) / 3 * (i + 1), 6) AS x2, round(ay + (byy - ay) / 3 * (j + 1), 6) AS y2 FROM h"""
)
def tiles_by_number(t):
    """X06"""
    box = t.bx.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return S.tiles_by_number(box, 3).select("i", "j", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    """WITH a AS (SELECT l_orderkey AS way, list_sort(list(DISTINCT l_partkey)) AS nodes FROM lineitem GROUP BY 1)
SELECT 'way' AS kind, way AS id, array_to_string(nodes, ',') AS nodes FROM a UNION ALL SELECT 'node', id, '' FROM (SELECT unnest(nodes) AS id FROM a UNION SELECT p_partkey FROM part)"""
)
def element_sets(t):
    """The nodes of ways as sorted sets, all nodes once, and both kinds in one table."""
    ways = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("n"))
    nodes = ways.select(F.explode("n").alias("id")).union(t.part.select("p_partkey")).distinct()
    return ways.select(F.lit("way").alias("kind"), "id", F.array_join(F.col("n").cast("array<string>"), ",").alias("nodes")).unionByName(nodes.select(F.lit("node").alias("kind"), "id", F.lit("").alias("nodes")))
