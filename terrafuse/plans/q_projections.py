"""Queries on layer tags, projections, address files, lists and archives."""


from pyspark.sql import functions as F

from terrafuse.functions import geometry as G
from terrafuse.operators import address_files as A
from terrafuse.operators import layers as L
from terrafuse.operators import tiles as T
from terrafuse.plans.q_layers import shared_folder
from terrafuse.plans.registry import BX, NEAR, PT, query
from terrafuse.sources import archives, glyph_files, lists, osm


def _k():
    return F.col("p_partkey")


def _c():
    return F.col("c_custkey")


def _text(tags):
    """A map as key=value words, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def _point(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def _ring(boxes):
    at = lambda x, y: _point(F.col(x), F.col(y))
    return boxes.withColumn("ring", F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"), at("x0", "y0")))


@query(
    f"""WITH {BX}, {NEAR}, l AS (SELECT id, x, y, x + 0.05::DOUBLE AS u, y + 0.05::DOUBLE AS v FROM near WHERE id % 4 = 0),
c AS (SELECT DISTINCT bx.id FROM bx JOIN l ON l.x > x0 AND l.u < x1 AND l.y > y0 AND l.v < y1)
SELECT bx.id, 'building=' || CASE WHEN c.id IS NULL THEN 'yes' ELSE 'church' END || CASE WHEN c.id IS NULL THEN '' ELSE ';religion=christian' END || ';start_date=' || (2000 + bx.id % 20)::VARCHAR
  || CASE WHEN bx.id % 3 = 2 THEN ';wall=no' ELSE '' END AS tags FROM bx LEFT JOIN c ON bx.id = c.id"""
)
def layer_buildings(t):
    """Buildings, those that hold a cross line as churches."""
    lines = t.near.where("id % 4 = 0").select("x", "y", (F.col("x") + 0.05).alias("u"), (F.col("y") + 0.05).alias("v"))
    held = L.holding(_ring(t.bx).select("id", "ring"), lines)
    rows = _ring(t.bx).where(G.signed_area(F.col("ring")) > 0).join(held.withColumn("church", F.lit(True)), "id", "left")
    tags = L.building_tags(F.coalesce("church", F.lit(False)), (2000 + F.col("id") % 20).cast("string"), F.col("id") % 3)
    return rows.select("id", _text(tags).alias("tags"))


@query(
    f"""WITH {BX}, s AS (SELECT id, [34, 65, 51][id % 3 + 1] AS sym, x0 / 5e4 AS a, x1 / 5e4 AS b, 45 + y0 / 5e4 AS c, 45 + y1 / 5e4 AS d FROM bx),
a AS (SELECT id, sym, round(6371000.0::DOUBLE * 6371000 * radians(b - a) * abs(sin(radians(d)) - sin(radians(c))), 2) AS area FROM s)
SELECT id, area, CASE WHEN sym = 34 OR area > 150 THEN 'natural=water' ELSE 'access=private;leisure=swimming_pool' END AS tags FROM a WHERE sym IN (34, 65)"""
)
def layer_water(t):
    """Surfaces of water and basins by their area on the sphere."""
    rows = t.bx.select("id", *[(F.col(c) / 5e4 + (45 if c[0] == "y" else 0)).alias(c) for c in ("x0", "y0", "x1", "y1")])
    rows = _ring(rows).withColumn("area", F.round(G.geodesic_area(F.col("ring")), 2))
    sym = F.element_at(F.array(F.lit(34), F.lit(65), F.lit(51)), (F.col("id") % 3 + 1).cast("int"))
    tags = L.water_tags(sym, F.col("area"))
    return rows.withColumn("t", tags).where("t is not null").select("id", "area", _text(F.map_filter("t", lambda k, v: k != "area")).alias("tags"))


_LAYERS = ("tsurf", "lieudit", "zoncommuni", "tronfluv", "tronroute", "voiep")


@query(
    f"""WITH p AS (SELECT p_partkey AS id, {list(_LAYERS)!r}[p_partkey % 6 + 1] AS layer, CASE WHEN p_size % 2 = 0 THEN 51 ELSE 34 END AS sym, CASE WHEN p_size % 5 = 0 THEN p_size::VARCHAR ELSE p_name END AS text FROM part)
SELECT id, layer, CASE layer WHEN 'tsurf' THEN 'landuse=cemetery' WHEN 'lieudit' THEN 'place=' WHEN 'zoncommuni' THEN 'highway=' WHEN 'tronfluv' THEN 'waterway=riverbank' ELSE '' END AS tags
FROM p WHERE (layer <> 'tsurf' OR sym = 51) AND NOT (layer = 'voiep' AND regexp_full_match(text, '[0-9]*'))"""
)
def layer_others(t):
    """The other layers; surfaces without a meaning and numbers among the small names go."""
    layer = F.element_at(F.array(*map(F.lit, _LAYERS)), (_k() % 6 + 1).cast("int"))
    rows = t.part.select(_k().alias("id"), layer.alias("layer"), F.when(F.col("p_size") % 2 == 0, 51).otherwise(34).alias("sym"), F.when(F.col("p_size") % 5 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_name")).alias("text"))
    rows = rows.where("layer <> 'voiep'").unionByName(L.named_only(rows.where("layer = 'voiep'"), "text")).withColumn("t", L.other_tags(F.col("layer"), F.col("sym")))
    return rows.where("t is not null").select("id", "layer", _text(F.col("t")).alias("tags"))


@query(
    """SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'name=' || p_brand || ' ' || p_name || ';' END || 'ref:FR:cadastre=' || lpad((p_size)::VARCHAR, 3, '0') || ':' || p_partkey::VARCHAR || ';source=register;source:date=2024-01-'
  || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') AS tags, ['building=yes', 'building=yes;wall=no', 'natural=water', 'waterway=riverbank', 'admin_level=8;boundary=administrative'][p_partkey % 5 + 1] AS style FROM part"""
)
def layer_primitives(t):
    """Tags of every row, and those of its style."""
    texts = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", F.concat("p_name", F.lit(" "))))
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"))
    tags = L.primitive_tags(F.lpad(F.col("p_size").cast("string"), 3, "0"), _k().cast("string"), day, texts, "register")
    style = L.style_tags(F.element_at(F.array(*map(F.lit, L.STYLES)), (_k() % 5 + 1).cast("int")))
    return t.part.select(_k().alias("id"), _text(tags).alias("tags"), _text(style).alias("style"))


@query(
    f"""WITH {PT}, n AS (SELECT id, x, y, (id % 90 - 45) / 57.3::DOUBLE AS angle, id % 50 AS num FROM pt), d AS (SELECT *, CAST(round(degrees(angle)) AS INTEGER) AS deg FROM n)
SELECT id, 'addr:housenumber=' || num::VARCHAR || ';angle=' || deg::VARCHAR || '°;fixme=check;source=register' AS tags,
  CASE WHEN deg <> 0 THEN round(x - cos(angle - pi() / 2), 6) END AS mx, CASE WHEN deg <> 0 THEN round(y - sin(angle - pi() / 2), 6) END AS my FROM d"""
)
def number_nodes(t):
    """House numbers with their angle, and the end of the mark that shows it."""
    rows = t.pt.select("id", "x", "y", ((F.col("id") % 90 - 45) / F.lit(57.3)).alias("angle"), (F.col("id") % 50).cast("string").alias("num"))
    got = L.number_nodes(rows, "register", "check")
    return got.select("id", _text(F.col("tags")).alias("tags"), F.round("mark.x", 6).alias("mx"), F.round("mark.y", 6).alias("my"))


@query(
    f"""WITH {PT}, n AS (SELECT pt.id, x, y, (pt.id % 3 - 1) * 0.4::DOUBLE AS angle, CASE WHEN pt.id % 2 = 0 THEN 'A' ELSE c_name END AS name FROM pt JOIN customer ON id = c_custkey)
SELECT id, 'name=' || name || ';source=register' AS tags, CASE WHEN angle <> 0 THEN round(x - length(name) * cos(angle), 6) END AS mx, CASE WHEN angle <> 0 THEN round(y - length(name) * sin(angle), 6) END AS my
FROM n WHERE length(name) > 1 OR angle <> 0"""
)
def name_nodes(t):
    """Street names; a level single letter is none."""
    names = t.customer.select(_c().alias("id"), F.when(_c() % 2 == 0, "A").otherwise(F.col("c_name")).alias("name"))
    rows = t.pt.join(names, "id").withColumn("angle", (F.col("id") % 3 - 1) * 0.4)
    got = L.name_nodes(rows, "register")
    return got.select("id", _text(F.col("tags")).alias("tags"), F.round("mark.x", 6).alias("mx"), F.round("mark.y", 6).alias("my"))


@query(
    f"""WITH RECURSIVE {BX}, e AS (SELECT a.id AS u, b.id AS v FROM bx a JOIN bx b ON a.id % 4 = b.id % 4 AND a.id <> b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
r AS (SELECT id AS node, id AS first FROM bx UNION SELECT e.v, r.first FROM r JOIN e ON r.node = e.u AND r.first < e.v)
SELECT node AS id, min(first) AS first FROM r GROUP BY node"""
)
def water_merge(t):
    """Chains of touching boxes of one of four keys."""
    return L.merge_touching(_ring(t.bx).withColumn("key", F.col("id") % 4), "key", 8.0)


@query(
    f"""WITH {NEAR}, {BX}, q AS (SELECT id, x - x0 AS a, y - y0 AS b, x1 - x0 AS w, y1 - y0 AS h FROM near JOIN bx USING (id))
SELECT id, round(CASE WHEN a BETWEEN 0 AND w AND b BETWEEN 0 AND h THEN least(a, w - a, b, h - b) ELSE sqrt(pow(greatest(-a, 0, a - w), 2) + pow(greatest(-b, 0, b - h), 2)) END, 6) AS d, round(sqrt(a * a + b * b), 6) AS r, round(atan2(b, a), 6) AS angle FROM q"""
)
def closest_on_ring(t):
    """How far each point is from its box's side, and where it is from the box's corner."""
    rows = t.near.join(_ring(t.bx), "id")
    r, angle = G.polar(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))
    return rows.select("id", F.round(G.closest_point(F.col("ring"), F.col("x"), F.col("y"))["d"], 6).alias("d"), F.round(r, 6).alias("r"), F.round(angle, 6).alias("angle"))


@query(
    f"""WITH {BX}, p AS (SELECT a.id AS a, b.id AS b, a.x0 AS x0, a.y0 AS y0, a.x1 AS x1, a.y1 AS y1, b.x0 AS u0, b.y0 AS v0, b.x1 AS u1, b.y1 AS v1 FROM bx a JOIN bx b ON b.id = a.id + 1)
SELECT a, x0 <= u1 AND u0 <= x1 AND y0 <= v1 AND v0 <= y1 AS meet, x0 < u0 AND u1 < x1 AND y0 < v0 AND v1 < y1 AS holds FROM p"""
)
def rings_meet(t):
    """Each box against the next one, as polygons."""
    a = _ring(t.bx).select(F.col("id").alias("a"), F.col("ring").alias("ra"))
    b = _ring(t.bx).select((F.col("id") - 1).alias("a"), F.col("ring").alias("rb"))
    return T.spread(a, "a").join(T.spread(b, "a"), "a").select("a", G.rings_intersect(F.col("ra"), F.col("rb")).alias("meet"), G.ring_holds(F.col("ra"), F.col("rb")).alias("holds"))


_N, _F, _R0, _X0, _Y0 = G._cone("LAMB93")
_E = G._ECCENTRICITY


@query(
    f"""WITH {PT}, d AS (SELECT id, x / 10 - 4 AS lon, 42 + y / 12 AS lat FROM pt),
t AS (SELECT *, tan(pi() / 4 - radians(lat) / 2) / pow((1 - {_E}::DOUBLE * sin(radians(lat))) / (1 + {_E}::DOUBLE * sin(radians(lat))), {_E / 2}::DOUBLE) AS t, {_N}::DOUBLE * radians(lon - 3) AS a FROM d),
r AS (SELECT *, {G._AXIS * _F}::DOUBLE * pow(t, {_N}::DOUBLE) AS r FROM t)
SELECT id, round({_X0} + r * sin(a), 3) AS x, round({_Y0} + {_R0}::DOUBLE - r * cos(a), 3) AS y, round(lon, 8) AS lon, round(lat, 8) AS lat FROM r"""
)
def conic_roundtrip(t):
    """Degrees to the national projection and back."""
    rows = t.pt.select("id", G.to_projection(F.col("x") / 10 - 4, F.col("y") / 12 + 42, "LAMB93").alias("p"))
    back = G.from_projection(F.col("p.x"), F.col("p.y"), "LAMB93")
    rows = rows.withColumn("b", back)
    return rows.select("id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"), F.round("b.lon", 8).alias("lon"), F.round("b.lat", 8).alias("lat"))


@query(f"WITH {PT}, d AS (SELECT id, x / 10 AS lon, 42 + y / 12 AS lat FROM pt) SELECT id, round((lon - 5) * 111194.92664455873::DOUBLE * cos(radians(46)), 4) AS x, round((lat - 46) * 111194.92664455873::DOUBLE, 4) AS y, round(lon, 9) AS lon, round(lat, 9) AS lat FROM d")
def metric_roundtrip(t):
    """Degrees to metres around a centre and back."""
    mid = F.lit(5.0), F.lit(46.0)
    rows = t.pt.select("id", G.to_metres(F.col("x") / 10, F.col("y") / 12 + 42, *mid).alias("m"))
    rows = rows.withColumn("b", G.from_metres(F.col("m.x"), F.col("m.y"), *mid))
    return rows.select("id", F.round("m.x", 4).alias("x"), F.round("m.y", 4).alias("y"), F.round("b.lon", 9).alias("lon"), F.round("b.lat", 9).alias("lat"))


@query(
    f"""WITH {BX} SELECT id, 2 AS polygons, 3 AS rings, round((x1 - x0) * (y1 - y0), 4) AS area FROM bx"""
)
def multipolygon_text(t):
    """P10: texts of two polygons, one of them with a hole."""
    box = lambda s: F.format_string("(%.7f %.7f, %.7f %.7f, %.7f %.7f, %.7f %.7f, %.7f %.7f)", *[F.col(c) + s for c in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1", "x0", "y0")])
    text = F.concat(F.lit("MULTIPOLYGON ((" ), box(0), F.lit(", "), box(0), F.lit("), ("), box(500), F.lit("))"))
    rows = T.spread(t.bx).select("id", G.wkt_polygons(text).alias("p"))
    return rows.select("id", F.size("p").alias("polygons"), F.size(F.flatten("p")).alias("rings"), F.round(G.signed_area(F.col("p")[0][0]), 4).alias("area"))


@query(
    """WITH p AS (SELECT p_partkey, ['Rue ', 'Hameau ', 'CHEMIN du ', 'Le ', 'Avenuedu '][p_partkey % 5 + 1] || p_name AS name, p_size % 3 > 0 AS new FROM part)
SELECT p_partkey AS id, CASE WHEN new AND p_partkey % 5 IN (0, 2) THEN 'fixme=à vérifier: nom créé automatiquement à partir des adresses du coin;highway=road;name=' || name ELSE 'name=' || name || ';place=' END AS tags FROM p"""
)
def place_to_highway(t):
    """P21, F04"""
    head = F.element_at(F.array(*map(F.lit, ("Rue ", "Hameau ", "CHEMIN du ", "Le ", "Avenuedu "))), (_k() % 5 + 1).cast("int"))
    tags = L.tag_map(name=F.concat(head, "p_name"), place="")
    return t.part.select(_k().alias("id"), _text(A.place_tags(tags, F.col("p_size") % 3 > 0)).alias("tags"))


@query(
    """WITH p AS (SELECT p_partkey, p_partkey % 3 > 0 AS found, p_size / 2.0::DOUBLE AS d, CASE WHEN p_partkey % 4 = 0 THEN p_brand || ' ou ' || p_name END AS streets FROM part),
a AS (SELECT p_partkey, d, list_filter([CASE WHEN NOT found THEN 'position à preciser, parcelle associée: n°' || p_partkey END, 'choisir la bonne rue: ' || streets,
  CASE WHEN d > 10 THEN CAST(floor(d) AS BIGINT)::VARCHAR || ' m de la parcelle n°' || p_partkey || ': vérifier la position et/ou la rue associée' END], lambda x: x IS NOT NULL) AS parts FROM p)
SELECT p_partkey AS id, CASE WHEN len(parts) > 0 THEN array_to_string(CASE WHEN d > 10 THEN list_reverse(parts) ELSE parts END, ' et ') END AS fixme FROM a"""
)
def fixme_messages(t):
    """P22"""
    streets = F.when(_k() % 4 == 0, F.array("p_brand", "p_name")).otherwise(F.array("p_brand"))
    return t.part.select(_k().alias("id"), A.fixme(_k() % 3 > 0, _k().cast("string"), F.col("p_size") / F.lit(2.0), streets).alias("fixme"))


_FILES = """files AS (SELECT id, CASE n WHEN 1 THEN s1 || '.osm' ELSE CASE n WHEN 0 THEN '_ORPHELINS_' ELSE '_AMBIGUS_' END || lpad(chunk::VARCHAR, length(last::VARCHAR)::INTEGER, '0') || '.osm' END AS file
  FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY CASE n WHEN 1 THEN s1 ELSE n::VARCHAR END ORDER BY id) - 1) / 30) + 1 AS INTEGER) AS chunk, CAST(ceil(count(*) OVER (PARTITION BY CASE n WHEN 1 THEN s1 ELSE n::VARCHAR END) / 30) AS INTEGER) AS last
        FROM (SELECT p_partkey AS id, p_partkey % 3 AS n, strip_accents('Rue ' || p_brand) AS s1 FROM part)))"""


def _files(t):
    street = F.concat(F.lit("Rue "), "p_brand")
    streets = F.when(_k() % 3 == 0, F.array().cast("array<string>")).when(_k() % 3 == 1, F.array(street)).otherwise(F.array(street, "p_name"))
    return A.number_files(t.part.select(_k().alias("id"), streets.alias("streets")), 30)


@query(f"WITH {_FILES} SELECT * FROM files")
def street_files(t):
    """The file that each new number goes to."""
    return _files(t)


@query(
    f"""WITH {_FILES}, w AS (SELECT DISTINCT l_orderkey AS way_id, l_partkey AS id FROM lineitem WHERE l_orderkey % 3 = 0),
c AS (SELECT way_id, count(DISTINCT file) AS n, min(file) AS file FROM w JOIN files USING (id) GROUP BY way_id)
SELECT way_id AS id, file FROM c WHERE n = 1 UNION ALL SELECT DISTINCT -id, 'fixme' FROM w JOIN c USING (way_id) WHERE n > 1"""
)
def way_files(t):
    """Ways whose new nodes are in one file, and the new nodes of the others."""
    ways = t.lineitem.where("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("way_id")).agg(F.collect_list(-F.col("l_partkey") - 1).alias("nds"))
    files = _files(t).select((-F.col("id") - 1).alias("id"), "file")
    single, torn = A.way_files(ways, files)
    return single.select(F.col("way_id").alias("id"), "file").union(torn.select(F.col("id") + 1, F.lit("fixme")))


@query(
    """WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, p_name FROM part WHERE p_partkey % 5 < 3),
f AS (SELECT *, CASE k WHEN 0 THEN 'lieux-dits' WHEN 1 THEN 'lieux_ressemblants_noms_de_rues_-_NE_PAS_ENVOYER_SUR_OSM' END AS kind FROM p WHERE k < 2)
SELECT -p_partkey - 1 AS id, kind || CASE WHEN count(*) OVER (PARTITION BY kind) > 100 THEN lpad(CAST(floor((row_number() OVER (PARTITION BY kind ORDER BY -p_partkey) - 1) / 100) + 1 AS INTEGER)::VARCHAR,
  length(CAST(ceil(count(*) OVER (PARTITION BY kind) / 100) AS INTEGER)::VARCHAR)::INTEGER, '0') ELSE '' END || '.osm' AS file FROM f"""
)
def place_files(t):
    """Places and what looks like streets."""
    tags = F.when(_k() % 5 == 0, L.tag_map(place="", name=F.col("p_name"))).when(_k() % 5 == 1, L.tag_map(highway="road", name=F.col("p_name"))).otherwise(L.tag_map(name=F.col("p_name")))
    return A.place_files(t.part.where("p_partkey % 5 < 3").select((-_k() - 1).alias("id"), tags.alias("tags")), 100)


@query("SELECT 'missing' AS side, ps AS fid FROM (SELECT DISTINCT l_suppkey AS ps FROM lineitem) WHERE ps NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 > 0) UNION ALL SELECT 'found', s_suppkey FROM supplier WHERE s_suppkey % 7 > 0 AND s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def unmatched_report(t):
    """Parcels that got addresses, and addresses without their parcel."""
    rows, missing = A.attach(t.supplier.where("s_suppkey % 7 > 0").select(F.col("s_suppkey").alias("fid")), t.lineitem.groupBy(F.col("l_suppkey").alias("fid")).agg(F.count("*").alias("n")))
    return missing.select(F.lit("missing").alias("side"), "fid").union(rows.where("n is not null").select(F.lit("found"), "fid"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' (' || c_mktsegment || ')' ELSE c_name END AS name, CASE WHEN c_custkey % 3 > 0 THEN lpad((c_custkey % 95)::VARCHAR, 5, '0') END AS post, lpad((c_custkey % 90)::VARCHAR, 3, '0') AS dep,
  substr(lpad((c_custkey % 90)::VARCHAR, 3, '0'), 2, 2) || '0' AS register, CASE WHEN c_custkey % 1000 < 999 THEN lpad((c_custkey % 1000)::VARCHAR, 3, '0') END AS commune FROM customer"""
)
def commune_names(t):
    """Names and post codes of labels, and padded codes."""
    name = F.when(_c() % 2 == 0, F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))).otherwise(F.col("c_name"))
    label = F.when(_c() % 3 > 0, F.concat(name, F.lit(" ("), F.lpad((_c() % 95).cast("string"), 5, "0"), F.lit(")"))).otherwise(F.concat(name, F.lit(" ()")))
    got, post = lists.commune_name(label)
    dep = lists.padded_department(F.concat((_c() % 90).cast("string"), F.lit(" ")))
    commune = lists.padded_commune(F.when(_c() % 1000 < 999, (_c() % 1000).cast("string")).otherwise("12a"))
    rows = t.customer.select("c_custkey", got.alias("name"), F.when(post != "", post).alias("post"), dep.alias("dep"), commune.alias("commune"))
    return rows.withColumn("register", lists.register_department(F.col("dep")))


@query("SELECT c_custkey AS n, lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS code, c_name || ' ' || c_mktsegment AS name, lpad((c_custkey % 95)::VARCHAR, 3, '0') AS dep, c_mktsegment AS dep_name FROM customer")
def list_files(t):
    """Communes and departments written as list lines and read again."""
    rows = t.customer.select(_c().alias("n"), F.lpad((_c() % 95).cast("string"), 3, "0").alias("dep"), F.lpad((_c() % 1000).cast("string"), 3, "0").alias("code"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"), "c_mktsegment")
    code, name = lists.list_fields(lists.list_line(F.col("dep"), F.col("code"), F.col("name")), 3)
    dep, dep_name = lists.list_fields(F.concat_ws(" ", "dep", F.concat(F.lit('"'), "c_mktsegment", F.lit('" '))), 2)
    return rows.select("n", code.alias("code"), name.alias("name"), dep.alias("dep"), dep_name.alias("dep_name"))


@query(
    """WITH v AS (SELECT c_custkey, ['075', '97A', '1', '', '9X2'][c_custkey % 5 + 1] AS dep, ['AB123-x (y)', 'ab123', 'A0001', 'AB12'][c_custkey % 4 + 1] AS ville, ['2.1,48.0', '1;2'][c_custkey % 2 + 1] AS bbox, ['bati', 'adresses', 'x'][c_custkey % 3 + 1] AS type FROM customer)
SELECT c_custkey, regexp_matches(dep, '^([09][0-9][0-9AB])?$') AS dep, regexp_matches(ville, '^[A-Z0-9][A-Z0-9][0-9][0-9][0-9][-a-zA-Z0-9_ ''().]*$') AS ville, regexp_matches(bbox, '^[-0-9.,]*$') AS bbox, type IN ('bati', 'adresses') AS type FROM v"""
)
def parameter_checks(t):
    """F10"""
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (_c() % len(v) + 1).cast("int"))
    values = {"dep": pick("075", "97A", "1", "", "9X2"), "ville": pick("AB123-x (y)", "ab123", "A0001", "AB12"), "bbox": pick("2.1,48.0", "1;2"), "type": pick("bati", "adresses", "x")}
    return t.customer.select("c_custkey", *[lists.valid(k, v).alias(k) for k, v in values.items()])


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR || ' RUE ' || p_name || chr(10) || 'VILLE' ELSE '' END AS address, p_partkey % 2 AS missing,
  CASE WHEN p_size BETWEEN 1 AND 9 THEN CAST('2024-0' || p_size::VARCHAR || '-15' AS DATE) END AS day, starts_with(lpad(p_partkey::VARCHAR, 6, '0'), '00') AS own FROM part"""
)
def parcel_pages(t):
    """Addresses on parcels' pages, days and commune prefixes."""
    page = F.concat(F.lit("<p><strong>REF 12</strong> Référence <strong>"), F.col("p_size").cast("string"), F.lit(" RUE "), "p_name", F.lit(" <br> VILLE\n</strong>"), F.when(_k() % 2 == 0, "\n Adresse de la parcelle").otherwise(" Surface"))
    found = lists.parcel_addresses(page)
    day = lists.registry_date(F.when(F.col("p_size").between(1, 9), F.concat(F.lit("20240"), F.col("p_size").cast("string"), F.lit("15"))).otherwise("2024"))
    return t.part.select("p_partkey", F.array_join(found, "|").alias("address"), (1 - F.size(found)).cast("long").alias("missing"), day.alias("day"), lists.of_commune(F.lpad(_k().cast("string"), 6, "0"), F.lit("00")).alias("own"))


@query(
    """SELECT c_custkey, 'node(area:' || (3600000000 + c_custkey)::VARCHAR || ');way(bn);(way._["building"];node(w););out meta;' AS ways, 'rel(area:' || (3600000000 + c_custkey)::VARCHAR || ')[type=multipolygon]["building"][wall];way(r);out meta;' AS relations,
  CASE WHEN c_nationkey < 10 THEN 'https://overpass.openstreetmap.fr/api/interpreter?' ELSE 'https://overpass-api.de/api/interpreter?' END AS server FROM customer"""
)
def map_queries(t):
    """S15"""
    dep = F.concat((F.col("c_nationkey") / 10).cast("int").cast("string"), F.lit("75"))
    return t.customer.select("c_custkey", lists.way_query(_c(), "building", nodes=True).alias("ways"), lists.multipolygon_query(_c(), "building", "[wall]").alias("relations"), lists.server(dep).alias("server"))


@query(
    """WITH w AS (SELECT DISTINCT l_orderkey AS way_id FROM lineitem WHERE l_partkey % 9 = 0) SELECT way_id FROM w WHERE way_id % 3 = 0"""
)
def cached_ways(t):
    """The ways of a tag with a node in the area."""
    ways = t.orders.select(F.col("o_orderkey").alias("way_id"), F.when(F.col("o_orderkey") % 3 == 0, L.tag_map(building="yes")).otherwise(L.tag_map(barrier="wall")).alias("tags"))
    nodes = t.lineitem.select(F.col("l_orderkey").alias("way_id"), F.col("l_partkey").alias("node_id"))
    return lists.cached_answer(ways, nodes, "building", t.part.where("p_partkey % 9 = 0").select(_k().alias("node_id"))).select("way_id")


@query(
    """SELECT 'a' || (p_size % 5)::VARCHAR || '.zip' AS path, replace(p_brand, '#', '_') || '.osm' AS name, count(*) AS nodes, 1 AS roots FROM part GROUP BY 1, 2"""
)
def zip_roundtrip(t):
    """Whole documents by file, zipped by archive, unzipped and counted."""
    file = F.concat(F.concat(F.lit("a"), (F.col("p_size") % 5).cast("string"), F.lit(".zip")), F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(".osm"))
    nodes = t.part.select(file.alias("file"), _k().alias("id"), (_k() % 180).cast("double").alias("lon"), (_k() % 90).cast("double").alias("lat"), L.tag_map(name=F.col("p_name"), kind="a & <b>").alias("tags"))
    docs = archives.documents(nodes)
    parts = F.split("file", "/")
    back = archives.unzipped(archives.zipped(docs.select(parts[0].alias("archive"), parts[1].alias("name"), "content")).withColumnRenamed("archive", "path"), ".osm")
    text = F.col("content").cast("string")
    count = lambda s: F.size(F.split(text, s)) - 1
    return back.select("path", "name", count("<node ").cast("long").alias("nodes"), (F.when(text.endswith("</osm>\n"), count("<osm ")).otherwise(0)).alias("roots"))


@query(
    """WITH w AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_partkey)) AS l FROM lineitem GROUP BY 1)
SELECT 'node' AS kind, p_partkey AS id, '' AS refs, 'name=' || p_name || ' & ''<' AS tags FROM part UNION ALL SELECT 'way', id, array_to_string(l, ','), 'kind=w' FROM w
UNION ALL SELECT 'relation', s_suppkey, 'way:' || (s_suppkey * 7)::VARCHAR || ':outer,way:' || (s_suppkey * 7 + 1)::VARCHAR || ':inner', 'type=multipolygon' FROM supplier"""
)
def osm_elements_roundtrip(t):
    """Nodes, ways and relations as whole documents by file, written and read again."""
    nodes = t.part.select(F.concat(F.lit("f"), _k() % 5).alias("file"), _k().alias("id"), (_k() % 180).cast("double").alias("lon"), (_k() % 90).cast("double").alias("lat"), L.tag_map(name=F.concat("p_name", F.lit(" & '<"))).alias("tags"))
    ways = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("nds"))
    ways = ways.select(F.concat(F.lit("f"), F.col("id") % 5).alias("file"), "id", "nds", L.tag_map(kind="w").alias("tags"))
    member = lambda i, role: F.struct(F.lit("way").alias("type"), (F.col("s_suppkey") * 7 + i).alias("ref"), F.lit(role).alias("role"))
    relations = t.supplier.select(F.concat(F.lit("f"), F.col("s_suppkey") % 5).alias("file"), F.col("s_suppkey").alias("id"), F.array(member(0, "outer"), member(1, "inner")).alias("members"), L.tag_map(type="multipolygon").alias("tags"))
    folder = shared_folder(t.spark)
    archives.documents(nodes, ways, relations).write.partitionBy("file").text(folder)
    got = osm.read_osm(t.spark, folder)
    refs = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    rows = got.nodes.select(F.lit("node").alias("kind"), "id", F.lit("").alias("refs"), _text(F.col("tags")).alias("tags"))
    rows = rows.union(got.ways.select(F.lit("way"), "id", refs("nds"), _text(F.col("tags"))))
    told = F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["type"], m["ref"].cast("string"), m["role"])), ",")
    return rows.union(got.relations.select(F.lit("relation"), "id", told, _text(F.col("tags"))))


@query("SELECT p_partkey % 9 AS file, p_name || ' \"' || p_partkey::VARCHAR || '<' AS value, 'M 0,0 L ' || p_size::VARCHAR || ',1 Z' AS d FROM part")
def glyph_library(t):
    """Glyphs written as SVG documents and read again."""
    d = F.concat(F.lit("M 0,0 L "), F.col("p_size").cast("string"), F.lit(",1 Z"))
    rows = t.part.select((_k() % 9).alias("file"), F.concat("p_name", F.lit(' "'), _k().cast("string"), F.lit("<")).alias("value"), d.alias("d"))
    return glyph_files.read_library(glyph_files.library_document(rows))


@query(
    """SELECT c_custkey, c_custkey % 3 <> 1 AS vector, (c_custkey * 37) % 500 > 300 AS session_over, CASE WHEN c_custkey % 3 <> 1 THEN lpad((c_custkey % 1000)::VARCHAR, 3, '0') END AS code FROM customer"""
)
def list_rules(t):
    """Communes drawn as vectors, and sessions that are over after five minutes."""
    now = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    rows = t.customer.select("c_custkey", F.when(_c() % 3 == 1, "IMAG").otherwise("VECT").alias("format"), F.timestamp_seconds(F.unix_timestamp(now) - (_c() * 37) % 500).alias("last"))
    drawn = lists.vector_communes(rows).select("c_custkey", F.lit(True).alias("vector"), F.lpad((_c() % 1000).cast("string"), 3, "0").alias("code"))
    rows = rows.join(drawn, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("vector", F.lit(False)).alias("vector"), lists.expired(F.col("last"), now, 300).alias("session_over"), "code")
