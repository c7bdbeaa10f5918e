"""Operators without SQL against brute force, and small cases worked by hand."""

import math
import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafuse.functions import geometry as G
from terrafuse.functions import text as X
from terrafuse.operators import buildings, classify, cleaning, glyphs, graph, parcels, rings, spatial, votes
from terrafuse.plans import jobs
from terrafuse.sources import fixed_width, json_layers, osm, paths, pbf
from terrafuse.streaming import votes as stream_votes


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_street_names(spark):
    types = {"AVENUE": "AV", "CHEMIN RURAL": "CR"}
    cases = {
        "Avenue de la République": "AV REPUBLIQUE", "chemin rural du Général Leclerc": "CR GAL LECLERC", "Rue Louis XIV": "RUE LOUIS UNQUATRE",
        "Place du 8 mai": "PLACE HUIT MAI", "": "", "Avenue": "AV", "avenues": "AVENUES",
    }
    for name, normal in cases.items():
        assert one(spark, X.normalize_street(F.lit(name), types)) == normal
    assert one(spark, X.normalize_street(F.lit(None).cast("string"), types)) is None


@pytest.mark.parametrize(
    "address,expected",
    [("12 RUE X", ("12", "", "RUE X")), ("12 bis RUE X", ("12", "bis", "RUE X")), ("12B RUE X", ("12", "B", "RUE X")), ("LE BOURG", ("", "", "LE BOURG"))],
)
def test_house_numbers(spark, address, expected):
    row = spark.range(1).select(*[c.alias(n) for n, c in zip("abc", X.house_number(F.lit(address)), strict=True)]).first()
    assert tuple(row) == expected


def test_intervals_and_codes(spark):
    assert one(spark, X.interval_numbers(F.lit("1 à 5 RUE X"))) == [1, 3, 5]
    assert one(spark, X.interval_numbers(F.lit("1 à 4 RUE X"))) == [1, 3]
    assert one(spark, X.interval_numbers(F.lit("RUE X"))) is None
    assert one(spark, X.insee_code(F.lit("081"), F.lit("UK020"))) == "81020"
    assert one(spark, X.insee_code(F.lit("971"), F.lit("AB101"))) == "97101"


def test_geometry(spark):
    f = lambda v: F.lit(float(v))
    assert one(spark, G.haversine(f(0), f(0), f(1), f(0))) == pytest.approx(math.pi * G.EARTH / 180)
    assert one(spark, G.cross_track(f(0), f(0), f(2), f(0), f(1), f(0.001))) == pytest.approx(G.EARTH * math.radians(0.001), rel=1e-6)
    assert one(spark, G.project(f(1), f(1), f(0), f(0), f(2), f(0))) == (1.0, 0.0, 0.5)
    assert one(spark, G.project(f(3), f(1), f(0), f(0), f(2), f(0))) is None
    assert one(spark, G.project(f(3), f(1), f(2), f(0), f(2), f(0))) is None
    hit = one(spark, G.project_along(f(0), f(1), F.lit(-math.pi / 4), f(0), f(0), f(2), f(0)))
    assert (hit["x"], hit["y"]) == (pytest.approx(1), 0)
    assert one(spark, G.incidence(F.lit(math.pi / 2), f(0), f(0), f(2), f(0))) == pytest.approx(0)
    assert one(spark, G.canonical_ring(F.array(*map(F.lit, [3, 1, 4, 2])))) == [1, 3, 2, 4]
    assert one(spark, G.canonical_ring(F.array(*map(F.lit, [2, 4, 1, 3])))) == [1, 3, 2, 4]


def test_ladder_takes_what_the_sequential_pass_takes(spark):
    rng = random.Random(3)
    for one_set in (False, True):
        edges = {(rng.randrange(30), rng.randrange(30)): rng.randrange(6) for _ in range(200)}
        edges = {(a, b): d for (a, b), d in edges.items() if not one_set or a < b}
        taken, used = set(), set()
        for d, a, b in sorted((d, a, b) for (a, b), d in edges.items()):
            ends = {a, b} if one_set else {("a", a), ("b", b)}
            if not ends & used:
                taken.add((a, b))
                used |= ends
        df = spark.createDataFrame([(a, b, d) for (a, b), d in edges.items()], "a long, b long, d int")
        assert {(r.a, r.b) for r in spatial.greedy_pairs(df, ["d"], one_set).collect()} == taken


def test_numbers_climb_the_whole_ladder(spark):
    rng = random.Random(5)
    points = [(i, rng.uniform(0, 300), rng.uniform(0, 40)) for i in range(40)]
    boxes = [(i, x, y, x + rng.uniform(1, 9), y + 5) for i, (x, y) in enumerate((rng.uniform(0, 120), rng.uniform(0, 40)) for _ in range(36))]
    edges = []
    for i, x, y in points:
        for j, x0, y0, x1, y1 in boxes:
            d = math.hypot(max(x0 - x, 0, x - x1), max(y0 - y, 0, y - y1))
            edges += [(min(s for s in spatial.LADDER if s >= d), i, j)] if d <= 195 else []
    want, used = set(), set()
    for s, i, j in sorted(edges):
        if ("p", i) not in used and ("b", j) not in used:
            want.add((i, j, s))
            used |= {("p", i), ("b", j)}
    got = spatial.ladder_pairs(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double"))
    assert {tuple(r) for r in got.collect()} == want and max(s for _, _, s in want) > 48


def test_boxes_are_halved_as_deep_as_it_takes(spark):
    rng = random.Random(6)
    rows = [(rng.random() * 1e-6, rng.random() * 1e-6) for _ in range(300)] + [(0.5, 0.5)] * 50 + [(rng.random(), rng.random()) for _ in range(60)]
    got = spatial.kd_leaves(spark.createDataFrame(rows, "x double, y double"), 40, depth=4).collect()
    assert sum(r.n for r in got) == len(rows) and len({r.path for r in got}) == len(got)
    assert {r.n for r in got if r.n >= 40} == {50} and max(len(r.path) for r in got) > 30


def test_components_and_levels(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(None, 1), (7, 7), (9, None)]
    parent = list(range(400))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in links:
        if u is not None and v is not None and find(u) != find(v):
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {i for u, v in links if u is not None and v is not None and u != v for i in (u, v)}
    assert got == {i: find(i) for i in linked}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    deps = {2: {11, 9}, 9: {11, 8}, 10: {11, 3, 2}, 11: {7, 5, 8}, 8: {7, 3}, 7: {5}, 5: {3}}
    df = spark.createDataFrame([(a, b) for a, bs in deps.items() for b in bs], "node long, needs long")
    order = [r.node for r in graph.levels(df).orderBy("level", "node").collect()]
    assert order == [3, 5, 7, 8, 11, 9, 2, 10]
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(spark.createDataFrame([(1, 2), (2, 1)], "node long, needs long"))


def test_votes(spark):
    rows = [(1, i, "join") for i in range(3)] + [(2, 1, "join"), (2, 2, "keep"), (2, 3, "join"), (2, 4, "keep")] + [(3, i, "join" if i < 6 else "keep") for i in range(11)]
    df = spark.createDataFrame([(c, ip, datetime(2024, 1, 1) + timedelta(hours=k), ch, k) for k, (c, ip, ch) in enumerate(rows)], "case_id long, ip long, ts timestamp_ntz, choice string, event_id long")
    got = {(r.case_id, r.choice): (r.margin, r.total, r.state) for r in votes.margins(df).withColumn("state", votes.state()).collect()}
    assert got == {(1, "join"): (3, 3, "resolved"), (2, "join"): (2, 2, "open"), (2, "keep"): (2, 2, "open"), (3, "join"): (1, 11, "undecided")}


def test_undo_in_batch_and_stream(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [(1, 7, 0, at(0), "join", 0), (1, 7, 0, at(5), "keep", 1), (2, 7, 0, at(6), "join", 2), (2, 7, 1, at(7), "join", 6), (2, 7, 0, at(12), "back", 7), (3, 8, 0, at(3), "keep", 3), (3, 8, 0, at(13), "join", 8), (9, 9, 0, at(300), "join", 4)]
    schema = "case_id long, ip long, session long, ts timestamp_ntz, choice string, event_id long"
    df = spark.createDataFrame(rows, schema)
    # a vote on another case, or of another session, takes nothing back; ten minutes after it is too late
    assert {r.event_id for r in votes.surviving(df).collect()} == {1, 6, 3, 8, 4}
    for k, part in enumerate((rows[:3], rows[3:7], rows[7:], [(5, 5, 0, at(900), "join", 5)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del k
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = stream_votes.surviving(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id for r in spark.read.parquet(out).collect()}
    assert got >= {1, 3, 6, 8} and not got & {0, 2, 7}


def test_rings():
    left = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    right = [(1, 0), (2, 0), (2, 1), (1, 1), (1, 0)]
    f = rings.features(left, right)
    assert len(f) == rings.FEATURES and f[:6] == pytest.approx([180, 180, 90, 90, 90, 90])
    assert rings.features(left, right[::-1]) == pytest.approx(f)
    assert rings.features(left, [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]) is None  # one common point
    assert rings.features(left[:-1], right) is None
    one, two, n = rings.common_run(left, right)
    assert n == 2 and one[:2] == two[:2]
    a, b = [(0, 0), (100, 0), (100, 1), (0, 1), (0, 0)], [(0, 0), (0, 1), (-100, 1), (-100, 0), (0, 0)]
    assert rings.features(a, b) is None  # both ratios are under the least


def test_simplify_and_snap(spark):
    rng = np.random.default_rng(2)
    lon, lat = np.cumsum(rng.normal(0, 1e-4, 40)), np.cumsum(rng.normal(0, 1e-4, 40))
    kept = cleaning.simplified(lon, lat, np.zeros(40, bool), 20.0)
    for a, b in zip(kept[:-1], kept[1:], strict=True):
        if b - a > 1:
            assert cleaning._off_track(lon, lat, a, b).max() <= 20.0
    square = cleaning.simplified(np.array([0, 1e-3, 2e-3, 2e-3, 0, 0]), np.array([0, 0, 0, 2e-3, 2e-3, 0]), np.zeros(6, bool), 1.0)
    assert list(square) == [0, 2, 3, 4, 5]
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 5.0, 0.2), (4, 5.0, 9.0)], "id long, x double, y double")
    ways = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 3), (2, 1, 4)], "way_id long, pos int, node_id long")
    got = cleaning.snap_to_ways(nodes, ways, 0.5, 2.0)
    assert [tuple(r) for r in got.collect()] == [(3, 1, 0, 5.0, 0.0)]
    spliced = cleaning.splice(ways, got).where("way_id = 1").orderBy("pos").collect()
    assert [r.node_id for r in spliced] == [1, 3, 2]
    merged = cleaning.merge_close_nodes(spark.createDataFrame([(1, 0.0, 0.0), (2, 0.1, 0.0), (3, 5.0, 0.0)], "id long, x double, y double"), ways, 0.5)
    assert [tuple(r) for r in merged.collect()] == [(2, 1)]


def test_paths(spark, tmp_path):
    assert paths.parse_path("M0,0 h10 v10 H0 z") == ("MLLLZ", [(0, 0), (10, 0), (10, 10), (0, 10)])
    assert paths.parse_path("m1 1 2 0 0 2")[1] == [(1, 1), (3, 1), (3, 3)]
    assert paths.parse_path("M0 0C0 1 1 1 1 0S2-1 2 0") == ("MCC", [(0, 0), (0, 1), (1, 1), (1, 0), (1, -1), (2, -1), (2, 0)])
    with pytest.raises(ValueError):
        paths.parse_path("M0 0 A1 1 0 0 0 2 2")
    content = b"1 0 0 rg 0 0 m 10 0 l 10 10 l h f 0 0 0 RG 0.75 w 1 2 3 4 re S n"
    pdf = b"%PDF-1.4\n1 0 obj <</Length 1>>\nstream\n" + zlib.compress(content) + b"\nendstream\nendobj\n"
    (tmp_path / "a.pdf").write_bytes(pdf)
    rows = paths.read_pdf_paths(spark, str(tmp_path / "a.pdf")).orderBy("seq").collect()
    assert [r.d for r in rows] == ["M 0,0 L 10,0 L 10,10 Z", "M 1,2 L 4,2 L 4,6 L 1,6 Z"]
    assert rows[0].style.startswith("fill:#ff0000") and "stroke-width:0.75" in rows[1].style


def test_sources(spark, tmp_path):
    doc = "<osm><node id='1' lat='1.5' lon='2.5'/><node id='2' lat='0' lon='0'><tag k='a' v='x &amp; y'/></node><way id='5'><nd ref='1'/><nd ref='2'/><nd ref='9'/><tag k='building' v='yes'/></way></osm>"
    (tmp_path / "a.osm").write_text(doc)
    t = osm.read_osm(spark, str(tmp_path / "a.osm"))
    assert {(r.id, r.lat, r.tags.get("a")) for r in t.nodes.collect()} == {(1, 1.5, None), (2, 0.0, "x & y")}
    assert [list(r.nds) for r in t.ways.collect()] == [[1, 2, 9]]
    assert [r.id for r in osm.missing_nodes(t.ways, t.nodes).collect()] == [5]
    line = "010" + "081" + "1234" + "K" + "RUE " + "DU PORT".ljust(26)
    line = line.ljust(73) + " " + " " * 34 + "1"
    (tmp_path / "r.txt").write_text(line + "\n")
    row = fixed_width.read_register(spark, str(tmp_path / "r.txt"), "010081").first()
    assert (row.insee, row.code, row.nature, row.label, row.cancelled, row.is_street) == ("01081", "1234", "RUE", "DU PORT", False, True)
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[{"layer":"batiment","properties":{"OBJECT_RID":"Objet_12","DUR":"2","TEX1":"b","TEX":" a ","CREAT_DATE":"20130215"},"geometry":{"type":"Polygon","coordinates":[[[0,0]]]}}]}')
    row = json_layers.layer(json_layers.read_features(spark, str(tmp_path / "f.json")), "batiment").first()
    assert (row.object_rid, row.dur, row.tex, str(row.creat_date)) == (12, 2, ["a", "b"], "2013-02-15")
    with pytest.raises(ValueError):
        json_layers.layer(json_layers.read_features(spark, str(tmp_path / "f.json")), "other")


def test_polygons_to_ways(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    hole = [(0.5, 0.2), (0.6, 0.2), (0.6, 0.3), (0.5, 0.2)]
    df = spark.createDataFrame([(1, [ring, hole]), (2, [ring])], "id long, rings array<array<struct<x:double,y:double>>>")
    nodes, ways, relations = osm.polygons_to_ways(df)
    assert nodes.count() == 6 and ways.count() == 3
    assert [[m.role for m in r.members] for r in relations.collect()] == [["outer", "inner"]]


def test_parcels(spark):
    text = ["©2012 Ministère", "Références de la parcelle 000 A 12", "Adresse", "1 à 3 RUE X", "75001 VILLE", "Adresse", "LE BOURG", "Références de la parcelle 045 B", "Adresse", "9 RUE Y"]
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(text)], "doc string, line_no int, line string")
    got = {r.fid: list(r.addresses) for r in parcels.parcel_addresses(lines, "12345").collect()}
    assert got == {"123450000A0012": ["1 RUE X", "3 RUE X", "LE BOURG"], "123450450B0000": ["9 RUE Y"]}
    claimed = parcels.claims(spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"])], "fid string, addresses array<string>"))
    assert {r.address: r.n for r in claimed.collect()} == {"x": 2, "y": 1}


def test_kmeans_names_every_part(spark):
    rows = [(i, float(i % 3 * 100 + i / 100), 0.0) for i in range(150)]
    got = classify.kmeans(spark.createDataFrame(rows, "id long, x double, y double"), ["x", "y"], 50).collect()
    assert len(got) == 150 and len({r.part for r in got}) == 3 and all(r.file.isdigit() for r in got)


def test_library_does_not_import_the_training_data_subpackage():
    from pathlib import Path

    import terrafuse

    root = Path(terrafuse.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "terrafuse.llm" not in path.read_text()


def test_numbers_on_shared_sides(spark):
    square = lambda i, x: (i, [(x, 0.0), (x + 10, 0.0), (x + 10, 10.0), (x, 10.0), (x, 0.0)])
    rings_ = spark.createDataFrame([square(1, 0.0), square(2, 10.0)], "id long, ring array<struct<x:double,y:double>>")
    rows = [(1, 5.0, -1.0, 0.0), (2, 10.05, 5.0, 0.0), (3, 5.0, 3.0, 0.0), (4, 5.0, -3.0, 0.0), (5, 5.0, -0.5, 0.1), (6, 5.0, -0.5, 1.2)]
    got = {r.id: (round(r.x, 6), round(r.y, 6), list(r.ways)) for r in buildings.snap_numbers(spark.createDataFrame(rows, "id long, x double, y double, angle double"), rings_).collect()}
    assert got[1] == (5.0, 0.0, [1]) and got[2] == (10.0, 5.0, [1, 2])
    assert 3 not in got and 4 not in got and 6 not in got
    assert got[5][1] == 0.0 and got[5][0] == pytest.approx(5 - 0.5 * math.tan(0.1))


def test_split_buildings_found_in_a_whole(spark):
    ring = lambda x0, x1: [(x0, 0.0), (x1, 0.0), (x1, 4.0), (x0, 4.0), (x0, 0.0)]
    schema = "id long, ring array<struct<x:double,y:double>>"
    parts = spark.createDataFrame([(1, ring(0.0, 5.0)), (2, ring(5.0, 10.0)), (3, ring(10.0, 12.0))], schema)
    got = [(r.whole, list(r.parts), r.joined) for r in buildings.covered_by(parts, spark.createDataFrame([(9, ring(0.0, 10.0))], schema), 4.0, 0.01).collect()]
    assert got == [(9, [1, 2], True)]


def test_joined_ring(spark):
    p = lambda *xy: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])
    got = one(spark, buildings.joined_ring(p((1, 1), (0, 1), (0, 0), (1, 0)), p((1, 0), (2, 0), (2, 1), (1, 1))))
    assert [(q["x"], q["y"]) for q in got] == [(1, 1), (0, 1), (0, 0), (1, 0), (2, 0), (2, 1), (1, 1)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = buildings.insert_absent(old, spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "k long, v string"), "k")
    assert sorted(tuple(r) for r in new.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    done, lost = buildings.update_by_key(old, spark.createDataFrame([(2, None), (7, "z")], "k long, v string"), ["k"], "v")
    assert sorted(tuple(r) for r in done.collect()) == [(1, "a"), (2, None)] and [r.k for r in lost.collect()] == [7]


def test_glyphs(spark):
    shape = np.array([(0, 0), (2, 0), (2, 1), (0.5, 2)])
    bar = np.array([(0, 0), (1, 0), (1, 3), (0, 3)])

    def moved(points, angle, scale, shift):
        turn = np.array([[math.cos(angle), math.sin(angle)], [-math.sin(angle), math.cos(angle)]])
        return [tuple(map(float, p)) for p in points @ turn * scale + shift]

    schema = "commands string, points array<struct<x:double,y:double>>"
    library = spark.createDataFrame([("A", "MLLL", moved(shape, 0, 1, 0)), ("I", "MLLL", moved(bar, 0, 1, 0))], "value string, " + schema)
    rows = [(1, "MLLL", moved(shape, 0.4, 3, 7)), (2, "MLLL", moved(bar, -2.0, 0.5, -3)), (3, "MLLL", moved(bar * [3, 1], 0, 1, 0)), (4, "MLL", moved(bar[:3], 0, 1, 0))]
    got = {r.id: r for r in glyphs.match_glyphs(spark.createDataFrame(rows, "id long, " + schema), library).collect()}
    assert [got[i].value for i in (1, 2, 3, 4)] == ["A", "I", "???", "???"]
    assert got[1].angle == pytest.approx(0.4) and got[2].angle == pytest.approx(-2.0)
    line = spark.createDataFrame([(1, 0, "R", 0.0, 1.0), (1, 1, "U", 1.1, 2.1), (1, 2, "X", 4.0, 5.0), (1, 3, "???", 5.1, 6.1)], "line int, pos int, value string, low double, high double")
    assert glyphs.words(line, "line", "pos").first().text == "RU X"


def test_cleaning_job(spark):
    degree = 111194.92664455873
    # two squares side by side, drawn apart by less than the merging distance, with a needless node on one side
    left = [(0, 0), (10, 0), (10, 10), (0, 10)]
    right = [(10.1, 0), (20, 0), (20, 5), (20, 10), (10.1, 10)]
    rows = [(i, x / degree, y / degree, float(x), float(y)) for i, (x, y) in enumerate([*left, *right])]
    ways = [(1, p, n) for p, n in enumerate([0, 1, 2, 3, 0])] + [(2, p, n) for p, n in enumerate([4, 5, 6, 7, 8, 4])]
    nodes, out = jobs.clean(spark.createDataFrame(rows, "id long, lon double, lat double, x double, y double"), spark.createDataFrame(ways, "way_id long, pos int, node_id long"))
    got = {w: [r.node_id for r in out.where(f"way_id = {w}").orderBy("pos").collect()] for w in (1, 2)}
    assert len(got[1]) == 5 and len(got[2]) == 5 and 6 not in got[2]
    assert len(set(got[1]) & set(got[2])) == 2
    assert nodes.count() == 7


def test_whole_cleaning(spark):
    degree = 111194.92664455873
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    inner = [(3, 3), (6, 3), (6, 6), (3, 6)]
    twin = [(0.05, 0), (10, 0.05), (10, 10.05), (0, 10)]
    rows = [(i, x / degree, y / degree, float(x), float(y)) for i, (x, y) in enumerate([*square, *inner, *twin, (20, 5)])]
    ways = [(1, p, n) for p, n in enumerate([0, 1, 2, 3, 0])] + [(2, p, n) for p, n in enumerate([4, 5, 6, 7, 4])] + [(3, p, n) for p, n in enumerate([9, 8, 11, 10, 9])]
    nodes, out, same = jobs.clean_all(spark.createDataFrame(rows, "id long, lon double, lat double, x double, y double"), spark.createDataFrame(ways, "way_id long, pos int, node_id long"))
    assert {r.way_id for r in out.collect()} == {1} and [tuple(r) for r in same.collect()] == [(3, 1)]
    assert nodes.count() == 4
    both = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "relation long, way_id long")
    _, out, _ = jobs.clean_all(spark.createDataFrame(rows, "id long, lon double, lat double, x double, y double"), spark.createDataFrame(ways, "way_id long, pos int, node_id long"), members=both)
    assert {r.way_id for r in out.collect()} == {1, 2}


def test_angles_at_the_joint_of_a_closed_way(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 1.0), (3, 9.0, -1.0), (4, 20.0, 0.0)], "id long, x double, y double")
    closed = [(1, p, n) for p, n in enumerate([1, 3, 2, 1])] + [(2, p, n) for p, n in enumerate([1, 2, 4])]
    got = {r.id: r.min_angle for r in cleaning.node_angles(nodes, spark.createDataFrame(closed, "way_id long, pos int, node_id long")).collect()}
    assert got[1] == pytest.approx(math.degrees(2 * math.atan(1 / 9))) and got[4] is None


def test_polygon_operators(spark):
    from terrafuse.operators import polygons as P

    point = "array<struct<x:double,y:double>>"
    ring = lambda *p: [(float(x), float(y)) for x, y in (*p, p[0])]
    cells = [(1, ring((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1))) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    (row,) = P.dissolve(spark.createDataFrame(cells, f"place long, ring {point}"), "place").collect()
    assert row.area == 8 and sorted(len(r) for r in row.rings) == [5, 5]
    shapes = [(1, ring((0, 0), (4, 0), (4, 4), (0, 4))), (2, ring((0, 0), (4, 4), (4, 0), (0, 4))), (3, ring((0, 0), (10, 0), (10, 10), (5.001, 10), (5, 10.02), (4.999, 10), (0, 10))), (4, ring((0, 0), (1, 0)))]
    got = {r.id: (len(r.parts), r.area, r.valid) for r in P.repair(spark.createDataFrame(shapes, f"id long, ring {point}"), 0.1).collect()}
    assert got[1] == (1, 16, True) and got[2] == (2, pytest.approx(8), False) and got[3][0] == 1 and got[4] == (0, 0, False)
    curve = P.flattened("MLCZ", np.array([(0, 0), (2, 0), (2, 1), (1, 2), (0, 2)], float), 4)
    assert len(curve) == 1 and len(curve[0]) == 7 and tuple(curve[0][0]) == tuple(curve[0][-1])
    with pytest.raises(ValueError, match="unknown"):
        P.flattened("MA", np.zeros((2, 2)))


def test_address_job(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    plots = spark.createDataFrame([(1, "p1", 0.0, 0.0, 20.0, 20.0), (2, "p2", 20.0, 0.0, 40.0, 20.0)], "id long, fid string, " + box)
    limits = spark.createDataFrame([(7, 0.2, 0.0, 20.0, 20.0)], "id long, " + box)
    said = spark.createDataFrame([("p1", ["6 RUE X", "LE BOURG"]), ("p2", ["8 RUE X", "10 RUE Y"])], "fid string, addresses array<string>")
    drawn = spark.createDataFrame([(1, "9", 5.0, 1.0), (2, "8", 60.0, 10.0), (3, "8", 41.0, 10.0), (4, "12", 5.0, 5.0)], "id long, num string, x double, y double")
    register = spark.createDataFrame([("Rue X", "c1"), ("Rue Y", "c2"), ("rue y", "c3")], "name string, code string")
    got = jobs.build_addresses(plots, limits, said, drawn, register, {})
    rows = {r.address: (r.how, r.x, r.fixme) for r in got.placed.collect()}
    assert rows == {"6 RUE X": ("drawn", 5.0, ""), "LE BOURG": ("parcel", 10.1, "place name"), "8 RUE X": ("drawn", 41.0, ""), "10 RUE Y": ("parcel", 30.0, "position")}
    assert {r.street: r.code for r in got.streets.collect()} == {"RUE X": "c1", "RUE Y": None}


def test_fusion_job(spark):
    box = "id long, x0 double, y0 double, x1 double, y1 double"
    base = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 50.0, 0.0, 60.0, 10.0)], box)
    current = spark.createDataFrame([(5, 0.5, 0.0, 10.5, 10.0)], box)
    tags = "id long, tags map<string,string>"
    classes, out = jobs.fuse(base, current, spark.createDataFrame([(1, {"building": "yes"}), (2, {})], tags), spark.createDataFrame([(5, {"name": "A", "building": "no", "source": "s"})], tags))
    assert {r.id: (r["class"], r.partner) for r in classes.collect()} == {1: ("Fusion", 5), 2: ("OK", None)}
    assert {r.id: r.tags for r in out.collect()} == {1: {"building": "yes", "name": "A"}, 2: {}}


def test_pbf(spark, tmp_path):
    def varint(n):
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    zigzag = lambda n: (n << 1) ^ (n >> 63)
    delta = lambda v: [zigzag(b - a) for a, b in zip([0, *v], v)]
    number = lambda k, n: varint(k << 3) + varint(n)
    text = lambda k, b: varint(k << 3 | 2) + varint(len(b)) + b
    pack = lambda k, v: text(k, b"".join(map(varint, v)))
    strings = text(1, b"".join(text(1, s) for s in (b"", b"building", b"yes", b"source", b"Cadastre", b"type", b"multipolygon", b"outer")))
    dense = text(2, pack(1, delta([5, 3, 9])) + pack(8, delta([480000000, -10, 7])) + pack(9, delta([20000000, 0, -1])) + pack(10, [1, 2, 0, 0, 0]))
    way = text(3, number(1, 70) + pack(2, [1, 3]) + pack(3, [2, 4]) + pack(8, delta([5, 3, 5])))
    loose = text(3, number(1, 71) + pack(8, delta([9, 3])))
    relation = text(4, number(1, 80) + pack(2, [5, 1]) + pack(3, [6, 2]) + pack(8, [7]) + pack(9, delta([71])) + pack(10, [1]))
    block = strings + text(2, dense + way + loose + relation)

    def blob(kind, data):
        body = number(2, len(data)) + text(3, zlib.compress(data))
        head = text(1, kind) + number(3, len(body))
        return len(head).to_bytes(4, "big") + head + body

    (tmp_path / "a.pbf").write_bytes(blob(b"OSMHeader", b"") + blob(b"OSMData", block))
    items = pbf.read_pbf(spark, str(tmp_path / "a.pbf"))
    got = {(r.kind, r.id): r for r in items.collect()}
    assert got["node", 5].lat == pytest.approx(48) and got["node", 5].lon == pytest.approx(2) and got["node", 5].tags == {"building": "yes"}
    assert got["node", 3].lat == pytest.approx(-1e-6) and got["way", 70].refs == [5, 3, 5] and got["relation", 80].types == ["way"]
    ways, nodes = pbf.registry_buildings(items)
    assert {r.id for r in ways.collect()} == {70, 71} and {r.id for r in nodes.collect()} == {5, 3, 9}


def test_multipolygons_of_a_document(spark, tmp_path):
    tag = "<tag k='type' v='multipolygon'/>"
    text = (
        "<osm><node id='1' lat='0' lon='0'/><node id='2' lat='0' lon='1'/><way id='5'><nd ref='1'/><nd ref='2'/></way>"
        f"<relation id='7'><member type='way' ref='5' role='outer'/><member type='way' ref='6' role='inner'/>{tag}</relation><relation id='8'><member type='way' ref='5' role=''/></relation>{{}}</osm>"
    )
    (tmp_path / "a.osm").write_text(text.format(""))
    got = osm.multipolygons(osm.read_osm(spark, str(tmp_path / "a.osm")))
    assert [(r.id, [m.ref for m in r.members]) for r in got.relations.collect()] == [(7, [5])]
    (tmp_path / "b.osm").write_text(text.format("<way id='9'><nd ref='1'/><nd ref='44'/></way>"))
    with pytest.raises(ValueError, match="no node 44"):
        osm.multipolygons(osm.read_osm(spark, str(tmp_path / "b.osm")))


def test_upright_documents(spark):
    from terrafuse.sources import glyph_files

    got = spark.createDataFrame([("<svg a='1'><g id='x'><path d='M0 0'/></g></svg>",)], "t string").select(glyph_files.upright(F.col("t")).alias("t")).first().t
    assert got == "<svg a='1'><g transform=\"scale(1,-1)\"><path d='M0 0'/></g></svg>"
