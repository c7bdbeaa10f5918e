"""Tags of the registry's layers (P13-P18, F03, F07, A24): what a drawn or stored shape becomes on the map."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafuse.functions.geometry import direction_end
from terrafuse.operators import tiles as T
from terrafuse.operators.graph import connected_components
from terrafuse.plans.cut import cut

# Symbols of the registry's drawings, and the area in square metres up to which a basin is a pool.
CHURCH, CEMETERY, WATER, BASIN, POOL_AREA, LIGHT = 14, 51, 34, 65, 150, 2
# Tags by the style that a layer is drawn in.
STYLES = {
    "building": {"building": "yes"}, "light_building": {"building": "yes", "wall": "no"}, "water": {"natural": "water"},
    "riverbank": {"waterway": "riverbank"}, "limit": {"boundary": "administrative", "admin_level": "8"},
}


def tag_map(**tags: Column | str | None) -> Column:
    """A map of the tags that have a value; names may hold ':' by '__'."""
    pairs = [F.struct(F.lit(k.replace("__", ":")).alias("k"), (v if isinstance(v, Column) else F.lit(v)).cast("string").alias("v")) for k, v in tags.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.v.isNotNull()))


def primitive_tags(department: Column, rid: Column, updated: Column, texts: Column, source: str) -> Column:
    """Tags that every exported row has: its date, source and number, and the drawn texts as its name, if there are any."""
    name = F.trim(F.array_join(texts, " "))
    return tag_map(source__date=updated, source=source, ref__FR__cadastre=F.concat_ws(":", department, rid), name=F.when(F.size(texts) > 0, name))


def building_tags(church: Column, created: Column, kind: Column) -> Column:
    """A church holds a cross; light buildings have no walls."""
    return tag_map(building=F.when(church, "church").otherwise("yes"), religion=F.when(church, "christian"), start_date=created, wall=F.when(kind == LIGHT, "no"))


def water_tags(symbol: Column, area: Column) -> Column:
    """Open water and large basins are water, small basins private pools; null for other surfaces."""
    water = (symbol == WATER) | (area > POOL_AREA)
    tags = tag_map(area=area, natural=F.when(water, "water"), leisure=F.when(~water, "swimming_pool"), access=F.when(~water, "private"))
    return F.when(symbol.isin(WATER, BASIN), tags)


def other_tags(layer: Column, symbol: Column) -> Column:
    """Cemeteries among surfaces, places, roads and rivers; null for surfaces that are none of these."""
    empty = F.create_map().cast("map<string,string>")
    return (
        F.when(layer == "tsurf", F.when(symbol == CEMETERY, tag_map(landuse="cemetery"))).when(layer == "lieudit", tag_map(place=""))
        .when(layer == "zoncommuni", tag_map(highway="")).when(layer == "tronfluv", tag_map(waterway="riverbank")).when(layer.isin("tronroute", "voiep"), empty)
    )


def named_only(rows: DataFrame, text: str) -> DataFrame:
    """Drawn small names that are not mere numbers."""
    return rows.where(~F.col(text).rlike("^[0-9]*$"))


def style_tags(layer: Column) -> Column:
    """Tags of the layer that a path's style stands for."""
    out = F
    for name, tags in STYLES.items():
        out = out.when(layer == name, tag_map(**tags))
    return out


def number_nodes(numbers: DataFrame, source: str, fixme: str) -> DataFrame:
    """House numbers (id, num, x, y, angle) as nodes with tags, and the end of a direction mark for those that are turned."""
    degrees = F.round(F.degrees("angle")).cast("int")
    tags = tag_map(fixme=fixme, addr__housenumber=F.col("num"), source=source, angle=F.concat(degrees.cast("string"), F.lit("°")))
    end = F.when(degrees != 0, direction_end(F.col("x"), F.col("y"), F.col("angle") - F.lit(3.141592653589793 / 2), F.lit(1.0)))
    return numbers.select("id", "x", "y", tags.alias("tags"), end.alias("mark"))


def name_nodes(names: DataFrame, source: str) -> DataFrame:
    """Street names (id, name, x, y, angle) as nodes; single level letters are none. Marks are as long as the name."""
    degrees = F.round(F.degrees("angle")).cast("int")
    rows = names.where((F.length("name") > 1) | (degrees != 0))
    end = F.when(degrees != 0, direction_end(F.col("x"), F.col("y"), F.col("angle"), F.length("name")))
    return rows.select("id", "x", "y", tag_map(name=F.col("name"), source=source).alias("tags"), end.alias("mark"))


def merge_touching(shapes: DataFrame, key: str, size: float) -> DataFrame:
    """(id, first): shapes (id, ring, key) that a chain of touching shapes of the same key connects, by the smallest id of the chain.

    Tiles find the chains inside them, without looking at the pairs of one chain, and these are connected by the shapes that they share.
    """
    low, high = (lambda c, f=f: f(F.transform("ring", lambda p: p[c])) for f in (F.array_min, F.array_max))
    rows = cut(shapes.select("id", "ring", F.col(key).alias("k"), low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1")).where("k is not null"))
    kind = dict(shapes.dtypes)["id"]

    def linked(batch: pa.Table) -> pa.Table:
        ids = T.column(batch, "id")
        first = T.chains(T.Rings(batch["ring"]))
        rest = np.flatnonzero(first != np.arange(len(ids)))
        return pa.table({"u": ids[rest], "v": ids[first[rest]]})

    by = ["k", "cx", "cy"]
    links = T.spread(T.placed(rows, T.tile_size(rows.select(F.col("x0").alias("x"), F.col("y0").alias("y")), rows, 2 * T.ROWS)), *by).groupBy(*by).applyInArrow(linked, f"u {kind}, v {kind}")
    parts = connected_components(links)
    return shapes.select("id").join(parts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("first"))


def churches(rails: DataFrame) -> DataFrame:
    """(x, y) of the places where a church's cross is drawn: a line meets three others there, and nowhere else. rails is (id, ax, ay, bx, by)."""
    ends = rails.select("id", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    counts = ends.groupBy("p").agg(F.count("*").alias("n"))
    # of a line's two ends each meets n - 1 others; both together three, at one place
    seen = ends.join(counts, "p").groupBy("id").agg(F.sum(F.col("n") - 1).alias("meets"), F.count_if(F.col("n") > 1).alias("places"), F.max_by("p", "n").alias("p"))
    return seen.where("meets = 3 and places = 1").select("p.x", "p.y").distinct()


def inner_rings(rings: DataFrame, size: float) -> DataFrame:
    """(id, inner) of different city-limit rings (id, ring): a ring is inner if another one holds any of its points
    (those on a side may fall either way). Equal rings count once."""
    single = cut(rings.groupBy("ring").agg(F.min("id").alias("id")))
    low, high = (lambda c, f=f: f(F.transform("ring", lambda p: p[c])) for f in (F.array_min, F.array_max))
    holders = single.select("id", "ring", low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))
    points = single.select("id", F.explode(F.array_distinct("ring")).alias("p")).select("id", "p.x", "p.y")

    def run(p: pa.Table, r: pa.Table) -> pa.Table:
        ids = T.column(p, "id")
        held = T.any_held(T.column(p, "x"), T.column(p, "y"), ids, T.Rings(r["ring"]), T.column(r, "id"))
        return pa.table({"id": np.unique(ids[held])})

    held = T.by_tiles(points, holders, run, f"id {dict(single.dtypes)['id']}").distinct()
    return single.select("id").join(held.withColumn("inner", F.lit(True)), "id", "left").select("id", F.coalesce("inner", F.lit(False)).alias("inner"))


def holding(rings: DataFrame, lines: DataFrame) -> DataFrame:
    """(id) of the rings (id, ring) that hold a line (x, y, u, v) from (x, y) to (u, v), nowhere on their edge; a ring is done with the first such line."""
    low, high = (lambda c, f=f: f(F.transform("ring", lambda p: p[c])) for f in (F.array_min, F.array_max))
    boxes = rings.select("id", "ring", low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))

    def run(p: pa.Table, r: pa.Table) -> pa.Table:
        x, y, u, v = (T.column(p, c) for c in ("x", "y", "u", "v"))
        ids, shape = T.column(r, "id"), T.Rings(r["ring"])
        side = T.Rings(pa.array([[{"x": a, "y": b}, {"x": c, "y": d}] for a, b, c, d in zip(x, y, u, v, strict=True)], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
        held = np.zeros(len(ids), bool)
        for i, j in T.pairs(x, y, shape.x0, shape.y0, shape.x1, shape.y1):
            ok = ~held[j] & (u[i] >= shape.x0[j]) & (u[i] <= shape.x1[j]) & (v[i] >= shape.y0[j]) & (v[i] <= shape.y1[j])
            i, j = i[ok], j[ok]
            _, one = np.unique(j, return_index=True)  # most rings need no second line
            for s in (one, np.setdiff1d(np.arange(len(j)), one)):
                s = s[~held[j[s]]]
                a, b = i[s], j[s]
                inside = shape.hold(b, x[a], y[a]) & shape.hold(b, u[a], v[a])
                a, b = a[inside], b[inside]
                held[b[~shape.meet(b, a, side)]] = True
        return pa.table({"id": ids[held]})

    return T.by_tiles(lines.select("x", "y", "u", "v"), boxes, run, f"id {dict(rings.dtypes)['id']}").distinct()
