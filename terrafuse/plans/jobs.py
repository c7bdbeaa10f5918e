"""Whole jobs made of the operators: cleaning a layer, fusing two, building addresses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafuse.functions.text import house_number, normalize_street
from terrafuse.operators import buildings, cleaning, graph, names, parcels, spatial
from terrafuse.plans.cut import cut


def clean(nodes: DataFrame, way_nodes: DataFrame, merge: float = 0.2, join: float = 0.2, threshold: float = 0.1, size: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lon, lat, x, y in metres) and way_nodes after merging close nodes, snapping to ways, and simplifying.

    merge and join are metres, threshold is the bend in metres under which a node goes; size is the grid's cell.
    Snapped nodes move onto the way that takes them in. Each stage is checkpointed, as the next reads it several times.
    """
    mapping = cut(cleaning.merge_close_nodes(nodes.select("id", "x", "y"), way_nodes, merge))
    ways = cut(cleaning.replace_nodes(way_nodes, mapping))
    left = nodes.join(mapping.select(F.col("old").alias("id")), "id", "left_anti")
    snapped = cut(cleaning.snap_to_ways(left.select("id", "x", "y"), ways, join, size))
    ways = cut(cleaning.splice(ways, snapped))
    moved = snapped.select("id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    rows = left.join(moved, "id", "left")
    # metres to degrees at each node's own scale: the move is at most `join` long
    shift = lambda c, k: F.coalesce(F.col(f"_{c}") - F.col(c), F.lit(0.0)) / k
    degree = 111194.92664455873
    rows = rows.withColumn("lon", F.col("lon") + shift("x", degree * F.cos(F.radians("lat")))).withColumn("lat", F.col("lat") + shift("y", F.lit(degree)))
    rows = cut(rows.withColumn("x", F.coalesce("_x", "x")).withColumn("y", F.coalesce("_y", "y")).drop("_x", "_y"))
    return rows, cleaning.simplify_ways(rows.select("id", "lon", "lat"), ways, threshold)


def clean_all(nodes: DataFrame, way_nodes: DataFrame, merge: float = 0.2, join: float = 0.2, threshold: float = 0.1, size: float = 8.0, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and way_nodes after the whole cleaning, and (old, new) for the ways that stand for identical ones.

    In order: nodes that repeat in a way and close nodes are merged, ways simplified, nodes joined to ways, and nodes merged again within the
    threshold; ways that lie inside another one go, unless both are of one relation (members: relation, way_id), and of identical ways
    the first stays. Each stage is checkpointed, as the next reads it several times.
    """
    flat = lambda df: df.select("id", "x", "y")
    mapping = cut(cleaning.merge_close_nodes(flat(nodes), way_nodes, merge))
    ways = cut(cleaning.replace_nodes(way_nodes, mapping))
    left = nodes.join(mapping.select(F.col("old").alias("id")), "id", "left_anti")
    ways = cut(cleaning.simplify_ways(left.select("id", "lon", "lat"), ways, threshold))
    left = cut(left.join(ways.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi"))
    ways = cut(cleaning.splice(ways, cut(cleaning.snap_to_ways(flat(left), ways, join, size))))
    mapping = cut(cleaning.merge_close_nodes(flat(left), ways, threshold))
    ways = cut(cleaning.replace_nodes(ways, mapping))
    left = cut(left.join(mapping.select(F.col("old").alias("id")), "id", "left_anti"))
    inside = cleaning.inside_ways(cleaning.rings_of(flat(left), ways), size)
    if members is not None:
        side = lambda c: members.select("relation", F.col("way_id").alias(c))
        inside = inside.join(side("inner").join(side("outer"), "relation").select("inner", "outer"), ["inner", "outer"], "left_anti")
    ways = cut(ways.join(inside.select(F.col("inner").alias("way_id")).distinct(), "way_id", "left_anti"))
    same = cut(graph.identical_ways(graph.way_lists(ways)))
    ways = ways.join(same.select(F.col("old").alias("way_id")), "way_id", "left_anti")
    return left.join(ways.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi"), ways, same


def fuse(base: DataFrame, current: DataFrame, base_tags: DataFrame, current_tags: DataFrame, size: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """(id, class, partner) of a base layer's boxes against a current layer, and the base tags with the partners' imported."""
    classes = cut(spatial.overlap_classes(base, current, size))
    return classes, buildings.import_tags(classes.where("partner is not null").select("id", "partner"), base_tags, current_tags)


@dataclass
class Addresses:
    """Placed numbers (fid, address, number, street, x, y, how, fixme), and addresses that no drawn number was found for."""

    placed: DataFrame
    streets: DataFrame


def build_addresses(parcel_boxes: DataFrame, limits: DataFrame, addresses: DataFrame, drawn: DataFrame, register: DataFrame, types: dict[str, str], size: float = 50.0) -> Addresses:
    """Entry point A: parcels (id, fid, x0, y0, x1, y1), limits (id, x0..y1), addresses (fid, addresses), drawn numbers (id, num, x, y), register (name, code).

    A parcel takes the limit that fits it best, else its own box, which is searched from the ladder's step for unknown limits on. Drawn numbers go to the parcels that
    claim an address of their number, at the first step of the distance ladder, one to one; an address
    without a drawn number is placed in the middle of its parcel. Streets get the register's code where only one has their name.
    """
    found = spatial.best_limits(parcel_boxes.select("id", "x0", "y0", "x1", "y1"), limits, size)
    shape = limits.select(F.col("id").alias("limit"), *[F.col(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")])
    boxes = parcel_boxes.join(found, "id").join(shape, "limit", "left").select("fid", F.col("limit").isNotNull().alias("limited"), *[F.coalesce(f"l{c}", c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    number, suffix, street = house_number(F.col("address"))
    wanted = parcels.attach(parcel_boxes.select("fid"), addresses).select("fid", F.explode("addresses").alias("address"))
    wanted = wanted.select("fid", "address", F.concat(number, suffix).alias("num"), street.alias("street")).withColumn("a", F.xxhash64("fid", "address"))
    wanted = cut(wanted.join(boxes, "fid"))
    # "6" and "9" look alike when they are turned
    key = lambda c: F.when(F.col(c).isin("6", "9"), "6/9").otherwise(F.col(c))
    boxes = wanted.where("num <> ''").select(key("num").alias("key"), F.col("a").alias("id"), "x0", "y0", "x1", "y1", "limited")
    marks = drawn.where("num is not null").select(key("num").alias("key"), "id", "x", "y")
    taken = spatial.climbed(marks, boxes, ["key"], point_first=False).select(F.col("box").alias("a"), F.col("point").alias("b"), "step")
    placed = wanted.join(taken, "a", "left").join(drawn.select(F.col("id").alias("b"), F.col("x").alias("dx"), F.col("y").alias("dy")), "b", "left")
    how = F.when(F.col("b").isNotNull(), "drawn").otherwise("parcel")
    off = lambda d, low, high: F.greatest(F.col(low) - F.col(d), F.lit(0.0), F.col(d) - F.col(high))
    away = F.sqrt(F.pow(off("dx", "x0", "x1"), 2) + F.pow(off("dy", "y0", "y1"), 2))
    fixme = F.array_compact(F.array(F.when(F.col("b").isNull() & (F.col("num") != ""), "position"), F.when(away > 10, "check the parcel"), F.when(F.col("num") == "", "place name")))
    placed = placed.select(
        "fid", "address", F.col("num").alias("number"), "street", F.coalesce("dx", (F.col("x0") + F.col("x1")) / 2).alias("x"), F.coalesce("dy", (F.col("y0") + F.col("y1")) / 2).alias("y"),
        how.alias("how"), F.array_join(F.reverse(fixme), " et ").alias("fixme"),
    )
    codes = names.unambiguous(register.select(normalize_street(F.col("name"), types).alias("normal"), "code"), "normal", "code")
    streets = placed.where("street <> '' and number <> ''").groupBy("street").agg(F.count("*").alias("numbers"))
    streets = streets.withColumn("normal", normalize_street(F.col("street"), types)).join(codes, "normal", "left").select("street", "numbers", "code")
    return Addresses(placed, streets)
