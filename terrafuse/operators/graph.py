"""Ways and nodes as a graph: adjacency, components, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafuse.functions.geometry import canonical_ring
from terrafuse.operators.tiles import spread
from terrafuse.plans.cut import cut


def touching_ways(way_nodes: DataFrame, same: str | None = None) -> DataFrame:
    """(way1, way2, common) for ways that share nodes, way1 < way2, with the number of common nodes; only of ways equal in a column, if it is given."""
    keys = ["node_id"] if same is None else ["node_id", same]
    a = way_nodes.select(F.col("way_id").alias("way1"), *keys).distinct()
    b = way_nodes.select(F.col("way_id").alias("way2"), *keys).distinct()
    pairs = spread(a, *keys).join(spread(b, *keys), keys).where("way1 < way2").select("way1", "way2")
    return spread(pairs, "way1", "way2").groupBy("way1", "way2").agg(F.count("*").alias("common"))


def node_degrees(way_nodes: DataFrame) -> DataFrame:
    """Ways of each node."""
    return way_nodes.groupBy("node_id").agg(F.countDistinct("way_id").alias("degree"))


def cyclic_neighbours(way_nodes: DataFrame) -> DataFrame:
    """The node before and after each node of a closed way, around the end."""
    w = Window.partitionBy("way_id").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("node_id").over(w), F.last("node_id").over(whole))
    after = F.coalesce(F.lead("node_id").over(w), F.first("node_id").over(whole))
    return way_nodes.select("way_id", "pos", "node_id", before.alias("before"), after.alias("after"))


def segments(way_nodes: DataFrame) -> DataFrame:
    """(way_id, pos, a, b) for consecutive nodes."""
    w = Window.partitionBy("way_id").orderBy("pos")
    return way_nodes.select("way_id", "pos", F.col("node_id").alias("a"), F.lead("node_id").over(w).alias("b")).where("b is not null")


def way_lists(way_nodes: DataFrame) -> DataFrame:
    """way_id, nds in order."""
    rows = way_nodes.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("l"))
    return rows.select("way_id", F.transform("l", lambda x: x["node_id"]).alias("nds"))


def identical_rings(ways: DataFrame) -> DataFrame:
    """First way of each ring, however it is rotated or directed, with the number of its copies: ring, way_id, n."""
    rows = ways.select("way_id", canonical_ring(F.col("nds")).alias("ring"))
    return rows.groupBy("ring").agg(F.min("way_id").alias("way_id"), F.count("*").alias("n"))


def identical_ways(ways: DataFrame) -> DataFrame:
    """(old, new): closed ways (way_id, nds) of the same ring, however rotated or directed, and open ones of the same line, and the first that stands for them."""
    closed = (F.size("nds") > 1) & (F.col("nds")[0] == F.element_at("nds", -1))
    line = F.when(F.array_min(F.array(F.col("nds"), F.reverse("nds"))) == F.col("nds"), F.col("nds")).otherwise(F.reverse("nds"))
    key = F.when(closed, canonical_ring(F.slice("nds", F.lit(1), F.size("nds") - 1))).otherwise(line)
    rows = ways.select("way_id", closed.alias("closed"), key.alias("key"))
    return rows.withColumn("new", F.min("way_id").over(Window.partitionBy("closed", "key"))).where("way_id <> new").select(F.col("way_id").alias("old"), "new")


def merged_tags(same: DataFrame, tags: DataFrame) -> DataFrame:
    """(way_id, tags) of ways (way_id, tags) after identical ones (old, new) are one: of a key's values the longest stays, ties to the one that sorts first."""
    rows = tags.join(same.withColumnRenamed("old", "way_id"), "way_id", "left").select(F.coalesce("new", "way_id").alias("way_id"), "tags")
    best = rows.select("way_id", F.explode("tags")).groupBy("way_id", "key").agg(F.min(F.struct((-F.length("value")).alias("n"), F.col("value").alias("v"))).alias("b"))
    lists = best.groupBy("way_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "b.v")))).alias("tags"))
    none = F.create_map().cast("map<string,string>")
    return rows.select("way_id").distinct().join(lists, "way_id", "left").select("way_id", F.coalesce("tags", none).alias("tags"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) over links (u, v): the smallest node that is reachable.

    Alternates large-star and small-star steps until the links are stars around their smallest node;
    each round is checkpointed. Null ends and self links make no link.
    """
    now, state = cut(edges.select("u", "v").where("u <> v").distinct()), None
    while True:  # some rounds more than the logarithm of the longest way
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            ends = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ends)
        state = seen
        both = spread(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "u")
        # written down, so that the join deals both of its sides anew and can split a node with very many links
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())


def levels(edges: DataFrame) -> DataFrame:
    """(node, level) of a dependency graph (node needs `needs`): longest way to a node without needs.

    Self dependencies are left out; a cycle is an error. Sorting by level and node is a topological order.
    """
    edges = cut(edges.select("node", "needs").where("node <> needs").distinct())
    nodes = edges.select("node").union(edges.select("needs")).distinct()
    left, done, level = edges, None, 0
    nodes = cut(nodes)
    while not nodes.isEmpty():
        ready = cut(nodes.join(left.select("node").distinct(), "node", "left_anti"))
        if ready.isEmpty():
            raise ValueError("the dependencies have a cycle")
        out = ready.select("node", F.lit(level).alias("level"))
        done = out if done is None else done.union(out)
        nodes = cut(nodes.join(ready, "node", "left_anti"))
        left = left.join(ready.select(F.col("node").alias("needs")), "needs", "left_anti").select("node", "needs")
        left = cut(left)
        level += 1
    return done if done is not None else nodes.select("node", F.lit(0).alias("level"))


def closure(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted items and all that they depend on, over members (item, member), to any depth."""
    found, new = cut(wanted.select("item").distinct()), wanted.select("item").distinct()
    while True:
        new = cut(members.join(new, "item", "left_semi").select(F.col("member").alias("item")).distinct().join(found, "item", "left_anti"))
        if new.isEmpty():
            return found
        found = cut(found.union(new))
