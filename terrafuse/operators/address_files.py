"""The address job's results as files (J01, J34, P21, P22, X04, F04, K04): streets, ambiguous and orphan numbers, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafuse.functions.text import to_ascii

# First words that make a place's name that of a street, file names, and messages.
STREET_WORDS = ("rue", "impasse", "chemin", "passage", "route", "avenue", "boulevard")
AMBIGUOUS, ORPHANS, PLACES, ROADS = "_AMBIGUS_", "_ORPHELINS_", "lieux-dits", "lieux_ressemblants_noms_de_rues_-_NE_PAS_ENVOYER_SUR_OSM"
FROM_ADDRESSES = "à vérifier: nom créé automatiquement à partir des adresses du coin"
FAR = 10


def attach(parcels: DataFrame, addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parcels with the addresses of their fid, and the addresses whose parcel is not there."""
    return parcels.join(addresses, "fid", "left"), addresses.join(parcels.select("fid"), "fid", "left_anti")


def place_tags(tags: Column, new: Column) -> Column:
    """A new place whose name begins like a street's becomes a road to be checked."""
    first = F.lower(F.get(F.split(F.trim(tags["name"]), r"\s+"), F.lit(0)))
    road = F.map_concat(F.map_filter(tags, lambda k, v: ~k.isin("place", "highway", "fixme")), F.create_map(F.lit("highway"), F.lit("road"), F.lit("fixme"), F.lit(FROM_ADDRESSES)))
    return F.when(new & F.map_contains_key(tags, "place") & F.coalesce(first.isin(*STREET_WORDS), F.lit(False)), road).otherwise(tags)


def fixme(found: Column, parcel: Column, distance: Column, streets: Column) -> Column:
    """What is to be checked about a placed number; null if nothing is.

    Parts are: no drawn number, several streets, too far from the parcel. The last one turns the order of all.
    """
    parts = F.array_compact(F.array(
        F.when(~found, F.concat(F.lit("position à preciser, parcelle associée: n°"), parcel)),
        F.when(F.size(streets) > 1, F.concat(F.lit("choisir la bonne rue: "), F.array_join(streets, " ou "))),
        F.when(distance > FAR, F.concat(F.floor(distance).cast("string"), F.lit(" m de la parcelle n°"), parcel, F.lit(": vérifier la position et/ou la rue associée"))),
    ))
    ordered = F.when(distance > FAR, F.reverse(parts)).otherwise(parts)
    return F.when(F.size(parts) > 0, F.array_join(ordered, " et "))


def number_files(numbers: DataFrame, chunk: int) -> DataFrame:
    """(id, file) of new numbers (id, streets): its street's file, or a file of ambiguous or orphan ones, of `chunk` each.

    Chunks are numbered from 1 in the order of ids, with as many digits as the last one has.
    """
    kind = F.when(F.size("streets") == 1, to_ascii(F.col("streets")[0])).when(F.size("streets") > 1, AMBIGUOUS).otherwise(ORPHANS)
    rows = numbers.select("id", F.size("streets").alias("n"), kind.alias("kind"))
    streets = rows.where("n = 1").select("id", F.concat("kind", F.lit(".osm")).alias("file"))
    return streets.unionByName(chunked(rows.where("n <> 1").select("id", "kind"), chunk))


def chunked(rows: DataFrame, chunk: int) -> DataFrame:
    """(id, file) of rows (id, kind): files of `chunk` each; a kind that fits one file has no number."""
    at = (F.floor((F.row_number().over(Window.partitionBy("kind").orderBy("id")) - 1) / chunk) + 1).cast("string")
    last = F.ceil(F.count("*").over(Window.partitionBy("kind")) / chunk)
    name = F.when(last > 1, F.concat("kind", F.lpad(at, F.length(last.cast("string")), F.lit("0")))).otherwise(F.col("kind"))
    return rows.select("id", F.concat(name, F.lit(".osm")).alias("file"))


def place_files(nodes: DataFrame, chunk: int) -> DataFrame:
    """(id, file) of new nodes (id, tags): places by themselves, and what looks like streets apart."""
    kind = F.when(F.map_contains_key("tags", "place"), PLACES).when(F.map_contains_key("tags", "highway"), ROADS)
    return chunked(nodes.where("id < 0").select("id", kind.alias("kind")).where("kind is not null"), chunk)


def way_files(ways: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(way_id, file) of changed ways (way_id, nds) whose new nodes (id < 0) are all in one file, and (id) of the new nodes of ways that have several.

    A way is in one file or in none, as two versions of it would clash.
    """
    new = ways.select("way_id", F.explode("nds").alias("id")).where("id < 0").join(files, "id")
    counts = new.groupBy("way_id").agg(F.countDistinct("file").alias("n"), F.min("file").alias("file"))
    torn = new.join(counts.where("n > 1").select("way_id"), "way_id", "left_semi").select("id").distinct()
    return counts.where("n = 1").select("way_id", "file"), torn
