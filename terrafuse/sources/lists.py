"""Lists, codes and small texts around the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forms of the web form's parameters.
PARAMETERS = {
    "dep": r"^([09][0-9][0-9AB])?$", "ville": r"^[A-Z0-9][A-Z0-9][0-9][0-9][0-9][-a-zA-Z0-9_ '().]*$", "type": r"(^bati$)|(^adresses$)",
    "bis": r"(^true$)|(^false$)", "bbox": r"^[-0-9.,]*$", "force": r"^(true)|(false)*$",
}
# The map servers, the one for the mainland first.
MAINLAND_SERVER, WORLD_SERVER = "https://overpass.openstreetmap.fr/api/interpreter?", "https://overpass-api.de/api/interpreter?"
AREA_BASE = 3600000000


def list_fields(line: Column, fields: int = 3) -> tuple[Column, Column]:
    """Code and name of a list's line: dep code "name" (three fields) or code "name" (two)."""
    parts = F.split(line, " ", fields)
    return F.trim(F.get(parts, F.lit(fields - 2))), F.trim(F.replace(F.get(parts, F.lit(fields - 1)), F.lit('"'), F.lit("")))


def list_line(department: Column, code: Column, name: Column) -> Column:
    """The line of a commune in a department's list."""
    return F.concat_ws(" ", department, code, F.concat(F.lit('"'), name, F.lit('"')))


def commune_name(label: Column) -> tuple[Column, Column]:
    """Name and post code of "NAME (12345)", parted at the last parenthesis; a label without one is a name without its last sign, and no code."""
    inside = F.regexp_extract(label, r"(?s)^.*\((.*)$", 1)
    name = F.regexp_extract(label, r"(?s)^(.*).\([^(]*$", 1)
    return F.when(F.contains(label, F.lit("(")), name), F.when(F.contains(label, F.lit("(")), F.substring(inside, F.lit(1), F.greatest(F.length(inside) - 1, F.lit(0))))


def register_department(code: Column) -> Column:
    """The street register's code of a department."""
    return F.when(F.substring(code, 1, 1) == "0", F.concat(F.substring(code, 2, 2), F.lit("0"))).otherwise(F.substring(code, 1, 3))


def padded_department(code: Column) -> Column:
    """A department of two or three signs with leading zeros; null for other texts."""
    out = F.lpad(F.trim(code), 3, "0")
    return F.when(F.length(F.trim(code)).between(1, 3) & out.rlike("^[0-9][0-9][0-9AB]$"), out)


def padded_commune(code: Column) -> Column:
    """A commune's number of up to three digits with leading zeros; null for other texts."""
    return F.when(F.trim(code).rlike("^[0-9]{1,3}$"), F.lpad(F.trim(code), 3, "0"))


def of_commune(parcel: Column, commune: Column) -> Column:
    """true for a parcel id that begins with the commune's number."""
    return F.startswith(parcel, commune)


def valid(name: str, value: Column) -> Column:
    """true for a value that a web parameter may have."""
    return value.rlike(PARAMETERS[name])


def vector_communes(rows: DataFrame) -> DataFrame:
    """communes whose plans are drawn as vectors."""
    return rows.where(F.col("format") == "VECT")


def registry_date(text: Column) -> Column:
    """The day of yyyymmdd; null for other texts."""
    return F.to_date(F.when(text.rlike("^[0-9]{8}$"), text), "yyyyMMdd")


def parcel_addresses(page: Column) -> Column:
    """The addresses of a parcel's page: what stands in bold before "Adresse de la parcelle", a line for each row of it."""
    groups = F.slice(F.split(page, "<strong>"), F.lit(1), F.size(F.split(page, "<strong>")))
    ends = r"(?s)^(.*?)</strong>\s*Adresse de la parcelle"
    body = lambda g: F.array_join(F.transform(F.split(F.regexp_extract(g, ends, 1), "<br>"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "\n")
    return F.transform(F.filter(groups, lambda g: g.rlike(r"</strong>\s*Adresse de la parcelle")), body)


def way_query(relation: Column, kind: str, condition: str = "", nodes: bool = False) -> Column:
    """The map query for ways of a tag in a commune."""
    return F.format_string(f'node(area:%d);way(bn);(way._["{kind}"]{condition};{"node(w);" if nodes else ""});out meta;', relation.cast("long") + AREA_BASE)


def multipolygon_query(relation: Column, kind: str, condition: str = "", nodes: bool = False) -> Column:
    """The map query for the ways of a commune's multipolygons."""
    return F.format_string(f'rel(area:%d)[type=multipolygon]["{kind}"]{condition};way(r);{"(._;>;);" if nodes else ""}out meta;', relation.cast("long") + AREA_BASE)


def server(department: Column) -> Column:
    """The server that knows a department."""
    return F.when(F.startswith(department, F.lit("0")), MAINLAND_SERVER).otherwise(WORLD_SERVER)


def cached_answer(ways: DataFrame, way_nodes: DataFrame, kind: str, area: DataFrame) -> DataFrame:
    """What way_query() answers from tables: ways (way_id, tags) of the tag with a node (node_id) in the area."""
    inside = way_nodes.join(area.select("node_id"), "node_id", "left_semi").select("way_id").distinct()
    return ways.where(F.map_contains_key("tags", kind)).join(inside, "way_id", "left_semi")


def expired(last: Column, now: Column, seconds: int) -> Column:
    """True for a session, lock or cached file that was last touched more than so many seconds ago."""
    return F.unix_timestamp(now) - F.unix_timestamp(last) > seconds
