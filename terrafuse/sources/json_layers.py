"""GeoJSON layers and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = """type string, features array<struct<layer:string, properties:map<string,string>,
  geometry:struct<type:string, coordinates:string>>>"""


def properties(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """rows with the fields of a JSON column beside the others; unreadable texts give nulls."""
    return rows.withColumn(column, F.from_json(column, schema)).select(*[c for c in rows.columns if c != column], f"{column}.*")


def tex_values(props: Column) -> Column:
    """The values of TEX, TEX1, TEX2.. in numeric order, trimmed, without empty ones."""
    tex = F.filter(F.map_entries(props), lambda e: e["key"].rlike("^TEX[0-9]*$"))
    numbered = F.transform(tex, lambda e: F.struct(F.coalesce(F.regexp_extract(e["key"], "([0-9]+)$", 1).try_cast("int"), F.lit(0)).alias("n"), F.trim(e["value"]).alias("v")))
    return F.filter(F.transform(F.array_sort(numbered), lambda x: x["v"]), lambda v: v != "")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """layer, properties and geometry (its coordinates as text) of every feature of GeoJSON files."""
    rows = spark.read.schema(FEATURES).json(path, multiLine=True)
    return rows.select(F.explode("features").alias("f")).select("f.layer", "f.properties", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def layer(features: DataFrame, name: str) -> DataFrame:
    """One layer with its typed columns and defaults."""
    p = lambda k: F.col("properties")[k]
    number = lambda k, default: F.coalesce(p(k).try_cast("int"), F.lit(default))
    own = {
        "batiment": {"dur": number("DUR", 1)}, "tsurf": {"sym": number("SYM", 0)}, "tline": {"sym": number("SYM", 0)},
        "parcelle": {"idu": F.coalesce(p("IDU"), F.lit("")), "supf": number("SUPF", 0), "indp": number("INDP", 0), "coar": p("COAR")},
        "commune": {"idu": number("IDU", 0)}, "numvoie": {"parcelle_idu": F.coalesce(p("PARCELLE_IDU"), F.lit(""))}, "tronroute": {"rcad": F.coalesce(p("RCAD"), F.lit(""))},
        "tronfluv": {}, "lieudit": {}, "voiep": {}, "zoncommuni": {},
    }
    if name not in own:
        raise ValueError(f"unknown layer {name}")
    rows = features.where(F.col("layer") == name)
    date = lambda k: F.try_to_date(p(k), "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(p(k), "yyyyMMdd")
    common = {"object_rid": F.regexp_extract(p("OBJECT_RID"), "Objet_([0-9]+)", 1).try_cast("int"), "creat_date": date("CREAT_DATE"), "update_date": date("UPDATE_DATE"), "tex": tex_values(F.col("properties"))}
    return rows.select(*[c.alias(n) for n, c in (common | own[name]).items()], "geometry_type", "coordinates")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """way1, way2 and their points from lines of `[{id, latlngs}, {id, latlngs}]` with the smaller id first."""
    rows = spark.read.text(path).select(F.from_json("value", "array<struct<id:bigint, latlngs:array<array<double>>>>").alias("p"))
    return rows.where("size(p) = 2 and p[0].id < p[1].id").select(F.expr("p[0].id way1"), F.expr("p[1].id way2"), F.expr("p[0].latlngs latlngs1"), F.expr("p[1].latlngs latlngs2"))
