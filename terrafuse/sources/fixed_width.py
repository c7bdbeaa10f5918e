"""The street register, a file of fixed-width lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Record types that are streets.
STREET_TYPES = ("1", "4", "5")


def parse_register(lines: DataFrame, column: str = "value") -> DataFrame:
    """insee, id, key, nature, label, cancelled, type, is_street and code of each line; other columns stay."""
    at = lambda first, size: F.substring(column, first + 1, size)  # noqa: E731  offsets count from 0
    out = lines.withColumns(
        {
            "insee": F.concat(at(0, 2), at(3, 3)), "code": at(6, 4), "key": at(10, 1), "nature": F.rtrim(at(11, 4)), "label": F.rtrim(at(15, 26)),
            "cancelled": F.coalesce(F.trim(at(73, 1)) != "", F.lit(False)), "type": F.trim(at(108, 1)), "is_street": at(108, 1).isin(*STREET_TYPES),
        }
    )
    return out.drop(column)


def read_register(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """Street records of a register file; prefix (department and commune) is filtered before anything is cut out."""
    lines = spark.read.text(path)
    if prefix:
        lines = lines.where(F.startswith("value", F.lit(prefix)))
    return parse_register(lines).where("type <> ''")


def read_abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """long_name, abbrev of a tab-separated file."""
    return spark.read.csv(path, sep="\t", schema="long_name string, abbrev string")


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """osm_id, insee of a comma-separated file."""
    return spark.read.csv(path, schema="osm_id long, insee string")


def read_bbox(spark: SparkSession, path: str) -> DataFrame:
    """Path, proj, x1, y1, x2, y2 of side files that hold `PROJ:x1,y1,x2,y2`."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.trim("value").alias("v"))
    numbers = F.split(F.substring_index("v", ":", -1), ",")
    return rows.select("path", F.regexp_extract("v", "^(.*):[^:]*$", 1).alias("proj"), *[numbers[i].cast("double").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
