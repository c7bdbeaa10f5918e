"""Parcels and the addresses printed for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafuse.functions.text import interval_numbers, postal_truncate

# How the lines of the printed form begin that carry nothing.
BOILERPLATE = (
    "Service de la Documentation Nationale du Cadastre",
    "82, rue du Maréchal Lyautey - 78103 Saint-Germain-en-Laye Cedex",
    "SIRET 16000001400011",
    "Informations sur la feuille éditée par internet le ",
    "©201",
)
REFERENCE = r"^Références de la parcelle (\S+) (\S+)(?: ([0-9]+))?\s*$"
#: The line that opens an address.
ADDRESS = "Adresse"


def parcel_addresses(lines: DataFrame, commune: str) -> DataFrame:
    """(fid, addresses) from the lines (doc, line_no, line) of printed parcel information.

    A reference has two or three parts; the number of one with two is 0.

    Where in the form a line stands is carried forward by windows over the document: its parcel, and
    the number of its address. Addresses are cut at the postal code, intervals are expanded, repeats go.
    """
    order = Window.partitionBy("doc").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    text = F.trim("line")
    empty = [F.startswith(text, F.lit(b)) for b in BOILERPLATE]
    rows = lines.where(~F.coalesce(reduce(lambda a, b: a | b, empty), F.lit(False)))
    ref = lambda g: F.regexp_extract(text, REFERENCE, g)
    padded = F.when(F.length(ref(2)) == 1, F.concat(F.lit("0"), ref(2))).otherwise(ref(2))
    fid = F.concat(F.lit(commune), ref(1), padded, F.lpad(F.when(ref(3) == "", "0").otherwise(ref(3)), 4, "0"))
    rows = rows.withColumn("marker", F.when(text.rlike(REFERENCE), fid)).withColumn("opens", (text == ADDRESS).cast("int"))
    rows = rows.withColumn("fid", F.last("marker", ignorenulls=True).over(upto)).where("fid is not null")
    within = Window.partitionBy("doc", "fid").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.sum("opens").over(within)).where((F.col("n") > 0) & (F.col("opens") == 0) & (text != "") & F.col("marker").isNull())
    joined = rows.groupBy("doc", "fid", "n").agg(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))).alias("l"))
    address = postal_truncate(F.array_join(F.transform("l", lambda x: x["t"]), "\n"))
    rows = joined.select("fid", address.alias("a")).where("a <> ''")
    numbers = F.transform(interval_numbers(F.col("a")), lambda n: F.concat(n.cast("string"), F.lit(" "), F.regexp_replace("a", "^[0-9]+ [àa] [0-9]+ *", "")))
    rows = rows.select("fid", F.explode(F.coalesce(numbers, F.array("a"))).alias("address")).distinct()
    return rows.groupBy("fid").agg(F.array_sort(F.collect_list("address")).alias("addresses"))


def attach(parcels: DataFrame, addresses: DataFrame) -> DataFrame:
    """Parcels with their addresses; an empty list where there are none."""
    return parcels.join(addresses, "fid", "left").withColumn("addresses", F.coalesce("addresses", F.array().cast("array<string>")))


def claims(parcels: DataFrame) -> DataFrame:
    """(address, fids, n): the parcels that claim each address."""
    rows = parcels.select("fid", F.explode("addresses").alias("address"))
    return rows.groupBy("address").agg(F.array_sort(F.collect_set("fid")).alias("fids"), F.countDistinct("fid").alias("n"))


def latest(parcels: DataFrame, seq: str = "file_seq") -> DataFrame:
    """One row of each fid, from the file that was read last."""
    own = [c for c in parcels.columns if c not in ("fid", seq)]
    return parcels.groupBy("fid").agg(F.max_by(F.struct(*own), seq).alias("r")).select("fid", *[F.col(f"r.{c}").alias(c) for c in own])
