"""Set operations, upserts, numbering and windows over relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of tables of one schema, where an earlier table's row of a key hides the later ones'."""
    rows = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("_part", F.lit(i)))
    own = [c for c in rows.columns if c not in (key, "_part")]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*own), "_part").alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in own])


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in some order, which should be total."""
    own = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*own), F.struct(*order)).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in own])


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are expected and not found."""
    return expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def upsert_states(old: DataFrame, new: DataFrame, key: str, value: str, closed: Column) -> DataFrame:
    """What an import does to each key: unchanged, outofdate (changed while open), replaced (changed while closed), insert or kept."""
    a = old.select(key, F.col(value).alias("old"), closed.alias("_closed"))
    rows = a.join(new.select(key, F.col(value).alias("new"), F.lit(True).alias("_new")), key, "full")
    state = (
        F.when(F.col("_new").isNull(), "kept").when(F.col("_closed").isNull(), "insert").when(F.col("old").eqNullSafe(F.col("new")), "unchanged")
        .when(F.col("_closed"), "replaced").otherwise("outofdate")
    )
    return rows.select(key, "old", "new", state.alias("state"))


def replace_partitions(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Old with every partition that new has rows of replaced by them."""
    return old.join(new.select(by).distinct(), by, "left_anti").select(old.columns).unionByName(new)


def chunks(rows: DataFrame, key: str, size: int, by: str) -> DataFrame:
    """(by, key, chunk, name) in chunks of `size` in order of key within each `by`, names zero-padded to the chunks' number."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(key)) - 1
    last = F.ceil(F.count("*").over(Window.partitionBy(by)) / size).cast("int")
    rows = rows.select(by, key, F.floor(n / size).cast("int").alias("chunk"), last.alias("_last"))
    name = "lpad(cast(chunk AS string), length(cast(_last - 1 AS string)), '0')"
    return rows.select(by, key, "chunk", F.expr(name).alias("name"))


def changes(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before in their group."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_before", before).where(~F.col(value).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def sessions(rows: DataFrame, by: str, order: list[str], starts: Column) -> DataFrame:
    """Rows with the number of their run; a run starts where `starts` holds."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("run", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def carry_forward(rows: DataFrame, by: str, order: list[str], value: str, name: str) -> DataFrame:
    """The last value that is not null up to each row."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))
