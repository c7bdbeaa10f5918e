"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafuse.functions.core import let
from terrafuse.plans.cut import cut

__all__ = ["SPACES", "SPACE_CLASS", "cut", "fresh", "give_back", "hot_join", "let", "slices", "table", "tidy", "words_of"]

#: Characters between words: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Texts are worked on in slices of about this many bytes.
SLICE = 2 << 20
#: A key of more than one in so many rows is hot.
HOT = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+; empty for null or blank text."""
    stripped = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, SPACE_CLASS + "+"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `size` bytes together: what a worker holds does not depend on the rows of a batch."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = int(total[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def hot_join(rows: DataFrame, side: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows joined with side on key, where side has one row for each key and its column n counts the rows of that key.

    Keys of more than 1 / HOT of all rows are at most HOT, so their side is broadcast; what is left is dealt out by
    key, none of which is large. Both tables are read twice and should be written down. Null keys match nothing.
    """
    total = side.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT > total
    large, small = side.where(hot).drop(n), side.where(~hot).drop(n)
    return rows.join(F.broadcast(large), key).unionByName(rows.join(small, key))


def tidy(spark: SparkSession) -> None:
    """Let go of the shuffles and checkpoints of tables that are no longer used, which else stay on disk until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Return freed memory to the system at the end of a task: a Python worker that is used again would keep the task's peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
