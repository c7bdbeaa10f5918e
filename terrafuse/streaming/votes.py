"""Structured Streaming forms of the vote log (X12, X13, K08). Event time and watermarks are additions to the batch semantics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrafuse.operators.votes import BACK

#: A voter's new vote takes back the one before if it comes within so many minutes.
UNDO_MINUTES = 10


def tallies(votes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Running count, first and last time of each case's choices; for update or complete output."""
    rows = votes.withWatermark("ts", late) if votes.isStreaming else votes
    return rows.groupBy("case_id", "choice").agg(F.count("*").alias("nb"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def windowed(votes: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Votes and voters of each hour, final once the watermark has passed it; for append output."""
    rows = votes.withWatermark("ts", late) if votes.isStreaming else votes
    g = rows.groupBy(F.window("ts", size)).agg(F.count("*").alias("votes"), F.approx_count_distinct("ip").alias("voters"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "votes", "voters")


def _survivors(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A session's events on one case: the last one waits in the state until the undo time has passed or another event decides."""
    span, columns = pd.Timedelta(minutes=UNDO_MINUTES), ["ts", "choice", "event_id"]
    told = lambda x: x[x["choice"] != BACK].assign(case_id=key[0], ip=key[1], session=key[2])[["case_id", "ip", "session", *columns]]
    rows = [pd.DataFrame([state.get], columns=columns)] if state.exists else []
    if state.hasTimedOut:
        state.remove()
        yield told(rows[0])
        return
    rows += list(batches)
    votes = pd.concat(rows)[columns].sort_values(["ts", "event_id"])
    later = votes["ts"].shift(-1)
    final = votes[later.notna() & (later >= votes["ts"] + span)]
    last = votes.iloc[-1]
    state.update((last["ts"].to_pydatetime(), str(last["choice"]), int(last["event_id"])))
    due = int((last["ts"] + span).timestamp() * 1000) + 1
    state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
    if len(final):
        yield told(final)


def surviving(votes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of the votes that were not taken back; state is one event for each case, voter and session."""
    rows = votes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = "case_id long, ip long, session long, ts timestamp, choice string, event_id long"
    return rows.groupBy("case_id", "ip", "session").applyInPandasWithState(_survivors, out, "ts timestamp, choice string, event_id long", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_sink(path: str, key: str, value: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a table of the latest value of each key at `path`, one folder for each batch.

    Folders are named by batch, so a batch that runs again replaces its own output and counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(key).agg(F.max_by(F.struct(value, order), order).alias("r")).select(key, f"r.{value}", f"r.{order}")
        spark = batch.sparkSession
        if number:
            old = spark.read.parquet(f"{path}/{number - 1}")
            both = old.unionByName(latest)
            latest = both.groupBy(key).agg(F.max_by(F.struct(value, order), order).alias("r")).select(key, f"r.{value}", f"r.{order}")
        latest.write.mode("overwrite").parquet(f"{path}/{number}")

    return write
