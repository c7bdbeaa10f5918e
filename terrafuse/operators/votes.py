"""Analytics of a vote log: ranking, margins, resolution, queues and undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A case is decided by so many votes of the first choice and such a margin, and given up from so many votes without it.
ENOUGH, MARGIN, UNDECIDED = 3, 3, 10
#: The choice that takes the last vote back and is none itself.
BACK = "back"


def ranked(votes: DataFrame) -> DataFrame:
    """case_id, choice, nb, first, last, rank; choices of a case with equal counts share a rank."""
    counts = votes.groupBy("case_id", "choice").agg(F.count("*").alias("nb"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return counts.withColumn("rank", F.rank().over(Window.partitionBy("case_id").orderBy(F.desc("nb"))))


def margins(votes: DataFrame) -> DataFrame:
    """case_id, choice, nb, margin, total of the first choices.

    Only choices ranked behind the first count against it: two first choices of a tie leave each other out.
    One window over the ranked choices stands for the self join.
    """
    rows = ranked(votes)
    others = F.sum(F.when(F.col("rank") > 1, F.col("nb"))).over(Window.partitionBy("case_id"))
    rows = rows.withColumn("others", F.coalesce(others, F.lit(0))).where("rank = 1")
    return rows.select("case_id", "choice", "nb", "last", (F.col("nb") - F.col("others")).alias("margin"), (F.col("nb") + F.col("others")).alias("total"))


def state() -> Column:
    """Resolved, undecided or open, from the columns of margins()."""
    done = (F.col("nb") >= ENOUGH) & (F.col("margin") >= MARGIN)
    return F.when(done, "resolved").when((F.col("margin") < MARGIN) & (F.col("total") >= UNDECIDED), "undecided").otherwise("open")


def statistics(votes: DataFrame) -> DataFrame:
    """One row of totals."""
    return votes.agg(
        F.count("*").alias("votes"), F.countDistinct("ip").alias("voters"), F.countDistinct("case_id").alias("cases"),
        F.min("ts").alias("first"), F.max("ts").alias("last"),
    )


def open_cases(votes: DataFrame, ip: int) -> DataFrame:
    """Open cases (margin below the needed one) that this voter has not voted on; one row each."""
    own = votes.where(F.col("ip") == ip).select("case_id").distinct()
    cases = margins(votes).where(F.col("margin") < MARGIN).groupBy("case_id").agg(F.max("nb").alias("nb"), F.max("total").alias("total"), F.max("last").alias("last"))
    return cases.join(own, "case_id", "left_anti")


def queue(votes: DataFrame, ip: int, limit: int) -> DataFrame:
    """The next cases for a voter, those with most votes first, then the longest waiting."""
    return open_cases(votes, ip).orderBy(F.desc("nb"), "last", "case_id").limit(limit)


def filled_queue(votes: DataFrame, places: DataFrame, ip: int, x: float, y: float, first: int, limit: int) -> DataFrame:
    """`first` cases near a decision, then the nearest ones weighted by votes, up to `limit`."""
    cases = open_cases(votes, ip).where(F.col("total") < UNDECIDED).join(places, "case_id")
    near = F.round(F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)) / (F.col("nb") * 10 + 1), 6)
    quota = cases.where("nb > 1").orderBy(F.desc("nb"), "last", "case_id").limit(first).select("case_id", "nb", F.lit(0).alias("part"), near.alias("weight"))
    rest = cases.join(quota.select("case_id"), "case_id", "left_anti").select("case_id", "nb", F.lit(1).alias("part"), near.alias("weight"))
    # a quota row sorts before all others, so the union's limit fills what the quota left
    return quota.union(rest).orderBy("part", "weight", "case_id").limit(limit)


def surviving(log: DataFrame, minutes: int = 10) -> DataFrame:
    """Votes that stay of a log (case_id, ip, session, ts, choice, event_id).

    Whatever the same session of a voter sends on a case, another vote or "back", takes back what it sent in the minutes before; "back"
    itself is no vote. The next event is the nearest, so one lead tells.
    """
    later = F.lead("ts").over(Window.partitionBy("case_id", "ip", "session").orderBy("ts", "event_id"))
    rows = log.withColumn("later", later).where(F.col("later").isNull() | (F.col("later") >= F.col("ts") + F.expr(f"interval {minutes} minutes")))
    return rows.where(F.col("choice") != BACK).drop("later")


def force_resolution(cases: DataFrame, forced: DataFrame) -> DataFrame:
    """Cases (case_id, resolution, resolved_at) with the resolutions of forced (case_id, resolution, at), whether they had one or not."""
    new = forced.groupBy("case_id").agg(F.max_by(F.struct("resolution", "at"), F.struct("at", "resolution")).alias("f"))
    rows = cases.join(new, "case_id", "left")
    return rows.select("case_id", F.coalesce("f.resolution", "resolution").alias("resolution"), F.coalesce("f.at", "resolved_at").alias("resolved_at"))


def next_nearest(cases: DataFrame, x: float, y: float) -> DataFrame:
    """The cases (case_id, x, y) in their order, with the one that is nearest to a place put first; `place` counts from 0."""
    d = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    best = cases.agg(F.min(F.struct(d.alias("d"), F.col("case_id"))).alias("b")).select(F.col("b.case_id").alias("nearest"))
    # one row
    rows = cases.crossJoin(F.broadcast(best))
    return rows.select("case_id", "x", "y", (F.col("case_id") == F.col("nearest")).alias("first"))
