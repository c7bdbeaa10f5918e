"""Queries on the vote log."""

from pyspark.sql import functions as F

from terrafuse.operators import votes as V
from terrafuse.plans.registry import PT, VOTE_LOG, VOTES, query

_RANKED = f"""{VOTES},
ranked AS (SELECT case_id, choice, count(*) AS nb, min(ts) AS first, max(ts) AS last,
  rank() OVER (PARTITION BY case_id ORDER BY count(*) DESC) AS rank FROM votes GROUP BY case_id, choice)"""
_MARGINS = f"""{_RANKED},
margins AS (SELECT c1.case_id, c1.choice, c1.nb, c1.last, CAST(c1.nb - coalesce(sum(c2.nb), 0) AS BIGINT) AS margin, CAST(c1.nb + coalesce(sum(c2.nb), 0) AS BIGINT) AS total
  FROM ranked c1 LEFT JOIN ranked c2 ON c1.case_id = c2.case_id AND c2.rank > 1 WHERE c1.rank = 1 GROUP BY c1.case_id, c1.choice, c1.nb, c1.last)"""
_OPEN = f"""{_MARGINS},
open_cases AS (SELECT case_id, max(nb) AS nb, max(total) AS total, max(last) AS last FROM margins WHERE margin < 3
  AND case_id NOT IN (SELECT case_id FROM votes WHERE ip = 7) GROUP BY case_id)"""


@query(f"WITH {_RANKED} SELECT * FROM ranked")
def vote_rank(t):
    return V.ranked(t.votes)


@query(f"WITH {_MARGINS} SELECT case_id, choice, nb, margin, total FROM margins WHERE margin < 3")
def vote_margin_open(t):
    return V.margins(t.votes).where("margin < 3").drop("last")


@query(f"WITH {VOTES} SELECT count(*) AS votes, count(DISTINCT ip) AS voters, count(DISTINCT case_id) AS cases, min(ts) AS first, max(ts) AS last FROM votes")
def vote_stats(t):
    return V.statistics(t.votes)


@query(f"WITH {_OPEN} SELECT * FROM open_cases ORDER BY nb DESC, last, case_id LIMIT 20")
def vote_queue_topk(t):
    return V.queue(t.votes, ip=7, limit=20)


@query(
    f"""WITH {_OPEN},
c AS (SELECT o.*, (case_id * 7919 % 10007) / 100.0::DOUBLE AS x, (case_id * case_id % 9973) / 100.0::DOUBLE AS y FROM open_cases o WHERE total < 10),
w AS (SELECT *, round(sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50)) / (nb * 10 + 1), 6) AS weight FROM c),
q AS (SELECT case_id, nb, 0 AS part, weight FROM w WHERE nb > 1 ORDER BY nb DESC, last, case_id LIMIT 8),
r AS (SELECT case_id, nb, 1 AS part, weight FROM w WHERE case_id NOT IN (SELECT case_id FROM q))
SELECT * FROM (SELECT * FROM q UNION ALL SELECT * FROM r) ORDER BY part, weight, case_id LIMIT 20"""
)
def vote_queue_fill(t):
    k = F.col("case_id")
    places = t.votes.select("case_id").distinct().select("case_id", (k * 7919 % 10007 / F.lit(100.0)).alias("x"), (k * k % 9973 / F.lit(100.0)).alias("y"))
    return V.filled_queue(t.votes, places, ip=7, x=50.0, y=50.0, first=8, limit=20)


@query(
    f"""WITH {_MARGINS} SELECT case_id, choice, nb, margin, total, CASE WHEN nb >= 3 AND margin >= 3 THEN 'resolved'
  WHEN margin < 3 AND total >= 10 THEN 'undecided' ELSE 'open' END AS state FROM margins"""
)
def vote_resolve(t):
    return V.margins(t.votes).drop("last").withColumn("state", V.state())


@query(
    f"""WITH {_MARGINS} SELECT case_id, count(*) AS votes, count(DISTINCT ip) AS voters FROM votes
  WHERE case_id IN (SELECT case_id FROM margins WHERE margin < 3 AND total >= 10) GROUP BY case_id"""
)
def undecided_semi(t):
    undecided = V.margins(t.votes).where(V.state() == "undecided").select("case_id").distinct()
    return t.votes.join(undecided, "case_id", "left_semi").groupBy("case_id").agg(F.count("*").alias("votes"), F.countDistinct("ip").alias("voters"))


@query(
    f"""WITH {VOTE_LOG} SELECT * FROM vote_log v WHERE choice <> 'back' AND NOT EXISTS (SELECT 1 FROM vote_log w WHERE w.case_id = v.case_id AND w.ip = v.ip AND w.session = v.session
  AND (w.ts > v.ts OR (w.ts = v.ts AND w.event_id > v.event_id)) AND w.ts - v.ts < INTERVAL 10 MINUTE)"""
)
def undo_window(t):
    return V.surviving(t.vote_log)


@query(
    f"""WITH {VOTES}, c AS (SELECT case_id, arg_max(choice, ts) AS resolution, max(ts) AS resolved_at FROM votes GROUP BY case_id),
f AS (SELECT case_id, arg_max(choice, {{'t': ts, 'c': choice}}) AS r, max(ts) AS a FROM votes WHERE ip % 10 = 0 GROUP BY case_id)
SELECT case_id, coalesce(r, resolution) AS resolution, coalesce(a, resolved_at) AS resolved_at FROM c LEFT JOIN f USING (case_id)"""
)
def force_resolution(t):
    """The last vote of one in ten voters is forced on its case; of a case's last votes at one time the first in the table counts."""
    cases = t.votes.groupBy("case_id").agg(F.max_by("choice", F.struct("ts", (-F.col("event_id")).alias("first"))).alias("resolution"), F.max("ts").alias("resolved_at"))
    return V.force_resolution(cases, t.votes.where("ip % 10 = 0").select("case_id", F.col("choice").alias("resolution"), F.col("ts").alias("at")))


@query(f"WITH {PT} SELECT id AS case_id, x, y, id = (SELECT arg_min(id, {{'d': (x - 50) * (x - 50) + (y - 50) * (y - 50), 'i': id}}) FROM pt) AS first FROM pt")
def nearest_next(t):
    return V.next_nearest(t.pt.withColumnRenamed("id", "case_id"), 50.0, 50.0)


@query(f"WITH {VOTES} SELECT case_id, max(ts) AS last FROM votes GROUP BY case_id ORDER BY last, case_id")
def cases_by_last_vote(t):
    """T09"""
    return t.votes.groupBy("case_id").agg(F.max("ts").alias("last")).orderBy("last", "case_id")
