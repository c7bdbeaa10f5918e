"""Registry of the engine's own queries, and the surrogate tables that they run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (tables) -> DataFrame under its name, with its SQL for the check if there is one."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


class Tables:
    """The driver's tables by attribute, and surrogates for votes, points, boxes and ways made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def votes(self) -> DataFrame:
        """case_id, ip, ts, choice, event_id"""
        case = F.expr("event_id div 11")
        kind = F.col("event_type")
        choice = F.when(kind.isin("view", "click", "purchase"), "join").when(kind == "signup", F.when(case % 2 == 0, "join").otherwise("keep")).otherwise("unknown")
        rows = self.events.where(~((case % 3 == 0) & (F.col("event_id") % 11 > 4)))
        return rows.select(case.alias("case_id"), F.col("user_id").alias("ip"), "ts", choice.alias("choice"), "event_id")

    @property
    def vote_log(self) -> DataFrame:
        """case_id, ip, session, ts, choice, event_id: several events of a session on a case within minutes, some of them taken back"""
        k = F.col("event_id")
        choice = F.when(k % 7 == 3, "back").when(k % 3 == 0, "keep").otherwise("join")
        return self.events.select(F.expr("event_id div 50").alias("case_id"), (F.col("user_id") % 3).alias("ip"), (k % 2).alias("session"), "ts", choice.alias("choice"), "event_id")

    @property
    def pt(self) -> DataFrame:
        """id, x, y: a point for each customer"""
        k = F.col("c_custkey")
        return self.customer.select(k.alias("id"), (k * 7919 % 10007 / F.lit(100.0)).alias("x"), (k * k % 9973 / F.lit(100.0)).alias("y"))

    @property
    def near(self) -> DataFrame:
        """id, x, y: a point inside or beside the box of the same id"""
        k = F.col("id")
        return self.pt.select(k, (F.col("x") + k % 13 / F.lit(4.1) - 1.03).alias("x"), (F.col("y") + k % 11 / F.lit(4.1) - 1.03).alias("y"))

    @property
    def spt(self) -> DataFrame:
        """id, x, y: a site for each supplier"""
        k = F.col("s_suppkey")
        return self.supplier.select(k.alias("id"), (k * 6007 % 10007 / F.lit(100.0)).alias("x"), (k * k * 31 % 9973 / F.lit(100.0)).alias("y"))

    @property
    def bx(self) -> DataFrame:
        """id, x0, y0, x1, y1: a box for each part"""
        k, x, y = F.col("p_partkey"), F.col("p_partkey") * 7919 % 10007 / F.lit(100.0), F.col("p_partkey") * F.col("p_partkey") % 9973 / F.lit(100.0)
        return self.part.select(k.alias("id"), x.alias("x0"), y.alias("y0"), (x + F.col("p_size") / F.lit(10.0)).alias("x1"), (y + (F.col("p_size") % 7 + 1) / F.lit(2.0)).alias("y1"))

    @property
    def cur(self) -> DataFrame:
        """A second layer of boxes: most of the first one's shifted, and some neighbours."""
        w, k = F.col("x1") - F.col("x0"), F.col("id")
        moved = self.bx.where((k % 7 != 0) & (k % 5 != 0)).select((k * 2).alias("id"), (F.col("x0") + k % 6 * w * 0.08).alias("x0"), "y0", (F.col("x1") + k % 6 * w * 0.08).alias("x1"), "y1")
        beside = self.bx.where(k % 4 == 0).select((k * 2 + 1).alias("id"), (F.col("x0") + w * 0.9).alias("x0"), "y0", (F.col("x1") + w * 0.9).alias("x1"), "y1")
        return moved.union(beside)

    @property
    def way_nodes(self) -> DataFrame:
        """way_id, node_id, pos: the distinct parts of each order in order of their key"""
        from pyspark.sql import Window

        nodes = self.lineitem.select(F.col("l_orderkey").alias("way_id"), F.col("l_partkey").alias("node_id")).distinct()
        return nodes.withColumn("pos", F.row_number().over(Window.partitionBy("way_id").orderBy("node_id")) - 1)


# The same surrogates for the check's SQL.
VOTES = """votes AS (SELECT event_id // 11 AS case_id, user_id AS ip, ts, event_id,
  CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'join'
       WHEN event_type = 'signup' THEN CASE WHEN (event_id // 11) % 2 = 0 THEN 'join' ELSE 'keep' END ELSE 'unknown' END AS choice
  FROM events WHERE NOT ((event_id // 11) % 3 = 0 AND event_id % 11 > 4))"""
VOTE_LOG = """vote_log AS (SELECT event_id // 50 AS case_id, user_id % 3 AS ip, event_id % 2 AS session, ts,
  CASE WHEN event_id % 7 = 3 THEN 'back' WHEN event_id % 3 = 0 THEN 'keep' ELSE 'join' END AS choice, event_id FROM events)"""
PT = "pt AS (SELECT c_custkey AS id, (c_custkey * 7919 % 10007) / 100.0::DOUBLE AS x, (c_custkey * c_custkey % 9973) / 100.0::DOUBLE AS y FROM customer)"
NEAR = f"{PT}, near AS (SELECT id, x + id % 13 / 4.1::DOUBLE - 1.03::DOUBLE AS x, y + id % 11 / 4.1::DOUBLE - 1.03::DOUBLE AS y FROM pt)"
SPT = "spt AS (SELECT s_suppkey AS id, (s_suppkey * 6007 % 10007) / 100.0::DOUBLE AS x, (s_suppkey * s_suppkey * 31 % 9973) / 100.0::DOUBLE AS y FROM supplier)"
BX = """bx AS (SELECT p_partkey AS id, (p_partkey * 7919 % 10007) / 100.0::DOUBLE AS x0, (p_partkey * p_partkey % 9973) / 100.0::DOUBLE AS y0,
  (p_partkey * 7919 % 10007) / 100.0::DOUBLE + p_size / 10.0::DOUBLE AS x1, (p_partkey * p_partkey % 9973) / 100.0::DOUBLE + (p_size % 7 + 1) / 2.0::DOUBLE AS y1 FROM part)"""
CUR = """cur AS (SELECT id * 2 AS id, x0 + id % 6 * (x1 - x0) * 0.08::DOUBLE AS x0, y0, x1 + id % 6 * (x1 - x0) * 0.08::DOUBLE AS x1, y1 FROM bx WHERE id % 7 <> 0 AND id % 5 <> 0
  UNION ALL SELECT id * 2 + 1, x0 + (x1 - x0) * 0.9::DOUBLE, y0, x1 + (x1 - x0) * 0.9::DOUBLE, y1 FROM bx WHERE id % 4 = 0)"""
WAY = """way_nodes AS (SELECT l_orderkey AS way_id, l_partkey AS node_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS pos
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))"""
