"""Queries with set operations, joins and windows."""

from pyspark.sql import functions as F

from terrafuse.operators import sets as S
from terrafuse.plans.registry import query


@query(
    """WITH a AS (SELECT o_orderkey AS id, o_totalprice AS v, 0 AS part FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT l_orderkey, sum(l_quantity), 1 FROM lineitem GROUP BY l_orderkey)
SELECT id, arg_min(v, part) AS v FROM a GROUP BY id"""
)
def first_wins_union(t):
    a = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("v"))
    return S.first_wins([a, b], "id")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM lineitem)
SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM r WHERE n = 1"""
)
def last_wins_dict(t):
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return S.last_wins(t.lineitem.select("l_orderkey", *order), "l_orderkey", order)


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40")
def set_difference_report(t):
    return S.missing(t.part, t.lineitem.where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query(
    """SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'
INTERSECT SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'"""
)
def intersect_nodes(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey").join(t.orders.select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    # one pass over the join instead of two: a part of both cohorts has both statuses
    both = rows.where("o_orderstatus in ('F', 'P')").groupBy("l_partkey").agg(F.min("o_orderstatus").alias("a"), F.max("o_orderstatus").alias("b"))
    return both.where("a <> b").select("l_partkey")


@query("SELECT o_orderkey, o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING' WHERE c_custkey IS NULL")
def left_null_filter(t):
    known = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(known, "o_custkey", "left_anti")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders")
def exists_flag(t):
    flag = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    return t.orders.select("o_orderkey").join(flag, "o_orderkey", "left").select("o_orderkey", F.coalesce("returned", F.lit(False)).alias("returned"))


@query(
    """WITH a AS (SELECT o_orderkey AS id, round(o_totalprice, 2) AS v, o_orderstatus = 'F' AS closed FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN round(o_totalprice, 2) + 1 ELSE round(o_totalprice, 2) END AS v FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT coalesce(a.id, b.id) AS id, a.v AS old, b.v AS new, CASE WHEN b.id IS NULL THEN 'kept' WHEN a.id IS NULL THEN 'insert'
  WHEN a.v = b.v THEN 'unchanged' WHEN closed THEN 'replaced' ELSE 'outofdate' END AS state FROM a FULL JOIN b ON a.id = b.id"""
)
def upsert_three_way(t):
    price = F.round("o_totalprice", 2)
    old = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), price.alias("v"), (F.col("o_orderstatus") == "F").alias("closed"))
    new = t.orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), price + 1).otherwise(price).alias("v"))
    return S.upsert_states(old, new, "id", "v", F.col("closed"))


@query(
    """WITH n AS (SELECT c_custkey, c_nationkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_nationkey < 5 AND c_acctbal > 0)
SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM n) UNION ALL SELECT * FROM n"""
)
def replace_partition(t):
    old = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    new = old.where("c_nationkey < 5 and c_acctbal > 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return S.replace_partitions(old, new, "c_nationkey")


@query(
    """WITH n AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n, ceil(count(*) OVER (PARTITION BY p_brand) / 10.0) AS m FROM part)
SELECT p_brand, p_partkey, CAST(n // 10 AS INTEGER) AS chunk, lpad((n // 10)::VARCHAR, CAST(length(CAST(m - 1 AS INTEGER)::VARCHAR) AS INTEGER), '0') AS name FROM n"""
)
def chunk_numbering(t):
    return S.chunks(t.part, "p_partkey", 10, "p_brand")


@query(
    """WITH l AS (SELECT event_id, user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, ts, event_type FROM l WHERE before IS NULL OR before <> event_type"""
)
def dedupe_consecutive(t):
    return S.changes(t.events.select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type")


@query(
    """SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM events"""
)
def split_at_markers(t):
    return S.sessions(t.events.select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "user_id", "run")


@query(
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS purchase FROM events"""
)
def state_carry_forward(t):
    rows = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return S.carry_forward(rows, "user_id", ["ts", "event_id"], "v", "purchase").select("event_id", "user_id", "purchase")


@query(
    """WITH n AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey)
SELECT p_partkey, CASE WHEN coalesce(n, 0) = 0 THEN 'orphan' WHEN n = 1 THEN 'street' ELSE 'ambiguous' END AS kind, CASE WHEN n = 1 THEN s END AS street,
  CASE WHEN n > 1 THEN 'choose of ' || n::VARCHAR END AS fixme FROM part LEFT JOIN n ON p_partkey = l_partkey"""
)
def street_split_class(t):
    n = t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n"), F.min("l_suppkey").alias("s"))
    rows = t.part.select("p_partkey").join(n, F.col("p_partkey") == F.col("l_partkey"), "left")
    kind = F.when(F.coalesce("n", F.lit(0)) == 0, "orphan").when(F.col("n") == 1, "street").otherwise("ambiguous")
    return rows.select("p_partkey", kind.alias("kind"), F.when(F.col("n") == 1, F.col("s")).alias("street"), F.when(F.col("n") > 1, F.concat(F.lit("choose of "), F.col("n").cast("string"))).alias("fixme"))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_linestatus END AS street FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, coalesce(street, o_orderpriority) AS street FROM r JOIN orders ON l_orderkey = o_orderkey"""
)
def assoc_street_push(t):
    k = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    members = t.lineitem.select(*k, F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")).alias("street"))
    names = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return members.join(names, "l_orderkey").select(*k, F.coalesce("street", "o_orderpriority").alias("street"))


@query(
    """SELECT o_orderpriority AS kind, o_orderstatus AS file, count(*) AS n, CAST(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM orders GROUP BY ALL"""
)
def layer_counts(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("file")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))


@query("SELECT n_name, r_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def sorted_communes(t):
    from pyspark.sql import Window

    rows = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_name", "r_name", F.row_number().over(Window.partitionBy("r_name").orderBy("n_name")).cast("long").alias("place"))
