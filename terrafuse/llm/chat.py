"""Chat formatting: the dialogue from every participant's view, with the masks that go with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafuse.llm.common import HOT, cut, table

#: Roles that take no part in the rotation: their turns stay system turns in every view.
SYSTEM_ROLES = ("system",)
UNKNOWN = "unknown"
END = "<|end|>\n"
#: A dialogue of more than one in HOT of all turns meets its views in so many parts a hot share.
PARTS = 64


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    system_roles: tuple[str, ...] = SYSTEM_ROLES,
) -> DataFrame:
    """One row per turn and view: conv_id, perspective, seq, kind, segment, start, end, loss, loss_start.

    A view renders the whole dialogue with one participant as the assistant and the others as named
    users, whose names are percent-encoded; joining its segments by seq gives the text, start and end are code points in it (end
    exclusive), and the loss falls on [loss_start, end) of the participant's own segments. A dialogue is
    never gathered: turns are range-partitioned by dialogue, view and order, offsets are summed within
    partitions, and the partitions' totals are added, so a dialogue of any length is spread out.

    Turns are ordered by turn, role and text, nulls first; equal rows are rendered as often as they
    come. A null role is the participant "unknown", a null text is empty; rows without conv_id form one
    dialogue. A dialogue of system turns alone has no participant and no view. "<|" in a text is parted, so that no text can
    forge a header. Other columns are not read.
    """
    rows = turns.select(
        turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"),
        F.coalesce(turns[role_col].cast("string"), F.lit(UNKNOWN)).alias("role"),
        F.replace(F.coalesce(turns[text_col].cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    system = F.col("role").isin(*system_roles)
    # long dialogues, which are at most HOT, are dealt in parts, and their views repeated for each of them
    sizes = cut(rows.groupBy("conv_id").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = F.least(F.ceil(F.col("n") * PARTS / max(total, 1)), F.lit(PARTS)).cast("int") + 1
    long_ones = F.broadcast(sizes.where(F.col("n") * HOT > total).select(F.col("conv_id").alias("long_conv"), parts.alias("parts")))
    dealt = lambda df: df.join(long_ones, F.col("conv_id").eqNullSafe(F.col("long_conv")), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("long_conv")
    views = dealt(rows.where(~system).select("conv_id", F.col("role").alias("perspective")).distinct())
    views = views.select(F.col("conv_id").alias("view_conv"), "perspective", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("view_part"))
    own = dealt(rows).withColumn("own_part", F.pmod(F.xxhash64("turn", "text"), F.col("parts")).cast("int"))
    seen = own.join(views, F.col("conv_id").eqNullSafe(F.col("view_conv")) & (F.col("own_part") == F.col("view_part"))).drop("view_conv", "view_part", "own_part", "parts")
    kind = F.when(system, "system").when(F.col("role") == F.col("perspective"), "assistant").otherwise("user")
    # percent signs and hex digits for all but letters, digits and - . _ ~, so that different names stay different
    name = F.replace(F.replace(F.replace(F.url_encode("role"), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    header = F.when(F.col("kind") == "user", F.concat(F.lit("<|user name="), name, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), "kind", F.lit("|>\n")))
    seen = seen.withColumn("kind", kind).withColumn("head", F.length(header)).withColumn("segment", F.concat(header, "text", F.lit(END)))
    order = ["turn", "role", "text"]
    dealt = seen.repartitionByRange("conv_id", "perspective", *order).withColumn("part", F.spark_partition_id())
    dealt = cut(dealt.withColumn("size", F.length("segment").cast("long")))
    own = Window.partitionBy("part", "conv_id", "perspective").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("n", F.row_number().over(own).cast("long")).withColumn("end", F.sum("size").over(upto))
    totals = dealt.groupBy("conv_id", "perspective", "part").agg(F.sum("size").alias("s"), F.count("*").alias("c"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("conv_id").alias("t_conv"), F.col("perspective").alias("t_view"), F.col("part").alias("t_part"),
        F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c"),
    ).where("c > 0")  # fmt: skip  # only dialogues that go on from an earlier partition
    on = F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("perspective") == F.col("t_view")) & (F.col("part") == F.col("t_part"))
    placed = local.join(totals, on, "left").withColumn("s", F.coalesce("s", F.lit(0))).withColumn("seq", F.col("n") + F.coalesce("c", F.lit(0)))
    start, loss = F.col("s") + F.col("end") - F.col("size"), F.col("kind") == "assistant"
    return placed.select(
        "conv_id", "perspective", "seq", "kind", "segment", start.alias("start"), (F.col("s") + F.col("end")).alias("end"),
        loss.alias("loss"), F.when(loss, start + F.col("head")).alias("loss_start"),
    )


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE_SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
v AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'),
k AS (SELECT r.*, perspective, CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user' END AS kind
      FROM r JOIN v ON r.conv_id IS NOT DISTINCT FROM v.conv_id),
h AS (SELECT *, CASE WHEN kind = 'user' THEN '<|user name=' || url_encode(role) || '|>' || chr(10)
      ELSE '<|' || kind || '|>' || chr(10) END AS head FROM k),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, row_number() OVER w AS seq, CAST(sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end"
      FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST))
SELECT conv_id, perspective, seq, kind, segment, "end" - length(segment) AS start, "end", kind = 'assistant' AS loss,
       CASE WHEN kind = 'assistant' THEN "end" - length(segment) + length(head) END AS loss_start
FROM o
"""
