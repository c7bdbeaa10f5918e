"""Conflation by name: fuzzy matches, register lookups, dictionaries made from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafuse.functions.text import repetition, to_ascii
from terrafuse.operators.spatial import nearest


def token_distance(name: Column, candidate: Column) -> Column:
    """Each word of name, from the last one on, takes the nearest remaining word of candidate; the distances' sum.

    The last words of a street's name tell most. Words compare in lower case without accents. Ties go to the word that sorts first; when none is left a word costs its length and one.
    """
    start = F.struct(F.lit(0).alias("sum"), F.split(F.lower(to_ascii(candidate)), " ").alias("rest"))

    def step(a: Column, w: Column) -> Column:
        near = F.array_min(F.transform(a["rest"], lambda c: F.struct(F.levenshtein(w, c).alias("d"), c.alias("c"))))
        at = F.array_position(a["rest"], near["c"]).cast("int")
        left = F.concat(F.slice(a["rest"], F.lit(1), at - 1), F.slice(a["rest"], at + 1, F.size(a["rest"])))
        none = F.size(a["rest"]) == 0
        return F.struct(
            (a["sum"] + F.when(none, F.length(w) + 1).otherwise(near["d"])).alias("sum"), F.when(none, a["rest"]).otherwise(left).alias("rest")
        )

    return F.aggregate(F.reverse(F.split(F.lower(to_ascii(name)), " ")), start, step, lambda a: a["sum"])


def best_names(pairs: DataFrame, key: list[str], most: float = 0.5) -> DataFrame:
    """(*key, name, distance): of the names that a row may have, the one nearest to the text drawn, if the distance is under `most` a letter of the name.

    pairs is (*key, text, name), a row for each name that comes into question: those of the row's parcel, or the register's within reach.
    All of them are compared, whatever they begin with; ties go to the name that sorts first.
    """
    scored = pairs.withColumn("distance", token_distance(F.col("name"), F.col("text")))
    best = scored.groupBy(*key).agg(F.min(F.struct("distance", "name")).alias("best"))
    return best.select(*key, F.col("best.name").alias("name"), F.col("best.distance").alias("distance")).where(F.col("distance") < most * F.length("name"))


def streets_within(points: DataFrame, drawn: DataFrame, reach: float = 50.0) -> DataFrame:
    """(id, text, away): the text (id, text, x, y) drawn nearest to each point (id, x, y), within reach; ties to the smaller id."""
    near = nearest(points, drawn.select("id", "x", "y")).where(F.col("distance") <= reach)
    return near.join(drawn.select(F.col("id").alias("site"), "text"), "site").select("id", "text", F.col("distance").alias("away"))


def with_dictionary(names: Column, dictionary: DataFrame, rows: DataFrame, out: str, key: str = "ascii", value: str = "word") -> DataFrame:
    """Rows with `out`, the names with each word replaced by the dictionary's (key, value) for it, where it has one.

    Words are dealt out with their places and joined, so that a dictionary of any size serves; rows need a column id.
    """
    words = rows.select("id", F.posexplode(F.split(names, " ")).alias("at", "w")).withColumn("plain", F.lower(to_ascii(F.col("w"))))
    told = words.join(dictionary.select(F.col(key).alias("plain"), F.col(value).alias("said")), "plain", "left")
    lists = told.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("said", "w").alias("x")))).alias("l"))
    return rows.join(lists, "id", "left").withColumn(out, F.array_join(F.transform("l", lambda p: p["x"]), " ")).drop("l")


def unambiguous(register: DataFrame, key: str, code: str) -> DataFrame:
    """Key -> code where only one code has the key."""
    return register.groupBy(key).agg(F.min(code).alias(code), F.countDistinct(code).alias("n")).where("n = 1").drop("n")


def ids_by_name(items: DataFrame, name: str, id_: str) -> DataFrame:
    """Sorted ids of each name, with their number and ends."""
    rows = items.groupBy(name).agg(F.array_sort(F.collect_list(id_)).alias("ids"))
    return rows.select(name, F.size("ids").alias("n"), F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def accent_dictionary(words: DataFrame) -> DataFrame:
    """A10: ascii word -> its one accented spelling; words with several spellings go."""
    rows = words.withColumn("ascii", to_ascii(F.col("word"))).where((F.col("ascii") != "") & (F.col("ascii") != F.col("word")))
    return rows.groupBy("ascii").agg(F.min("word").alias("word"), F.countDistinct("word").alias("n")).where("n = 1").drop("n")


def shortest_names(names: DataFrame, key: str, name: str) -> DataFrame:
    """The shortest name of each key; ties go to the one that sorts first."""
    return names.groupBy(key).agg(F.min(F.struct(F.length(name).alias("n"), F.col(name).alias("x"))).alias("b")).select(key, F.col("b.x").alias(name))


def letter_series(items: DataFrame) -> DataFrame:
    """Where all letters of a (street, number) stand for bis, ter, quater they are written out, else kept."""
    seen = F.bool_and(repetition(F.col("letter")).isNotNull()).over(Window.partitionBy("street", "number"))
    return items.withColumn("series", F.when(seen, repetition(F.col("letter"))).otherwise(F.col("letter")))
