"""What is scraped from pages of the land registry's site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINK = r'<a\s[^>]*href="([^"]*)"'


def titles_and_links(pages: DataFrame) -> DataFrame:
    """page_id, title, number of links and their targets in order."""
    links = F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))
    rows = pages.select("page_id", F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"), links.alias("l"))
    return rows.select("page_id", "title", F.size("l").alias("links"), F.array_join("l", " ").alias("hrefs"))


def options(pages: DataFrame, column: str = "html") -> DataFrame:
    """value and label of every <option> of a page: the list of departments."""
    pattern = F.lit(r'(?i)<option\s[^>]*value="([^"]*)"[^>]*>([^<]*)')
    pairs = F.arrays_zip(F.regexp_extract_all(column, pattern, F.lit(1)).alias("value"), F.regexp_extract_all(column, pattern, F.lit(2)).alias("label"))
    return pages.select(*[c for c in pages.columns if c != column], F.explode(pairs).alias("o")).select("*", "o.value", F.trim("o.label").alias("label")).drop("o")
