"""Glyph libraries as SVG documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafuse.functions.text import html_unescape, xml_escape

HEAD, FOOT = '<svg xmlns="http://www.w3.org/2000/svg">\n', "</svg>\n"
_PATH = r"(?s)<path\b[^>]*>.*?</path>"


def library_document(glyphs: DataFrame) -> DataFrame:
    """(file, content): one SVG document for the glyphs (file, value, d) of each file; a glyph is a path whose title is its value."""
    line = F.concat(F.lit('<path d="'), xml_escape(F.col("d")), F.lit('"><title>'), xml_escape(F.col("value")), F.lit("</title></path>\n"))
    lists = glyphs.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("value", "d", line.alias("line")))).alias("l"))
    return lists.select("file", F.concat(F.lit(HEAD), F.array_join(F.transform("l", lambda e: e["line"]), ""), F.lit(FOOT)).alias("content"))


def read_library(documents: DataFrame) -> DataFrame:
    """(file, value, d) of the titled paths of SVG documents (file, content)."""
    paths = documents.select("file", F.explode(F.regexp_extract_all("content", F.lit(_PATH), F.lit(0))).alias("p"))
    value = F.regexp_extract("p", r"(?s)<title[^>]*>(.*?)</title>", 1)
    d = F.regexp_extract("p", r"""(?s)<path\b[^>]*?\sd=["']([^"']*)["']""", 1)
    rows = paths.select("file", html_unescape(F.replace(value, F.lit("&apos;"), F.lit("'"))).alias("value"), html_unescape(d).alias("d"))
    return rows.where("value <> ''")


def upright(content):
    """An SVG document whose y axis points up: one group around all that mirrors it; groups inside go."""
    flat = F.regexp_replace(content, r"(?i)</?g\b[^>]*>", "")
    opened = F.regexp_replace(flat, r"(?is)^(.*?<svg\b[^>]*>)", r'$1<g transform="scale(1,-1)">')
    return F.regexp_replace(opened, r"(?i)</svg>", "</g></svg>")
