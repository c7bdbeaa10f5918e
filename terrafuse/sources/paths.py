"""Vector paths: SVG path data, styles and page content streams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PATH = T.StructType([T.StructField("commands", T.StringType()), T.StructField("points", T.ArrayType(_POINT))])
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
#: Numbers that each command takes.
ARITY = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "Z": 0}


def parse_path(d: str) -> tuple[str, list[tuple[float, float]]]:
    """Absolute commands of M, L, C, Q, Z and their points. Arcs are an error.

    Further pairs of a move are lines; H and V become lines; S and T get the reflected control point if
    the command before was of their kind, else the current point.
    """
    out, points, at, start, control = [], [], (0.0, 0.0), (0.0, 0.0), None
    for letter, body in re.findall(r"([A-Za-z])([^A-DF-Za-df-z]*)", d):
        kind, relative = letter.upper(), letter.islower()
        if kind not in ARITY:
            raise ValueError(f"command {letter} is not supported")
        numbers = [float(x) for x in _NUMBER.findall(body)]
        n = ARITY[kind]
        if (n == 0 and numbers) or (n and (not numbers or len(numbers) % n)):
            raise ValueError(f"{letter} with {len(numbers)} numbers")
        for k in range(0, max(len(numbers), 1), n or 1):
            v = numbers[k : k + n]
            base = at if relative else (0.0, 0.0)
            if kind == "Z":
                out.append("Z")
                control = None
                continue
            if kind == "H":
                pairs = [(v[0] + base[0], at[1])]
            elif kind == "V":
                pairs = [(at[0], v[0] + base[1])]
            else:
                pairs = [(v[i] + base[0], v[i + 1] + base[1]) for i in range(0, n, 2)]
            if kind in "ST":
                curve = "C" if kind == "S" else "Q"
                same = out and out[-1] == curve and control
                pairs.insert(0, (2 * at[0] - control[0], 2 * at[1] - control[1]) if same else at)
                name = curve
            else:
                name = "L" if kind in "HVL" or (kind == "M" and k) else kind
            out.append(name)
            points += pairs
            control = pairs[-2] if name in "CQ" else None
            at = pairs[-1]
            if name == "M":
                start = at
    del start
    return "".join(out), points


@F.pandas_udf(PATH)
def svg_path(d: pd.Series) -> pd.DataFrame:
    """Commands and points of path data; null for texts that are not path data."""
    rows = []
    for text in d:
        try:
            commands, points = parse_path(text) if text is not None else (None, None)
        except ValueError:
            commands, points = None, None
        rows.append((commands, None if points is None else [{"x": x, "y": y} for x, y in points]))
    return pd.DataFrame(rows, columns=["commands", "points"])


def style_map(style: Column) -> Column:
    """key:value pairs of a style attribute."""
    return F.str_to_map(F.regexp_replace(F.lower(style), r"\s", ""), F.lit(";"), F.lit(":"))


def layer_of(style: Column) -> Column:
    """the layer that a path's style stands for; null if none."""
    width = style["stroke-width"].try_cast("double")
    fill, stroke = style["fill"], style["stroke"]
    return (
        F.when(fill == "#ffcc33", "building").when(fill == "#ffe599", "light building").when(fill == "#98c3d9", "water").when(fill == "#1979ac", "riverbank")
        .when((stroke == "#000000") & width.between(0.7, 0.8), "parcel")
        .when((stroke == "#ffffff") & (width.between(17.8, 17.9) | width.between(8.4, 8.6)), "limit")
    )


def is_polygon(commands: Column, points: Column, tolerance: float = 0.5) -> Column:
    """only closed rings of at least four points, whose ends meet within the tolerance (for one ring)."""
    shape = commands.rlike("^(ML{3,}Z)+$")
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    gap = F.sqrt(F.pow(first["x"] - last["x"], 2) + F.pow(first["y"] - last["y"], 2))
    return F.coalesce(shape & ((F.length(F.regexp_replace(commands, "[^M]", "")) > 1) | (gap <= tolerance)), F.lit(False))


_OPERAND = re.compile(rb"\[[^\]]*\]|/[^\s/\[\]<>()]+|[+-]?[0-9]*\.?[0-9]+|[A-Za-z*'\"]+|\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f]*>")


def content_paths(content: bytes) -> Iterator[tuple[str, str]]:
    """Path data and style of every path that a page's drawing operators paint or end."""
    stack, d, color = [], [], {"stroke": "#000000", "fill": "#000000"}
    width, saved, at = 1.0, [], (0.0, 0.0)
    shade = lambda values: "#" + "".join(f"{round(max(0.0, min(1.0, v)) * 255):02x}" for v in (values * 3 if len(values) == 1 else values))
    pair = lambda v: f"{v[0]:g},{v[1]:g}"
    for token in _OPERAND.findall(content):
        if re.fullmatch(rb"[+-]?[0-9]*\.?[0-9]+", token):
            stack.append(float(token))
            continue
        if token[:1] in b"[/(<":
            continue
        op, v, stack = token.decode("latin-1"), stack, []
        if op in "ml" and len(op) == 1 and len(v) >= 2:
            at = (v[-2], v[-1])
            d.append(f"{op.upper()} {pair(at)}")
        elif op == "c" and len(v) >= 6:
            at = (v[4], v[5])
            d.append("C " + " ".join(pair(v[i : i + 2]) for i in (0, 2, 4)))
        elif op == "v" and len(v) >= 4:
            d.append(f"C {pair(at)} {pair(v[0:2])} {pair(v[2:4])}")
            at = (v[2], v[3])
        elif op == "y" and len(v) >= 4:
            d.append(f"C {pair(v[0:2])} {pair(v[2:4])} {pair(v[2:4])}")
            at = (v[2], v[3])
        elif op == "h":
            d.append("Z")
        elif op == "re" and len(v) >= 4:
            x, y, w, h = v[-4:]
            d.append(f"M {x:g},{y:g} L {x + w:g},{y:g} L {x + w:g},{y + h:g} L {x:g},{y + h:g} Z")
        elif op == "w" and v:
            width = v[-1]
        elif op == "q":
            saved.append((dict(color), width))
        elif op == "Q" and saved:
            color, width = saved.pop()
        elif op in ("RG", "G") and v:
            color["stroke"] = shade(v[-3:] if op == "RG" else v[-1:])
        elif op in ("rg", "g") and v:
            color["fill"] = shade(v[-3:] if op == "rg" else v[-1:])
        elif op in ("S", "s", "f", "F", "f*", "B", "B*", "n"):
            if op == "s":
                d.append("Z")
            rule = "evenodd" if "*" in op else "nonzero"
            style = {
                "S": f"fill:none;stroke:{color['stroke']};stroke-opacity:1;stroke-width:{width:g}", "n": "",
                "f": f"fill:{color['fill']};stroke:none;fill-rule:{rule}",
                "B": f"fill:{color['fill']};stroke:{color['stroke']};stroke-width:{width:g};fill-rule:{rule}",
            }[op[0].replace("s", "S").replace("F", "f")]
            if d:
                yield " ".join(d), style
            d = []


def pdf_paths(data: bytes) -> Iterator[tuple[str, str]]:
    """Paths of all content streams of a PDF file, in order; streams that do not inflate are skipped."""
    for m in re.finditer(rb"stream\r?\n", data):
        end = data.find(b"endstream", m.end())
        raw = data[m.end() : end if end >= 0 else len(data)]
        try:
            text = zlib.decompressobj().decompress(raw)
        except zlib.error:
            text = raw if re.search(rb"\s(?:re|[mlcfSn])\s", raw) else b""
        yield from content_paths(text)


def read_pdf_paths(spark: SparkSession, path: str) -> DataFrame:
    """Doc, seq, d, style of the paths of PDF files; a file is one row of the binary source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(pdf_paths(content))
                yield pd.DataFrame({"doc": doc, "seq": range(len(rows)), "d": [r[0] for r in rows], "style": [r[1] for r in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "doc string, seq long, d string, style string")


def within_page(paths: DataFrame) -> DataFrame:
    """Paths after the first white rectangle of each document, which bounds its page: adds page x1, y1, x2, y2.

    paths has doc, seq, commands, points and style (a map).
    """
    white = F.col("style")["fill"] == "#ffffff"
    box = lambda f, c: f(F.transform("points", lambda p: p[c]))
    first = paths.where(white & (F.col("commands") == "MLLLLZ")).groupBy("doc").agg(
        F.min_by(F.struct(F.col("seq").alias("at"), box(F.array_min, "x").alias("x1"), box(F.array_min, "y").alias("y1"), box(F.array_max, "x").alias("x2"), box(F.array_max, "y").alias("y2")), "seq").alias("page")
    )
    return paths.join(first, "doc").where(F.col("seq") > F.col("page.at")).select(*paths.columns, "page.x1", "page.y1", "page.x2", "page.y2")
