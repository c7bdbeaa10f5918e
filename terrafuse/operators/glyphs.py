"""Text drawn as paths: normal forms, glyph matching and words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "???"
#: Largest distance of normalised points at which two shapes are the same glyph.
TOLERANCE = 0.05


def normal_form(points: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """Points moved, turned and scaled so that the first lies in (0, 0) and the furthest one from it in (1, 0), with that angle and length; None for a single place."""
    moved = points - points[0]
    far = int(np.argmax((moved**2).sum(axis=1)))
    x, y = moved[far]
    length, angle = math.hypot(x, y), math.atan2(y, x)
    if not length:
        return None
    turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
    return moved @ turn / length, angle, length


def spread(points: np.ndarray, angle: float) -> tuple[float, float]:
    """Least and largest projection of the points on a direction."""
    along = points @ np.array([math.cos(angle), math.sin(angle)])
    return float(along.min()), float(along.max())


def match_glyphs(shapes: DataFrame, library: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, value, angle, low, high) of shapes (id, commands, points); value is "???" where no glyph fits.

    The library (value, commands, points) is a font of a few hundred glyphs, collected once. A glyph fits if it has
    the same commands and near the same normal form; the nearest one wins, ties go to the value that sorts first. angle is how far the shape is turned
    against the glyph; low and high are its extent along its own base line.
    """
    glyphs: dict[str, list] = {}
    for r in library.collect():
        form = normal_form(np.array([(p["x"], p["y"]) for p in r["points"]]))
        if form is not None:
            glyphs.setdefault(r["commands"], []).append((r["value"], form[0], form[1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, commands, points in zip(batch["id"], batch["commands"], batch["points"], strict=True):
                xy = np.array([(p["x"], p["y"]) for p in points])
                form = normal_form(xy) if len(xy) else None
                fits = []
                for value, own, turned in glyphs.get(commands, []) if form is not None else []:
                    off = float(np.abs(own - form[0]).max()) if own.shape == form[0].shape else math.inf
                    if off <= tolerance:
                        fits.append((off, value, form[1] - turned))
                value, angle = min(fits)[1:] if fits else (UNKNOWN, 0.0)
                angle = math.remainder(angle, 2 * math.pi)
                low, high = spread(xy, angle) if len(xy) else (0.0, 0.0)
                out.append((id_, value, angle, low, high))
            yield pd.DataFrame(out, columns=["id", "value", "angle", "low", "high"])

    return shapes.select("id", "commands", "points").mapInPandas(run, "id long, value string, angle double, low double, high double")


def words(glyphs: DataFrame, line: str, order: str) -> DataFrame:
    """Text of each line; a gap of over half the mean glyph width is a space, unknown glyphs at the end go."""
    w = Window.partitionBy(line).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = glyphs.withColumn("_space", F.avg(F.col("high") - F.col("low")).over(whole) / 2)
    gap = F.col("low") - F.lag("high").over(w)
    rows = rows.withColumn("_piece", F.when(gap > F.col("_space"), F.concat(F.lit(" "), "value")).otherwise(F.col("value")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_piece").alias("p")))), lambda x: x["p"]), "")
    return rows.groupBy(line).agg(F.regexp_replace(text, r"( ?\?\?\?)+$", "").alias("text"))
