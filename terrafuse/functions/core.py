"""Helpers for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def rounded(value: Column, decimals: int) -> Column:
    """value in units of the last decimal, to the next whole one, halves away from zero, as SQL engines round binary fractions; F.round takes the shortest
    decimal text for the value, in which 57.949999999999996 is below the half."""
    scaled = value * F.lit(10.0**decimals)
    return let(scaled, lambda v: F.signum(v) * (F.floor(F.abs(v)) + F.when(F.abs(v) - F.floor(F.abs(v)) >= 0.5, 1).otherwise(0))) / F.lit(10.0**decimals)
