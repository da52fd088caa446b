"""Scalar functions over strings and arrays that Spark has not under one name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slice_text(text: Column, begin: int, end: int | None) -> Column:
    """Characters begin to end (exclusive), negative positions from the end, as of a Python slice."""
    n = F.length(text)
    at = F.greatest(n + begin, F.lit(0)) if begin < 0 else F.lit(begin)
    stop = n if end is None else (F.greatest(n + end, F.lit(0)) if end < 0 else F.least(n, F.lit(end)))
    return F.substr(text, at + 1, F.greatest(stop - at, F.lit(0)))


def is_numeric(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


def like_star(text: Column, pattern: str) -> Column:
    """LIKE with * for any run; % and _ are ordinary characters."""
    return text.like(pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%"))


def find_index(xs: Column, value: Column) -> Column:
    """Position from 0; null if it is not there."""
    at = F.array_position(xs, value)
    return F.when(at > 0, at - 1)
