"""Joins to a table with one row a key, where one key may hold a large share of the other side's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that may be broadcast, and keys that may count as hot.
SMALL, HOT_KEYS = 1_000_000, 50_000


def join_unique(rows: DataFrame, lookup: DataFrame, on: list[str], weight: str, how: str = "inner", small: int = SMALL) -> DataFrame:
    """rows with the columns of lookup (a kept table, one row for each key; weight: how many of rows have the key) but
    weight.  how: inner or left; a null key meets nothing.  A lookup of at most `small` rows is broadcast.  Beyond, the
    keys that hold more than a HOT_KEYS-th of all rows, of which there are fewer than HOT_KEYS, are broadcast, so that no
    task gets the rows of one; the others are joined by shuffle."""
    found = lookup.agg(F.count("*").alias("n"), F.sum(weight).alias("rows")).first()
    plain = lookup.drop(weight)
    if found["n"] <= small:
        return rows.join(F.broadcast(plain), on, how)
    limit = (found["rows"] or 0) // HOT_KEYS
    hot = F.broadcast(lookup.where(F.col(weight) > limit).drop(weight))
    cold = lookup.where(F.col(weight) <= limit).drop(weight)
    rest = rows.join(hot.select(*on), on, "left_anti").join(cold, on, how)
    return rows.join(hot, on).unionByName(rest)
