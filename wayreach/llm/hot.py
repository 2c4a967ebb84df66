"""Joins of rows with one row a key, where single keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot if it holds more than this share of all rows, so that there are at most so many
HOT_KEYS = 2000
HOT_ROWS = 20_000


def join_totals(rows: DataFrame, totals: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``totals``, one row for each ``key`` (null equals null).

    ``totals`` holds in ``count`` how many rows each key has (the column is dropped). Keys of
    many rows are looked up in a broadcast: these are at most ``HOT_KEYS``, since each
    holds more than that part of all rows. All others are shuffled, none with more rows
    than a task can hold. ``how``: ``left``, or ``inner`` for keys in ``totals`` only.
    """
    n = totals.agg(F.sum(count)).first()[0] or 0
    bound = max(HOT_ROWS, n // HOT_KEYS)
    new = [c for c in totals.columns if c not in (key, count)]
    hot = totals.where(F.col(count) > bound).select(F.col(key).alias("__hot"), F.struct(*new).alias("__found"))
    cold = totals.where(F.col(count) <= bound).select(F.col(key).alias("__cold"), *new)
    marked = rows.join(F.broadcast(hot), rows[key].eqNullSafe(F.col("__hot")), "left")
    missed = marked.where("__found is null").drop("__hot", "__found")
    found = marked.where("__found is not null").select(*rows.columns, *[F.col(f"__found.{c}").alias(c) for c in new])
    # a sorted merge at every size: neither side is bounded
    return found.unionByName(missed.join(cold.hint("merge"), missed[key].eqNullSafe(F.col("__cold")), how).drop("__cold"))
