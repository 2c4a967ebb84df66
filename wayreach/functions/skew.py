"""Equality joins in which single keys may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys above this number of rows, and above this share of all rows, are split.
MIN_ROWS = 50_000
SHARE = 1000
# Rows that a task should hold of those that are grouped or sorted.
ROWS_PER_TASK = 250_000


def heavy_keys(rows: DataFrame, keys: Sequence[str], min_rows: int | None = None) -> DataFrame:
    """(*keys, __fan): keys with more rows than a task should hold, and over how many to deal them.

    There are fewer than ``SHARE`` of them, since each holds more than that part of the rows.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    bound = max(MIN_ROWS if min_rows is None else min_rows, total // SHARE)
    return counts.where(F.col("n") > bound).select(*keys, F.ceil(F.col("n") / bound).cast("int").alias("__fan"))


def deal(df: DataFrame, rows: int, keys: Sequence, rows_per_task: int | None = None) -> DataFrame:
    """``df`` by its keys in tasks of a bounded share of its ``rows``; small tables are left to Spark.

    Adaptive execution puts shuffled parts together by their packed size, so the share of a task
    grows with the table. What is grouped by these keys afterwards stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    waves = -(-rows // (cores * (rows_per_task or ROWS_PER_TASK)))
    return df if waves <= 1 else df.repartition(waves * cores, *keys)


def merge_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join by sorting both sides, whatever Spark thinks of their sizes.

    Ids in files are many times smaller than in memory, and a side that Spark takes for small
    is built whole on the driver to be broadcast.
    """
    return left.join(right.hint("merge"), on, how)


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], by: str, min_rows: int | None = None) -> DataFrame:
    """Inner join on ``keys`` with the heavy keys of ``left`` dealt by the hash of column ``by``.

    The rows of ``right`` with a heavy key are copied once for every part; the others stay.
    """
    keys = list(keys)
    heavy = F.broadcast(heavy_keys(left, keys, min_rows))
    fan = F.coalesce("__fan", F.lit(1))
    dealt = left.join(heavy, keys, "left").withColumn("__part", F.pmod(F.xxhash64(by), fan.cast("long")).cast("int")).drop("__fan")
    copied = right.join(heavy, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), fan - 1))).drop("__fan")
    # in as many tasks as the session says, since a row may meet many
    dealt = dealt.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "__part")
    return merge_join(dealt, copied, [*keys, "__part"]).drop("__part")
