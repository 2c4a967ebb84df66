"""Ordered work inside groups whose size nobody can promise.

A window over a key puts the whole group into one task. ``OrderedGroups`` first
measures the largest group. While it stays below a bound the plain window is
used; beyond it the rows are range-partitioned by (key, order) so that a hot
group is cut into consecutive chunks, windows run per chunk, and a small table
of chunk summaries carries numbers and last values across the chunk borders.
Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

MAX_ROWS_PER_GROUP = 500_000
CHUNK = "__chunk"


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    counts = df.groupBy(*keys).count() if keys else df.select(F.count("*").alias("count"))
    return counts.agg(F.max("count")).first()[0] or 0


class OrderedGroups:
    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[Column],
        max_rows: int = MAX_ROWS_PER_GROUP,
        settle: bool = False,
    ):
        """``settle`` writes ``df`` first: right when measuring it would repeat costly work."""
        self.keys, self.order = list(keys), list(order)
        if settle:
            df = Scratch(df.sparkSession, "ordered").keep(df, "input")
        self.chunked = largest_group(df, self.keys) > max_rows
        if self.chunked:
            spark = df.sparkSession
            slices = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
            ranged = df.repartitionByRange(slices, *[F.col(k) for k in self.keys], *self.order)
            self.df = Scratch(spark, "ordered").keep(
                ranged.withColumn(CHUNK, F.spark_partition_id()), "chunks"
            )
        else:
            self.df = df.withColumn(CHUNK, F.lit(0))

    @property
    def window(self):
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*self.order)

    def _replace(self, df: DataFrame) -> OrderedGroups:
        self.df = df
        return self

    def _with_carry(self, per_chunk: DataFrame, carried: dict[str, Column], backwards=False) -> DataFrame:
        """Attach, to every row, values taken from the chunks before (after) its own."""
        by_chunk = F.col(CHUNK).desc() if backwards else F.col(CHUNK)
        earlier = (
            Window.partitionBy(*self.keys)
            .orderBy(by_chunk)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        summary = per_chunk.select(
            *self.keys, CHUNK, *[c.over(earlier).alias(n) for n, c in carried.items()]
        )
        # keys may be null, so the join compares them null-safely
        left, right = self.df.alias("l"), summary.alias("r")
        same = F.lit(True)
        for k in [*self.keys, CHUNK]:
            same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        return left.join(right, same, "left").select("l.*", *[f"r.{n}" for n in carried])

    def row_number(self, name: str) -> OrderedGroups:
        local = F.row_number().over(self.window)
        if not self.chunked:
            return self._replace(self.df.withColumn(name, local.cast("long")))
        sizes = self.df.groupBy(*self.keys, CHUNK).agg(F.count("*").alias("__n"))
        df = self._with_carry(sizes, {"__before": F.sum("__n")})
        return self._replace(
            df.withColumn(name, (local + F.coalesce("__before", F.lit(0))).cast("long")).drop("__before")
        )

    def lag(self, value: str, name: str) -> OrderedGroups:
        local = F.lag(value).over(self.window)
        if not self.chunked:
            return self._replace(self.df.withColumn(name, local))
        numbered = self.df.withColumn("__rn", F.row_number().over(self.window))
        ends = numbered.groupBy(*self.keys, CHUNK).agg(
            F.max(F.struct("__rn", F.col(value).alias("__v"))).alias("__end")
        )
        self.df = numbered
        df = self._with_carry(ends, {"__prev": F.last("__end")})
        value_before = F.when(F.col("__rn") == 1, F.col("__prev.__v")).otherwise(local)
        return self._replace(df.withColumn(name, value_before).drop("__rn", "__prev"))

    def running_sum(self, value: str, name: str) -> OrderedGroups:
        """Sum of ``value`` over the rows up to and including each row."""
        local = F.sum(value).over(self.window.rowsBetween(Window.unboundedPreceding, 0))
        if not self.chunked:
            return self._replace(self.df.withColumn(name, local))
        sums = self.df.groupBy(*self.keys, CHUNK).agg(F.sum(value).alias("__s"))
        df = self._with_carry(sums, {"__before": F.sum("__s")})
        total = local + F.coalesce("__before", F.lit(0))
        return self._replace(df.withColumn(name, total).drop("__before"))

    def known_around(self, value: str, prev: str, following: str) -> OrderedGroups:
        """Nearest known (non-null) ``value`` at or before, and at or after, each row."""
        payload = F.when(
            F.col(value).isNotNull(), F.struct(F.col("__pos").alias("pos"), F.col(value).alias("v"))
        )
        if "__pos" not in self.df.columns:
            self.row_number("__pos")
        back = self.window.rowsBetween(Window.unboundedPreceding, 0)
        ahead = self.window.rowsBetween(0, Window.unboundedFollowing)
        df = self.df.withColumn("__known", payload)
        self.df = df
        prev_local = F.last("__known", ignorenulls=True).over(back)
        next_local = F.first("__known", ignorenulls=True).over(ahead)
        if self.chunked:
            ends = df.groupBy(*self.keys, CHUNK).agg(
                F.max("__known").alias("__last"), F.min("__known").alias("__first")
            )
            self.df = self._with_carry(ends, {"__bp": F.last("__last", ignorenulls=True)})
            self.df = self._with_carry(ends, {"__bn": F.last("__first", ignorenulls=True)}, True)
            prev_local = F.coalesce(prev_local, F.col("__bp"))
            next_local = F.coalesce(next_local, F.col("__bn"))
        df = self.df.withColumn(prev, prev_local).withColumn(following, next_local)
        return self._replace(df.drop("__known", "__bp", "__bn"))

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK, "__pos")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "rn",
    max_rows: int = MAX_ROWS_PER_GROUP,
    settle: bool = False,
) -> DataFrame:
    """1-based row number inside each key, exact however large one key is."""
    return OrderedGroups(df, keys, order, max_rows, settle).row_number(name).result()
