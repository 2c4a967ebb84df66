"""Spatial joins on a square grid: an equi-join on cells plus an exact test.

The grid turns 'near' into an ordinary shuffle join, so Spark partitions it and
adaptive execution splits cells that hold more than their share.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.scratch import Scratch
from ..functions.skew import merge_join

# Offsets of a cell and its eight neighbours.
NEIGHBOUR_OFFSETS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def cell(c: Column | str, size: float) -> Column:
    return F.floor(X.col(c) / F.lit(float(size))).cast("long")


def _cells_around(x, y, size: float) -> Column:
    cx, cy = cell(x, size), cell(y, size)
    return F.array(
        *[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i, j in NEIGHBOUR_OFFSETS]
    )


MAX_PER_CELL = 2000
SMALLEST_SHARE = 64


def fitting_cell(cells_at, size: float, max_rows: int = MAX_PER_CELL) -> float:
    """``size``, halved until no cell holds more than ``max_rows`` (at most 64 times smaller).

    ``cells_at(size)`` gives one row (c) per item and cell. Bounds the pairs a dense
    place can form before the exact test; the result of a join does not depend on it.
    """
    smallest = size / SMALLEST_SHARE
    while size > smallest:
        fullest = cells_at(size).groupBy("c").count().agg(F.max("count")).first()[0] or 0
        if fullest <= max_rows:
            break
        size /= 2
    return size


def within_distance(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """All (left, right) pairs at most ``radius`` apart, with their distance ``d``.

    Both sides have ``x, y``; the left side's come back as ``x, y`` and all other
    column names must differ. Only pairs of neighbouring cells meet.
    """
    lhs = left.withColumn("__c", F.explode(_cells_around("x", "y", radius)))
    rhs = right.withColumnsRenamed({"x": "__rx", "y": "__ry"}).withColumn(
        "__c", F.struct(cell("__rx", radius).alias("cx"), cell("__ry", radius).alias("cy"))
    )
    pairs = merge_join(lhs, rhs, "__c").withColumn("d", X.point_distance("x", "y", "__rx", "__ry"))
    return pairs.filter(F.col("d") <= radius).drop("__c", "__rx", "__ry")


def extent(points: DataFrame, targets: DataFrame) -> float:
    """A distance that no point and target exceed; 0 if there are no points or no targets."""
    boxes = [df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first() for df in (points, targets)]
    if any(v is None for box in boxes for v in box):
        return 0.0
    (a, b, c, d), (e, f, g, h) = boxes
    return math.hypot(max(b, f) - min(a, e), max(d, h) - min(c, g)) + 1.0


def _nearest(points, limit, first, candidates, scratch) -> DataFrame:
    """Resolve each distinct point at the smallest radius that proves its answer.

    ``candidates(todo, r)`` gives (x, y, best) with ``best.d``; an answer found
    within radius r is exact, because everything that near was a candidate. Radii
    double from ``first`` to ``limit``; points without coordinates find nothing.
    """
    todo = points.filter("x IS NOT NULL AND y IS NOT NULL").select("x", "y").distinct()
    r = min(first, limit)
    found = []
    while True:
        answers = candidates(todo, r).filter(F.col("best.d") <= r)
        if r == limit:
            return reduce(DataFrame.unionByName, [*found, answers])
        found.append(scratch.keep(answers, f"found-{r:g}"))
        todo = scratch.keep(todo.join(found[-1], ["x", "y"], "left_anti"), f"todo-{r:g}")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, found)
        r = min(r * 2, limit)


def nearest_point(
    points: DataFrame,
    targets: DataFrame,
    target_id: str,
    limit: float | None,
    first: float | None = None,
) -> DataFrame:
    """Nearest target of each point within ``limit`` (``None``: however far); ties to the smallest id.

    Adds ``<target_id>`` and ``d``; points without a target in reach are dropped.
    Equal points are searched once and equal target places meet only once.
    """
    places = targets.groupBy(F.col("x").alias("tx"), F.col("y").alias("ty")).agg(
        F.min(target_id).alias("tid")
    )

    def candidates(todo, r):
        lhs = todo.withColumn("__c", F.explode(_cells_around("x", "y", r)))
        rhs = places.withColumn("__c", F.struct(cell("tx", r).alias("cx"), cell("ty", r).alias("cy")))
        best = F.struct(X.point_distance("x", "y", "tx", "ty").alias("d"), F.col("tid"))
        return lhs.join(rhs, "__c").groupBy("x", "y").agg(F.min(best).alias("best"))

    def cells_at(r):
        return places.select(F.struct(cell("tx", r).alias("cx"), cell("ty", r).alias("cy")).alias("c"))

    scratch = Scratch(points.sparkSession, "nearest-point")
    if limit is None:
        # however far, but not farther than the data reach
        limit, first = extent(points, targets), first or 50.0
        if not limit:
            kind = targets.schema[target_id].dataType
            return points.select("*", F.lit(None).cast(kind).alias(target_id), F.lit(None).cast("double").alias("d")).limit(0)
    start = fitting_cell(cells_at, float(first or limit))
    best = _nearest(points, limit, start, candidates, scratch)
    return points.join(
        best.select("x", "y", F.col("best.tid").alias(target_id), F.col("best.d").alias("d")), ["x", "y"]
    )


def segment_cells(ax, ay, bx, by, size: float) -> Column:
    """The cells a segment runs through: rows of cells, in each only the columns it crosses."""
    ax, ay, bx, by = (X.col(c).cast("double") for c in (ax, ay, bx, by))
    lo_row, hi_row = cell(F.least(ay, by), size), cell(F.greatest(ay, by), size)
    slope = F.when(ay == by, F.lit(None)).otherwise((bx - ax) / F.nullif(by - ay, F.lit(0.0)))

    def at(y):
        y = F.greatest(F.least(ay, by), F.least(F.greatest(ay, by), y))
        return ax + (y - ay) * slope

    def row_cells(row):
        low, high = at(row * F.lit(float(size))), at((row + 1) * F.lit(float(size)))
        flat = slope.isNull()
        left = F.when(flat, F.least(ax, bx)).otherwise(F.least(low, high))
        right = F.when(flat, F.greatest(ax, bx)).otherwise(F.greatest(low, high))
        return F.transform(
            F.sequence(cell(left - F.lit(1e-6), size), cell(right + F.lit(1e-6), size)),
            lambda column: F.struct(column.alias("cx"), row.alias("cy")),
        )

    return F.flatten(F.transform(F.sequence(lo_row, hi_row), row_cells))


def nearest_segment(
    points: DataFrame, segments: DataFrame, ids: Sequence[str], limit: float, first: float = 50.0
) -> DataFrame:
    """Nearest segment of each point within ``limit``; ties go to the smallest ids.

    ``segments`` has ``ax, ay, bx, by`` and the columns ``ids``. Adds those columns,
    the foot point ``qx, qy``, and ``d``. Exact: radii widen until the best answer
    lies inside the searched radius.
    """

    def candidates(todo, r):
        lhs = todo.withColumn("__c", F.explode(_cells_around("x", "y", r)))
        rhs = segments.withColumn("__c", F.explode(segment_cells("ax", "ay", "bx", "by", r)))
        qx, qy, d = X.closest_on_segment("x", "y", "ax", "ay", "bx", "by")
        best = F.struct(
            d.alias("d"), *ids, qx.alias("qx"), qy.alias("qy"), "ax", "ay", "bx", "by"
        )
        return lhs.join(rhs, "__c").groupBy("x", "y").agg(F.min(best).alias("best"))

    def cells_at(r):
        return segments.select(F.explode(segment_cells("ax", "ay", "bx", "by", r)).alias("c"))

    scratch = Scratch(points.sparkSession, "nearest-segment")
    start = fitting_cell(cells_at, float(min(first, limit)))
    best = _nearest(points, limit, start, candidates, scratch)
    return points.join(best.select("x", "y", "best.*"), ["x", "y"])
