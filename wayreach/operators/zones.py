"""Hexagons and nearest-building assignment for aggregation and display."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..functions.hexes import HEX_AND_NEIGHBOURS, hex_centre, hex_of
from . import near

# Columns that are ids and therefore never summed.
ID_COLUMNS = ("fid", "osm_id", "id", "aid")


def with_hex(points: DataFrame, side: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    q, r = hex_of("x", "y", side, x0, y0)
    return points.withColumn("q", q).withColumn("r", r)


def hex_grid(buildings: DataFrame, side: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(q, r, cx, cy) of every hexagon that holds a building centroid."""
    cx, cy = hex_centre("q", "r", side, x0, y0)
    return with_hex(buildings, side, x0, y0).select("q", "r").distinct().select(
        "q", "r", cx.alias("cx"), cy.alias("cy")
    )


def _steps(low, high):
    """low..high as rows; nothing if the range is empty."""
    return F.explode(F.when(low <= high, F.sequence(low, high)))


def _hexes_in_box(df: DataFrame, side: float, margin: float, x0: float, y0: float) -> DataFrame:
    """Add (q, r, cx, cy) of hexagons whose centre lies in the box x1..x2, y1..y2 plus a margin."""
    tall = math.sqrt(3.0) * side
    q1 = F.ceil((F.col("x1") - margin - x0) / (1.5 * side))
    q2 = F.floor((F.col("x2") + margin - x0) / (1.5 * side))
    df = df.withColumn("q", _steps(q1, q2))
    r1 = F.ceil((F.col("y1") - margin - y0) / tall - F.col("q") / 2.0)
    r2 = F.floor((F.col("y2") + margin - y0) / tall - F.col("q") / 2.0)
    cx, cy = hex_centre("q", "r", side, x0, y0)
    return df.withColumn("r", _steps(r1, r2)).withColumn("cx", cx).withColumn("cy", cy)


def hex_filter(
    polygons: DataFrame, side: float, ring: str = "ring", x0: float = 0.0, y0: float = 0.0
) -> DataFrame:
    """(q, r, cx, cy) of every hexagon that a building polygon touches.

    Each polygon edge proposes the hexagons near it and keeps those it enters (clipping
    against the hexagon's three strips). Hexagons without an edge can only lie wholly
    inside a polygon, so for the rest it is enough to test centres inside its box.
    """
    s = float(side)
    rings = polygons.filter(F.size(ring) >= 3).select(F.col(ring).alias("ring"))
    n = F.size("ring")
    edges = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.element_at("ring", i).alias("a"),
            F.element_at("ring", F.when(i == n, 1).otherwise(i + 1)).alias("b"),
        ),
    )
    edge = rings.select(F.explode(edges).alias("e")).select(
        *[F.col(f"e.{p}.{k}").alias(p + k) for p in "ab" for k in "xy"]
    )
    boxed = edge.select(
        "*",
        F.least("ax", "bx").alias("x1"),
        F.greatest("ax", "bx").alias("x2"),
        F.least("ay", "by").alias("y1"),
        F.greatest("ay", "by").alias("y2"),
    )
    half = math.sqrt(3.0) * s / 2
    lows, highs = [F.lit(0.0)], [F.lit(1.0)]
    for angle in (math.pi / 2, math.pi / 6, 5 * math.pi / 6):
        nx, ny = math.cos(angle), math.sin(angle)
        da = (F.col("ax") - F.col("cx")) * nx + (F.col("ay") - F.col("cy")) * ny
        slope = (F.col("bx") - F.col("ax")) * nx + (F.col("by") - F.col("ay")) * ny
        safe = F.nullif(slope, F.lit(0.0))
        t1, t2 = (-half - da) / safe, (half - da) / safe
        beside = F.when(F.abs(da) > half, 2.0).otherwise(0.0)
        lows.append(F.when(slope == 0, beside).otherwise(F.least(t1, t2)))
        highs.append(F.when(slope == 0, 1.0).otherwise(F.greatest(t1, t2)))
    entered = _hexes_in_box(boxed, s, s, x0, y0).filter(F.greatest(*lows) <= F.least(*highs))

    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxes = rings.select(
        edges.alias("edges"),
        F.array_min(xs).alias("x1"),
        F.array_max(xs).alias("x2"),
        F.array_min(ys).alias("y1"),
        F.array_max(ys).alias("y2"),
    )

    def crosses_ray(e):
        ay, by = e["a"]["y"], e["b"]["y"]
        above = (ay > F.col("cy")) != (by > F.col("cy"))
        at = e["a"]["x"] + (F.col("cy") - ay) / F.nullif(by - ay, F.lit(0.0)) * (e["b"]["x"] - e["a"]["x"])
        return F.when(above & (at > F.col("cx")), 1).otherwise(0)

    crossings = F.aggregate("edges", F.lit(0), lambda acc, e: acc + crosses_ray(e))
    inside = _hexes_in_box(boxes, s, 0.0, x0, y0).filter(crossings % 2 == 1)
    found = ["q", "r", "cx", "cy"]
    return entered.select(*found).unionAll(inside.select(*found)).distinct()


def hex_nearest_building(
    hexes: DataFrame, buildings: DataFrame, side: float, x0: float = 0.0, y0: float = 0.0
) -> DataFrame:
    """Add ``aid`` of the building nearest to each hexagon's centre; ties to the smallest id.

    Buildings offer themselves to their own and the six adjacent hexagons and one
    aggregation picks the best, combined before the shuffle. Nothing outside those
    seven is nearer than two sides, so answers within that are final; the few
    hexagons left over search on with growing radius.
    """
    offsets = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in HEX_AND_NEIGHBOURS]
    )
    offered = (
        with_hex(buildings, side, x0, y0)
        .withColumn("o", F.explode(offsets))
        .select("aid", "x", "y", (F.col("q") + F.col("o.i")).alias("q"), (F.col("r") + F.col("o.j")).alias("r"))
    )
    cx, cy = hex_centre("q", "r", side, x0, y0)
    d = X.point_distance("x", "y", cx, cy)
    best = offered.groupBy("q", "r").agg(F.min(F.struct(d.alias("d"), "aid")).alias("b"))
    near_by = hexes.join(best.filter(F.col("b.d") <= 2.0 * side), ["q", "r"], "left")
    done = near_by.filter(F.col("b").isNotNull()).select(*hexes.columns, F.col("b.aid").alias("aid"))
    rest = near_by.filter(F.col("b").isNull()).select(*hexes.columns)
    if rest.isEmpty():
        return done
    points = rest.select(*hexes.columns, F.col("cx").alias("x"), F.col("cy").alias("y"))
    far = near.nearest_point(points, buildings.select("aid", "x", "y"), "aid", None, 2.0 * side)
    return done.unionByName(far.select(*hexes.columns, "aid"))


def summed_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name.lower() not in (*ID_COLUMNS, *skip)
    ]


def hex_sum(buildings: DataFrame, side: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Per hexagon: ``numbuildings`` and the sum of every numeric attribute."""
    fields = summed_columns(buildings, ("x", "y", "q", "r"))
    return (
        with_hex(buildings, side, x0, y0)
        .groupBy("q", "r")
        .agg(
            F.count("*").alias("numbuildings"),
            *[F.coalesce(F.sum(f).cast("double"), F.lit(0.0)).alias(f) for f in fields],
        )
    )


def dissolve_zones(hexes: DataFrame) -> DataFrame:
    """One zone per ``aid``: number of hexagons and the sums over all its pieces.

    Which hexagons form a zone stays in the input's (q, r, aid) rows.
    """
    fields = summed_columns(hexes, ("q", "r", "cx", "cy", "x", "y"))
    return hexes.groupBy("aid").agg(F.count("*").alias("n_hexes"), *[F.sum(f).alias(f) for f in fields])


def voronoi_assign(points: DataFrame, buildings: DataFrame, reach: float = 50.0) -> DataFrame:
    """Attach the nearest building within ``reach`` to each point, as clipped Voronoi cells would."""
    return near.nearest_point(points, buildings.select("aid", "x", "y"), "aid", reach)
