"""Cleaning road links and buildings.

A link is (link_id, geom = array of vertices, fclass, oneway, maxspeed, ...).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.ordered import MAX_ROWS_PER_GROUP, OrderedGroups, number_rows
from ..functions.scratch import Scratch
from . import near

FIRST_BUILDING_ID = 1_000_000
FIRST_LINK_ID = 1
OSM_COLUMNS = ("fclass", "oneway", "maxspeed")


# -- ids and geometry -----------------------------------------------------------


def assign_ids(
    df: DataFrame,
    order: Sequence[str],
    name: str = "aid",
    first: int = FIRST_BUILDING_ID,
    max_rows: int = MAX_ROWS_PER_GROUP,
) -> DataFrame:
    """Serial ids from ``first`` in the order of ``order``."""
    numbered = number_rows(df.drop(name), [], [F.col(c) for c in order], name, max_rows)
    return numbered.withColumn(name, F.col(name) + (first - 1)).select(
        name, *[c for c in df.columns if c != name]
    )


def multiline_to_line(roads: DataFrame, parts: str = "parts", straight: bool = False) -> DataFrame:
    """Multi-part lines to single lines (``geom``).

    Each part becomes its own link; with ``straight`` a multi-part line becomes one
    straight line from its first to its last vertex.
    """
    c = F.col(parts)
    if not straight:
        return roads.withColumn("geom", F.explode(c)).drop(parts)
    first = F.element_at(F.element_at(c, 1), 1)
    last = F.element_at(F.element_at(c, -1), -1)
    line = F.when(F.size(c) == 1, F.element_at(c, 1)).otherwise(F.array(first, last))
    return roads.filter(F.size(c) > 0).withColumn("geom", line).drop(parts)


def segments(roads: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(link_id, seg, ax, ay, bx, by, *keep): the consecutive vertex pairs of each link."""
    pairs = F.transform(
        F.arrays_zip(
            F.slice("geom", F.lit(1), F.size("geom") - 1).alias("a"),
            F.slice("geom", F.lit(2), F.size("geom") - 1).alias("b"),
        ),
        lambda p: p,
    )
    long = roads.filter(F.size("geom") >= 2).select("link_id", *keep, F.posexplode(pairs).alias("seg", "p"))
    return long.select(
        "link_id",
        "seg",
        *[F.col(f"p.{e}.{k}").cast("double").alias(e + k) for e in "ab" for k in "xy"],
        *keep,
    )


# -- topology -----------------------------------------------------------------------


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): root is the smallest node of the component (isolated nodes are absent).

    Alternates the published large-star and small-star steps, each one aggregation and
    one join, so neighbourhoods are never collected and rounds grow with log(size).
    """

    def star(pairs, large):
        if large:
            both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("lo"))
        low = low.withColumn("lo", F.least("lo", "u")) if large else low
        hung = both.join(low, "u")
        if large:
            out = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("lo").alias("v"))
        else:
            out = hung.select(F.col("v").alias("u"), F.col("lo").alias("v")).unionAll(
                low.select("u", F.col("lo").alias("v"))
            )
        return out.filter(F.col("u") != F.col("v")).distinct()

    def mark(pairs):
        return pairs.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).cast("string")
        ).first()

    pairs = scratch.keep(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), "cc")
    seen = mark(pairs)
    while True:
        pairs = scratch.replace(pairs, star(star(pairs, True), False), "cc")
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root")).distinct()


def snap_endpoints(roads: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Move link ends that lie within ``tolerance`` of each other (chains included) onto one point.

    Points of one small cell belong together without testing pairs; only points of
    neighbouring cells are compared. The smallest point of a group represents it.
    """
    side = tolerance / math.sqrt(2) * (1 - 1e-9)
    scratch = Scratch(roads.sparkSession, "snap")
    start, end = F.element_at("geom", 1), F.element_at("geom", -1)
    ends = roads.select(F.explode(F.array(start, end)).alias("p")).distinct()
    at = F.struct(near.cell("p.x", side).alias("cx"), near.cell("p.y", side).alias("cy"))
    points = scratch.keep(ends.select("p", at.alias("c")), "ends")
    offsets = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    around = F.array(
        *[
            F.struct((F.col("c.cx") + i).alias("cx"), (F.col("c.cy") + j).alias("cy"))
            for i, j in offsets
        ]
    )
    others = points.select(F.col("p").alias("p2"), F.col("c").alias("n"))
    close = (
        points.withColumn("n", F.explode(around))
        .join(others, "n")
        .filter(X.point_distance("p.x", "p.y", "p2.x", "p2.y") <= tolerance)
        .select(F.col("c").alias("u"), F.col("n").alias("v"))
        .distinct()
    )
    roots = connected_components(close, scratch)
    grouped = points.join(roots, F.col("c") == F.col("node"), "left").withColumn(
        "g", F.coalesce("root", "c")
    )
    target = grouped.groupBy("g").agg(F.min("p").alias("to"))
    moves = grouped.join(target, "g").filter(F.col("p") != F.col("to")).select("p", "to")
    moves = scratch.keep(moves, "moves")
    m1 = moves.select(F.col("p").alias("__s"), F.col("to").alias("__st"))
    m2 = moves.select(F.col("p").alias("__e"), F.col("to").alias("__et"))
    moved = roads.join(m1, start == F.col("__s"), "left").join(m2, end == F.col("__e"), "left")
    inner = F.slice("geom", F.lit(2), F.greatest(F.size("geom") - 2, F.lit(0)))
    geom = F.concat(
        F.array(F.coalesce("__st", start)), inner, F.array(F.coalesce("__et", end))
    )
    return moved.withColumn("geom", geom).select(*roads.columns)


def _meeting(a: str, b: str) -> Column:
    """Positions 0..1 on segment ``a`` at which segment ``b`` meets it (array)."""

    def c(s, k):
        return F.col(f"{s}.{k}")

    rx, ry = c(a, "bx") - c(a, "ax"), c(a, "by") - c(a, "ay")
    sx, sy = c(b, "bx") - c(b, "ax"), c(b, "by") - c(b, "ay")
    wx, wy = c(b, "ax") - c(a, "ax"), c(b, "ay") - c(a, "ay")
    cross = rx * sy - ry * sx
    safe = F.nullif(cross, F.lit(0.0))
    t, u = (wx * sy - wy * sx) / safe, (wx * ry - wy * rx) / safe
    length = F.nullif(rx * rx + ry * ry, F.lit(0.0))

    def on(px, py):
        dx, dy = px - c(a, "ax"), py - c(a, "ay")
        return F.when((rx * dy - ry * dx) == 0, (dx * rx + dy * ry) / length)

    overlap = F.array(on(c(b, "ax"), c(b, "ay")), on(c(b, "bx"), c(b, "by")))
    hits = F.when(cross == 0, overlap).otherwise(
        F.array(F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), t))
    )
    return F.filter(hits, lambda v: v.isNotNull() & (v >= 0) & (v <= 1))


def break_crossings(
    roads: DataFrame, cell_m: float = 100.0, max_rows: int = MAX_ROWS_PER_GROUP
) -> DataFrame:
    """Cut links where another link meets or crosses them.

    Long result (link_id, piece, seq, ax, ay, bx, by): ``piece`` counts the parts of a
    link, ``seq`` the segments in link order. Only segments of one grid cell are compared,
    and cells shrink where links are dense.
    """
    segs = segments(roads)
    cell_m = near.fitting_cell(
        lambda size: segs.select(F.explode(near.segment_cells("ax", "ay", "bx", "by", size)).alias("c")), cell_m
    )
    celled = segs.withColumn("c", F.explode(near.segment_cells("ax", "ay", "bx", "by", cell_m)))
    a, b = celled.alias("a"), celled.alias("b")
    met = a.join(b, (F.col("a.c") == F.col("b.c")) & (F.col("a.link_id") != F.col("b.link_id")))
    cuts = (
        met.select(
            F.col("a.link_id").alias("link_id"),
            F.col("a.seg").alias("seg"),
            *[F.col(f"a.{k}").alias(k) for k in ("ax", "ay", "bx", "by")],
            F.explode(_meeting("a", "b")).alias("t"),
        )
        .withColumn("pos", F.round(F.col("seg") + F.col("t"), 9))
        .groupBy("link_id", "pos")
        .agg(
            F.min(
                F.struct(
                    (F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax"))).alias("x"),
                    (F.col("ay") + F.col("t") * (F.col("by") - F.col("ay"))).alias("y"),
                )
            ).alias("p")
        )
        .select("link_id", "pos", "p", F.lit(1).alias("cut"))
    )
    vertices = roads.select("link_id", F.posexplode("geom").alias("i", "p")).select(
        "link_id", F.col("i").cast("double").alias("pos"), "p", F.lit(0).alias("cut")
    )
    marks = (
        vertices.unionByName(cuts)
        .groupBy("link_id", "pos")
        .agg(F.min(F.struct("cut", "p")).alias("m"), F.max("cut").alias("cut"))
        .select("link_id", "pos", F.col("m.p").alias("p"), "cut")
    )
    rows = OrderedGroups(marks, ["link_id"], [F.col("pos")], max_rows, settle=True)
    df = rows.lag("p", "q").running_sum("cut", "cuts").row_number("rn").result()
    # a cut at a link's own start does not open a new piece
    starts = df.filter("rn = 1 AND cut = 1").select("link_id", F.lit(1).alias("at_start"))
    return (
        df.filter("rn > 1")
        .join(starts, "link_id", "left")
        .select(
            "link_id",
            (F.col("cuts") - F.col("cut") - F.coalesce("at_start", F.lit(0)) + 1).alias("piece"),
            (F.col("rn") - 1).alias("seq"),
            F.col("q.x").alias("ax"),
            F.col("q.y").alias("ay"),
            F.col("p.x").alias("bx"),
            F.col("p.y").alias("by"),
        )
        .filter("ax <> bx OR ay <> by")
    )


def cut_links(roads: DataFrame, cell_m: float = 100.0, max_rows: int = MAX_ROWS_PER_GROUP) -> DataFrame:
    """``roads`` cut where they meet, as links again: new ids, geometry, all other attributes.

    ``source_link`` names the link a piece comes from; ids follow (source_link, piece).
    """
    pieces = Scratch(roads.sparkSession, "cut-links").keep(break_crossings(roads, cell_m, max_rows), "pieces")
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    steps = F.array_sort(F.collect_list(F.struct("seq", point("ax", "ay").alias("a"), point("bx", "by").alias("b"))))
    lines = pieces.groupBy("link_id", "piece").agg(steps.alias("steps"))
    geom = F.concat(F.array(F.element_at("steps", 1)["a"]), F.transform("steps", lambda s: s["b"]))
    lines = lines.select(F.col("link_id").alias("source_link"), "piece", geom.alias("geom"))
    attributes = roads.withColumnRenamed("link_id", "source_link").drop("geom", "piece")
    ided = assign_ids(lines.join(attributes, "source_link"), ["source_link", "piece"], "link_id", FIRST_LINK_ID, max_rows)
    return ided.select(*roads.columns, "source_link")


def dedupe_links(roads: DataFrame, classes: DataFrame) -> DataFrame:
    """Of links with the same vertices (either direction) keep the highest priority, then lowest id."""
    prio = F.coalesce("priority", F.lit(0))
    ranked = roads.join(
        classes.select(F.col("link_type").alias("fclass"), "priority"), "fclass", "left"
    ).withColumn("__p", -prio)
    same = F.least("geom", F.reverse("geom"))
    rest = [c for c in roads.columns if c != "link_id"]
    best = ranked.groupBy(same.alias("__g")).agg(F.min(F.struct("__p", "link_id", *rest)).alias("b"))
    return best.select(*[F.col(f"b.{c}").alias(c) for c in roads.columns])


def drop_errored_links(roads: DataFrame, errors: DataFrame, error_id: str = "link_id") -> DataFrame:
    return roads.join(errors.select(F.col(error_id).alias("link_id")), "link_id", "left_anti")


# -- attributes ------------------------------------------------------------------


def drop_no_drive(roads: DataFrame) -> DataFrame:
    return roads.filter(F.col("oneway").isNull() | (F.col("oneway") != "N"))


def fill_speeds(roads: DataFrame, classes: DataFrame, default: int = 30) -> DataFrame:
    """Missing or zero speeds: the class default, else ``default``."""
    speeds = classes.select(F.col("link_type").alias("fclass"), F.col("speed_km_h").alias("__s"))
    given = F.nullif(F.col("maxspeed").try_cast("double"), F.lit(0.0))
    filled = F.coalesce(given, F.col("__s").cast("double"), F.lit(float(default)))
    return roads.join(speeds, "fclass", "left").withColumn("maxspeed", filled).select(*roads.columns)


def flip_direction(roads: DataFrame) -> DataFrame:
    """For travelling towards a place: T and F swap, anything else becomes B."""
    flipped = F.when(F.col("oneway") == "T", "F").when(F.col("oneway") == "F", "T").otherwise("B")
    return roads.withColumn("oneway", flipped)


def road_attr_test(
    roads: DataFrame, classes: DataFrame, directions: DataFrame, pass_percent: float = 99.0
) -> DataFrame:
    """Percent of links with a known direction and a plausible speed, and whether both pass."""
    bounds = classes.agg(F.min("speed_km_h"), F.max("speed_km_h")).first()
    low, high = bounds
    speed = F.col("maxspeed").try_cast("double")
    known = directions.select(F.col("direction_type").alias("oneway"), F.lit(1).alias("__ok"))
    checked = roads.join(known.distinct(), "oneway", "left")
    percent = [
        (F.avg(F.when(F.col("__ok") == 1, 100.0).otherwise(0.0))).alias("oneway_pct"),
        (F.avg(F.when((speed == 0) | speed.between(low, high), 100.0).otherwise(0.0))).alias("maxspeed_pct"),
    ]
    return checked.agg(*percent).withColumn(
        "passed", (F.col("oneway_pct") >= pass_percent) & (F.col("maxspeed_pct") >= pass_percent)
    )


def is_osm_schema(roads: DataFrame) -> bool:
    return set(OSM_COLUMNS) <= {c.lower() for c in roads.columns}


# -- buildings -------------------------------------------------------------------


def centroids(buildings: DataFrame, ring: str = "ring") -> DataFrame:
    """Add ``x, y`` of the outer ring's centroid."""
    centre = X.ring_centroid(ring)
    return buildings.withColumn("__c", centre).select(
        *buildings.columns, F.col("__c.x").alias("x"), F.col("__c.y").alias("y")
    )


def clean_buildings(
    raw: DataFrame,
    order: Sequence[str],
    polygons: str = "polygons",
    max_rows: int = MAX_ROWS_PER_GROUP,
) -> DataFrame:
    """Single-part buildings without holes, with ids, without repeated centroids.

    ``polygons`` is an array of polygons, each an array of rings, outer ring first.
    Of buildings whose centroids agree to six decimals the first id stays.
    """
    attributes = [c for c in raw.columns if c != polygons]
    parts = raw.filter(F.col(polygons).isNotNull()).select(
        *attributes, F.posexplode(polygons).alias("part", "rings")
    )
    outer = parts.withColumn("ring", F.get("rings", F.lit(0))).filter(F.size("ring") > 0)
    ided = assign_ids(outer.drop("rings"), [*order, "part"], max_rows=max_rows)
    placed = centroids(ided)
    spot = [X.half_up("x", 6).alias("__x"), X.half_up("y", 6).alias("__y")]
    rest = [c for c in placed.columns if c != "aid"]
    first = placed.groupBy(*spot).agg(F.min(F.struct("aid", *rest)).alias("b"))
    return first.select("b.*").drop("part")
