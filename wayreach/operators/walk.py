"""Walking: linking objects to roads, the walk graph, reach and footpaths.

Objects are (obj_id string, kind 's' or 'b', x, y). Distances are metres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.ordered import MAX_ROWS_PER_GROUP, number_rows
from . import near
from .relax import shortest
from .roads import segments

MAX_PATH_M = 400.0


def nearest_link(objects: DataFrame, roads: DataFrame, max_path: float = MAX_PATH_M) -> DataFrame:
    """Nearest road segment of each object within ``max_path``: link, segment, foot point.

    ``access_m`` is the distance rounded to whole metres, ``d`` the exact one.
    """
    found = near.nearest_segment(objects, segments(roads), ["link_id", "seg"], max_path)
    return found.withColumn("access_m", X.half_up("d"))


def _node(x: str, y: str) -> Column:
    return F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def link_edges(linked: DataFrame) -> DataFrame:
    """Two edges per linked object: foot point to both ends of its segment (node = struct<x,y>)."""
    ends = F.array(_node("ax", "ay"), _node("bx", "by"))
    long = linked.select("obj_id", "kind", "access_m", _node("qx", "qy").alias("u"), F.explode(ends).alias("v"))
    return long.withColumn("w", X.point_distance("u.x", "u.y", "v.x", "v.y"))


def access_lines(linked: DataFrame) -> DataFrame:
    """Lines from buildings to their foot points, with building and link ids."""
    return linked.filter("kind = 'b'").select(
        "obj_id", "kind", "link_id", F.col("x").cast("double"), F.col("y").cast("double"), "qx", "qy"
    )


def build_original_graph(roads: DataFrame) -> DataFrame:
    """Undirected edges (u, v, w) between consecutive vertices of unsplit roads, both ways."""
    segs = segments(roads).select(_node("ax", "ay").alias("u"), _node("bx", "by").alias("v"))
    both = segs.unionAll(segs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.distinct().withColumn("w", X.point_distance("u.x", "u.y", "v.x", "v.y"))


def build_walk_graph(roads: DataFrame, linked: DataFrame) -> DataFrame:
    """The road graph plus the edges that tie foot points to segment ends."""
    ties = link_edges(linked).select("u", "v", "w")
    both = ties.unionAll(ties.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    return build_original_graph(roads).unionByName(both).distinct()


def attachments(linked: DataFrame) -> DataFrame:
    """(obj_id, kind, node, access_m): where each object meets the walk graph."""
    return linked.select("obj_id", "kind", _node("qx", "qy").alias("node"), "access_m")


def coord_to_vertex(edges: DataFrame, max_rows: int = MAX_ROWS_PER_GROUP) -> DataFrame:
    """(vertex_id, x, y): ids 0.. for the distinct end points, ordered by coordinates."""
    nodes = edges.select("u.x", "u.y").unionAll(edges.select("v.x", "v.y")).distinct()
    numbered = number_rows(nodes, [], [F.col("x"), F.col("y")], "rn", max_rows, settle=True)
    return numbered.select((F.col("rn") - 1).alias("vertex_id"), "x", "y")


def by_vertex_id(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with compact vertex ids in place of coordinates."""
    keyed = vertices.select("vertex_id", F.struct("x", "y").alias("p"))
    u = keyed.select(F.col("vertex_id").alias("__u"), F.col("p").alias("u"))
    v = keyed.select(F.col("vertex_id").alias("__v"), F.col("p").alias("v"))
    return edges.join(u, "u").join(v, "v").select(F.col("__u").alias("u"), F.col("__v").alias("v"), "w")


def walk_reach(
    sources: DataFrame, attached: DataFrame, edges: DataFrame, max_path: float = MAX_PATH_M
) -> DataFrame:
    """(from_id, to_id, kind, dist_m): objects within ``max_path`` metres of the sources on foot.

    ``sources`` (from_id, node, access_m) are searched once per distinct node; the total
    of access, way and egress is rounded and the least per target kept. A stop does not
    reach itself.
    """
    left = F.lit(float(max_path)) - F.col("access_m")
    budgeted = sources.withColumn("budget", left.cast("double")).filter("budget > 0")
    seeds = budgeted.groupBy("node").agg(F.max("budget").alias("budget")).select(
        F.col("node").alias("src"), "node", F.lit(0.0).alias("d"), "budget"
    )
    reach = shortest(seeds, edges, "walk")
    targets = attached.select(
        F.col("obj_id").alias("to_id"), "kind", "node", F.col("access_m").alias("egress_m")
    )
    total = X.half_up(F.col("access_m") + F.col("d") + F.col("egress_m"))
    pairs = (
        budgeted.withColumnRenamed("node", "src")
        .join(reach, "src")
        .filter(F.col("d") <= F.col("budget"))
        .join(targets, "node")
        .withColumn("dist_m", total)
        .filter(F.col("dist_m") <= max_path)
        .filter((F.col("kind") == "b") | (F.col("to_id") != F.col("from_id")))
    )
    return pairs.groupBy("from_id", "to_id", "kind").agg(F.min("dist_m").alias("dist_m"))


def build_footpaths(attached: DataFrame, edges: DataFrame, max_path: float = MAX_PATH_M) -> DataFrame:
    """(from_id, from_kind, to_id, to_kind, dist_m): stop to stop, stop to building and back."""
    stops = attached.filter("kind = 's'").select(F.col("obj_id").alias("from_id"), "node", "access_m")
    reach = walk_reach(stops, attached, edges, max_path).withColumnRenamed("kind", "to_kind")
    out = reach.select("from_id", F.lit("s").alias("from_kind"), "to_id", "to_kind", "dist_m")
    back = out.filter("to_kind = 'b'").select(
        F.col("to_id").alias("from_id"),
        F.lit("b").alias("from_kind"),
        F.col("from_id").alias("to_id"),
        F.lit("s").alias("to_kind"),
        "dist_m",
    )
    return out.unionAll(back)


def vertex_reach(original: DataFrame, edges: DataFrame, max_path: float = MAX_PATH_M) -> DataFrame:
    """(vertex, node, d): walking distances from every vertex of the unsplit roads."""
    seeds = original.select("u").distinct().select(
        F.col("u").alias("src"), F.col("u").alias("node"), F.lit(0.0).alias("d"), F.lit(float(max_path)).alias("budget")
    )
    return shortest(seeds, edges, "vertex").withColumnRenamed("src", "vertex")


def near_buildings_of_vertices(
    reach: DataFrame, attached: DataFrame, max_path: float = MAX_PATH_M
) -> DataFrame:
    """(vertex, building_id, dist_m): all buildings within ``max_path`` of each vertex."""
    buildings = attached.filter("kind = 'b'").select(F.col("obj_id").alias("building_id"), "node", "access_m")
    total = X.half_up(F.col("d") + F.col("access_m"))
    near_by = reach.join(buildings, "node").withColumn("dist_m", total).filter(F.col("dist_m") <= max_path)
    return near_by.groupBy("vertex", "building_id").agg(F.min("dist_m").alias("dist_m"))


def nearest_vertex_of_buildings(reach: DataFrame, attached: DataFrame) -> DataFrame:
    """(building_id, vertex, dist_m): the nearest vertex of the unsplit roads; ties to the smallest.

    The walk graph is undirected, so distances from vertices serve as distances to them.
    """
    buildings = attached.filter("kind = 'b'").select(F.col("obj_id").alias("building_id"), "node", "access_m")
    best = reach.groupBy("node").agg(F.min(F.struct("d", "vertex")).alias("b"))
    return buildings.join(best, "node").select(
        "building_id", F.col("b.vertex").alias("vertex"), X.half_up(F.col("b.d") + F.col("access_m")).alias("dist_m")
    )


def footpath_lists(
    footpaths: DataFrame, page: int = 1000, max_rows: int = MAX_ROWS_PER_GROUP
) -> DataFrame:
    """(from_id, page_no, paths): each place's (to_id, dist_m) list, ordered, in pages.

    A page holds at most ``page`` entries, so no place can grow one row without bound.
    """
    order = [F.col("dist_m"), F.col("to_id")]
    numbered = number_rows(footpaths.select("from_id", "to_id", "dist_m"), ["from_id"], order, "pos", max_rows)
    paged = numbered.withColumn("page_no", F.floor((F.col("pos") - 1) / page))
    entry = F.struct("pos", "to_id", "dist_m")
    return paged.groupBy("from_id", "page_no").agg(F.array_sort(F.collect_list(entry)).alias("paths"))
