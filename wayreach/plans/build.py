"""Building the transit and the car database: cleaned feed, walk network, drive network.

Each returns a dict of DataFrames; ``save``/``load`` keep them as Parquet tables, which
is how the computations are meant to be run repeatedly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.scratch import Scratch
from ..operators import car, gtfs_clean, roads, timetable, walk, zones


def clean_feed(feed: dict[str, DataFrame], date: int | None = None) -> dict[str, DataFrame]:
    """Select the service day and repair the feed; stop times come back in seconds (``t``).

    ``feed`` as from ``sources.gtfs.read_gtfs``. Steps: services of the date, times,
    interpolation, frequencies, stop patterns, repeated stops, falling times, sequences.
    """
    spark = feed["trips"].sparkSession
    scratch = Scratch(spark, "feed")
    trips, times = feed["trips"], feed["stop_times"]
    if date is not None and ("calendar" in feed or "calendar_dates" in feed):
        services = gtfs_clean.services_on_date(feed.get("calendar"), feed.get("calendar_dates"), date)
        trips, times = gtfs_clean.filter_trips_by_service(trips, times, services)
    seconds = X.time_to_seconds("arrival_time").cast("long")
    times = scratch.keep(times.select("trip_id", "stop_id", "stop_sequence", seconds.alias("t")), "read")
    times = scratch.keep(gtfs_clean.interpolate_times(times, ["stop_sequence", "stop_id"]), "timed")
    if "frequencies" in feed:
        runs = feed["frequencies"].select(
            "trip_id",
            X.time_to_seconds("start_time").alias("start_s"),
            X.time_to_seconds("end_time").alias("end_s"),
            F.col("headway_secs").cast("int"),
        )
        trips, times = gtfs_clean.expand_frequencies(trips, times, runs)
        times = scratch.keep(times, "expanded")
    new_routes, trips = gtfs_clean.split_route_patterns(feed["routes"], trips, times)
    trips = scratch.keep(trips, "trips")
    times, stops = gtfs_clean.dedupe_repeated_stops(trips, times, feed["stops"])
    times = gtfs_clean.drop_nonmonotone_trips(scratch.keep(times, "named"), ["stop_sequence", "stop_id"])
    times = scratch.keep(gtfs_clean.renumber_sequence(times, ["stop_sequence", "t", "stop_id"]), "times")
    trips = trips.join(times, "trip_id", "left_semi")
    out = {
        "routes": new_routes.join(trips, "route_id", "left_semi"),
        "trips": trips,
        "stop_times": times,
        "stops": stops.join(times, "stop_id", "left_semi"),
    }
    return out | {k: feed[k] for k in ("shapes", "calendar", "calendar_dates", "agency") if k in feed}


def feed_as_text(feed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The cleaned feed with time text, ready for ``sources.gtfs.write_gtfs``."""
    text = X.seconds_to_time("t")
    times = feed["stop_times"].withColumn("arrival_time", text).withColumn("departure_time", text)
    return feed | {"stop_times": times}


def clean_roads(
    road_links: DataFrame, classes: DataFrame, errors: DataFrame | None = None, tolerance: float = 0.5
) -> DataFrame:
    """Links that meet at common vertices: ends snapped, cut at crossings, repeated and erroneous ones dropped.

    ``errors`` (link_id) names links of the given table. The result has new ids and
    ``source_link``, the link each piece comes from.
    """
    if errors is not None:
        road_links = roads.drop_errored_links(road_links, errors)
    scratch = Scratch(road_links.sparkSession, "clean-roads")
    snapped = scratch.keep(roads.snap_endpoints(road_links, tolerance), "snapped")
    return roads.dedupe_links(scratch.keep(roads.cut_links(snapped), "cut"), classes)


def clean_buildings(raw: DataFrame, order: Sequence[str]) -> DataFrame:
    """Single buildings with ids and centroids (aid, x, y, ring, attributes) from multi-part polygons."""
    return Scratch(raw.sparkSession, "buildings").keep(roads.clean_buildings(raw, order))


def hexagons(buildings: DataFrame, side: float, fields: Sequence[str] = ()) -> DataFrame:
    """The hexagons that hold buildings, each with its nearest building and the sums of ``fields``."""
    scratch = Scratch(buildings.sparkSession, "hexagons")
    grid = scratch.keep(zones.hex_grid(buildings, side), "grid")
    nearest = scratch.keep(zones.hex_nearest_building(grid, buildings, side), "nearest")
    sums = zones.hex_sum(buildings.select("x", "y", *fields), side)
    return nearest.join(sums.drop("cx", "cy"), ["q", "r"], "left")


def transit_database(
    feed: dict[str, DataFrame], road_links: DataFrame, buildings: DataFrame, max_path: float = walk.MAX_PATH_M
) -> dict[str, DataFrame]:
    """Events, footpaths, attachments and walk graph from a cleaned feed with projected stops.

    ``feed['stops']`` has (stop_id, x, y) in the buildings' plane, ``buildings`` (aid, x, y).
    """
    scratch = Scratch(road_links.sparkSession, "transit-db")
    stops = feed["stops"].select(
        X.normalize_id("stop_id").alias("obj_id"), F.lit("s").alias("kind"), F.col("x").cast("double"), F.col("y").cast("double")
    )
    houses = buildings.select(
        F.col("aid").cast("string").alias("obj_id"), F.lit("b").alias("kind"), F.col("x").cast("double"), F.col("y").cast("double")
    )
    linked = scratch.keep(walk.nearest_link(stops.unionAll(houses), road_links, max_path), "linked")
    graph = scratch.keep(walk.build_walk_graph(road_links, linked), "graph")
    attached = walk.attachments(linked)
    times = timetable.trip_stop_times(feed["trips"], feed["stop_times"])
    times = times.withColumn("stop_id", X.normalize_id("stop_id"))
    return {
        "events": scratch.keep(timetable.stop_events(times), "events"),
        "footpaths": scratch.keep(walk.build_footpaths(attached, graph, max_path), "footpaths"),
        "access_lines": walk.access_lines(linked),
        "attachments": attached,
        "walk_graph": graph,
    }


def near_buildings(db: dict[str, DataFrame], sources: DataFrame, max_path: float, speed_kmh: float = 3.6) -> DataFrame:
    """(src, place, walk_s): buildings reached from the source buildings on foot."""
    own = db["attachments"].filter("kind = 'b'").join(sources, F.col("obj_id") == F.col("src"), "left_semi")
    targets = db["attachments"].filter("kind = 'b'")
    start = own.select(F.col("obj_id").alias("from_id"), "node", "access_m")
    reach = walk.walk_reach(start, targets, db["walk_graph"], max_path)
    seconds = X.half_up(F.col("dist_m") * 3.6 / speed_kmh)
    return reach.select(F.col("from_id").alias("src"), F.col("to_id").alias("place"), seconds.alias("walk_s"))


def car_database(
    road_links: DataFrame, buildings: DataFrame, classes: DataFrame, default_speed: int = 30, max_path: float = walk.MAX_PATH_M
) -> dict[str, DataFrame]:
    """Drive edges with compact vertex ids, nearest vertex per building, buildings near each vertex."""
    scratch = Scratch(road_links.sparkSession, "car-db")
    drivable = roads.fill_speeds(roads.drop_no_drive(road_links), classes, default_speed)
    edges = car.drive_edges(drivable)
    original = scratch.keep(walk.build_original_graph(drivable), "original")
    vertices = scratch.keep(walk.coord_to_vertex(original), "vertices")
    houses = buildings.select(
        F.col("aid").cast("string").alias("obj_id"), F.lit("b").alias("kind"), F.col("x").cast("double"), F.col("y").cast("double")
    )
    linked = scratch.keep(walk.nearest_link(houses, drivable, max_path), "linked")
    graph = scratch.keep(walk.build_walk_graph(drivable, linked), "graph")
    attached = walk.attachments(linked)
    reach = scratch.keep(walk.vertex_reach(original, graph, max_path), "reach")
    ids = vertices.select(F.col("vertex_id").alias("node"), F.struct("x", "y").alias("vertex"))
    start = walk.nearest_vertex_of_buildings(reach, attached).join(ids, "vertex")
    close = walk.near_buildings_of_vertices(reach, attached, max_path).join(ids, "vertex")
    aid = F.col("building_id").cast("long")
    return {
        "edges": scratch.keep(walk.by_vertex_id(edges, vertices), "edges"),
        "vertices": vertices,
        "access": scratch.keep(start.select(aid.alias("building"), "node", F.col("dist_m").alias("access_m")), "access"),
        "egress": scratch.keep(close.select("node", aid.alias("building"), F.col("dist_m").alias("egress_m")), "egress"),
    }


def save(db: dict[str, DataFrame], folder: str) -> None:
    for name, df in db.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
