"""Timetable tables derived from trips and stop times (``t`` in seconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import MAX_ROWS_PER_GROUP, number_rows
from ..functions.skew import merge_join


def trip_stop_times(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Stop times with the route of their trip."""
    return stop_times.drop("route_id").join(trips.select("trip_id", "route_id"), "trip_id")


def pattern_stops(tst: DataFrame) -> DataFrame:
    """One stop per (route, sequence); conflicting stops resolve to the smallest id."""
    return tst.groupBy("route_id", "stop_sequence").agg(F.min("stop_id").alias("stop_id"))


def route_stop_position(patterns: DataFrame, max_rows: int = MAX_ROWS_PER_GROUP) -> DataFrame:
    """0-based position of each stop in its route's list; a repeated stop keeps the last."""
    numbered = number_rows(patterns, ["route_id"], [F.col("stop_sequence")], "rn", max_rows, settle=True)
    return numbered.groupBy("route_id", "stop_id").agg((F.max("rn") - 1).alias("position"))


def stop_events(tst: DataFrame) -> DataFrame:
    """Events ``(route_id, trip_id, seq, stop_id, t, t_first)``.

    ``t_first`` is the trip's first time; trips of a route are ordered by it (then id),
    which is the order in which a rider tries them.
    """
    first = tst.groupBy("trip_id").agg(F.min("t").alias("t_first"))
    return merge_join(tst, first, "trip_id").select(
        "route_id",
        "trip_id",
        F.col("stop_sequence").cast("long").alias("seq"),
        "stop_id",
        F.col("t").cast("long").alias("t"),
        F.col("t_first").cast("long").alias("t_first"),
    )


def mirrored(events: DataFrame) -> DataFrame:
    """The same events for travelling backwards: time and sequence change sign.

    Searching back from an arrival is then the forward search on this table.
    """
    last = events.groupBy("trip_id").agg(F.max("t").alias("__last"))
    return merge_join(events, last, "trip_id").select(
        "route_id",
        "trip_id",
        (-F.col("seq")).alias("seq"),
        "stop_id",
        (-F.col("t")).alias("t"),
        (-F.col("__last")).alias("t_first"),
    )


def trip_order(events: DataFrame, max_rows: int = MAX_ROWS_PER_GROUP) -> DataFrame:
    """Rank of each trip in its route by first time (on mirrored events: by last, descending)."""
    trips = events.select("route_id", "trip_id", "t_first").distinct()
    return number_rows(
        trips, ["route_id"], [F.col("t_first"), F.col("trip_id")], "trip_rank", max_rows, settle=True
    )


def route_stop_index(tst: DataFrame) -> DataFrame:
    """First sequence of each stop on its route (apply to reversed stop times for the way back)."""
    return tst.groupBy("route_id", "stop_id").agg(F.min("stop_sequence").alias("stop_index"))


def routes_by_stop(tst: DataFrame, buildings: DataFrame, building_id: str = "aid") -> DataFrame:
    """Distinct (place_id, route_id); buildings are places that no route serves (null route)."""
    served = tst.select(F.col("stop_id").alias("place_id"), "route_id").distinct()
    unserved = buildings.select(
        F.col(building_id).cast("string").alias("place_id"), F.lit(None).cast("string").alias("route_id")
    ).distinct()
    return served.unionByName(unserved)


def stop_departures(events: DataFrame) -> DataFrame:
    """(stop_id, route_id, trip_id, t) laid out by stop and time.

    Range partitioning on both columns spreads a busy stop over several tasks.
    """
    wanted = events.select("stop_id", "route_id", "trip_id", "t")
    return wanted.repartitionByRange("stop_id", "t").sortWithinPartitions("stop_id", "t")


def available_boardings(
    access: DataFrame,
    departures: DataFrame,
    start: int,
    min_delta: int,
    max_delta: int,
    first_per_route: bool = False,
) -> DataFrame:
    """Departures one can catch: ``start+min <= t <= start+max`` and not before the walk ends.

    ``access`` holds (source, stop_id, walk_s). With ``first_per_route`` only the first
    departure per (source, stop, route) is kept, within ``max_delta`` after the walk.
    """
    t, walk = F.col("t"), F.col("walk_s")
    if not first_per_route:
        open_window = departures.filter((t >= start + min_delta) & (t <= start + max_delta))
        found = access.join(open_window, "stop_id").filter(t >= start + walk)
        return found.select("source", "stop_id", "route_id", "trip_id", "t", "walk_s")
    # each window touches at most two buckets as wide as the window
    width = max_delta + 1
    arrives = start + walk
    buckets = F.sequence(F.floor(arrives / width), F.floor((arrives + max_delta) / width))
    asked = access.withColumn("__bucket", F.explode(buckets))
    offered = departures.filter(t >= start).withColumn("__bucket", F.floor(t / width))
    found = asked.join(offered, ["stop_id", "__bucket"]).filter((t >= arrives) & (t <= arrives + max_delta))
    return (
        found.groupBy("source", "stop_id", "route_id")
        .agg(F.min(F.struct("t", "trip_id", "walk_s")).alias("b"))
        .select("source", "stop_id", "route_id", "b.trip_id", "b.t", "b.walk_s")
    )


def list_stop_ids(stops: DataFrame) -> DataFrame:
    return stops.select("stop_id").distinct()
