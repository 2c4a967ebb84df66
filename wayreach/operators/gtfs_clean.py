"""Selecting a service day and repairing a GTFS feed.

Times inside the pipeline are whole seconds after midnight (``t``); text times
appear only at the edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.ordered import MAX_ROWS_PER_GROUP, OrderedGroups, number_rows
from ..functions.skew import merge_join
from ..sources.gtfs import ORDER, fix_ids

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
DAY_S = 86400

# Time columns of a result file that are mirrored around midnight.
RESULT_TIME_COLUMNS = (
    "Start_time",
    "Bus1_start_time",
    "Bus1_finish_time",
    "Bus2_start_time",
    "Bus2_finish_time",
    "Bus3_start_time",
    "Bus3_finish_time",
    "Destination_time",
)


def services_on_date(calendar: DataFrame | None, calendar_dates: DataFrame | None, date: int) -> DataFrame:
    """Services running on ``date`` (yyyymmdd): the weekly calendar, plus and minus exceptions."""
    import datetime

    if calendar is None and calendar_dates is None:
        raise ValueError("a feed needs calendar or calendar_dates")
    weekday = WEEKDAYS[datetime.datetime.strptime(str(date), "%Y%m%d").weekday()]
    running = None
    if calendar is not None:
        running = calendar.filter(
            (F.col("start_date") <= date) & (F.col("end_date") >= date) & (F.col(weekday) == 1)
        ).select("service_id")
    if calendar_dates is not None:
        on_date = calendar_dates.filter(F.col("date") == date)
        added = on_date.filter("exception_type = 1").select("service_id")
        removed = on_date.filter("exception_type = 2").select("service_id")
        running = added if running is None else running.unionAll(added)
        running = running.join(removed, "service_id", "left_anti")
    return running.distinct()


def filter_trips_by_service(trips, stop_times, services) -> tuple[DataFrame, DataFrame]:
    kept = trips.join(services, "service_id", "left_semi")
    return kept, stop_times.join(kept, "trip_id", "left_semi")


def normalise_times(stop_times: DataFrame) -> DataFrame:
    """Two-digit hours, and departure := arrival; missing times stay missing."""
    return stop_times.withColumn("arrival_time", X.normalise_time("arrival_time")).withColumn(
        "departure_time", F.col("arrival_time")
    )


def interpolate_times(
    stop_times: DataFrame,
    order: Sequence[str] = ("stop_sequence",),
    t: str = "t",
    max_rows: int = MAX_ROWS_PER_GROUP,
) -> DataFrame:
    """Fill missing ``t`` inside a trip linearly by row position; ends take the nearest known.

    Filled values are cut to whole seconds; trips without any known time keep nulls.
    """
    groups = OrderedGroups(stop_times, ["trip_id"], [F.col(c) for c in order], max_rows)
    df = groups.row_number("__pos").known_around(t, "__prev", "__next").df
    step = (F.col("__next.v") - F.col("__prev.v")) / F.nullif(
        F.col("__next.pos") - F.col("__prev.pos"), F.lit(0)
    )
    between = F.floor(F.col("__prev.v") + step * (F.col("__pos") - F.col("__prev.pos")))
    filled = F.coalesce(F.col(t), between, F.col("__prev.v"), F.col("__next.v"))
    return df.withColumn(t, filled.cast("long")).select(*stop_times.columns)


def expand_frequencies(
    trips: DataFrame, stop_times: DataFrame, frequencies: DataFrame, keep_template: bool = True
) -> tuple[DataFrame, DataFrame]:
    """One trip per start ``start_s, start_s + headway, ... < end_s`` of each frequency row.

    New ids are ``<trip>_f<start>`` so that the result does not depend on row order. The
    template trip stays in the feed unless ``keep_template`` is false.
    """
    starts = frequencies.filter("start_s < end_s AND headway_secs > 0").withColumn(
        "start",
        F.explode(F.sequence(F.col("start_s"), F.col("end_s") - 1, F.col("headway_secs"))),
    )
    starts = starts.select(
        "trip_id", F.col("start").cast("long"), F.concat_ws("_f", "trip_id", "start").alias("__new")
    )
    used = merge_join(starts, trips, "trip_id", "left_semi")
    first = stop_times.groupBy("trip_id").agg(
        F.min(F.struct("stop_sequence", "t")).getField("t").alias("__t0")
    )
    runs = merge_join(used, first, "trip_id")
    new_times = (
        merge_join(runs, stop_times, "trip_id")
        .withColumn("t", F.col("t") - F.col("__t0") + F.col("start"))
        .withColumn("trip_id", F.col("__new"))
        .select(*stop_times.columns)
    )
    new_trips = (
        merge_join(runs, trips, "trip_id").withColumn("trip_id", F.col("__new")).select(*trips.columns)
    )
    if not keep_template:
        templates = runs.select("trip_id").distinct()
        trips = merge_join(trips, templates, "trip_id", "left_anti")
        stop_times = merge_join(stop_times, templates, "trip_id", "left_anti")
    return trips.unionByName(new_trips), stop_times.unionByName(new_times)


def trip_patterns(trips: DataFrame, stop_times: DataFrame, max_rows: int = MAX_ROWS_PER_GROUP) -> DataFrame:
    """(trip_id, route_id, pattern_id): trips of a route with the same stops share a pattern.

    Stop lists are compared through order-free sums of row hashes, so no list is
    collected. Two independent 64-bit sums and the row count must agree. Patterns are
    numbered inside the route by their smallest trip id.
    """
    row_hash = F.xxhash64("stop_sequence", "stop_id")
    other_hash = F.xxhash64("stop_id", "stop_sequence", F.lit("second"))
    shape = (
        stop_times.groupBy("trip_id")
        .agg(
            F.sum(row_hash.cast("decimal(20,0)")).alias("h1"),
            F.sum(other_hash.cast("decimal(20,0)")).alias("h2"),
            F.count("*").alias("n"),
        )
        .join(trips.select("trip_id", "route_id"), "trip_id")
    )
    same = ["route_id", "h1", "h2", "n"]
    groups = shape.groupBy(*same).agg(F.min("trip_id").alias("first_trip"))
    numbered = number_rows(groups, ["route_id"], [F.col("first_trip")], "rn", max_rows, settle=True)
    pattern = F.concat_ws("_", "route_id", F.col("rn").cast("string"))
    return shape.join(numbered.withColumn("pattern_id", pattern), same).select(
        "trip_id", "route_id", "pattern_id"
    )


def split_route_patterns(
    routes: DataFrame, trips: DataFrame, stop_times: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Routes and trips with one route per stop pattern (``route_1, route_2, ...``)."""
    of_trip = trip_patterns(trips, stop_times)
    new_trips = (
        trips.drop("route_id")
        .join(of_trip.select("trip_id", F.col("pattern_id").alias("route_id")), "trip_id")
        .select(*trips.columns)
    )
    patterns = of_trip.select("route_id", "pattern_id").distinct()
    new_routes = (
        routes.join(patterns, "route_id").withColumn("route_id", F.col("pattern_id")).select(*routes.columns)
    )
    return new_routes, new_trips


def dedupe_repeated_stops(
    trips: DataFrame, stop_times: DataFrame, stops: DataFrame, max_rows: int = MAX_ROWS_PER_GROUP
) -> tuple[DataFrame, DataFrame]:
    """Give the 2nd, 3rd, ... visit of a stop in a pattern its own stop id.

    ``trips.route_id`` is the pattern; its smallest trip id decides. The clones
    ``<stop>#<visit>`` copy the stop's row. Returns (stop_times, stops).
    """
    first_trip = trips.groupBy("route_id").agg(F.min("trip_id").alias("trip_id"))
    rows = stop_times.drop("route_id").join(first_trip, "trip_id")
    rows = rows.select("route_id", "stop_id", "stop_sequence")
    visits = number_rows(
        rows, ["route_id", "stop_id"], [F.col("stop_sequence")], "visit", max_rows, settle=True
    )
    clones = visits.filter("visit > 1").select(
        F.col("route_id").alias("__route"),
        "stop_sequence",
        F.col("stop_id").alias("__old"),
        F.concat_ws("#", "stop_id", F.col("visit").cast("string")).alias("__clone"),
    )
    renamed = (
        stop_times.join(trips.select("trip_id", F.col("route_id").alias("__route")), "trip_id", "left")
        .join(clones, ["__route", "stop_sequence"], "left")
        .withColumn("stop_id", F.coalesce("__clone", "stop_id"))
        .select(*stop_times.columns)
    )
    new_stops = (
        clones.select("__old", "__clone")
        .distinct()
        .join(stops, F.col("__old") == F.col("stop_id"))
        .withColumn("stop_id", F.col("__clone"))
        .select(*stops.columns)
    )
    return renamed, stops.unionByName(new_stops)


def drop_nonmonotone_trips(
    stop_times: DataFrame,
    order: Sequence[str] = ("stop_sequence",),
    max_rows: int = MAX_ROWS_PER_GROUP,
) -> DataFrame:
    """Remove trips whose time falls from one row to the next (equal times are fine)."""
    before = OrderedGroups(stop_times, ["trip_id"], [F.col(c) for c in order], max_rows)
    falling = before.lag("t", "__before").df.filter(F.col("t") < F.col("__before"))
    return stop_times.join(falling.select("trip_id").distinct(), "trip_id", "left_anti")


def renumber_sequence(
    stop_times: DataFrame,
    order: Sequence[str] = ("stop_sequence", "t"),
    max_rows: int = MAX_ROWS_PER_GROUP,
) -> DataFrame:
    """Number the rows 1..n in trips whose sequence repeats, has gaps or does not start at 1."""
    seq = F.col("stop_sequence")
    broken = (
        stop_times.groupBy("trip_id")
        .agg(
            F.max(seq).alias("hi"),
            F.min(seq).alias("lo"),
            F.count(seq).alias("n"),
            F.count_distinct(seq).alias("nd"),
        )
        .withColumn("__broken", ~((F.col("hi") - F.col("lo") + 1 == F.col("nd")) & (F.col("lo") == 1) & (F.col("n") == F.col("nd"))))
        .select("trip_id", "__broken")
    )
    numbered = number_rows(stop_times, ["trip_id"], [F.col(c) for c in order], "__rn", max_rows)
    kind = stop_times.schema["stop_sequence"].dataType
    fixed = F.when(F.col("__broken"), F.col("__rn")).otherwise(seq).cast(kind)
    return (
        numbered.join(broken, "trip_id").withColumn("stop_sequence", fixed).select(*stop_times.columns)
    )


def _with_trip_bounds(stop_times: DataFrame) -> DataFrame:
    bounds = stop_times.groupBy("trip_id").agg(
        F.max("stop_sequence").alias("__hi"), F.min("stop_sequence").alias("__lo")
    )
    return stop_times.join(bounds, "trip_id")


def reverse_sequence(stop_times: DataFrame) -> DataFrame:
    """``max - seq + 1`` inside each trip."""
    df = _with_trip_bounds(stop_times)
    seq = F.col("__hi") - F.col("stop_sequence") + 1
    return df.withColumn("stop_sequence", seq).select(*stop_times.columns)


def mirror_times(stop_times: DataFrame) -> DataFrame:
    """Times mirrored around midnight and sequence ``max - seq + min``; rows past 23:59 dropped."""
    df = _with_trip_bounds(stop_times.filter((F.col("t") >= 0) & (F.col("t") < DAY_S)))
    return (
        df.withColumn("t", mirror_second(F.col("t")))
        .withColumn("stop_sequence", F.col("__hi") - F.col("stop_sequence") + F.col("__lo"))
        .select(*stop_times.columns)
    )


def mirror_second(t: Column) -> Column:
    """24:00:00 - t on a 24-hour clock (midnight stays midnight)."""
    return F.pmod(DAY_S - t, F.lit(DAY_S))


def mirror_result_times(result: DataFrame, columns: Sequence[str] = RESULT_TIME_COLUMNS) -> DataFrame:
    """Mirror the named time columns of a result table; invalid times become null."""

    def mirrored(c):
        t = X.time_to_seconds(c)
        valid = F.col(c).rlike(r"^\s*([01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]\s*$")
        return F.when(valid, X.seconds_to_time(mirror_second(t)))

    return result.withColumns({c: mirrored(c) for c in columns if c in result.columns})


def repeated_stop_report(stop_times: DataFrame) -> DataFrame:
    """(trip_id, stop_id, visits) for stops that a trip visits more than once."""
    visits = stop_times.groupBy("trip_id", "stop_id").agg(F.count("*").alias("visits"))
    return visits.filter("visits > 1")


def delete_routes(
    feed: dict[str, DataFrame], route_ids: DataFrame
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Split a feed into (kept, removed) by a table of ``route_id`` to remove."""
    kept, removed = {}, {}

    def split(name, keep_with, on, remove_with=None, anti=False):
        df = feed[name]
        kept[name] = df.join(keep_with, on, "left_semi")
        removed[name] = df.join(keep_with, on, "left_anti") if anti else df.join(remove_with, on, "left_semi")

    for name in ("routes", "trips"):
        kept[name] = feed[name].join(route_ids, "route_id", "left_anti")
        removed[name] = feed[name].join(route_ids, "route_id", "left_semi")
    # stop times of unknown trips go to the removed feed
    split("stop_times", kept["trips"], "trip_id", anti=True)
    split("stops", kept["stop_times"], "stop_id", removed["stop_times"])
    for name in ("calendar", "calendar_dates"):
        if name in feed:
            split(name, kept["trips"], "service_id", removed["trips"])
    if "shapes" in feed:
        split("shapes", kept["trips"], "shape_id", removed["trips"])
        for side in (kept, removed):
            side["shapes"] = first_rows(side["shapes"], ["shape_id", "shape_pt_sequence"])
    if "agency" in feed:
        kept["agency"] = removed["agency"] = feed["agency"]
    return kept, removed


def first_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The first row of each key: by the place in the files if the rows carry it (``read_gtfs(ordered=True)``).

    Rows of derived tables have no place; for them it is the order in which Spark holds them.
    """
    numbered = df.withColumn("__row", F.col(ORDER) if ORDER in df.columns else F.monotonically_increasing_id())
    first = numbered.groupBy(*key).agg(F.min_by(F.struct(*df.columns), "__row").alias("first"))
    return first.select("first.*")


def _append(base: DataFrame, extra: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Rows of ``base`` and then of ``extra`` in base's columns; with a key, first row wins."""
    extra = extra.select(*[c for c in base.columns if c in extra.columns])
    if key:
        base = first_rows(base, key)
        extra = first_rows(merge_join(extra, base, list(key), "left_anti"), key)
    return base.unionByName(extra, allowMissingColumns=True)


def add_routes(
    base: dict[str, DataFrame],
    other: dict[str, DataFrame],
    route_ids: DataFrame,
    start_date: int,
    end_date: int,
) -> dict[str, DataFrame]:
    """Add the chosen routes of another feed: their trips, times, stops and shapes.

    The added services run daily over [start_date, end_date]; the other feed's
    exceptions are dropped. Stops, routes and services already present win.
    """
    routes = merge_join(other["routes"], route_ids, "route_id", "left_semi")
    trips = merge_join(other["trips"], route_ids, "route_id", "left_semi")
    times = merge_join(fix_ids(other["stop_times"]), trips, "trip_id", "left_semi")
    stops = merge_join(other["stops"], times, "stop_id", "left_semi")
    services = trips.select("service_id").distinct()
    calendar = services.select(
        "service_id",
        *[F.lit(1).alias(d) for d in WEEKDAYS],
        F.lit(start_date).alias("start_date"),
        F.lit(end_date).alias("end_date"),
    )
    out = dict(base)
    out["routes"] = fix_ids(_append(base["routes"], routes, ["route_id"]))
    out["trips"] = fix_ids(_append(base["trips"], trips))
    out["stop_times"] = _append(base["stop_times"], times)
    out["stops"] = fix_ids(_append(base["stops"], stops, ["stop_id"]))
    out["calendar"] = _append(base["calendar"], calendar, ["service_id"]) if "calendar" in base else calendar
    if "shapes" in base or "shapes" in other:
        used = fix_ids(trips.select("shape_id")) if "shape_id" in trips.columns else None
        extra = None
        if "shapes" in other and used is not None:
            extra = merge_join(fix_ids(other["shapes"]), used, "shape_id", "left_semi")
        if "shapes" in base and extra is not None:
            out["shapes"] = _append(base["shapes"], extra, ["shape_id", "shape_pt_sequence"])
        elif extra is not None:
            out["shapes"] = first_rows(extra, ["shape_id", "shape_pt_sequence"])
    return out


def description_column(routes: DataFrame, order: Sequence[str] = ("route_id",)) -> str:
    """The column with the longest text in the first row; earlier columns win ties."""
    first = routes.orderBy(*order).limit(1).select(
        *[F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in routes.columns]
    )
    lengths = first.first()
    return max(routes.columns, key=lambda c: lengths[c] if lengths else 0)


def search_routes(routes: DataFrame, search: str = "") -> DataFrame:
    """Routes whose short name is one of the words searched for (any case); none given shows all."""
    import re

    words = [w.lower() for w in re.split(r"[,\s;]+", search) if w.strip()]
    text = description_column(routes)
    shown = routes.filter(F.lower("route_short_name").isin(words)) if words else routes
    return shown.select("route_id", "route_short_name", F.col(text).cast("string").alias("description"))


def routes_by_shape(
    routes: DataFrame,
    trips: DataFrame,
    shapes: DataFrame,
    piece: int = 1000,
    max_rows: int = MAX_ROWS_PER_GROUP,
) -> DataFrame:
    """Polylines per (shape, route) with the route's attributes.

    A path longer than ``piece`` vertices comes in several rows (``piece_no``), so no
    single row grows without bound; the last vertex of a piece is the first of the next.
    """
    users = trips.select("shape_id", "route_id").distinct()
    points = number_rows(shapes, ["shape_id"], [F.col("shape_pt_sequence")], "pos", max_rows)
    number = F.floor((F.col("pos") - 1) / piece)
    border = (F.col("pos") > 1) & ((F.col("pos") - 1) % piece == 0)
    numbers = F.when(border, F.array(number - 1, number)).otherwise(F.array(number))
    points = points.withColumn("piece_no", F.explode(numbers))
    lines = points.groupBy("shape_id", "piece_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("path")
    )
    # a path that ends on a border needs no further piece
    lines = lines.filter((F.col("piece_no") == 0) | (F.size("path") > 1))
    path = F.transform("path", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return users.join(routes, "route_id").join(lines.withColumn("path", path), "shape_id")


def stops_points(stops: DataFrame, lon0: float, lat0: float) -> DataFrame:
    """Stops with metric coordinates ``x, y`` in the plane around (lon0, lat0)."""
    x, y = X.project_local("stop_lon", "stop_lat", lon0, lat0)
    return stops.withColumn("x", x).withColumn("y", y)
