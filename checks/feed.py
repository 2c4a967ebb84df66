"""Sources, feed cleaning and timetable tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayreach.functions import expr as X
from wayreach.functions.scratch import Scratch
from wayreach.operators import gtfs_clean as G
from wayreach.operators import timetable as TT
from wayreach.sources import gtfs, tables

from .derived import LAT0, LON0, Inputs
from .registry import check

MONDAY = 20240205


def _text(*columns):
    return "CONCAT_WS('|', " + ", ".join(f"CAST({c} AS STRING)" for c in columns) + ")"


DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

def write_feed(i: Inputs) -> str:
    """The derived feed as GTFS text files in the scratch folder."""
    folder = Scratch(i.spark, "feed").root
    times = i.stop_times_txt.withColumn("departure_time", F.col("arrival_time"))
    feed = {
        "stops": i.stops.select("stop_id", "stop_lat", "stop_lon"),
        "stop_times": times,
        "trips": i.trips,
        "routes": i.routes,
        "calendar": i.calendar,
        "calendar_dates": i.calendar_dates,
    }
    gtfs.write_gtfs(feed, folder)
    return folder


@check(
    "s1_read_gtfs",
    """SELECT stop_id, stop_lat, stop_lon FROM {stops} WHERE stop_id IN (SELECT stop_id FROM {stop_times})""",
)
def _(i):
    return gtfs.read_gtfs(i.spark, write_feed(i))["stops"]


@check(
    "s2_read_gtfs_raw",
    """SELECT trip_id, arrival_time, arrival_time AS departure_time, stop_id,
       CAST(stop_sequence AS STRING) AS stop_sequence FROM {stop_times_txt}""",
)
def _(i):
    return gtfs.read_gtfs_raw(i.spark, write_feed(i), "stop_times")


@check(
    "s3_validate_gtfs",
    """SELECT f.file AS file, c.chk AS "check", (SELECT COUNT(*) FROM {orders}) > 0 AS ok
FROM (VALUES ('routes.txt', 'route_id'), ('stops.txt', 'stop_id'), ('stop_times.txt', 'trip_id'), ('trips.txt', 'trip_id')) f(file, col)
JOIN (VALUES ('exists'), ('has header'), ('has ')) c0(kind) ON TRUE
JOIN LATERAL (SELECT CASE WHEN kind = 'has ' THEN CONCAT(kind, col) ELSE kind END AS chk) c ON TRUE""",
)
def _(i):
    return gtfs.validate_gtfs(i.spark, write_feed(i))


@check(
    "s4_gtfs_date_range",
    """SELECT CAST(MIN(d) AS STRING) AS first_date, CAST(MAX(d) AS STRING) AS last_date, COUNT(d) > 0 AS found
FROM (SELECT start_date AS d FROM {calendar} UNION ALL SELECT end_date FROM {calendar} UNION ALL SELECT date FROM {calendar_dates}) z""",
)
def _(i):
    return gtfs.gtfs_date_range(i.calendar, i.calendar_dates)


SQUARE_SQL = """SELECT aid, jobs, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM {buildings}"""


def square(half=5.0):
    """A square ring around (x, y), as array<struct<x,y>>."""
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    return F.array(
        *[
            F.struct((F.col("x") + dx * half).cast("double").alias("x"), (F.col("y") + dy * half).cast("double").alias("y"))
            for dx, dy in corners
        ]
    )


@check("s5_read_features", SQUARE_SQL)
def _(i):
    """Buildings written as WKT polygons in CSV and read back by centroid."""
    pairs = F.transform(square(), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    wkt = F.concat(F.lit("POLYGON(("), F.array_join(pairs, ", "), F.lit("))"))
    path = f"{Scratch(i.spark, 'layer').root}/buildings"
    i.buildings.select(F.col("aid"), "jobs", wkt.alias("geometry")).write.csv(path, header=True)
    got = tables.read_features(i.spark, path, "csv", "aid")
    return got.select(F.col("aid").cast("long"), F.col("jobs").cast("long"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@check(
    "s6_read_config",
    """SELECT l.fclass, c.speed AS speed_km_h, COUNT(*) AS links FROM {links} l
JOIN (VALUES ('primary', 90), ('secondary', 50), ('residential', 50), ('footway', 3), ('motorway', 120)) c(fclass, speed) ON c.fclass = l.fclass
GROUP BY l.fclass, c.speed""",
)
def _(i):
    classes = i.classes.select(F.col("link_type").alias("fclass"), "speed_km_h")
    return i.links.join(classes, "fclass").groupBy("fclass", "speed_km_h").agg(F.count("*").alias("links"))


@check(
    "s7_write_table",
    """SELECT star, hash, CAST(duration_s AS DOUBLE) AS duration_s FROM {pairs}""",
)
def _(i):
    folder = Scratch(i.spark, "out").root
    text = i.pairs.select("star", "hash", F.col("duration_s").cast("string"))
    tables.write_table(text, folder, "od")
    return i.spark.read.parquet(f"{folder}/od")


@check(
    "s8_write_gtfs",
    f"""SELECT 'trips' AS file, {_text("trip_id", "route_id", "service_id", "shape_id")} AS line FROM {{trips}} WHERE trip_id IN (SELECT trip_id FROM {{stop_times}})
UNION ALL SELECT 'routes', {_text("route_id", "agency_id", "route_short_name", "route_type")} FROM {{routes}} WHERE route_id IN (SELECT route_id FROM {{trips}})
UNION ALL SELECT 'stops', stop_id FROM {{stops}}
UNION ALL SELECT 'stop_times', {_text("trip_id", "stop_sequence", "stop_id", "arrival_time")} FROM {{stop_times_txt}}
UNION ALL SELECT 'calendar', {_text("service_id", *DAYS, "start_date", "end_date")} FROM {{calendar}}
UNION ALL SELECT 'calendar_dates', {_text("service_id", "date", "exception_type")} FROM {{calendar_dates}}""",
)
def _(i):
    folder = write_feed(i)

    def lines(name, *columns):
        rows = i.spark.read.csv(f"{folder}/{name}.txt", header=True)
        return rows.select(F.lit(name).alias("file"), F.concat_ws("|", *columns).alias("line"))

    out = lines("trips", "trip_id", "route_id", "service_id", "shape_id")
    out = out.unionAll(lines("routes", "route_id", "agency_id", "route_short_name", "route_type")).unionAll(lines("stops", "stop_id"))
    out = out.unionAll(lines("stop_times", "trip_id", "stop_sequence", "stop_id", "arrival_time"))
    out = out.unionAll(lines("calendar", "service_id", *DAYS, "start_date", "end_date"))
    return out.unionAll(lines("calendar_dates", "service_id", "date", "exception_type"))


LOG_LINES_SQL = """
SELECT run_id,
       CASE WHEN INSTR(line, ':') > 0 THEN TRIM(SUBSTRING(line, 1, INSTR(line, ':') - 1)) ELSE line END AS Parameter,
       CASE WHEN INSTR(line, ':') > 0 THEN TRIM(SUBSTRING(line, INSTR(line, ':') + 1)) ELSE '' END AS Value
FROM (SELECT run_id, TRIM(line) AS line FROM (SELECT run_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS line FROM {logs}) a) b
WHERE line <> ''"""


@check("s9_write_run_log", LOG_LINES_SQL)
def _(i):
    return tables.run_log(i.logs, "text", ["run_id"])


@check(
    "s9_write_run_log_csv",
    f"""SELECT run_id, '"' || REPLACE(Parameter, '"', '""') || '","' || REPLACE(Value, '"', '""') || '"' AS csv_line FROM ({LOG_LINES_SQL}) z""",
)
def _(i):
    return tables.run_log_csv(i.logs, "text", ["run_id"])


@check(
    "s12_check_features",
    """SELECT (SELECT COUNT(*) FROM {buildings}) > 0 AS ok, '' AS message
UNION ALL SELECT (SELECT COUNT(*) FROM {buildings}) < 0, 'Layer ''buildings'' does not contain required field ''osm_id'''""",
)
def _(i):
    b = i.buildings
    return tables.check_features(b, "buildings", "aid").unionAll(tables.check_features(b, "buildings", "osm_id"))


# -- cleaning ----------------------------------------------------------------------

SERVICES_SQL = f"""
SELECT DISTINCT service_id FROM (
  SELECT service_id FROM {{calendar}} WHERE start_date <= {MONDAY} AND end_date >= {MONDAY} AND monday = 1
  UNION ALL SELECT service_id FROM {{calendar_dates}} WHERE date = {MONDAY} AND exception_type = 1) z
WHERE service_id NOT IN (SELECT service_id FROM {{calendar_dates}} WHERE date = {MONDAY} AND exception_type = 2)"""


@check("g1_services_on_date", SERVICES_SQL)
def _(i):
    return G.services_on_date(i.calendar, i.calendar_dates, MONDAY)


@check(
    "g2_filter_trips_by_service",
    f"""SELECT trip_id, stop_sequence, stop_id, t FROM {{stop_times}} WHERE service_id IN ({SERVICES_SQL})""",
)
def _(i):
    services = G.services_on_date(i.calendar, i.calendar_dates, MONDAY)
    _, times = G.filter_trips_by_service(i.trips, i.stop_times, services)
    return times.select("trip_id", "stop_sequence", "stop_id", "t")


@check(
    "g3_normalise_times",
    """SELECT trip_id, stop_id, stop_sequence,
       CASE WHEN LENGTH(arrival_time) = 7 THEN '0' || arrival_time ELSE arrival_time END AS arrival_time,
       CASE WHEN LENGTH(arrival_time) = 7 THEN '0' || arrival_time ELSE arrival_time END AS departure_time
FROM {stop_times_txt}""",
)
def _(i):
    return G.normalise_times(i.stop_times_txt)


ORDER = ["stop_sequence", "tiebreak", "tiebreak2", "stop_id"]


@check(
    "g4_interpolate_times",
    """
WITH pos AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY stop_sequence, tiebreak, tiebreak2, stop_id) AS p FROM {dirty_stop_times}),
k AS (SELECT *,
        MAX(CASE WHEN t IS NOT NULL THEN p END) OVER (PARTITION BY trip_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS p0,
        MIN(CASE WHEN t IS NOT NULL THEN p END) OVER (PARTITION BY trip_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1
      FROM pos)
SELECT k.trip_id, k.stop_id, k.stop_sequence, k.tiebreak, k.tiebreak2,
       CAST(COALESCE(k.t, CASE WHEN a.p < b.p THEN FLOOR(a.t + (b.t - a.t) / CAST(b.p - a.p AS DOUBLE) * (k.p - a.p)) END, a.t, b.t) AS BIGINT) AS t
FROM k LEFT JOIN pos a ON a.trip_id = k.trip_id AND a.p = k.p0
LEFT JOIN pos b ON b.trip_id = k.trip_id AND b.p = k.p1""",
)
def _(i):
    return G.interpolate_times(i.dirty_stop_times, ORDER)


FREQUENCY_RUNS_SQL = """
SELECT f.trip_id, f.start_s + n * f.headway_secs AS start, CONCAT(f.trip_id, '_f', CAST(f.start_s + n * f.headway_secs AS STRING)) AS new_id
FROM (SELECT *, UNNEST(RANGE(CAST(CEIL((end_s - start_s) / CAST(headway_secs AS DOUBLE)) AS BIGINT))) AS n FROM {frequencies}) f
WHERE f.trip_id IN (SELECT trip_id FROM {trips})"""


@check(
    "g5_expand_frequencies",
    f"""
WITH r AS ({FREQUENCY_RUNS_SQL}),
f0 AS (SELECT trip_id, MIN(t) AS t0 FROM {{stop_times}} WHERE stop_sequence = 1 GROUP BY trip_id)
SELECT trip_id, route_id, service_id, stop_sequence, stop_id, t FROM {{stop_times}}
UNION ALL
SELECT r.new_id, s.route_id, s.service_id, s.stop_sequence, s.stop_id, s.t - f0.t0 + r.start
FROM r JOIN f0 ON f0.trip_id = r.trip_id JOIN {{stop_times}} s ON s.trip_id = r.trip_id""",
)
def _(i):
    _, times = G.expand_frequencies(i.trips, i.stop_times, i.frequencies)
    return times


@check(
    "g5_expand_frequencies_trips",
    f"""
SELECT route_id, service_id, trip_id FROM {{trips}}
UNION ALL SELECT t.route_id, t.service_id, r.new_id FROM ({FREQUENCY_RUNS_SQL}) r JOIN {{trips}} t ON t.trip_id = r.trip_id""",
)
def _(i):
    trips, _ = G.expand_frequencies(i.trips, i.stop_times, i.frequencies)
    return trips.select("route_id", "service_id", "trip_id")


PATTERN_SQL = """
SELECT trip_id, route_id, CONCAT(route_id, '_', CAST(DENSE_RANK() OVER (PARTITION BY route_id ORDER BY first_trip) AS STRING)) AS pattern_id
FROM (SELECT trip_id, route_id, MIN(trip_id) OVER (PARTITION BY route_id, shape) AS first_trip
      FROM (SELECT trip_id, route_id, STRING_AGG(CONCAT(CAST(stop_sequence AS STRING), ':', stop_id), ',' ORDER BY stop_sequence, stop_id) AS shape
            FROM {mixed_stop_times} GROUP BY trip_id, route_id) a) b"""


@check("g6_split_route_patterns", f"SELECT trip_id, pattern_id AS route_id FROM ({PATTERN_SQL}) z")
def _(i):
    _, trips = G.split_route_patterns(i.routes, i.trips, i.mixed_stop_times)
    return trips.select("trip_id", "route_id")


@check(
    "g6_split_route_patterns_routes",
    f"""SELECT DISTINCT p.pattern_id AS route_id, r.route_short_name, r.route_desc, r.route_type
FROM ({PATTERN_SQL}) p JOIN {{routes}} r ON r.route_id = p.route_id""",
)
def _(i):
    routes, _ = G.split_route_patterns(i.routes, i.trips, i.mixed_stop_times)
    return routes.select("route_id", "route_short_name", "route_desc", "route_type")


CLONES_SQL = """
SELECT route_id, stop_sequence, stop_id, CONCAT(stop_id, '#', CAST(visit AS STRING)) AS clone
FROM (SELECT s.route_id, s.stop_sequence, s.stop_id, ROW_NUMBER() OVER (PARTITION BY s.route_id, s.stop_id ORDER BY s.stop_sequence) AS visit
      FROM {loop_stop_times} s JOIN (SELECT route_id, MIN(trip_id) AS trip_id FROM {trips} GROUP BY route_id) f ON f.trip_id = s.trip_id) z
WHERE visit > 1"""


@check(
    "g7_dedupe_repeated_stops",
    f"""SELECT s.trip_id, s.stop_sequence, COALESCE(c.clone, s.stop_id) AS stop_id, s.t
FROM {{loop_stop_times}} s LEFT JOIN ({CLONES_SQL}) c ON c.route_id = s.route_id AND c.stop_sequence = s.stop_sequence""",
)
def _(i):
    times, _ = G.dedupe_repeated_stops(i.trips, i.loop_stop_times, i.stops)
    return times.select("trip_id", "stop_sequence", "stop_id", "t")


@check(
    "g7_dedupe_repeated_stops_stops",
    f"""SELECT stop_id, x, y FROM {{stops}} UNION ALL
SELECT c.clone, s.x, s.y FROM (SELECT DISTINCT stop_id, clone FROM ({CLONES_SQL}) a) c JOIN {{stops}} s ON s.stop_id = c.stop_id""",
)
def _(i):
    _, stops = G.dedupe_repeated_stops(i.trips, i.loop_stop_times, i.stops)
    return stops.select("stop_id", "x", "y")


@check(
    "g8_drop_nonmonotone_trips",
    """SELECT trip_id, stop_id, stop_sequence, tiebreak, tiebreak2, t FROM {dirty_stop_times} WHERE trip_id NOT IN (
  SELECT trip_id FROM (SELECT trip_id, t, LAG(t) OVER (PARTITION BY trip_id ORDER BY stop_sequence, tiebreak, tiebreak2, stop_id) AS b FROM {dirty_stop_times}) z WHERE t < b)""",
)
def _(i):
    return G.drop_nonmonotone_trips(i.dirty_stop_times, ORDER)


@check(
    "g9_renumber_sequence",
    """SELECT d.trip_id, d.stop_id, d.tiebreak, d.tiebreak2, d.t,
       CASE WHEN b.hi - b.lo + 1 = b.nd AND b.lo = 1 AND b.n = b.nd THEN d.stop_sequence ELSE d.rn END AS stop_sequence
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY stop_sequence, tiebreak, tiebreak2, stop_id) AS rn FROM {dirty_stop_times}) d
JOIN (SELECT trip_id, MAX(stop_sequence) AS hi, MIN(stop_sequence) AS lo, COUNT(*) AS n, COUNT(DISTINCT stop_sequence) AS nd
      FROM {dirty_stop_times} GROUP BY trip_id) b ON b.trip_id = d.trip_id""",
)
def _(i):
    return G.renumber_sequence(i.dirty_stop_times, ORDER)


@check(
    "g10_reverse_sequence",
    """SELECT s.trip_id, s.stop_id, s.t, m.hi - s.stop_sequence + 1 AS stop_sequence FROM {stop_times} s
JOIN (SELECT trip_id, MAX(stop_sequence) AS hi FROM {stop_times} GROUP BY trip_id) m ON m.trip_id = s.trip_id""",
)
def _(i):
    return G.reverse_sequence(i.stop_times.select("trip_id", "stop_id", "stop_sequence", "t"))


@check(
    "g11_mirror_times",
    """WITH k AS (SELECT * FROM {dirty_stop_times} WHERE t >= 0 AND t < 86400)
SELECT k.trip_id, k.stop_id, k.tiebreak, (86400 - k.t) % 86400 AS t, m.hi - k.stop_sequence + m.lo AS stop_sequence
FROM k JOIN (SELECT trip_id, MAX(stop_sequence) AS hi, MIN(stop_sequence) AS lo FROM k GROUP BY trip_id) m ON m.trip_id = k.trip_id""",
)
def _(i):
    return G.mirror_times(i.dirty_stop_times.select("trip_id", "stop_id", "tiebreak", "stop_sequence", "t"))


@check(
    "g12_mirror_result_times",
    """SELECT event_id, CASE WHEN h < 24 THEN CONCAT(LPAD(CAST(CAST(FLOOR(m / 3600) AS BIGINT) AS STRING), 2, '0'), ':',
       LPAD(CAST(CAST(FLOOR((m % 3600) / 60) AS BIGINT) AS STRING), 2, '0'), ':', LPAD(CAST(m % 60 AS STRING), 2, '0')) END AS Start_time
FROM (SELECT event_id, user_id % 30 AS h, (86400 - ((user_id % 30) * 3600 + (event_id % 60) * 60 + 7)) % 86400 AS m FROM {events}) z""",
)
def _(i):
    text = F.concat_ws(":", (F.col("user_id") % 30).cast("string"), (F.col("event_id") % 60).cast("string"), F.lit("07"))
    return G.mirror_result_times(i.events.select("event_id", text.alias("Start_time")))


@check(
    "g13_repeated_stop_report",
    """SELECT trip_id, stop_id, COUNT(*) AS visits FROM {dirty_stop_times} GROUP BY trip_id, stop_id HAVING COUNT(*) > 1""",
)
def _(i):
    return G.repeated_stop_report(i.dirty_stop_times)


def feed_tables(i):
    return {
        "routes": i.routes,
        "trips": i.trips,
        "stop_times": i.stop_times,
        "stops": i.stops,
        "calendar": i.calendar,
        "calendar_dates": i.calendar_dates,
        "shapes": i.shapes,
    }


# whole rows as text
FEED_KEYS = {
    "routes": _text("route_id", "route_short_name", "route_long_name", "route_desc", "agency_id"),
    "trips": _text("trip_id", "route_id", "service_id", "shape_id", "trip_headsign", "direction_id"),
    "stop_times": _text("trip_id", "stop_sequence", "stop_id", "t"),
    "stops": _text("stop_id", "x", "y", "stop_lon"),
    "calendar": _text("service_id", *DAYS, "start_date", "end_date"),
    "calendar_dates": _text("service_id", "date", "exception_type"),
    "shapes": _text("shape_id", "shape_pt_sequence", "x", "y"),
}


def feed_rows(feed, side):
    parts = [
        feed[n].select(F.lit(side).alias("side"), F.lit(n).alias("file"), F.expr(k).alias("id")) for n, k in FEED_KEYS.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


# routes named 'Brand#1...' are deleted; the trips of the rest stay
DELETED_SQL = "SELECT route_id FROM {routes} WHERE route_short_name LIKE 'Brand#1%'"


def _delete_sql():
    kept = f"SELECT * FROM {{trips}} WHERE route_id NOT IN ({DELETED_SQL})"
    gone = f"SELECT * FROM {{trips}} WHERE route_id IN ({DELETED_SQL})"
    parts = []
    for side, mine in (("kept", kept), ("removed", gone)):
        inn = "NOT IN" if side == "kept" else "IN"
        st_in = "IN" if side == "kept" else "NOT IN"
        times = f"SELECT * FROM {{stop_times}} WHERE trip_id {st_in} (SELECT trip_id FROM ({kept}) k)"
        wheres = {
            "routes": f"route_id {inn} ({DELETED_SQL})",
            "trips": f"route_id {inn} ({DELETED_SQL})",
            "stop_times": f"trip_id {st_in} (SELECT trip_id FROM ({kept}) k)",
            "stops": f"stop_id IN (SELECT stop_id FROM ({times}) s)",
            "calendar": f"service_id IN (SELECT service_id FROM ({mine}) m)",
            "calendar_dates": f"service_id IN (SELECT service_id FROM ({mine}) m)",
            "shapes": f"shape_id IN (SELECT shape_id FROM ({mine}) m)",
        }
        for n, k in FEED_KEYS.items():
            parts.append(f"SELECT '{side}' AS side, '{n}' AS file, {k} AS id FROM {{{n}}} WHERE {wheres[n]}")
    return "\nUNION ALL ".join(parts)


@check("g14_delete_routes", _delete_sql())
def _(i):
    gone = i.routes.filter(F.col("route_short_name").startswith("Brand#1")).select("route_id")
    kept, removed = G.delete_routes(feed_tables(i), gone)
    return feed_rows(kept, "kept").unionAll(feed_rows(removed, "removed"))


# the second feed is the first with other ids for routes, trips and services;
# every other stop is new. Only its 'Brand#2...' routes are added.
def other_feed(i):
    def x(c):
        return F.concat(F.lit("x"), F.col(c))

    stop = F.when(F.col("stop_id").cast("long") % 2 == 0, F.col("stop_id")).otherwise(x("stop_id"))
    return {
        "routes": i.routes.withColumn("route_id", x("route_id")),
        "trips": i.trips.withColumns({c: x(c) for c in ("route_id", "trip_id", "service_id", "shape_id")}),
        "stop_times": i.stop_times.withColumn("trip_id", x("trip_id")).withColumn("stop_id", stop),
        "stops": i.stops.withColumn("stop_id", stop),
        "shapes": i.shapes.withColumn("shape_id", x("shape_id")),
    }


ADDED_SQL = "SELECT route_id FROM {routes} WHERE route_short_name LIKE 'Brand#2%'"
ADDED_TRIPS_SQL = f"SELECT * FROM {{trips}} WHERE route_id IN ({ADDED_SQL})"
OTHER_STOP = "CASE WHEN CAST(stop_id AS BIGINT) % 2 = 0 THEN stop_id ELSE CONCAT('x', stop_id) END"


def _add_sql():
    times = f"trip_id IN (SELECT trip_id FROM ({ADDED_TRIPS_SQL}) a)"
    x = ", ".join(f"CONCAT('x', {c}) AS {c}" for c in ("route_id", "trip_id", "service_id", "shape_id"))
    extra = {
        "routes": f"SELECT CONCAT('x', route_id) AS route_id, route_short_name, route_long_name, route_desc, agency_id FROM {{routes}} WHERE route_id IN ({ADDED_SQL})",
        "trips": f"SELECT {x}, trip_headsign, direction_id FROM ({ADDED_TRIPS_SQL}) a",
        "stop_times": f"SELECT CONCAT('x', trip_id) AS trip_id, stop_sequence, {OTHER_STOP} AS stop_id, t FROM {{stop_times}} WHERE {times}",
        "stops": f"""SELECT {OTHER_STOP} AS stop_id, x, y, stop_lon FROM {{stops}} WHERE stop_id IN (SELECT stop_id FROM {{stop_times}} WHERE {times})
                     AND {OTHER_STOP} NOT IN (SELECT stop_id FROM {{stops}})""",
        "calendar": f"""SELECT DISTINCT CONCAT('x', service_id) AS service_id, {", ".join(f"1 AS {d}" for d in DAYS)},
                     20240101 AS start_date, 20241231 AS end_date FROM ({ADDED_TRIPS_SQL}) a""",
        "shapes": f"SELECT CONCAT('x', shape_id) AS shape_id, shape_pt_sequence, x, y FROM {{shapes}} WHERE shape_id IN (SELECT shape_id FROM ({ADDED_TRIPS_SQL}) a)",
    }
    parts = []
    for n, k in FEED_KEYS.items():
        parts.append(f"SELECT 'both' AS side, '{n}' AS file, {k} AS id FROM {{{n}}}")
        if n in extra:
            parts.append(f"SELECT 'both', '{n}', {k} FROM ({extra[n]}) e")
    return "\nUNION ALL ".join(parts)


@check("g15_add_routes", _add_sql())
def _(i):
    chosen = i.routes.filter(F.col("route_short_name").startswith("Brand#2"))
    chosen = chosen.select(F.concat(F.lit("x"), F.col("route_id")).alias("route_id"))
    return feed_rows(G.add_routes(feed_tables(i), other_feed(i), chosen, 20240101, 20241231), "both")


@check(
    "g16_fix_ids",
    """SELECT event_id, TRIM(REPLACE(CONCAT(' ', CAST(value AS STRING), ' '), '.0', '')) AS shape_id,
       CONCAT(CAST(user_id AS STRING), '') AS direction_id FROM {events}""",
)
def _(i):
    text = F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))
    dotted = F.concat(F.col("user_id").cast("string"), F.lit(".0"))
    return gtfs.fix_ids(i.events.select("event_id", text.alias("shape_id"), dotted.alias("direction_id")))


@check(
    "g17_search_routes",
    """SELECT route_id, route_short_name, route_desc AS description FROM {routes} WHERE LOWER(route_short_name) IN ('brand#1', 'brand#22', 'brand#9')""",
)
def _(i):
    wanted = i.routes.select("route_id", "route_short_name", F.rpad("route_desc", 40, " ").alias("route_desc"))
    return G.search_routes(wanted, "Brand#1, BRAND#22;brand#9").withColumn("description", F.rtrim("description"))


@check(
    "g18_routes_by_shape",
    """SELECT u.shape_id, u.route_id, r.route_short_name, p.piece_no, p.path
FROM (SELECT DISTINCT shape_id, route_id FROM {trips}) u JOIN {routes} r ON r.route_id = u.route_id
JOIN (SELECT shape_id, piece_no, COUNT(*) AS n, STRING_AGG(CONCAT(CAST(CAST(x AS BIGINT) AS STRING), ' ', CAST(CAST(y AS BIGINT) AS STRING)), ',' ORDER BY pos) AS path
      FROM (SELECT *, CAST(FLOOR((pos - 1) / 3) AS BIGINT) AS piece_no FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY shape_id ORDER BY shape_pt_sequence) AS pos FROM {shapes}) a
            UNION ALL
            SELECT *, CAST(FLOOR((pos - 1) / 3) AS BIGINT) - 1 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY shape_id ORDER BY shape_pt_sequence) AS pos FROM {shapes}) b
            WHERE pos > 1 AND (pos - 1) % 3 = 0) c
      GROUP BY shape_id, piece_no) p ON p.shape_id = u.shape_id WHERE p.piece_no = 0 OR p.n > 1""",
)
def _(i):
    lines = G.routes_by_shape(i.routes, i.trips, i.shapes, piece=3)
    point = F.transform("path", lambda p: F.concat_ws(" ", p["x"].cast("long").cast("string"), p["y"].cast("long").cast("string")))
    return lines.select("shape_id", "route_id", "route_short_name", "piece_no", F.array_join(point, ",").alias("path"))


@check(
    "g19_stops_points",
    f"""SELECT stop_id, FLOOR(6371008.8 * COS(RADIANS({LAT0})) * RADIANS(stop_lon - {LON0}) * 1000 + 0.5) / 1000 AS x,
       FLOOR(6371008.8 * RADIANS(stop_lat - {LAT0}) * 1000 + 0.5) / 1000 AS y FROM {{stops}}""",
)
def _(i):
    points = G.stops_points(i.stops.select("stop_id", "stop_lon", "stop_lat"), LON0, LAT0)
    return points.select("stop_id", X.half_up("x", 3).alias("x"), X.half_up("y", 3).alias("y"))


@check(
    "g20_normalize_id",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS STRING) WHEN 1 THEN CAST(user_id AS STRING)
       WHEN 2 THEN CONCAT('x', CAST(user_id AS STRING), '.0') ELSE CAST(CAST(FLOOR(value) AS BIGINT) AS STRING) END AS id FROM {events}""",
)
def _(i):
    u, v = F.col("user_id").cast("string"), F.format_string("%.2f", F.col("value"))
    m = F.col("event_id") % 4
    text = F.when(m == 0, F.concat(F.lit(" "), u)).when(m == 1, F.concat(u, F.lit(".0")))
    text = text.when(m == 2, F.concat(F.lit("  x"), u, F.lit(".0 "))).otherwise(v)
    return i.events.select("event_id", X.normalize_id(text).alias("id"))


# -- timetable -------------------------------------------------------------------


def mixed(i):
    return i.mixed_stop_times


@check("t1_pattern_stops", "SELECT route_id, stop_sequence, MIN(stop_id) AS stop_id FROM {mixed_stop_times} GROUP BY route_id, stop_sequence")
def _(i):
    return TT.pattern_stops(mixed(i))


EVENTS_SQL = """SELECT route_id, trip_id, stop_sequence AS seq, stop_id, t, MIN(t) OVER (PARTITION BY trip_id) AS t_first FROM {stop_times}"""


@check(
    "t2_stop_events",
    f"""SELECT e.*, r.trip_rank FROM ({EVENTS_SQL}) e JOIN (
  SELECT trip_id, ROW_NUMBER() OVER (PARTITION BY route_id ORDER BY t_first, trip_id) AS trip_rank FROM (SELECT DISTINCT route_id, trip_id, t_first FROM ({EVENTS_SQL}) a) b) r ON r.trip_id = e.trip_id""",
)
def _(i):
    events = TT.stop_events(i.stop_times)
    return events.join(TT.trip_order(events).select("trip_id", "trip_rank"), "trip_id")


@check(
    "t3_stop_events_reversed",
    """SELECT e.route_id, e.trip_id, -e.stop_sequence AS seq, e.stop_id, -e.t AS t, -r.t_last AS t_first, r.trip_rank
FROM {stop_times} e JOIN (
  SELECT trip_id, t_last, ROW_NUMBER() OVER (PARTITION BY route_id ORDER BY t_last DESC, trip_id) AS trip_rank
  FROM (SELECT route_id, trip_id, MAX(t) AS t_last FROM {stop_times} GROUP BY route_id, trip_id) a) r ON r.trip_id = e.trip_id""",
)
def _(i):
    events = TT.mirrored(TT.stop_events(i.stop_times))
    return events.join(TT.trip_order(events).select("trip_id", "trip_rank"), "trip_id")


@check("t4_route_stop_index", "SELECT route_id, stop_id, MIN(stop_sequence) AS stop_index FROM {loop_stop_times} GROUP BY route_id, stop_id")
def _(i):
    return TT.route_stop_index(i.loop_stop_times)


@check(
    "t4_route_stop_index_reversed",
    """SELECT s.route_id, s.stop_id, MIN(m.hi - s.stop_sequence + 1) AS stop_index FROM {loop_stop_times} s
JOIN (SELECT trip_id, MAX(stop_sequence) AS hi FROM {loop_stop_times} GROUP BY trip_id) m ON m.trip_id = s.trip_id GROUP BY s.route_id, s.stop_id""",
)
def _(i):
    return TT.route_stop_index(G.reverse_sequence(i.loop_stop_times))


@check(
    "t5_route_stop_position",
    """SELECT route_id, stop_id, MAX(rn) - 1 AS position FROM (
  SELECT route_id, stop_id, ROW_NUMBER() OVER (PARTITION BY route_id ORDER BY stop_sequence) AS rn
  FROM (SELECT route_id, stop_sequence, MIN(stop_id) AS stop_id FROM {loop_stop_times} GROUP BY route_id, stop_sequence) a) b GROUP BY route_id, stop_id""",
)
def _(i):
    return TT.route_stop_position(TT.pattern_stops(i.loop_stop_times))


@check(
    "t6_routes_by_stop",
    """SELECT DISTINCT stop_id AS place_id, route_id FROM {stop_times} UNION ALL SELECT CAST(aid AS STRING), NULL FROM {buildings}""",
)
def _(i):
    return TT.routes_by_stop(i.stop_times, i.buildings)


@check("t7_stop_departures", "SELECT stop_id, route_id, trip_id, t FROM {stop_times}")
def _(i):
    return TT.stop_departures(TT.stop_events(i.stop_times))


BOARDINGS_SQL = """SELECT f.from_id AS source, f.to_id AS stop_id, s.route_id, s.trip_id, s.t, f.walk_s
FROM {footpaths} f JOIN {stop_times} s ON s.stop_id = f.to_id WHERE f.from_kind = 'b' AND f.to_kind = 's'"""


def access_rows(i):
    walks = i.footpaths.filter("from_kind = 'b' AND to_kind = 's'")
    return walks.select(F.col("from_id").alias("source"), F.col("to_id").alias("stop_id"), "walk_s")


@check(
    "t8_available_boardings",
    f"SELECT * FROM ({BOARDINGS_SQL}) z WHERE t >= 30600 + 300 AND t <= 30600 + 900 AND t >= 30600 + walk_s",
)
def _(i):
    return TT.available_boardings(access_rows(i), i.stop_events, 30600, 300, 900)


@check(
    "t8_first_boardings",
    f"""SELECT source, stop_id, route_id, trip_id, t, walk_s FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY source, stop_id, route_id ORDER BY t, trip_id) AS rn FROM ({BOARDINGS_SQL}) z
  WHERE t >= 30600 + walk_s AND t <= 30600 + 900 + walk_s) y WHERE rn = 1""",
)
def _(i):
    return TT.available_boardings(access_rows(i), i.stop_events, 30600, 0, 900, True)


@check("t10_list_stop_ids", "SELECT DISTINCT stop_id FROM {stops}")
def _(i):
    return TT.list_stop_ids(i.stops)


@check("t11_trip_stop_times", "SELECT trip_id, stop_sequence, stop_id, t, route_id FROM {stop_times}")
def _(i):
    return TT.trip_stop_times(i.trips, i.stop_times.select("trip_id", "stop_sequence", "stop_id", "t"))
