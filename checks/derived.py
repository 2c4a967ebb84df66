"""Network inputs derived from the given tables.

The given tables are not transit data, so stops, buildings, routes, trips, roads and
OD results are derived from them by integer arithmetic over every row. Each view is
one SQL text; ``EXPLODE_SERIES(a, b)`` stands for the engine's own way to expand a
range, and ``{name}`` for another table. Spark gets footpaths from the library's grid
join; the SQL side uses a plain join with bounds.

Geography keeps its density as the tables grow: stops sit on a jittered grid of 400 m
with about as many rows as columns, buildings are spread over the same square.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayreach.functions import expr as X
from wayreach.functions.scratch import Scratch
from wayreach.functions.skew import deal, merge_join
from wayreach.operators import near, timetable
from wayreach.sources import tables

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

LON0, LAT0 = 34.8, 32.0

# Trips that a task should hold with all their stops.
TRIPS_PER_TASK = 100_000

ROAD_CLASS_NAMES = ("primary", "secondary", "residential", "footway", "motorway", "unheard_of")

VIEWS = {
    "side": "SELECT CAST(FLOOR(SQRT(COUNT(*))) AS BIGINT) AS g, COUNT(*) AS n FROM {supplier}",
    "stops": """
SELECT CAST(s_suppkey AS STRING) AS stop_id, s_suppkey AS stop_key,
       (s_suppkey % (SELECT g FROM {side})) * 400 + (s_suppkey * 37) % 120 AS x,
       CAST(FLOOR(s_suppkey / (SELECT g FROM {side})) AS BIGINT) * 400 + (s_suppkey * 53) % 120 AS y,
       CAST(34.8 AS DOUBLE) + s_suppkey % 97 / CAST(250.0 AS DOUBLE) AS stop_lon,
       CAST(32.0 AS DOUBLE) + s_suppkey % 89 / CAST(300.0 AS DOUBLE) AS stop_lat
FROM {supplier}""",
    "buildings": """
SELECT 1000000 + c_custkey AS aid,
       (c_custkey * 3571) % (400 * (SELECT g FROM {side})) AS x,
       (c_custkey * 2801) % (400 * (SELECT g FROM {side})) AS y,
       CAST(FLOOR(ABS(c_acctbal)) AS BIGINT) AS jobs, 1 + c_custkey % 7 AS flats, c_mktsegment AS kind
FROM {customer}""",
    "routes": """
SELECT CAST(p_partkey AS STRING) AS route_id, p_partkey AS route_key, 'agency' AS agency_id,
       p_brand AS route_short_name, p_name AS route_long_name,
       CONCAT(p_type, '-', CAST(p_partkey % 10 AS STRING), '-#') AS route_desc, 3 AS route_type,
       'ffffff' AS route_color, 4 + p_partkey % 4 AS n_stops
FROM {part}""",
    "route_seq": """
SELECT route_id, route_key, EXPLODE_SERIES(1, n_stops) AS stop_sequence FROM {routes}""",
    "pattern": """
SELECT route_id, stop_sequence,
       CAST((route_key * 17 + stop_sequence * 7) % (SELECT n FROM {side}) AS STRING) AS stop_id,
       CAST(SUM(CASE WHEN stop_sequence = 1 THEN 0
                     ELSE 90 + (route_key * 31 + stop_sequence * 17) % 120 END)
            OVER (PARTITION BY route_id ORDER BY stop_sequence) AS BIGINT) AS t_off
FROM {route_seq}""",
    "trips": """
SELECT CAST(o_orderkey % (SELECT COUNT(*) FROM {part}) AS STRING) AS route_id, o_orderstatus AS service_id,
       CAST(o_orderkey AS STRING) AS trip_id, o_orderpriority AS trip_headsign,
       CAST(o_orderkey % 2 AS STRING) AS direction_id,
       CAST(o_orderkey % (SELECT COUNT(*) FROM {part}) AS STRING) AS shape_id,
       18000 + (o_orderkey * 97) % 61200 AS dep0
FROM {orders}""",
    "stop_times": """
SELECT t.trip_id, t.route_id, t.service_id, p.stop_sequence, p.stop_id, t.dep0 + p.t_off AS t
FROM {trips} t JOIN {pattern} p ON p.route_id = t.route_id""",
    "stop_times_txt": """
SELECT trip_id, stop_id, stop_sequence,
       CONCAT(CAST(CAST(FLOOR(t / 3600) AS BIGINT) AS STRING), ':',
              LPAD(CAST(CAST(FLOOR((t % 3600) / 60) AS BIGINT) AS STRING), 2, '0'), ':',
              LPAD(CAST(t % 60 AS STRING), 2, '0')) AS arrival_time
FROM {stop_times}""",
    # trips of one route that call at other stops: several patterns per route
    "mixed_stop_times": """
SELECT trip_id, route_id, stop_sequence,
       CASE WHEN CAST(trip_id AS BIGINT) % 11 = 0 AND stop_sequence = 2 THEN CONCAT(stop_id, 'b')
            WHEN CAST(trip_id AS BIGINT) % 3 = 0 AND stop_sequence = 3 THEN CONCAT(stop_id, 'c')
            ELSE stop_id END AS stop_id, t
FROM {stop_times}""",
    # routes whose later stops come back to an earlier one
    "loop_stop_times": """
SELECT trip_id, route_id, stop_sequence,
       CASE WHEN stop_sequence > 2 AND (CAST(route_id AS BIGINT) + stop_sequence) % 2 = 0
            THEN FIRST_VALUE(stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence) ELSE stop_id END AS stop_id, t
FROM {stop_times}""",
    "calendar": """
SELECT DISTINCT o_orderstatus AS service_id,
       CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS monday, 1 AS tuesday, 1 AS wednesday,
       1 AS thursday, 1 AS friday, 0 AS saturday, 0 AS sunday, 20240101 AS start_date,
       CASE WHEN o_orderstatus = 'O' THEN 20240131 ELSE 20241231 END AS end_date
FROM {orders}""",
    "calendar_dates": """
SELECT DISTINCT o_orderstatus AS service_id, CASE WHEN o_orderstatus = 'O' THEN 20231225 ELSE 20240205 END AS date,
       CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS exception_type
FROM {orders}""",
    "frequencies": """
SELECT CAST(p_partkey AS STRING) AS trip_id, 21600 AS start_s, 25200 AS end_s,
       300 + 60 * (p_partkey % 5) AS headway_secs
FROM {part}""",
    "shapes": """
SELECT p.route_id AS shape_id, p.stop_sequence AS shape_pt_sequence, CAST(s.x AS DOUBLE) AS x, CAST(s.y AS DOUBLE) AS y
FROM {pattern} p JOIN {stops} s ON s.stop_id = p.stop_id""",
    "dirty_stop_times": """
SELECT CAST(l_orderkey AS STRING) AS trip_id, CAST(l_suppkey AS STRING) AS stop_id,
       CAST(l_linenumber AS BIGINT) AS stop_sequence, l_partkey AS tiebreak, l_extendedprice AS tiebreak2,
       CASE WHEN l_partkey % 11 = 0 THEN NULL
            ELSE 21600 + l_linenumber * 300 + (l_partkey % 7) * 100 END AS t
FROM {lineitem}""",
    "footpaths": """
SELECT from_id, from_kind, to_id, to_kind, dist_m, dist_m AS walk_s FROM (
  SELECT a.stop_id AS from_id, 's' AS from_kind, b.stop_id AS to_id, 's' AS to_kind,
         CAST(FLOOR(SQRT(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) + 0.5) AS BIGINT) AS dist_m
  FROM {stops} a JOIN {stops} b ON a.stop_id <> b.stop_id AND b.x BETWEEN a.x - 400 AND a.x + 400 AND b.y BETWEEN a.y - 400 AND a.y + 400
  UNION ALL
  SELECT a.stop_id, 's', CAST(b.aid AS STRING), 'b',
         CAST(FLOOR(SQRT(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) + 0.5) AS BIGINT)
  FROM {stops} a JOIN {buildings} b ON b.x BETWEEN a.x - 400 AND a.x + 400 AND b.y BETWEEN a.y - 400 AND a.y + 400
  UNION ALL
  SELECT CAST(b.aid AS STRING), 'b', a.stop_id, 's',
         CAST(FLOOR(SQRT(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) + 0.5) AS BIGINT)
  FROM {stops} a JOIN {buildings} b ON b.x BETWEEN a.x - 400 AND a.x + 400 AND b.y BETWEEN a.y - 400 AND a.y + 400) z
WHERE dist_m <= 400""",
    # every building is a source
    "sources": "SELECT CAST(aid AS STRING) AS src FROM {buildings}",
    "near_buildings": """
SELECT src, place, walk_s FROM (
  SELECT s.src, CAST(b.aid AS STRING) AS place,
         CAST(FLOOR(SQRT(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) + 0.5) AS BIGINT) AS walk_s
  FROM {sources} s JOIN {buildings} a ON CAST(a.aid AS STRING) = s.src
  JOIN {buildings} b ON b.x BETWEEN a.x - 400 AND a.x + 400 AND b.y BETWEEN a.y - 400 AND a.y + 400) z
WHERE walk_s <= 400""",
    # streets: each stop to the next and to its upper neighbour, with a bend half-way
    "links": """
SELECT l.link_id, CAST(a.x AS DOUBLE) AS ax, CAST(a.y AS DOUBLE) AS ay,
       CAST(FLOOR((a.x + b.x) / 2) + 15 AS DOUBLE) AS mx, CAST(FLOOR((a.y + b.y) / 2) - 10 AS DOUBLE) AS my,
       CAST(b.x AS DOUBLE) AS bx, CAST(b.y AS DOUBLE) AS by_,
       CASE l.link_id % 6 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'residential'
            WHEN 3 THEN 'footway' WHEN 4 THEN 'motorway' ELSE 'unheard_of' END AS fclass,
       CASE l.link_id % 10 WHEN 0 THEN 'N' WHEN 1 THEN 'T' WHEN 2 THEN 'F' ELSE 'B' END AS oneway,
       CASE WHEN l.link_id % 3 = 0 THEN 0 ELSE 30 + l.link_id % 60 END AS maxspeed
FROM (SELECT s_suppkey * 2 AS link_id, s_suppkey AS u, s_suppkey + 1 AS v FROM {supplier}
      UNION ALL
      SELECT s_suppkey * 2 + 1, s_suppkey, s_suppkey + (SELECT g FROM {side}) FROM {supplier}) l
JOIN {stops} a ON a.stop_key = l.u JOIN {stops} b ON b.stop_key = l.v""",
    "segments": """
SELECT link_id, 0 AS seg, ax, ay, mx AS bx, my AS by_, fclass, oneway, maxspeed FROM {links}
UNION ALL
SELECT link_id, 1, mx, my, bx, by_, fclass, oneway, maxspeed FROM {links}""",
    "runs": """
SELECT 1000000 + l_suppkey AS o_id, 1000000 + CAST(FLOOR(l_partkey / 200) AS BIGINT) AS d_id,
       CASE WHEN l_linenumber % 2 = 0 THEN 'to' ELSE 'from' END AS direction,
       CONCAT('T', CAST(l_orderkey % 4 AS STRING)) AS label,
       CAST(MIN(60 + (l_orderkey * 53 + l_partkey * 7) % 3000) AS BIGINT) AS duration_s
FROM {lineitem}
GROUP BY 1000000 + l_suppkey, 1000000 + CAST(FLOOR(l_partkey / 200) AS BIGINT),
         CASE WHEN l_linenumber % 2 = 0 THEN 'to' ELSE 'from' END,
         CONCAT('T', CAST(l_orderkey % 4 AS STRING))""",
    "pairs": """
SELECT 1000000 + l_suppkey AS star, 1000000 + l_partkey AS hash,
       CAST(MIN((l_orderkey * 53 + l_partkey * 7) % 3600) AS BIGINT) AS duration_s
FROM {lineitem} GROUP BY 1000000 + l_suppkey, 1000000 + l_partkey""",
    "pairs2": """
SELECT 1000000 + l_suppkey * 2 AS star, 1000000 + l_partkey + l_linenumber AS hash,
       CAST(MIN((l_orderkey * 31 + l_linenumber * 977) % 3600) AS BIGINT) AS duration_s
FROM {lineitem} GROUP BY 1000000 + l_suppkey * 2, 1000000 + l_partkey + l_linenumber""",
    "logs": """
SELECT o_orderkey AS run_id,
       CONCAT('[Parameters]', CHR(10), 'Mode: ', CASE WHEN o_orderkey % 2 = 0 THEN 'Service area' ELSE 'Cumulative opportunities' END, CHR(10),
              '  Accessibility : ', CASE o_orderkey % 3 WHEN 0 THEN 'FROM' WHEN 1 THEN 'TO' ELSE 'ROUNDTRIP' END, ' "', o_orderpriority, '"  ', CHR(10), CHR(10),
              CASE o_orderkey % 4 WHEN 0 THEN 'Start at (hh:mm:ss): ' WHEN 1 THEN 'Earliest start time:   '
                   WHEN 2 THEN 'Arrive before (hh:mm:ss): ' ELSE 'Earliest arrival time: ' END,
              CAST(o_orderkey % 24 AS STRING), ':', LPAD(CAST(o_custkey % 60 AS STRING), 2, '0'), ':30', CHR(10),
              CASE WHEN o_orderkey % 5 = 0 THEN 'Start at (hh:mm:ss): 08:15:00' ELSE 'no time here: 8:15' END, CHR(10)) AS text
FROM {orders}""",
    "params1": """
SELECT c_custkey + 1 AS position,
       CASE c_custkey WHEN 3 THEN 'Mode' WHEN 5 THEN 'Start from the origin' WHEN 6 THEN 'The earliest start'
            ELSE CONCAT('Setting ', CAST(c_custkey AS STRING)) END AS Parameter, c_mktsegment AS Value
FROM {customer}""",
    "params2": """
SELECT s_suppkey + 1 AS position,
       CASE s_suppkey WHEN 0 THEN 'The earliest start' WHEN 2 THEN 'Arrive to destination' WHEN 4 THEN 'Mode'
            ELSE CONCAT('Setting ', CAST(s_suppkey * 20 AS STRING)) END AS Parameter, s_name AS Value
FROM {supplier}""",
}

NAME = re.compile(r"\{([a-z]\w*)\}")
SERIES = re.compile(r"EXPLODE_SERIES\(([^,]+), ([^)]+)\)")


class Inputs:
    """The given tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        own = getattr(type(self), f"make_{name}", None)
        if own is not None:
            return own(self)
        return self.sql(VIEWS[name])

    def sql(self, text: str, **dealt: DataFrame) -> DataFrame:
        """The rows of an SQL text; ``dealt`` stands for tables whose rows are laid out for it."""
        text = SERIES.sub(r"explode(sequence(\1, \2))", text)
        return self.spark.sql(text, **{n: dealt[n] if n in dealt else getattr(self, n) for n in set(NAME.findall(text))})

    def grouped_lineitem(self, view: str, *keys: str) -> DataFrame:
        """A view that groups ``lineitem`` by at least these keys."""
        rows = deal(self.lineitem, self.lineitem.count(), [F.expr(k) for k in keys])
        return self.sql(VIEWS[view], lineitem=rows)

    # -- views whose joins the library does itself --------------------------------

    def make_pairs(self) -> DataFrame:
        return self.grouped_lineitem("pairs", "1000000 + l_suppkey", "1000000 + l_partkey")

    def make_pairs2(self) -> DataFrame:
        return self.grouped_lineitem("pairs2", "1000000 + l_suppkey * 2", "1000000 + l_partkey + l_linenumber")

    def make_runs(self) -> DataFrame:
        return self.grouped_lineitem("runs", "1000000 + l_suppkey", "1000000 + CAST(FLOOR(l_partkey / 200) AS BIGINT)")

    def make_loop_stop_times(self) -> DataFrame:
        rows = deal(self.stop_times, self.orders.count(), ["trip_id"], TRIPS_PER_TASK)
        return self.sql(VIEWS["loop_stop_times"], stop_times=rows)

    def make_stop_times(self) -> DataFrame:
        trips = self.trips.select("trip_id", "route_id", "service_id", "dep0")
        trips = deal(trips, self.orders.count(), ["route_id"], TRIPS_PER_TASK)
        times = merge_join(trips, self.pattern, "route_id").withColumn("t", F.col("dep0") + F.col("t_off"))
        return times.select("trip_id", "route_id", "service_id", "stop_sequence", "stop_id", "t")

    def make_footpaths(self) -> DataFrame:
        stops = self.stops.select("stop_id", "x", "y")
        places = stops.select(F.col("stop_id").alias("to_id"), F.lit("s").alias("to_kind"), "x", "y").unionAll(
            self.buildings.select(F.col("aid").cast("string"), F.lit("b"), "x", "y")
        )
        # half a metre more, since distances are rounded before the limit is tested
        near_by = near.within_distance(stops, places, 400.5).filter("to_kind = 'b' OR to_id <> stop_id")
        out = near_by.select(
            F.col("stop_id").alias("from_id"), F.lit("s").alias("from_kind"), "to_id", "to_kind", X.half_up("d").alias("dist_m")
        ).filter("dist_m <= 400")
        out = Scratch(self.spark, "footpaths").keep(out)
        back = out.filter("to_kind = 'b'").select("to_id", "to_kind", "from_id", "from_kind", "dist_m")
        both = out.unionAll(back)
        return both.withColumn("walk_s", F.col("dist_m"))

    def make_near_buildings(self) -> DataFrame:
        ids = self.buildings.select(F.col("aid").cast("string").alias("place"), "x", "y")
        own = merge_join(ids, self.sources, F.col("place") == F.col("src")).select("src", "x", "y")
        near_by = near.within_distance(own, ids, 400.5)
        return near_by.select("src", "place", X.half_up("d").alias("walk_s")).filter("walk_s <= 400")

    def make_roads(self) -> DataFrame:
        def point(x, y):
            return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

        geom = F.array(point("ax", "ay"), point("mx", "my"), point("bx", "by_"))
        return self.links.select("link_id", geom.alias("geom"), "fclass", "oneway", "maxspeed")

    def make_stop_events(self) -> DataFrame:
        return Scratch(self.spark, "events").keep(timetable.stop_events(self.stop_times))

    def make_classes(self) -> DataFrame:
        return tables.read_config(self.spark, "road_classes")


def oracle(text: str) -> str:
    """The SQL text for DuckDB, with the views it needs as common table expressions."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in NAME.findall(sql):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(text)

    def render(sql: str) -> str:
        sql = SERIES.sub(r"unnest(generate_series(\1, \2))", sql)
        return NAME.sub(lambda m: f"d_{m[1]}" if m[1] in VIEWS else m[1], sql).strip()

    ctes = ",\n".join(f"d_{n} AS MATERIALIZED ({render(VIEWS[n])})" for n in needed)
    body = render(text)
    if not ctes:
        return body
    if re.match(r"WITH\s+RECURSIVE\s", body, re.I):
        return f"WITH RECURSIVE {ctes},\n" + re.sub(r"^WITH\s+RECURSIVE\s+", "", body, flags=re.I)
    if re.match(r"WITH\s", body, re.I):
        return f"WITH {ctes},\n" + re.sub(r"^WITH\s+", "", body, flags=re.I)
    return f"WITH {ctes}\n{body}"
