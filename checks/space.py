"""Roads, buildings, zones, walking and driving networks, scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayreach.functions import expr as X
from wayreach.operators import car as C
from wayreach.operators import roads as R
from wayreach.operators import walk as WK
from wayreach.operators import zones as Z
from wayreach.plans import build
from wayreach.sources import tables

from .derived import LAT0, LON0
from .feed import square
from .registry import check

CLASSES_SQL = "(VALUES " + ", ".join(f"('{c}', {s}, {p})" for c, s, p in tables.ROAD_CLASSES) + ") c(fclass, speed, priority)"

# -- roads ------------------------------------------------------------------------

# every link twice, the second time backwards, under another id and with the next class
DOUBLED_SQL = """
SELECT link_id, fclass, LEAST(CONCAT(ax, ' ', ay, ' ', mx, ' ', my, ' ', bx, ' ', by_), CONCAT(bx, ' ', by_, ' ', mx, ' ', my, ' ', ax, ' ', ay)) AS geo FROM {links}
UNION ALL
SELECT 1000000 + link_id, CASE link_id % 3 WHEN 0 THEN 'steps' WHEN 1 THEN 'unknown' ELSE 'primary' END,
       LEAST(CONCAT(ax, ' ', ay, ' ', mx, ' ', my, ' ', bx, ' ', by_), CONCAT(bx, ' ', by_, ' ', mx, ' ', my, ' ', ax, ' ', ay)) FROM {links}"""


def doubled(i):
    again = i.roads.withColumn("geom", F.reverse("geom")).withColumn(
        "fclass", F.expr("CASE link_id % 3 WHEN 0 THEN 'steps' WHEN 1 THEN 'unknown' ELSE 'primary' END")
    )
    return i.roads.unionByName(again.withColumn("link_id", F.col("link_id") + 1000000))


# nodes lie far apart, so the ends at one node form one group and its smallest point wins
SNAP_SQL = """
WITH e AS (SELECT link_id, 0 AS side, ax AS nx, ay AS ny, ax + 0.1 * (link_id % 4) AS x, ay AS y FROM {links}
           UNION ALL SELECT link_id, 1, bx, by_, bx, by_ FROM {links}),
g AS (SELECT nx, ny, MIN(x) AS x FROM e GROUP BY nx, ny)
SELECT e.link_id, e.side, FLOOR(g.x * 1000 + 0.5) / 1000 AS x, e.y FROM e JOIN g ON g.nx = e.nx AND g.ny = e.ny"""


@check("r1_snap_endpoints", SNAP_SQL)
def _(i):
    """Link ends shaken by up to 0.3 m and snapped together again."""
    shake = F.lit(0.1) * (F.col("link_id") % 4)
    first = F.struct((F.col("geom")[0]["x"] + shake).alias("x"), F.col("geom")[0]["y"].alias("y"))
    shaken = i.roads.withColumn("geom", F.concat(F.array(first), F.slice("geom", 2, 2)))
    snapped = R.snap_endpoints(shaken, 0.5)
    ends = snapped.select("link_id", F.posexplode(F.array(F.col("geom")[0], F.element_at("geom", -1))).alias("side", "p"))
    return ends.select("link_id", "side", m3("p.x").alias("x"), F.col("p.y").alias("y"))


BREAK_SQL = """
WITH s AS (SELECT link_id, seg, ax, ay, bx, by_ AS by2, bx - ax AS rx, by_ - ay AS ry FROM {segments}),
m AS (SELECT a.link_id, a.seg, a.ax, a.ay, a.rx, a.ry, a.rx * b.ry - a.ry * b.rx AS cr,
             (b.ax - a.ax) * b.ry - (b.ay - a.ay) * b.rx AS tn, (b.ax - a.ax) * a.ry - (b.ay - a.ay) * a.rx AS un,
             a.rx * (b.ay - a.ay) - a.ry * (b.ax - a.ax) AS o1, a.rx * (b.by2 - a.ay) - a.ry * (b.bx - a.ax) AS o2,
             ((b.ax - a.ax) * a.rx + (b.ay - a.ay) * a.ry) / (a.rx * a.rx + a.ry * a.ry) AS p1,
             ((b.bx - a.ax) * a.rx + (b.by2 - a.ay) * a.ry) / (a.rx * a.rx + a.ry * a.ry) AS p2
      FROM s a JOIN s b ON b.link_id <> a.link_id
       AND LEAST(b.ax, b.bx) <= GREATEST(a.ax, a.bx) AND GREATEST(b.ax, b.bx) >= LEAST(a.ax, a.bx)
       AND LEAST(b.ay, b.by2) <= GREATEST(a.ay, a.by2) AND GREATEST(b.ay, b.by2) >= LEAST(a.ay, a.by2)),
c AS (SELECT link_id, seg, ax, ay, rx, ry, tn / cr AS t FROM m WHERE cr <> 0 AND tn / cr BETWEEN 0 AND 1 AND un / cr BETWEEN 0 AND 1
      UNION ALL SELECT link_id, seg, ax, ay, rx, ry, p1 FROM m WHERE cr = 0 AND o1 = 0 AND p1 BETWEEN 0 AND 1
      UNION ALL SELECT link_id, seg, ax, ay, rx, ry, p2 FROM m WHERE cr = 0 AND o2 = 0 AND p2 BETWEEN 0 AND 1),
pts AS (SELECT link_id, FLOOR((seg + t) * 1e6 + 0.5) AS pos, ax + t * rx AS x, ay + t * ry AS y, 1 AS cut FROM c
        UNION ALL SELECT link_id, seg * 1e6, ax, ay, 0 FROM s UNION ALL SELECT link_id, (seg + 1) * 1e6, bx, by2, 0 FROM s),
u AS (SELECT link_id, pos, MIN(x) AS x, MIN(y) AS y, MAX(cut) AS cut FROM pts GROUP BY link_id, pos),
n AS (SELECT link_id, ROW_NUMBER() OVER w - 1 AS seq, LAG(x) OVER w AS ax, LAG(y) OVER w AS ay, x AS bx, y AS by2,
             SUM(cut) OVER (PARTITION BY link_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - cut - FIRST_VALUE(cut) OVER w + 1 AS piece
      FROM u WINDOW w AS (PARTITION BY link_id ORDER BY pos))
SELECT link_id, CAST(piece AS BIGINT) AS piece, seq, FLOOR(ax * 1000 + 0.5) / 1000 AS ax, FLOOR(ay * 1000 + 0.5) / 1000 AS ay,
       FLOOR(bx * 1000 + 0.5) / 1000 AS bx, FLOOR(by2 * 1000 + 0.5) / 1000 AS by2 FROM n WHERE seq > 0"""


@check("r2_break_crossings", BREAK_SQL)
def _(i):
    pieces = R.break_crossings(i.roads)
    return pieces.select("link_id", "piece", "seq", m3("ax").alias("ax"), m3("ay").alias("ay"), m3("bx").alias("bx"), m3("by").alias("by2"))


def line_sql(order: str, first: str, last: str) -> str:
    """Corner points of each piece as text, in one direction."""
    point = "CONCAT(CAST(CAST(%s AS BIGINT) AS STRING), ' ', CAST(CAST(%s AS BIGINT) AS STRING))"
    a, b = point % ("ax * 1000", "ay * 1000"), point % ("bx * 1000", "by2 * 1000")
    ends = {"a": a, "b": b}
    return f"CONCAT(FIRST({ends[first]} ORDER BY seq {order}), ',', STRING_AGG({ends[last]}, ',' ORDER BY seq {order}))"


# whole job: cut at crossings, with attributes, of equal pieces the first of the best class
CLEAN_SQL = f"""
SELECT source_link, geo, fclass, oneway, maxspeed FROM (
  SELECT p.link_id AS source_link, p.geo, l.fclass, l.oneway, l.maxspeed,
         ROW_NUMBER() OVER (PARTITION BY LEAST(p.geo, p.back) ORDER BY COALESCE(c.priority, 0) DESC, p.link_id, p.piece) AS rn
  FROM (SELECT link_id, piece, {line_sql("ASC", "a", "b")} AS geo, {line_sql("DESC", "b", "a")} AS back FROM ({BREAK_SQL}) z GROUP BY link_id, piece) p
  JOIN {{links}} l ON l.link_id = p.link_id LEFT JOIN {CLASSES_SQL} ON c.fclass = l.fclass) y WHERE rn = 1"""


@check("j1_clean_roads", CLEAN_SQL)
def _(i):
    cleaned = build.clean_roads(i.roads, i.classes)
    mm = lambda v: F.floor(v * 1000 + 0.5).cast("long").cast("string")
    geo = F.array_join(F.transform("geom", lambda p: F.concat_ws(" ", mm(p["x"]), mm(p["y"]))), ",")
    return cleaned.select("source_link", geo.alias("geo"), "fclass", "oneway", "maxspeed")


@check(
    "r3_dedupe_links",
    f"""SELECT link_id, fclass FROM (SELECT d.*, ROW_NUMBER() OVER (PARTITION BY geo ORDER BY COALESCE(c.priority, 0) DESC, link_id) AS rn
FROM ({DOUBLED_SQL}) d LEFT JOIN {CLASSES_SQL} ON c.fclass = d.fclass) z WHERE rn = 1""",
)
def _(i):
    return R.dedupe_links(doubled(i), i.classes).select("link_id", "fclass")


@check(
    "r4_drop_errored_links",
    "SELECT link_id, fclass, oneway FROM {links} WHERE link_id NOT IN (SELECT doc_id FROM {labels})",
)
def _(i):
    errors = i.labels.select(F.col("doc_id").alias("link_id"))
    return R.drop_errored_links(i.roads, errors).select("link_id", "fclass", "oneway")


@check("r5_assign_ids", "SELECT link_id, fclass, ROW_NUMBER() OVER (ORDER BY fclass, link_id) AS aid FROM {links}")
def _(i):
    return R.assign_ids(i.roads.select("link_id", "fclass"), ["fclass", "link_id"], "aid", R.FIRST_LINK_ID)


def multi(i):
    """Two-way links as two parts (up to the bend, from the bend), others as one."""
    two = F.array(F.slice("geom", 1, 2), F.slice("geom", 2, 2))
    return i.roads.select("link_id", F.when(F.col("oneway") == "B", two).otherwise(F.array("geom")).alias("parts"))


def line_text(c):
    return F.array_join(F.transform(c, lambda p: F.concat_ws(" ", p["x"].cast("long").cast("string"), p["y"].cast("long").cast("string"))), ",")


def xy(*names):
    return " || ',' || ".join(f"CAST(CAST({a} AS BIGINT) AS STRING) || ' ' || CAST(CAST({b} AS BIGINT) AS STRING)" for a, b in names)


A, M, B = ("ax", "ay"), ("mx", "my"), ("bx", "by_")


@check(
    "r6_multiline_to_line",
    f"""SELECT link_id, {xy(A, M, B)} AS line FROM {{links}} WHERE oneway <> 'B'
UNION ALL SELECT link_id, {xy(A, M)} FROM {{links}} WHERE oneway = 'B'
UNION ALL SELECT link_id, {xy(M, B)} FROM {{links}} WHERE oneway = 'B'""",
)
def _(i):
    return R.multiline_to_line(multi(i)).select("link_id", line_text("geom").alias("line"))


@check("r6_multiline_straight", f"SELECT link_id, CASE WHEN oneway <> 'B' THEN {xy(A, M, B)} ELSE {xy(A, B)} END AS line FROM {{links}}")
def _(i):
    return R.multiline_to_line(multi(i), straight=True).select("link_id", line_text("geom").alias("line"))


@check("r7_drop_no_drive", "SELECT link_id, oneway FROM {links} WHERE oneway <> 'N'")
def _(i):
    return R.drop_no_drive(i.roads).select("link_id", "oneway")


SPEED_SQL = f"""SELECT l.*, CAST(COALESCE(NULLIF(l.maxspeed, 0), c.speed, 30) AS DOUBLE) AS speed FROM {{links}} l LEFT JOIN {CLASSES_SQL} ON c.fclass = l.fclass"""


@check("r8_fill_speeds", f"SELECT link_id, speed AS maxspeed FROM ({SPEED_SQL}) z")
def _(i):
    return R.fill_speeds(i.roads, i.classes).select("link_id", "maxspeed")


@check("r9_flip_direction", "SELECT link_id, CASE oneway WHEN 'T' THEN 'F' WHEN 'F' THEN 'T' ELSE 'B' END AS oneway FROM {links}")
def _(i):
    return R.flip_direction(i.roads).select("link_id", "oneway")


@check(
    "r10_road_attr_test",
    """SELECT AVG(CASE WHEN oneway IN ('T', 'F', 'B', 'N') THEN 100.0 ELSE 0.0 END) AS oneway_pct,
       AVG(CASE WHEN maxspeed = 0 OR maxspeed BETWEEN 3 AND 120 THEN 100.0 ELSE 0.0 END) AS maxspeed_pct,
       AVG(CASE WHEN oneway IN ('T', 'F', 'B', 'N') THEN 100.0 ELSE 0.0 END) >= 99
       AND AVG(CASE WHEN maxspeed = 0 OR maxspeed BETWEEN 3 AND 120 THEN 100.0 ELSE 0.0 END) >= 99 AS passed
FROM (SELECT oneway, maxspeed FROM {links} UNION ALL SELECT CASE WHEN link_id % 7 = 0 THEN '?' ELSE 'B' END, link_id FROM {links}) z""",
)
def _(i):
    odd = i.links.select(F.expr("CASE WHEN link_id % 7 = 0 THEN '?' ELSE 'B' END").alias("oneway"), F.col("link_id").alias("maxspeed"))
    both = i.links.select("oneway", "maxspeed").unionAll(odd)
    return R.road_attr_test(both, i.classes, tables.read_config(i.spark, "directions"))


@check("r11_is_osm_schema", "SELECT COUNT(*) AS links, COUNT(*) > 0 AS osm, COUNT(*) < 0 AS stops_osm FROM {links}")
def _(i):
    shouting = i.roads.withColumnsRenamed({"fclass": "FCLASS", "oneway": "ONEWAY"})
    return shouting.agg(
        F.count("*").alias("links"), F.lit(R.is_osm_schema(shouting)).alias("osm"), F.lit(R.is_osm_schema(i.stops)).alias("stops_osm")
    )


# -- buildings and zones --------------------------------------------------------------

# each building as one square with a hole; those of some kinds have a second part 40 m to
# the east; every building comes again under another id, and once more without geometry
RAW_SQL = """
SELECT aid AS raw_id, 0 AS part, x, y, jobs FROM {buildings}
UNION ALL SELECT aid, 1, x + 40, y, jobs FROM {buildings} WHERE kind IN ('FURNITURE', 'MACHINERY')
UNION ALL SELECT aid + 5000000, 0, x, y, jobs FROM {buildings}"""


def raw_buildings(i):
    b = i.buildings.select("aid", "x", "y", "jobs", "kind")
    east = F.transform(square(), lambda p: F.struct((p["x"] + 40).alias("x"), p["y"].alias("y")))
    one = F.array(square(5.0), square(1.0))
    two = F.col("kind").isin("FURNITURE", "MACHINERY")
    polygons = F.when(two, F.array(one, F.array(east))).otherwise(F.array(one))
    first = b.select(F.col("aid").alias("raw_id"), "jobs", polygons.alias("polygons"))
    twin = b.select((F.col("aid") + 5000000).alias("raw_id"), "jobs", F.array(one).alias("polygons"))
    nothing = b.select((F.col("aid") + 9000000).alias("raw_id"), "jobs", F.lit(None).cast(first.schema["polygons"].dataType).alias("polygons"))
    return first.unionAll(twin).unionAll(nothing)


@check(
    "b1_clean_buildings",
    f"""SELECT aid, raw_id, jobs, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY x, y ORDER BY aid) AS rn FROM (
    SELECT *, 999999 + ROW_NUMBER() OVER (ORDER BY raw_id, part) AS aid FROM ({RAW_SQL}) a) b) c WHERE rn = 1""",
)
def _(i):
    clean = R.clean_buildings(raw_buildings(i), ["raw_id"])
    return clean.select("aid", "raw_id", "jobs", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@check("b2_centroids", "SELECT aid, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM {buildings}")
def _(i):
    rings = i.buildings.select("aid", square(3.0).alias("ring"))
    return R.centroids(rings).select("aid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


SIDE = 200.0
HEX_SQL = f"""
SELECT aid, x, y, jobs, flats,
       CAST(CASE WHEN eq > er AND eq > es THEN -rr - rs ELSE rq END AS BIGINT) AS q,
       CAST(CASE WHEN NOT (eq > er AND eq > es) AND er > es THEN -rq - rs ELSE rr END AS BIGINT) AS r
FROM (SELECT *, ABS(rq - q0) AS eq, ABS(rr - r0) AS er, ABS(rs - s0) AS es
      FROM (SELECT *, FLOOR(q0 + 0.5) AS rq, FLOOR(r0 + 0.5) AS rr, FLOOR(s0 + 0.5) AS rs
            FROM (SELECT *, -q0 - r0 AS s0
                  FROM (SELECT *, px * CAST({2.0 / 3.0!r} AS DOUBLE) AS q0, py * CAST({3**0.5 / 3.0!r} AS DOUBLE) - px * CAST({1.0 / 3.0!r} AS DOUBLE) AS r0
                        FROM (SELECT *, CAST(x AS DOUBLE) / {SIDE} AS px, CAST(y AS DOUBLE) / {SIDE} AS py FROM {{buildings}}) p) a) b) c) d"""
CENTRE_SQL = f"{SIDE} * 1.5 * q AS cx, {SIDE} * CAST({3**0.5!r} AS DOUBLE) * (r + q / 2.0) AS cy"
HEXES_SQL = f"SELECT q, r, {CENTRE_SQL} FROM (SELECT DISTINCT q, r FROM ({HEX_SQL}) h) g"


@check("z1_hex_grid", f"SELECT q, r, FLOOR(cx * 1000 + 0.5) / 1000 AS cx, FLOOR(cy * 1000 + 0.5) / 1000 AS cy FROM ({HEXES_SQL}) z")
def _(i):
    grid = Z.hex_grid(i.buildings, SIDE)
    return grid.select("q", "r", X.half_up("cx", 3).alias("cx"), X.half_up("cy", 3).alias("cy"))


# squares of 30 m touch a hexagon unless one of the five edge directions separates them
HALF_HEIGHT = SIDE * 3**0.5 / 2
TOUCH_SQL = f"""
SELECT DISTINCT q, r FROM (
  SELECT q, r, b.x - ({SIDE} * 1.5 * q) AS dx, b.y - ({SIDE} * CAST({3**0.5!r} AS DOUBLE) * (r + q / 2.0)) AS dy
  FROM (SELECT x, y, q + i AS q, r + j AS r FROM ({HEX_SQL}) h JOIN (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)) o(i, j) ON TRUE) b) z
WHERE ABS(dx) <= {SIDE} + 15 AND ABS(dy) <= {HALF_HEIGHT!r} + 15
  AND ABS(dx * {3**0.5 / 2!r} + dy * 0.5) <= {HALF_HEIGHT!r} + 15 * {(3**0.5 + 1) / 2!r}
  AND ABS(dy * 0.5 - dx * {3**0.5 / 2!r}) <= {HALF_HEIGHT!r} + 15 * {(3**0.5 + 1) / 2!r}"""


@check("z2_hex_filter", TOUCH_SQL)
def _(i):
    return Z.hex_filter(i.buildings.select(square(15.0).alias("ring")), SIDE).select("q", "r")


NEAREST_SQL = f"""SELECT q, r, aid FROM (
  SELECT h.q, h.r, b.aid, ROW_NUMBER() OVER (PARTITION BY h.q, h.r ORDER BY SQRT((b.x - h.cx) * (b.x - h.cx) + (b.y - h.cy) * (b.y - h.cy)), b.aid) AS rn
  FROM ({HEXES_SQL}) h JOIN {{buildings}} b ON b.x BETWEEN h.cx - 400 AND h.cx + 400 AND b.y BETWEEN h.cy - 400 AND h.cy + 400) z WHERE rn = 1"""


@check("z3_hex_nearest_building", NEAREST_SQL)
def _(i):
    hexes = Z.hex_grid(i.buildings, SIDE)
    return Z.hex_nearest_building(hexes, i.buildings, SIDE).select("q", "r", "aid")


SUM_SQL = f"SELECT q, r, COUNT(*) AS numbuildings, CAST(SUM(jobs) AS DOUBLE) AS jobs, CAST(SUM(flats) AS DOUBLE) AS flats FROM ({HEX_SQL}) h GROUP BY q, r"


@check("z4_hex_sum", SUM_SQL)
def _(i):
    return Z.hex_sum(i.buildings, SIDE)


@check(
    "z5_dissolve_zones",
    f"""SELECT n.aid, COUNT(*) AS n_hexes, CAST(SUM(s.numbuildings) AS BIGINT) AS numbuildings, SUM(s.jobs) AS jobs, SUM(s.flats) AS flats
FROM ({NEAREST_SQL}) n JOIN ({SUM_SQL}) s ON s.q = n.q AND s.r = n.r GROUP BY n.aid""",
)
def _(i):
    named = Z.hex_nearest_building(Z.hex_grid(i.buildings, SIDE), i.buildings, SIDE)
    return Z.dissolve_zones(named.select("q", "r", "aid").join(Z.hex_sum(i.buildings, SIDE), ["q", "r"]))


@check(
    "z6_voronoi_assign",
    """SELECT stop_id, aid, FLOOR(d * 1000 + 0.5) / 1000 AS d FROM (
  SELECT s.stop_id, b.aid, SQRT(CAST((b.x - s.x) * (b.x - s.x) + (b.y - s.y) * (b.y - s.y) AS DOUBLE)) AS d,
         ROW_NUMBER() OVER (PARTITION BY s.stop_id ORDER BY (b.x - s.x) * (b.x - s.x) + (b.y - s.y) * (b.y - s.y), b.aid) AS rn
  FROM {stops} s JOIN {buildings} b ON b.x BETWEEN s.x - 50 AND s.x + 50 AND b.y BETWEEN s.y - 50 AND s.y + 50) z
WHERE rn = 1 AND d <= 50""",
)
def _(i):
    near_by = Z.voronoi_assign(i.stops.select("stop_id", "x", "y"), i.buildings)
    return near_by.select("stop_id", "aid", X.half_up("d", 3).alias("d"))


# -- walking --------------------------------------------------------------------------

OBJECTS_SQL = """
SELECT stop_id AS obj_id, 's' AS kind, CAST(x + 13 AS DOUBLE) AS x, CAST(y - 21 AS DOUBLE) AS y FROM {stops}
UNION ALL SELECT CAST(aid AS STRING), 'b', CAST(x AS DOUBLE), CAST(y AS DOUBLE) FROM {buildings}"""
PATH = 400

LINKED_SQL = f"""
SELECT obj_id, kind, x, y, link_id, seg, qx, qy, ax, ay, bx, by_, d, CAST(FLOOR(d + 0.5) AS BIGINT) AS access_m FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY kind, obj_id ORDER BY d, link_id, seg) AS rn FROM (
    SELECT *, SQRT((x - qx) * (x - qx) + (y - qy) * (y - qy)) AS d FROM (
      SELECT *, ax + t * (bx - ax) AS qx, ay + t * (by_ - ay) AS qy FROM (
        SELECT o.*, s.link_id, s.seg, s.ax, s.ay, s.bx, s.by_,
               GREATEST(CAST(0.0 AS DOUBLE), LEAST(CAST(1.0 AS DOUBLE), ((o.x - s.ax) * (s.bx - s.ax) + (o.y - s.ay) * (s.by_ - s.ay))
                 / ((s.bx - s.ax) * (s.bx - s.ax) + (s.by_ - s.ay) * (s.by_ - s.ay)))) AS t
        FROM ({OBJECTS_SQL}) o JOIN {{segments}} s
          ON o.x BETWEEN LEAST(s.ax, s.bx) - {PATH} AND GREATEST(s.ax, s.bx) + {PATH}
         AND o.y BETWEEN LEAST(s.ay, s.by_) - {PATH} AND GREATEST(s.ay, s.by_) + {PATH}) a) b) c) e WHERE rn = 1 AND d <= {PATH}"""


def objects(i):
    stops = i.stops.select(
        F.col("stop_id").alias("obj_id"), F.lit("s").alias("kind"), (F.col("x") + 13).cast("double").alias("x"), (F.col("y") - 21).cast("double").alias("y")
    )
    return stops.unionAll(
        i.buildings.select(F.col("aid").cast("string"), F.lit("b"), F.col("x").cast("double"), F.col("y").cast("double"))
    )


def linked(i):
    from wayreach.functions.scratch import Scratch

    return Scratch(i.spark, "linked").keep(WK.nearest_link(objects(i), i.roads, PATH))


def m3(c):
    return X.half_up(c, 3)


@check(
    "w1_nearest_link",
    f"SELECT obj_id, kind, link_id, seg, access_m, FLOOR(qx * 1000 + 0.5) / 1000 AS qx, FLOOR(qy * 1000 + 0.5) / 1000 AS qy FROM ({LINKED_SQL}) z",
)
def _(i):
    found = linked(i)
    return found.select("obj_id", "kind", "link_id", "seg", "access_m", m3("qx").alias("qx"), m3("qy").alias("qy"))


TIES_SQL = f"""
SELECT obj_id, kind, access_m, qx AS ux, qy AS uy, ax AS vx, ay AS vy FROM ({LINKED_SQL}) z1
UNION ALL SELECT obj_id, kind, access_m, qx, qy, bx, by_ FROM ({LINKED_SQL}) z2"""


@check(
    "w2_link_edges",
    f"""SELECT obj_id, kind, access_m, vx, vy, FLOOR(SQRT((ux - vx) * (ux - vx) + (uy - vy) * (uy - vy)) * 1000 + 0.5) / 1000 AS w FROM ({TIES_SQL}) t""",
)
def _(i):
    ties = WK.link_edges(linked(i))
    return ties.select("obj_id", "kind", "access_m", F.col("v.x").alias("vx"), F.col("v.y").alias("vy"), m3("w").alias("w"))


@check(
    "w3_access_lines",
    f"SELECT obj_id, kind, link_id, x, y, FLOOR(qx * 1000 + 0.5) / 1000 AS qx, FLOOR(qy * 1000 + 0.5) / 1000 AS qy FROM ({LINKED_SQL}) z WHERE kind = 'b'",
)
def _(i):
    lines = WK.access_lines(linked(i))
    return lines.withColumn("qx", m3("qx")).withColumn("qy", m3("qy"))


ORIGINAL_SQL = """
SELECT ax AS ux, ay AS uy, bx AS vx, by_ AS vy FROM {segments} UNION SELECT bx, by_, ax, ay FROM {segments}"""


def edge_rows(edges):
    return edges.select(
        *[m3(f"{e}.{k}").alias(f"{e}{k}") for e in "uv" for k in "xy"], m3("w").alias("w")
    )


EDGE_COLUMNS = ", ".join(f"FLOOR({c} * 1000 + 0.5) / 1000 AS {c}" for c in ("ux", "uy", "vx", "vy"))
EDGE_COLUMNS += ", FLOOR(SQRT((ux - vx) * (ux - vx) + (uy - vy) * (uy - vy)) * 1000 + 0.5) / 1000 AS w"


@check(
    "w4_build_walk_graph",
    f"""SELECT {EDGE_COLUMNS} FROM ({ORIGINAL_SQL} UNION SELECT ux, uy, vx, vy FROM ({TIES_SQL}) t1 UNION SELECT vx, vy, ux, uy FROM ({TIES_SQL}) t2) e""",
)
def _(i):
    return edge_rows(WK.build_walk_graph(i.roads, linked(i)))


def walk_inputs(i):
    from wayreach.functions.scratch import Scratch

    scratch = Scratch(i.spark, "walkgraph")
    found = linked(i)
    return WK.attachments(found), scratch.keep(WK.build_walk_graph(i.roads, found))


# least distances by number of steps; the cutoff ends the recursion
WALKS_SQL = f"""
WITH RECURSIVE lk AS MATERIALIZED ({LINKED_SQL}),
ties AS MATERIALIZED (SELECT qx AS ux, qy AS uy, ax AS vx, ay AS vy FROM lk UNION SELECT qx, qy, bx, by_ FROM lk),
ed AS MATERIALIZED (SELECT ux, uy, vx, vy, SQRT((ux - vx) * (ux - vx) + (uy - vy) * (uy - vy)) AS w FROM (
  {ORIGINAL_SQL} UNION SELECT ux, uy, vx, vy FROM ties UNION SELECT vx, vy, ux, uy FROM ties) e0),
seeds AS MATERIALIZED (%s),
r AS (
  SELECT sx, sy, budget, sx AS x, sy AS y, CAST(0 AS DOUBLE) AS d, 0 AS hop FROM seeds
  UNION ALL
  SELECT r.sx, r.sy, r.budget, ed.vx, ed.vy, MIN(r.d + ed.w), r.hop + 1 FROM r JOIN ed ON ed.ux = r.x AND ed.uy = r.y
  WHERE r.d + ed.w <= r.budget AND r.hop < 60 GROUP BY r.sx, r.sy, r.budget, ed.vx, ed.vy, r.hop),
reach AS MATERIALIZED (SELECT sx, sy, x, y, MIN(d) AS d FROM r GROUP BY sx, sy, x, y)
"""
STOP_SEEDS = f"SELECT qx AS sx, qy AS sy, MAX(CAST({PATH} AS DOUBLE) - access_m) AS budget FROM lk WHERE kind = 's' GROUP BY qx, qy HAVING MAX({PATH} - access_m) > 0"
REACH_SQL = (
    WALKS_SQL % STOP_SEEDS
    + f""", found AS MATERIALIZED (SELECT a.obj_id AS from_id, b.obj_id AS to_id, b.kind, MIN(CAST(FLOOR(a.access_m + reach.d + b.access_m + 0.5) AS BIGINT)) AS dist_m
FROM lk a JOIN reach ON reach.sx = a.qx AND reach.sy = a.qy JOIN lk b ON b.qx = reach.x AND b.qy = reach.y
WHERE a.kind = 's' AND a.access_m < {PATH} AND reach.d <= {PATH} - a.access_m AND FLOOR(a.access_m + reach.d + b.access_m + 0.5) <= {PATH}
  AND (b.kind = 'b' OR b.obj_id <> a.obj_id) GROUP BY a.obj_id, b.obj_id, b.kind)
"""
)


@check("w5_walk_reach", REACH_SQL + "SELECT from_id, to_id, kind, dist_m FROM found")
def _(i):
    attached, edges = walk_inputs(i)
    stops = attached.filter("kind = 's'").select(F.col("obj_id").alias("from_id"), "node", "access_m")
    return WK.walk_reach(stops, attached, edges, PATH)


@check(
    "w6_build_footpaths",
    REACH_SQL
    + """SELECT from_id, 's' AS from_kind, to_id, kind AS to_kind, dist_m FROM found
UNION ALL SELECT to_id, 'b', from_id, 's', dist_m FROM found WHERE kind = 'b'""",
)
def _(i):
    attached, edges = walk_inputs(i)
    return WK.build_footpaths(attached, edges, PATH)


VERTEX_SEEDS = f"SELECT DISTINCT ux AS sx, uy AS sy, CAST({PATH} AS DOUBLE) AS budget FROM ({ORIGINAL_SQL}) o"


@check(
    "w7_near_buildings_of_vertices",
    WALKS_SQL % VERTEX_SEEDS
    + f"""SELECT sx AS vx, sy AS vy, lk.obj_id AS building_id, MIN(CAST(FLOOR(reach.d + lk.access_m + 0.5) AS BIGINT)) AS dist_m
FROM reach JOIN lk ON lk.qx = reach.x AND lk.qy = reach.y WHERE lk.kind = 'b' AND FLOOR(reach.d + lk.access_m + 0.5) <= {PATH} GROUP BY sx, sy, lk.obj_id""",
)
def _(i):
    attached, edges = walk_inputs(i)
    reach = WK.vertex_reach(WK.build_original_graph(i.roads), edges, PATH)
    near_by = WK.near_buildings_of_vertices(reach, attached, PATH)
    return near_by.select(F.col("vertex.x").alias("vx"), F.col("vertex.y").alias("vy"), "building_id", "dist_m")


@check(
    "w8_nearest_vertex_of_buildings",
    WALKS_SQL % VERTEX_SEEDS
    + """SELECT building_id, x, y, dist_m FROM (
  SELECT lk.obj_id AS building_id, reach.sx AS x, reach.sy AS y, CAST(FLOOR(reach.d + lk.access_m + 0.5) AS BIGINT) AS dist_m,
         ROW_NUMBER() OVER (PARTITION BY lk.obj_id ORDER BY reach.d, reach.sx, reach.sy) AS rn
  FROM reach JOIN lk ON lk.qx = reach.x AND lk.qy = reach.y WHERE lk.kind = 'b') z WHERE rn = 1""",
)
def _(i):
    attached, edges = walk_inputs(i)
    reach = WK.vertex_reach(WK.build_original_graph(i.roads), edges, PATH)
    return WK.nearest_vertex_of_buildings(reach, attached).select("building_id", "vertex.x", "vertex.y", "dist_m")


@check(
    "w9_footpath_lists",
    """SELECT from_id, CAST(FLOOR((pos - 1) / 50) AS BIGINT) AS page_no, STRING_AGG(CONCAT(to_id, ':', CAST(dist_m AS STRING)), ',' ORDER BY pos) AS paths
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY from_id ORDER BY dist_m, to_id) AS pos FROM {footpaths}) z GROUP BY from_id, CAST(FLOOR((pos - 1) / 50) AS BIGINT)""",
)
def _(i):
    lists = WK.footpath_lists(i.footpaths, page=50)
    text = F.array_join(F.transform("paths", lambda p: F.concat_ws(":", p["to_id"], p["dist_m"].cast("string"))), ",")
    return lists.select("from_id", "page_no", text.alias("paths"))


@check("w10_build_original_graph", f"SELECT {EDGE_COLUMNS} FROM ({ORIGINAL_SQL}) e")
def _(i):
    return edge_rows(WK.build_original_graph(i.roads))


@check("w11_coord_to_vertex", f"SELECT ROW_NUMBER() OVER (ORDER BY ux, uy) - 1 AS vertex_id, ux AS x, uy AS y FROM (SELECT DISTINCT ux, uy FROM ({ORIGINAL_SQL}) o) z")
def _(i):
    return WK.coord_to_vertex(WK.build_original_graph(i.roads))


# -- driving ---------------------------------------------------------------------------

DRIVE_SQL = f"""
SELECT ux, uy, vx, vy, MIN(w) AS w FROM (
  SELECT ax AS ux, ay AS uy, bx AS vx, by_ AS vy, SQRT((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) * 3.6 / speed AS w
  FROM (SELECT s.*, f.speed FROM {{segments}} s JOIN ({SPEED_SQL}) f ON f.link_id = s.link_id) a WHERE oneway IN ('T', 'B')
  UNION ALL
  SELECT bx, by_, ax, ay, SQRT((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) * 3.6 / speed
  FROM (SELECT s.*, f.speed FROM {{segments}} s JOIN ({SPEED_SQL}) f ON f.link_id = s.link_id) b WHERE oneway IN ('F', 'B')) z GROUP BY ux, uy, vx, vy"""


def drive_roads(i):
    return R.fill_speeds(R.drop_no_drive(i.roads), i.classes)


@check("c1_drive_edges", f"SELECT ux, uy, vx, vy, FLOOR(w * 1000 + 0.5) / 1000 AS w FROM ({DRIVE_SQL}) z")
def _(i):
    return edge_rows(C.drive_edges(drive_roads(i)))


HOURLY_SQL = f"""
SELECT l.link_id, ax, ay, bx, by_, h.hour, CASE WHEN f IS NULL AND b IS NULL THEN c.speed ELSE GREATEST(f, 3.6) END AS f,
       CASE WHEN f IS NULL AND b IS NULL THEN c.speed ELSE CASE WHEN b IS NOT NULL THEN GREATEST(b, 3.6) END END AS b,
       SQRT((ax - mx) * (ax - mx) + (ay - my) * (ay - my)) + SQRT((mx - bx) * (mx - bx) + (my - by_) * (my - by_)) AS len
FROM (SELECT *, UNNEST(GENERATE_SERIES(5, 23)) AS hour FROM {{links}}) l
JOIN LATERAL (SELECT l.hour AS hour, CASE WHEN l.link_id % 4 = 0 THEN NULL ELSE CAST(l.link_id % 50 + l.hour AS DOUBLE) END AS f,
              CASE WHEN l.link_id % 2 = 0 THEN NULL ELSE CAST((l.link_id + l.hour) % 9 AS DOUBLE) END AS b) h ON TRUE
LEFT JOIN {CLASSES_SQL} ON c.fclass = l.fclass"""


def hourly_roads(i):
    df = i.roads
    k = F.col("link_id")
    for h in C.HOURS:
        df = df.withColumn(f"fspeed_{h:02d}", F.when(k % 4 != 0, (k % 50 + h).cast("double")))
        df = df.withColumn(f"bspeed_{h:02d}", F.when(k % 2 != 0, ((k + h) % 9).cast("double")))
    return df


@check(
    "c2_drive_edges_hourly",
    f"""SELECT CAST(hour AS INTEGER) AS hour, ux, uy, vx, vy, FLOOR(MIN(w) * 1000 + 0.5) / 1000 AS w FROM (
SELECT hour, ax AS ux, ay AS uy, bx AS vx, by_ AS vy, len / (f / 3.6) AS w FROM ({HOURLY_SQL}) a WHERE f IS NOT NULL
UNION ALL SELECT hour, bx, by_, ax, ay, len / (b / 3.6) FROM ({HOURLY_SQL}) b WHERE b IS NOT NULL) z GROUP BY hour, ux, uy, vx, vy""",
)
def _(i):
    edges = C.drive_edges_hourly(hourly_roads(i), i.classes)
    return edges.select("hour", *[F.col(f"{e}.{k}").alias(f"{e}{k}") for e in "uv" for k in "xy"], m3("w").alias("w"))


@check("c3_check_speed_fields", "SELECT COUNT(*) AS links, COUNT(*) > 0 AS hourly, COUNT(*) < 0 AS plain FROM {links}")
def _(i):
    full = hourly_roads(i)
    return full.agg(
        F.count("*").alias("links"), F.lit(C.check_speed_fields(full)).alias("hourly"), F.lit(C.check_speed_fields(i.roads)).alias("plain")
    )


FACTOR = 0.6
LIMITS = C.CarLimits(max_time=1200)
CAR_BINS = ", ".join(f"({k})" for k in range(1, LIMITS.max_time // 100 + 1))
BOUND = LIMITS.cost_bound(FACTOR)
# every vertex is a start; the time limit bounds the work
COSTS_SQL = f"""
WITH RECURSIVE ed AS MATERIALIZED ({DRIVE_SQL}),
seeds AS MATERIALIZED (SELECT DISTINCT ux AS sx, uy AS sy FROM ed),
r AS (
  SELECT sx, sy, sx AS x, sy AS y, CAST(0 AS DOUBLE) AS d, 0 AS hop FROM seeds
  UNION ALL
  SELECT r.sx, r.sy, ed.vx, ed.vy, MIN(r.d + ed.w), r.hop + 1 FROM r JOIN ed ON ed.ux = r.x AND ed.uy = r.y
  WHERE r.d + ed.w <= {BOUND} AND r.hop < 200 GROUP BY r.sx, r.sy, ed.vx, ed.vy, r.hop),
costs AS MATERIALIZED (SELECT sx, sy, x, y, MIN(d) AS d FROM r GROUP BY sx, sy, x, y)
"""


def drive(i):
    from wayreach.functions.scratch import Scratch

    edges = C.drive_edges(drive_roads(i))
    vertices = Scratch(i.spark, "vertices").keep(WK.coord_to_vertex(edges))
    compact = Scratch(i.spark, "drive-edges").keep(WK.by_vertex_id(edges, vertices))
    starts = compact.select(F.col("u").alias("node")).distinct()
    return C.drive_costs(starts, compact, BOUND), vertices


def named(df, vertices, node, x, y):
    v = vertices.select(F.col("vertex_id").alias(node), F.col("x").alias(x), F.col("y").alias(y))
    return df.join(v, node).drop(node)


@check("c4_drive_costs", COSTS_SQL + "SELECT sx, sy, x, y, FLOOR(d * 1000 + 0.5) / 1000 AS d FROM costs")
def _(i):
    costs, vertices = drive(i)
    return named(named(costs, vertices, "src", "sx", "sy"), vertices, "node", "x", "y").withColumn("d", m3("d"))


# access and egress: buildings within 120 m of a vertex, straight; the nearest vertex is the start
NEAR_VERTEX_SQL = """
SELECT b.aid, v.x, v.y, FLOOR(SQRT((b.x - v.x) * (b.x - v.x) + (b.y - v.y) * (b.y - v.y)) + 0.5) AS m
FROM {buildings} b JOIN (SELECT DISTINCT ux AS x, uy AS y FROM (SELECT ux, uy FROM ed UNION SELECT vx, vy FROM ed) e) v
  ON v.x BETWEEN b.x - 121 AND b.x + 121 AND v.y BETWEEN b.y - 121 AND b.y + 121
WHERE FLOOR(SQRT((b.x - v.x) * (b.x - v.x) + (b.y - v.y) * (b.y - v.y)) + 0.5) <= 120"""

CAR_SQL = (
    COSTS_SQL
    + f""", nv AS MATERIALIZED ({NEAR_VERTEX_SQL}),
acc AS MATERIALIZED (SELECT aid, x, y, m FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY aid ORDER BY m, x, y) AS rn FROM nv) z WHERE rn = 1),
od AS MATERIALIZED (
  SELECT src, building, CASE WHEN src = building THEN 0
         WHEN whole <= 200 THEN FLOOR(whole + 0.5)
         WHEN dist < 800 THEN FLOOR(200 + FLOOR(dist + 0.5) + 0.5)
         ELSE FLOOR(200 + COALESCE(d * ((whole - 200) / NULLIF(dist, 0)) / {FACTOR}, 0) + 0.5) END AS dur,
         CASE WHEN whole <= 200 THEN 0 ELSE 1 END AS veh
  FROM (SELECT a.aid AS src, e.aid AS building, c.d, c.d * 10 AS dist, a.m + c.d * 10 + e.m AS whole
        FROM acc a JOIN costs c ON c.sx = a.x AND c.sy = a.y JOIN nv e ON e.x = c.x AND e.y = c.y) z),
best AS MATERIALIZED (SELECT src, building, veh, CAST(dur AS BIGINT) AS dur FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY src, building ORDER BY dur, veh) AS rn FROM od WHERE dur <= {LIMITS.max_time}) z WHERE rn = 1)
"""
)


def car_pairs(i):
    from wayreach.operators import near

    costs, vertices = drive(i)
    spots = vertices.select("vertex_id", "x", "y")
    b = i.buildings.select("aid", "x", "y")
    close = near.within_distance(b, spots, 120.5).withColumn("m", X.half_up("d")).filter("m <= 120")
    # vertex ids follow (x, y), so the smallest id is the smallest place
    start = close.groupBy("aid").agg(F.min(F.struct("m", "vertex_id")).alias("s"))
    sources = start.select(F.col("aid").alias("src"), F.col("s.vertex_id").alias("node"), F.col("s.m").alias("access_m"))
    egress = close.select(F.col("vertex_id").alias("node"), F.col("aid").alias("building"), F.col("m").alias("egress_m"))
    return C.car_od(sources, costs, egress, FACTOR, LIMITS)


@check("c5_car_od", CAR_SQL + "SELECT src, building, veh AS veh_legs, dur AS duration_s FROM best")
def _(i):
    return car_pairs(i)


@check("c6_congestion_factor", "SELECT COUNT(*) AS orders, CAST(FLOOR(SUM(CASE WHEN h < 6 THEN 1.0 WHEN h < 12 THEN 0.75 ELSE 0.6 END) + 0.5) AS DOUBLE) AS factors FROM (SELECT o_orderkey % 3 * 6 AS h FROM {orders}) z")
def _(i):
    """Factors of three start hours, summed over all orders."""
    congestion = tables.read_config(i.spark, "congestion")
    f = [C.congestion_factor(congestion, h * 3600) for h in (0, 6, 16)]
    m = F.col("o_orderkey") % 3
    factor = F.when(m == 0, f[0]).when(m == 1, f[1]).otherwise(f[2])
    return i.orders.agg(F.count("*").alias("orders"), F.floor(F.sum(factor) + 0.5).cast("double").alias("factors"))


@check("c7_car_rows", CAR_SQL + "SELECT building AS Origin_aid, src AS Destination_aid, veh AS Veh_legs, dur AS Duration FROM best")
def _(i):
    return C.car_rows(car_pairs(i), backward=True)


@check(
    "c8_car_cumulative",
    CAR_SQL
    + f"""SELECT s.src AS star, n.bin AS bin, n.bin * 100 AS bound_s, 1 + COUNT(o.building) AS nbldg, CAST(MIN(a.jobs) + COALESCE(SUM(h.jobs), 0) AS BIGINT) AS jobs
FROM (SELECT aid AS src FROM {{buildings}}) s JOIN (VALUES {CAR_BINS}) n(bin) ON TRUE JOIN {{buildings}} a ON a.aid = s.src
LEFT JOIN best o ON o.src = s.src AND o.building <> s.src AND o.dur <= n.bin * 100 LEFT JOIN {{buildings}} h ON h.aid = o.building GROUP BY s.src, n.bin""",
)
def _(i):
    # every building is a source, also where no vertex is near
    sources = i.buildings.select(F.col("aid").alias("star"))
    return C.car_cumulative(car_pairs(i), 100, LIMITS.max_time, i.buildings, ["jobs"], sources)


@check("c9_is_walk_trip", CAR_SQL + "SELECT veh AS veh_legs, COUNT(*) AS pairs FROM best GROUP BY veh")
def _(i):
    return car_pairs(i).groupBy("veh_legs").agg(F.count("*").alias("pairs"))


# -- scalar expressions -----------------------------------------------------------------


@check(
    "x1_x2_time_text",
    """SELECT event_id, s AS seconds, CASE WHEN s IS NOT NULL THEN CONCAT(LPAD(CAST(CAST(FLOOR(s / 3600) AS BIGINT) AS STRING), 2, '0'), ':', LPAD(CAST(CAST(FLOOR(s % 3600 / 60) AS BIGINT) AS STRING), 2, '0'), ':', LPAD(CAST(s % 60 AS STRING), 2, '0')) END AS text
FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN (user_id % 30) * 3600 + (event_id % 60) * 60 + user_id % 60 END AS s FROM {events}) z""",
)
def _(i):
    u, e = F.col("user_id"), F.col("event_id")
    raw = F.when(e % 9 != 0, F.concat_ws(":", *[(v).cast("string") for v in (u % 30, e % 60, u % 60)]))
    seconds = X.time_to_seconds(raw).cast("long")
    return i.events.select("event_id", seconds.alias("seconds"), X.seconds_to_time(seconds).alias("text"))


@check(
    "x4_metres_degrees",
    """SELECT stop_id, FLOOR(ABS(stop_key / (111320 * COS(RADIANS(stop_lat)))) * 1e9 + 0.5) / 1e9 AS deg,
       FLOOR(stop_lon * 111132.92 * COS(RADIANS(stop_lat)) * 1000 + 0.5) / 1000 AS m FROM {stops}""",
)
def _(i):
    return i.stops.select(
        "stop_id",
        X.half_up(X.metres_to_degrees("stop_key", "stop_lat"), 9).alias("deg"),
        X.half_up(X.degrees_to_metres("stop_lon", "stop_lat"), 3).alias("m"),
    )


def _geodesic_sql():
    f = X.WGS84_F
    b = X.WGS84_A * (1 - f)
    sql = f"""SELECT stop_id, RADIANS(35.0 - stop_lon) AS span, RADIANS(35.0 - stop_lon) AS lam,
       ATAN((1 - {f!r}) * TAN(RADIANS(stop_lat))) AS u1, ATAN((1 - {f!r}) * TAN(RADIANS(CAST(31.9 AS DOUBLE)))) AS u2 FROM {{stops}}"""
    parts = """SELECT *, SIN(u1) AS su1, COS(u1) AS cu1, SIN(u2) AS su2, COS(u2) AS cu2 FROM ({0}) z{1}"""
    sql = parts.format(sql, "a")

    def angles(inner, n):
        s = f"SELECT *, SQRT(POW(cu2 * SIN(lam), 2) + POW(cu1 * su2 - su1 * cu2 * COS(lam), 2)) AS ss, su1 * su2 + cu1 * cu2 * COS(lam) AS cs FROM ({inner}) a{n}"
        s = f"SELECT *, ATAN2(ss, cs) AS sg, cu1 * cu2 * SIN(lam) / ss AS sa FROM ({s}) b{n}"
        s = f"SELECT *, 1 - sa * sa AS c2 FROM ({s}) c{n}"
        return f"SELECT *, cs - 2 * su1 * su2 / c2 AS cm FROM ({s}) d{n}"

    keep = "stop_id, span, su1, cu1, su2, cu2"
    for n in range(12):
        sql = angles(sql, n)
        sql = f"SELECT *, {f / 16!r} * c2 * (4 + {f!r} * (4 - 3 * c2)) AS cc FROM ({sql}) e{n}"
        sql = f"SELECT {keep}, span + (1 - cc) * {f!r} * sa * (sg + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) AS lam FROM ({sql}) f{n}"
    sql = angles(sql, 99)
    a = X.WGS84_A
    sql = f"SELECT *, c2 * {(a * a - b * b) / (b * b)!r} AS us FROM ({sql}) g"
    sql = f"SELECT *, 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us))) AS ba, us / 1024 * (256 + us * (-128 + us * (74 - 47 * us))) AS bb FROM ({sql}) h"
    delta = "bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))"
    return f"SELECT stop_id, FLOOR({b!r} * ba * (sg - {delta}) * 1000 + 0.5) / 1000 AS m FROM ({sql}) k"


@check("x5_geodesic", _geodesic_sql())
def _(i):
    return i.stops.select("stop_id", m3(X.geodesic_m("stop_lon", "stop_lat", F.lit(35.0), F.lit(31.9))).alias("m"))


@check(
    "x6_text_before",
    """SELECT o_orderkey, SPLIT_PART(o_orderpriority, '-', 1) AS head, CASE WHEN INSTR(o_orderpriority, '_') > 1 THEN SPLIT_PART(o_orderpriority, '_', 1) END AS needed FROM {orders}""",
)
def _(i):
    p = F.col("o_orderpriority")
    return i.orders.select("o_orderkey", X.text_before(p, "-").alias("head"), X.text_before(p, "_", True).alias("needed"))


@check(
    "x7_last_logged_time",
    """SELECT run_id, CASE WHEN run_id % 5 = 0 THEN '08:15:00' ELSE t END AS time, CASE WHEN run_id % 5 = 0 OR run_id % 4 < 2 THEN 'start' ELSE 'end' END AS kind
FROM (SELECT o_orderkey AS run_id, CONCAT(CAST(o_orderkey % 24 AS STRING), ':', LPAD(CAST(o_custkey % 60 AS STRING), 2, '0'), ':30') AS t FROM {orders}) z""",
)
def _(i):
    time, kind = X.last_logged_time("text")
    return i.logs.select("run_id", time.alias("time"), kind.alias("kind"))


@check(
    "x9_closest_on_segment",
    """SELECT link_id, seg, FLOOR((ax + t * (bx - ax)) * 1000 + 0.5) / 1000 AS qx, FLOOR((ay + t * (by_ - ay)) * 1000 + 0.5) / 1000 AS qy,
  FLOOR(SQRT((ax + t * (bx - ax) - 1000) * (ax + t * (bx - ax) - 1000) + (ay + t * (by_ - ay) - 1000) * (ay + t * (by_ - ay) - 1000)) * 1000 + 0.5) / 1000 AS d
FROM (SELECT *, GREATEST(CAST(0.0 AS DOUBLE), LEAST(CAST(1.0 AS DOUBLE), ((1000 - ax) * (bx - ax) + (1000 - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM {segments}) z""",
)
def _(i):
    segs = R.segments(i.roads)
    qx, qy, d = X.closest_on_segment(F.lit(1000), F.lit(1000), "ax", "ay", "bx", "by")
    return segs.select("link_id", "seg", m3(qx).alias("qx"), m3(qy).alias("qy"), m3(d).alias("d"))


@check(
    "x10_project_tm",
    """SELECT stop_id, FLOOR((500000 + 0.9996 * n * (a + (1 - t + c) * POW(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * POW(a, 5) / 120)) * 1000 + 0.5) / 1000 AS x,
  FLOOR(0.9996 * (6378137.0 * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * phi - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * SIN(2 * phi)
    + (15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * SIN(4 * phi) - (35 * e2 * e2 * e2 / 3072) * SIN(6 * phi))
    + n * TAN(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * POW(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * POW(a, 6) / 720)) * 1000 + 0.5) / 1000 AS y
FROM (SELECT *, 6378137.0 / SQRT(1 - e2 * POW(SIN(phi), 2)) AS n, POW(TAN(phi), 2) AS t, ep2 * POW(COS(phi), 2) AS c, COS(phi) * RADIANS(stop_lon - 33) AS a
      FROM (SELECT *, e2 / (1 - e2) AS ep2 FROM (SELECT stop_id, stop_lon, RADIANS(stop_lat) AS phi, CAST(0.0066943799901413165 AS DOUBLE) AS e2 FROM {stops}) p) q) r""",
)
def _(i):
    x, y = X.project_tm("stop_lon", "stop_lat", 33.0)
    return i.stops.select("stop_id", m3(x).alias("x"), m3(y).alias("y"))


@check(
    "x11_ring_area",
    "SELECT aid, CAST(4 * flats * flats AS DOUBLE) AS area FROM {buildings}",
)
def _(i):
    return i.buildings.select("aid", F.round(X.ring_area(square(F.col("flats").cast("double"))), 6).alias("area"))


@check(
    "x12_round_up_magnitude",
    """SELECT event_id, CASE WHEN v <= 0 THEN 0 ELSE CEIL(v / POW(10, FLOOR(LOG10(v)))) * POW(10, FLOOR(LOG10(v))) END AS top FROM (SELECT event_id, CAST(FLOOR(value * 10) - 50 AS DOUBLE) AS v FROM {events}) z""",
)
def _(i):
    return i.events.select("event_id", X.round_up_magnitude(F.floor(F.col("value") * 10) - 50).alias("top"))
