"""Travel times by transit, and the journeys behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayreach.functions import expr as X
from wayreach.operators import measures as A
from wayreach.operators import timetable as TT
from wayreach.operators import transit as P
from wayreach.plans import access

from .derived import Inputs
from .registry import check

START = 30600
LIMITS = P.Limits()
SCHEDULE = P.Limits(schedule=True)

EVENTS = """SELECT route_id, trip_id, stop_sequence AS seq, stop_id, t, MIN(t) OVER (PARTITION BY trip_id) AS t_first FROM {stop_times}"""
MIRRORED = """SELECT route_id, trip_id, -stop_sequence AS seq, stop_id, -t AS t, -MAX(t) OVER (PARTITION BY trip_id) AS t_first FROM {stop_times}"""


def labels_sql(limits: P.Limits, backward: bool = False, rounds: int | None = None) -> str:
    """Common table expressions l0, r1, w1, l1, ... in plain SQL."""
    deps = P.schedule_starts(START, limits.gap, backward) if limits.schedule else [START]
    walk_base = "d.dep"
    if backward:
        shift = limits.gap if limits.schedule else 0
        deps = [-(d + shift) for d in deps]
        walk_base, limits = str(-START), limits.swapped()
    values = ", ".join(f"(CAST({d} AS BIGINT))" for d in deps)
    parts = [
        f"ev AS MATERIALIZED ({MIRRORED if backward else EVENTS})",
        f"""l0 AS MATERIALIZED (
  SELECT s.src, d.dep, f.to_id AS place, 's' AS kind, d.dep + f.walk_s AS t, d.dep AS start, f.walk_s, s.src AS prev,
         CAST(NULL AS BIGINT) AS board_t, CAST(NULL AS STRING) AS trip
  FROM {{sources}} s JOIN (VALUES {values}) d(dep) ON TRUE JOIN {{footpaths}} f ON f.from_id = s.src AND f.from_kind = 'b' AND f.to_kind = 's' AND f.walk_s <= {limits.walk1}
  UNION ALL
  SELECT n.src, d.dep, n.place, 'b', {walk_base} + n.walk_s, CAST({walk_base} AS BIGINT), n.walk_s, n.src, NULL, NULL
  FROM {{near_buildings}} n JOIN (VALUES {values}) d(dep) ON TRUE WHERE n.src <> n.place)""",
    ]
    for k in range(1, (limits.max_transfers + 1 if rounds is None else rounds) + 1):
        wait = limits.first_wait if k == 1 else limits.wait_transfer
        start = "o.board_t - l.walk_s" if limits.schedule and k == 1 else "l.start"
        more = k <= limits.max_transfers
        allowed = f"f.to_kind = 'b' AND f.walk_s <= {limits.walk3}"
        if more:
            allowed = f"(f.walk_s <= {limits.walk2} OR ({allowed}))"
        parts += [
            f"""b{k} AS MATERIALIZED (SELECT stop_id, t, route_id, seq, trip_id, board_t FROM (
  SELECT a.stop_id, a.t, e.route_id, e.seq, e.trip_id, e.t AS board_t,
         ROW_NUMBER() OVER (PARTITION BY a.stop_id, a.t, e.route_id, e.seq ORDER BY e.t_first, e.trip_id, e.t) AS rn
  FROM (SELECT DISTINCT place AS stop_id, t FROM l{k - 1} WHERE kind = 's') a
  JOIN ev e ON e.stop_id = a.stop_id AND e.t BETWEEN a.t + 1 AND a.t + {wait}) z WHERE rn = 1)""",
            f"""o{k} AS MATERIALIZED (SELECT stop_id, t, to_stop, alight_t, board_t, trip FROM (
  SELECT b.stop_id, b.t, e.stop_id AS to_stop, e.t AS alight_t, b.board_t, CONCAT(b.route_id, '_', b.trip_id) AS trip,
         ROW_NUMBER() OVER (PARTITION BY b.stop_id, b.t, e.stop_id ORDER BY e.t, b.board_t DESC, b.trip_id, b.route_id) AS rn
  FROM b{k} b JOIN ev e ON e.trip_id = b.trip_id AND e.seq > b.seq AND e.stop_id <> b.stop_id) z WHERE rn = 1)""",
            f"""r{k} AS MATERIALIZED (SELECT src, dep, place, 's' AS kind, t, start, CAST(NULL AS BIGINT) AS walk_s, prev, board_t, trip FROM (
  SELECT l.src, l.dep, o.to_stop AS place, o.alight_t AS t, {start} AS start, o.stop_id AS prev, o.board_t, o.trip,
         ROW_NUMBER() OVER (PARTITION BY l.src, l.dep, o.to_stop ORDER BY o.alight_t, {start} DESC, o.stop_id, o.board_t, o.trip) AS rn
  FROM l{k - 1} l JOIN o{k} o ON o.stop_id = l.place AND o.t = l.t WHERE l.kind = 's' AND o.alight_t <= l.dep + {limits.horizon}) z WHERE rn = 1)""",
            f"""w{k} AS MATERIALIZED (SELECT src, dep, place, kind, t, start, walk_s, prev, CAST(NULL AS BIGINT) AS board_t, CAST(NULL AS STRING) AS trip FROM (
  SELECT r.src, r.dep, f.to_id AS place, f.to_kind AS kind, r.t + f.walk_s AS t, r.start, f.walk_s, r.place AS prev,
         ROW_NUMBER() OVER (PARTITION BY r.src, r.dep, f.to_id, f.to_kind ORDER BY r.t + f.walk_s, r.start DESC, r.place, f.walk_s) AS rn
  FROM r{k} r JOIN {{footpaths}} f ON f.from_id = r.place AND f.from_kind = 's' AND {allowed} WHERE r.t + f.walk_s <= r.dep + {limits.horizon}
    AND NOT EXISTS (SELECT 1 FROM r{k} q WHERE q.src = r.src AND q.dep = r.dep AND q.place = f.to_id AND f.to_kind = 's')) z WHERE rn = 1)""",
            f"l{k} AS MATERIALIZED (SELECT * FROM r{k} UNION ALL SELECT * FROM w{k})",
        ]
    return "WITH " + ",\n".join(parts)


def journeys_sql(limits: P.Limits, backward: bool = False, by_dep: bool = False) -> str:
    """The same, then ``j``: the best journey per (src, place) (per start time if ``by_dep``)."""
    used = limits.swapped() if backward else limits
    every = " UNION ALL ".join(f"SELECT *, {k} AS k FROM l{k}" for k in range(limits.max_transfers + 2))
    ok = f"kind = 'b' AND place <> src AND walk_s <= {used.walk3} AND GREATEST(k - 1, 0) >= {used.min_transfers}"
    if limits.schedule:
        window = f"start <= {-START}" if backward else f"start <= dep + {limits.gap}"
        ok += f" AND t - start <= {limits.max_time} AND {window}"
    keys = "src, dep, place" if by_dep else "src, place"
    order = "t - start, GREATEST(k - 1, 0), -k" if by_dep else "t - start, dep, GREATEST(k - 1, 0), -k"
    return (
        labels_sql(limits, backward)
        + f""",
j AS MATERIALIZED (SELECT src, dep, place, k, t, start, walk_s, prev, t - start AS duration, GREATEST(k - 1, 0) AS transfers FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM ({every}) e WHERE {ok}) z WHERE rn = 1)
"""
    )


OD_FROM = "SELECT src AS origin_aid, place AS destination_aid, duration AS duration_s, CAST(transfers AS INTEGER) AS transfers FROM j"
OD_TO = "SELECT place AS origin_aid, src AS destination_aid, duration AS duration_s, CAST(transfers AS INTEGER) AS transfers FROM j"


def rounds(i: Inputs, limits: P.Limits = LIMITS, backward: bool = False):
    """Labels of the whole search."""
    starts, events, paths, walk_at = [START], i.stop_events, i.footpaths, None
    if backward:
        starts, events, paths, limits = P.backward_inputs(starts, events, paths, limits)
        walk_at = -START
    return P.travel_labels(i.sources, starts, events, paths, i.near_buildings, limits, walk_at)


def journeys(i: Inputs, limits: P.Limits, backward: bool = False):
    return P.transit_journeys(i.sources, i.stop_events, i.footpaths, i.near_buildings, START, limits, backward)


LABEL_COLUMNS = "src, place, kind, t, start, walk_s, prev, board_t, trip"


def label_rows(df):
    return df.select(*LABEL_COLUMNS.split(", "))


# -- single rounds -------------------------------------------------------------------


@check("p1_initial_access", labels_sql(LIMITS, rounds=0) + f"SELECT {LABEL_COLUMNS} FROM l0 WHERE kind = 's'")
def _(i):
    return label_rows(P.initial_access(P.with_departures(i.sources, [START]), i.footpaths, LIMITS.walk1))


@check(
    "p2_first_step",
    """SELECT from_id AS src, to_id AS place, 's' AS kind, 30600 + walk_s + 60 AS t, 30600 AS start, walk_s, from_id AS prev
FROM {footpaths} WHERE from_kind = 'b' AND to_kind = 's'""",
)
def _(i):
    walks = i.footpaths.filter("from_kind = 'b' AND to_kind = 's'")
    access = walks.select(
        F.col("from_id").alias("src"), F.lit(START).alias("dep"), F.col("to_id").alias("stop_id"), (START + F.col("walk_s") + 60).alias("t"), "walk_s"
    )
    return P.first_step(access).select("src", "place", "kind", "t", "start", "walk_s", "prev")


@check("p3_walk_only_trips", labels_sql(LIMITS, rounds=0) + f"SELECT {LABEL_COLUMNS} FROM l0 WHERE kind = 'b'")
def _(i):
    return label_rows(P.walk_only_trips(P.with_departures(i.sources, [START]), i.near_buildings))


def first_arrivals(i, backward=False):
    timed = P.with_departures(i.sources, [START])
    stops = P.initial_access(timed, i.footpaths, LIMITS.walk1)
    t = 2 * F.col("dep") - F.col("t") if backward else F.col("t")
    return stops.select(F.col("place").alias("stop_id"), t.alias("t"))


@check("p4_board_next_trip", labels_sql(LIMITS, rounds=1) + "SELECT * FROM b1")
def _(i):
    return P.board_next_trip(first_arrivals(i), i.stop_events, LIMITS.first_wait)


@check(
    "p5_board_previous_trip",
    labels_sql(LIMITS, True, rounds=1) + "SELECT stop_id, -t AS t, route_id, -seq AS seq, trip_id, -board_t AS board_t FROM b1",
)
def _(i):
    return P.board_previous_trip(first_arrivals(i, True), i.stop_events, LIMITS.first_wait)


@check("p6_ride_round", labels_sql(LIMITS, rounds=1) + f"SELECT {LABEL_COLUMNS} FROM r1")
def _(i):
    zero = P.initial_access(P.with_departures(i.sources, [START]), i.footpaths, LIMITS.walk1)
    boardings = P.board_next_trip(first_arrivals(i), i.stop_events, LIMITS.first_wait)
    options = P.ride_options(boardings, i.stop_events, LIMITS.horizon)
    return label_rows(P.ride_round(zero, options, 1, LIMITS.horizon))


def ridden(i, k, backward=False):
    return rounds(i, LIMITS, backward).filter((F.col("k") == k) & F.col("board_t").isNotNull())


def walked(i, k, backward=False):
    return rounds(i, LIMITS, backward).filter((F.col("k") == k) & F.col("walk_s").isNotNull())


@check("p7_ride_round_reverse", labels_sql(LIMITS, True) + f"SELECT 1 AS k, {LABEL_COLUMNS} FROM r1 UNION ALL SELECT 2, {LABEL_COLUMNS} FROM r2")
def _(i):
    labels = rounds(i, LIMITS, True).filter("board_t IS NOT NULL")
    return labels.select("k", *LABEL_COLUMNS.split(", "))


@check("p8_transfer_walk", labels_sql(LIMITS) + f"SELECT {LABEL_COLUMNS} FROM w1")
def _(i):
    return label_rows(walked(i, 1))


@check("p9_egress_walk", labels_sql(LIMITS) + f"SELECT {LABEL_COLUMNS} FROM w2")
def _(i):
    return label_rows(walked(i, 2))


@check("p10_walks_reverse", labels_sql(LIMITS, True) + f"SELECT 1 AS k, {LABEL_COLUMNS} FROM w1 UNION ALL SELECT 2, {LABEL_COLUMNS} FROM w2")
def _(i):
    labels = rounds(i, LIMITS, True).filter("walk_s IS NOT NULL AND k > 0")
    return labels.select("k", *LABEL_COLUMNS.split(", "))


@check("p10_last_walks_reverse", labels_sql(LIMITS, True) + f"SELECT {LABEL_COLUMNS} FROM w2")
def _(i):
    return label_rows(rounds(i, LIMITS, True).filter("walk_s IS NOT NULL AND k = 2"))


# -- journeys ----------------------------------------------------------------------------

ALL_LABELS = " UNION ALL ".join(f"SELECT *, {k} AS k FROM l{k}" for k in range(3))


@check(
    "p11_journey_metrics",
    labels_sql(LIMITS) + f"SELECT src, place, k, t - start AS duration, GREATEST(k - 1, 0) AS transfers FROM ({ALL_LABELS}) z",
)
def _(i):
    return P.journey_metrics(rounds(i)).select("src", "place", "k", "duration", "transfers")


STRICT = P.Limits(min_transfers=1, walk3=250)


@check(
    "p12_filter_journeys",
    labels_sql(STRICT) + f"SELECT src, place, k, t - start AS duration FROM ({ALL_LABELS}) z WHERE walk_s <= 250 AND k >= 2",
)
def _(i):
    kept = P.filter_journeys(P.journey_metrics(rounds(i, STRICT)), STRICT)
    return kept.select("src", "place", "k", "duration")


@check("p13_best_journey", journeys_sql(LIMITS, by_dep=True) + "SELECT src, dep, place, k, duration, transfers, walk_s, prev FROM j")
def _(i):
    buildings = rounds(i).filter("kind = 'b' AND place <> src")
    best = P.best_journey(P.filter_journeys(P.journey_metrics(buildings), LIMITS))
    return best.select("src", "dep", "place", "k", "duration", "transfers", "walk_s", "prev")


@check(
    "p14_all_destinations",
    labels_sql(LIMITS)
    + f"""SELECT src, dep, place, kind, duration, transfers FROM (SELECT *, t - start AS duration, GREATEST(k - 1, 0) AS transfers,
  ROW_NUMBER() OVER (PARTITION BY src, place, kind ORDER BY t - start, GREATEST(k - 1, 0), -k) AS rn FROM ({ALL_LABELS}) e WHERE walk_s <= 400 AND (place <> src OR kind <> 'b')) z WHERE rn = 1""",
)
def _(i):
    found = P.all_destinations(rounds(i), LIMITS, include_stops=True)
    return found.select("src", "dep", "place", "kind", "duration", "transfers")


LEGS = """,
legs AS MATERIALIZED (
  SELECT j.*, NULL AS b1, NULL AS bt1, NULL AS a1, NULL AS at1, NULL AS tr1, NULL AS w1, NULL AS b2, NULL AS bt2, NULL AS a2, NULL AS at2, NULL AS tr2, NULL AS w2
  FROM j WHERE k = 0
  UNION ALL
  SELECT j.*, r.prev, r.board_t, r.place, r.t, r.trip, l.walk_s, NULL, NULL, NULL, NULL, NULL, NULL
  FROM j JOIN r1 r ON r.src = j.src AND r.dep = j.dep AND r.place = j.prev JOIN l0 l ON l.src = j.src AND l.dep = j.dep AND l.place = r.prev WHERE j.k = 1
  UNION ALL
  SELECT j.*, q.prev, q.board_t, q.place, q.t, q.trip, l.walk_s, r.prev, r.board_t, r.place, r.t, r.trip, m.walk_s
  FROM j JOIN r2 r ON r.src = j.src AND r.dep = j.dep AND r.place = j.prev
  JOIN l1 m ON m.src = j.src AND m.dep = j.dep AND m.place = r.prev
  JOIN r1 q ON q.src = j.src AND q.dep = j.dep AND q.place = CASE WHEN m.walk_s IS NULL THEN m.place ELSE m.prev END
  JOIN l0 l ON l.src = j.src AND l.dep = j.dep AND l.place = q.prev WHERE j.k = 2)
"""


@check(
    "p15_unroll_journey",
    journeys_sql(LIMITS) + LEGS + "SELECT src, place, k, w1, b1, bt1, a1, at1, tr1, w2, b2, bt2, a2, at2, tr2, walk_s FROM legs",
)
def _(i):
    found, labels = journeys(i, LIMITS)
    df = P.unroll_journey(found, labels, 2)
    names = {}
    for k in (1, 2):
        names |= {f"r{k}_board": f"b{k}", f"r{k}_board_t": f"bt{k}", f"r{k}_alight": f"a{k}", f"r{k}_alight_t": f"at{k}", f"r{k}_trip": f"tr{k}"}
    return df.withColumnsRenamed(names).select(
        "src", "place", "k", *[f"{c}{k}" for k in (1, 2) for c in ("w", "b", "bt", "a", "at", "tr")], "walk_s"
    )


@check("p16_schedule_scan", journeys_sql(SCHEDULE) + "SELECT src, place, dep, start, k, duration FROM j")
def _(i):
    found, _labels = journeys(i, SCHEDULE)
    return found.select("src", "place", "dep", "start", "k", "duration")


@check("p16_schedule_scan_reverse", journeys_sql(SCHEDULE, True) + "SELECT src, place, dep, start, k, duration FROM j")
def _(i):
    found, _labels = journeys(i, SCHEDULE, True)
    return found.select("src", "place", "dep", "start", "k", "duration")


@check("p17_transit_from", journeys_sql(LIMITS) + OD_FROM)
def _(i):
    return P.transit_from(i.sources, i.stop_events, i.footpaths, i.near_buildings, START, LIMITS)


@check("p17_transit_to", journeys_sql(LIMITS, True) + OD_TO)
def _(i):
    return P.transit_to(i.sources, i.stop_events, i.footpaths, i.near_buildings, START, LIMITS)


THREE_RIDES = P.Limits(max_transfers=2)


@check("p17_transit_three_rides", journeys_sql(THREE_RIDES) + OD_FROM)
def _(i):
    return P.transit_from(i.sources, i.stop_events, i.footpaths, i.near_buildings, START, THREE_RIDES)


def clock(c):
    return (
        f"CASE WHEN {c} IS NOT NULL THEN CONCAT(LPAD(CAST(CAST(FLOOR(({c}) / 3600) AS BIGINT) AS STRING), 2, '0'), ':', "
        f"LPAD(CAST(CAST(FLOOR((({c}) % 3600) / 60) AS BIGINT) AS STRING), 2, '0'), ':', LPAD(CAST(({c}) % 60 AS STRING), 2, '0')) END"
    )


def stop(c):
    return f"CASE WHEN {c} IS NOT NULL THEN CONCAT('s:', {c}) END"


NUMBERS = ("Walk_time", "Wait_time", "Ride_time")
THIRD = ", ".join(
    f"CAST(NULL AS {'BIGINT' if c in NUMBERS else 'STRING'}) AS {c}3"
    for c in ("Walk_time", "BStop_ID", "Wait_time", "Bus_start_time", "Line_ID", "Ride_time", "AStop_ID", "Bus_finish_time")
)
NO_RIDES = ", ".join(
    f"NULL AS {c}{k}"
    for k in (1, 2)
    for c in ("BStop_ID", "Wait_time", "Bus_start_time", "Line_ID", "Ride_time", "AStop_ID", "Bus_finish_time")
)
OWN = f"""
UNION ALL BY NAME SELECT src AS Origin_aid, {clock(START)} AS Start_time, 0 AS Walk_time1, NULL AS Walk_time2, {NO_RIDES}, {THIRD},
0 AS DestWalk_time, src AS Destination_aid, {clock(START)} AS Destination_time, 0 AS Legs, 0 AS Duration"""

FROM_TABLE = f"""
SELECT src AS Origin_aid, {clock("start")} AS Start_time,
  COALESCE(w1, 0) AS Walk_time1, {stop("b1")} AS BStop_ID1, bt1 - start - COALESCE(w1, 0) AS Wait_time1, {clock("bt1")} AS Bus_start_time1, tr1 AS Line_ID1,
  at1 - bt1 AS Ride_time1, {stop("a1")} AS AStop_ID1, {clock("at1")} AS Bus_finish_time1,
  CASE WHEN b2 IS NOT NULL THEN COALESCE(w2, 0) END AS Walk_time2, {stop("b2")} AS BStop_ID2, bt2 - at1 - COALESCE(w2, 0) AS Wait_time2, {clock("bt2")} AS Bus_start_time2,
  tr2 AS Line_ID2, at2 - bt2 AS Ride_time2, {stop("a2")} AS AStop_ID2, {clock("at2")} AS Bus_finish_time2, {THIRD},
  walk_s AS DestWalk_time, place AS Destination_aid, {clock("t")} AS Destination_time, transfers + 1 AS Legs, duration AS Duration FROM legs"""


@check("p18_trip_table_from", journeys_sql(LIMITS) + LEGS + FROM_TABLE + OWN + " FROM {sources}")
def _(i):
    found, labels = journeys(i, LIMITS)
    return P.trip_table(i.sources, found, labels, START, LIMITS)


@check("p18_trip_table_from_schedule", journeys_sql(SCHEDULE) + LEGS + FROM_TABLE + OWN + " FROM {sources}")
def _(i):
    found, labels = journeys(i, SCHEDULE)
    return P.trip_table(i.sources, found, labels, START, SCHEDULE)


def to_table(limit_name):
    """Search ride 2 (if any) is the traveller's first ride; times change sign."""
    two = "k = 2"
    b1, bt1 = f"CASE WHEN {two} THEN a2 ELSE a1 END", f"CASE WHEN {two} THEN -at2 ELSE -at1 END"
    a1, at1 = f"CASE WHEN {two} THEN b2 ELSE b1 END", f"CASE WHEN {two} THEN -bt2 ELSE -bt1 END"
    tr1 = f"CASE WHEN {two} THEN tr2 ELSE tr1 END"
    b2, bt2, a2, at2 = (f"CASE WHEN {two} THEN {c} END" for c in ("a1", "-at1", "b1", "-bt1"))
    inner = f"""SELECT *, -t AS leaves, {b1} AS x1, {bt1} AS xt1, {a1} AS y1, {at1} AS yt1, {tr1} AS line1,
      {b2} AS x2, {bt2} AS xt2, {a2} AS y2, {at2} AS yt2, CASE WHEN {two} THEN tr1 END AS line2, CASE WHEN {two} THEN COALESCE(w2, 0) END AS walk2 FROM legs"""
    return f"""
SELECT place AS Origin_aid, {clock("leaves")} AS Start_time,
  CASE WHEN k > 0 THEN walk_s ELSE 0 END AS Walk_time1, {stop("x1")} AS BStop_ID1, xt1 - leaves - walk_s AS Wait_time1, {clock("xt1")} AS Bus_start_time1, line1 AS Line_ID1,
  yt1 - xt1 AS Ride_time1, {stop("y1")} AS AStop_ID1, {clock("yt1")} AS Bus_finish_time1,
  walk2 AS Walk_time2, {stop("x2")} AS BStop_ID2, xt2 - yt1 - walk2 AS Wait_time2, {clock("xt2")} AS Bus_start_time2, line2 AS Line_ID2,
  yt2 - xt2 AS Ride_time2, {stop("y2")} AS AStop_ID2, {clock("yt2")} AS Bus_finish_time2, {THIRD},
  CASE WHEN k = 0 THEN walk_s ELSE w1 END AS DestWalk_time, src AS Destination_aid,
  CASE WHEN k = 0 THEN {clock(START)} ELSE {clock("COALESCE(yt2, yt1) + w1")} END AS Destination_time, {clock(START)} AS {limit_name},
  transfers + 1 AS Legs, duration AS Duration FROM ({inner}) legs2""" + OWN + f", {clock(START)} AS {limit_name} FROM {{sources}}"


@check("p18_trip_table_to", journeys_sql(LIMITS, True) + LEGS + to_table("Arrive_before"))
def _(i):
    found, labels = journeys(i, LIMITS, True)
    return P.trip_table(i.sources, found, labels, START, LIMITS, True)


@check("p18_trip_table_to_schedule", journeys_sql(SCHEDULE, True) + LEGS + to_table("Earlest_arrival_time"))
def _(i):
    found, labels = journeys(i, SCHEDULE, True)
    return P.trip_table(i.sources, found, labels, START, SCHEDULE, True)


# -- measures on transit results -----------------------------------------------------------


def od_pairs(i):
    od = P.transit_from(i.sources, i.stop_events, i.footpaths, i.near_buildings, START, LIMITS)
    return A.with_own_pairs(access.pairs(od, False), stars(i))


def stars(i):
    return i.sources.select(F.col("src").cast("long").alias("star"))


@check(
    "a3_cumulative_opportunities_transit",
    journeys_sql(LIMITS)
    + """SELECT CAST(s.src AS BIGINT) AS star, n.bin, n.bin * 300 AS bound_s, 1 + COUNT(j.place) AS nbldg, CAST(MIN(a.jobs) + COALESCE(SUM(h.jobs), 0) AS BIGINT) AS jobs
FROM {sources} s JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9)) n(bin) ON TRUE
JOIN {buildings} a ON CAST(a.aid AS STRING) = s.src
LEFT JOIN j ON j.src = s.src AND j.duration <= n.bin * 300 LEFT JOIN {buildings} h ON CAST(h.aid AS STRING) = j.place GROUP BY s.src, n.bin""",
)
def _(i):
    return A.cumulative_opportunities(od_pairs(i), 300, LIMITS.max_time, i.buildings, ["jobs"], sources=stars(i))


@check(
    "a2_service_area_transit",
    journeys_sql(LIMITS)
    + """SELECT CAST(src AS BIGINT) AS star, CAST(place AS BIGINT) AS hash, duration AS duration_s FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY place ORDER BY duration, CAST(src AS BIGINT)) AS rn
  FROM (SELECT src, place, duration FROM j UNION ALL SELECT src, src, 0 FROM {sources}) p) z WHERE rn = 1""",
)
def _(i):
    return A.service_area(od_pairs(i))


@check("x2_departure_text", "SELECT trip_id, " + clock("MIN(t)") + " AS first_time FROM {stop_times} GROUP BY trip_id")
def _(i):
    first = TT.stop_events(i.stop_times).groupBy("trip_id").agg(F.min("t").alias("t"))
    return first.select("trip_id", X.seconds_to_time("t").alias("first_time"))
