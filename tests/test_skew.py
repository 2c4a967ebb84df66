"""Joins with heavy keys, and the boarding windows of the profile search."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from checks import derived
from checks.derived import Inputs
from wayreach.functions import skew
from wayreach.operators import car, gtfs_clean, measures, profile
from wayreach.operators import transit as P


def test_heavy_keys_are_dealt_and_nothing_is_lost(spark):
    # half of all rows stand at one stop and second
    rows = [(f"s{k}", "hot" if k % 2 else f"p{k % 50}", 7 if k % 2 else k % 3) for k in range(4000)]
    left = spark.createDataFrame(rows, "src string, place string, t long")
    options = [("hot", 7, n) for n in range(3)] + [(f"p{k}", t, k) for k in range(50) for t in range(3)]
    right = spark.createDataFrame(options, "place string, t long, n long")
    plain = Counter(tuple(r) for r in left.join(right, ["place", "t"]).select("src", "place", "t", "n").collect())
    dealt = skew.spread_join(left, right, ["place", "t"], "src", min_rows=100)
    assert Counter(tuple(r) for r in dealt.select("src", "place", "t", "n").collect()) == plain
    fans = {(r.place, r.t): r["__fan"] for r in skew.heavy_keys(left, ["place", "t"], min_rows=100).collect()}
    assert fans == {("hot", 7): 20}


def test_no_task_gets_many_times_the_median(spark):
    """The rows that a task of the join receives, with one stop and second holding half of all labels."""
    rows = spark.range(40_000).select(
        F.concat(F.lit("s"), "id").alias("src"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 997)).alias("place"),
    )
    heavy = skew.heavy_keys(rows, ["place"], min_rows=200)
    dealt = rows.join(F.broadcast(heavy), "place", "left")
    part = F.pmod(F.xxhash64("src"), F.coalesce("__fan", F.lit(1)).cast("long")).cast("int")
    sizes = sorted(r["count"] for r in dealt.withColumn("part", part).repartition(16, "place", "part").groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 4 * sizes[8]


def test_boarding_windows_against_every_second(spark):
    """From each second, the trip to take of each route: the first in route order that leaves in time."""
    rng = random.Random(4)
    events = []
    for route in range(3):
        for trip in range(14):
            first = rng.randrange(0, 600)
            # trips overtake each other, and some leave at the same second
            events.append((f"R{route}", f"T{route}-{trip:02d}", 1, "A", first + rng.choice([0, 30, 200, 400]), first))
    frame = spark.createDataFrame(events, "route_id string, trip_id string, seq long, stop_id string, t long, t_first long")
    wait, change = 150, 1
    expected = set()
    for now in range(-50, 1100):
        for route in range(3):
            best = min(((f, trip, t) for r, trip, _, _, t, f in events if r == f"R{route}" and now + change <= t <= now + wait), default=None)
            if best is not None:
                expected.add((now, f"R{route}", best[1], best[2]))
    asked = spark.createDataFrame([("A", t) for t in range(-50, 1100)], "stop_id string, t long")
    found = [(r.t, r.route_id, r.trip_id, r.board_t) for r in P.board_next_trip(asked, frame, wait, change).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert profile.boarding_windows(frame, 0, change).isEmpty()


def test_more_start_times_than_one_row_holds(spark, monkeypatch):
    """Ways of many start times lie in several rows; the result is that of one search for each."""
    from test_transit import Net

    net, limits = Net(5), P.Limits(max_time=4000)
    times = [28000 + 200 * k for k in range(7)]
    whole = {(r.src, r.place, r.run): (r.duration, r.transfers) for r in P.transit_runs(*net.frames(spark), times, limits).collect()}
    monkeypatch.setattr(profile, "SLOTS", 3)
    parts = {(r.src, r.place, r.run): (r.duration, r.transfers) for r in P.transit_runs(*net.frames(spark), times, limits).collect()}
    assert whole == parts and len(whole) > 20


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spread_join_builds_no_side_on_the_driver(spark):
    left = spark.range(100).selectExpr("id % 7 AS k", "id AS src")
    right = spark.range(7).selectExpr("id AS k", "id * 10 AS v")
    joined = skew.spread_join(left, right, ["k"], "src")
    # what is broadcast are the heavy keys, for each side once
    assert "SortMergeJoin" in plan_of(joined) and plan_of(joined).count("BroadcastHashJoin") <= 2
    assert joined.count() == 100


def test_frequencies_are_joined_without_broadcasts(spark):
    trips = spark.createDataFrame([("a", "r"), ("b", "r")], "trip_id string, route_id string")
    times = spark.createDataFrame([("a", 1, "s", 100), ("a", 2, "u", 160), ("b", 1, "s", 5)], "trip_id string, stop_sequence int, stop_id string, t long")
    runs = spark.createDataFrame([("a", 1000, 1200, 100)], "trip_id string, start_s int, end_s int, headway_secs int")
    new_trips, new_times = gtfs_clean.expand_frequencies(trips, times, runs)
    assert "Broadcast" not in plan_of(new_trips) and "Broadcast" not in plan_of(new_times)
    found = {(r["trip_id"], r["stop_id"], r["t"]) for r in new_times.collect()}
    assert found == {("a", "s", 100), ("a", "u", 160), ("b", "s", 5), ("a_f1000", "s", 1000), ("a_f1000", "u", 1060), ("a_f1100", "s", 1100), ("a_f1100", "u", 1160)}


def test_stop_times_are_joined_without_broadcasts(spark, tmp_path):
    spark.range(5).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    parts = "id AS p_partkey, 'b' AS p_brand, 'n' AS p_name, 't' AS p_type"
    spark.range(6).selectExpr(*parts.split(", ")).write.parquet(f"{tmp_path}/part.parquet")
    orders = "id AS o_orderkey, 'F' AS o_orderstatus, '1' AS o_orderpriority"
    spark.range(9).selectExpr(*orders.split(", ")).write.parquet(f"{tmp_path}/orders.parquet")
    times = Inputs(spark, str(tmp_path)).stop_times
    assert "BroadcastHashJoin" not in plan_of(times)
    rows = times.collect()
    # trip n is of route n % 6, which has 4 + route % 4 stops
    assert Counter(r["trip_id"] for r in rows) == {str(n): 4 + n % 6 % 4 for n in range(9)}
    assert {r["t"] for r in rows if r["stop_sequence"] == 1} == {18000 + n * 97 for n in range(9)}


def largest_task(df):
    """The rows of the fullest part in which the rows of a query come out."""
    return max(r["count"] for r in df.select(F.spark_partition_id().alias("part")).groupBy("part").count().collect())


def timetable(spark, folder):
    """1000 trips of 50 routes."""
    spark.range(40).selectExpr("id AS s_suppkey").write.parquet(f"{folder}/supplier.parquet")
    parts = "id AS p_partkey, 'b' AS p_brand, 'n' AS p_name, 't' AS p_type"
    spark.range(50).selectExpr(*parts.split(", ")).write.parquet(f"{folder}/part.parquet")
    orders = "id AS o_orderkey, 'O' AS o_orderstatus, '1' AS o_orderpriority"
    spark.range(1000).selectExpr(*orders.split(", ")).write.parquet(f"{folder}/orders.parquet")


def test_a_task_joins_a_bounded_share_of_the_trips(spark, tmp_path, monkeypatch):
    timetable(spark, tmp_path)
    plain = Counter(tuple(r) for r in Inputs(spark, str(tmp_path)).stop_times.collect())
    monkeypatch.setattr(derived, "TRIPS_PER_TASK", 10)
    times = Inputs(spark, str(tmp_path)).stop_times
    assert Counter(tuple(r) for r in times.collect()) == plain
    assert largest_task(times) <= sum(plain.values()) // 6


def test_a_task_orders_a_bounded_share_of_the_trips(spark, tmp_path, monkeypatch):
    timetable(spark, tmp_path)
    plain = Counter(tuple(r) for r in Inputs(spark, str(tmp_path)).loop_stop_times.collect())
    monkeypatch.setattr(derived, "TRIPS_PER_TASK", 10)
    times = Inputs(spark, str(tmp_path)).loop_stop_times
    assert Counter(tuple(r) for r in times.collect()) == plain
    assert largest_task(times) <= sum(plain.values()) // 20


def lines(spark, folder):
    """3000 lines, some of the same pair."""
    kinds = "id % 700 AS l_orderkey, id * 7 % 400 AS l_partkey, id * 3 % 50 AS l_suppkey, CAST(id % 7 AS INT) AS l_linenumber"
    spark.range(3000).selectExpr(*kinds.split(", ")).write.parquet(f"{folder}/lineitem.parquet")


def test_a_task_groups_a_bounded_share_of_the_pairs(spark, tmp_path, monkeypatch):
    lines(spark, tmp_path)
    plain = Counter(tuple(r) for r in measures.by_source(Inputs(spark, str(tmp_path)).pairs).collect())
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 100)
    pairs = Inputs(spark, str(tmp_path)).pairs
    least = measures.by_source(pairs)
    # pairs stay where they are when they are grouped once more
    assert plan_of(least).count("Exchange") == 1
    assert Counter(tuple(r) for r in least.collect()) == plain
    assert largest_task(least) <= len(plain) // 10


def test_roundtrips_are_added_up_without_copies_of_the_rows(spark, tmp_path, monkeypatch):
    rows = [
        ("o", "d", "to", "T1", 100), ("o", "d", "to", "T1", 140), ("o", "d", "to", None, 60), ("o", "d", "to", "T2", None),
        ("o", "d", "from", "T1", 10), ("o", "d", "from", "T3", 30), ("o", "d", None, "T9", 5),
        ("o", "e", "to", "T1", 100), (None, "d", "to", "T1", 7), (None, "d", "from", "T1", 8),
    ]
    runs = spark.createDataFrame(rows, "o_id string, d_id string, direction string, label string, duration_s long")
    stats = measures.roundtrip_pairs(runs)
    # std: variances of (100, 140, 60) and (10, 30) over all their sums
    assert {tuple(r) for r in stats.collect()} == {
        ("o", "d", 120.0, 34.16, 6, 3, 2, 70, 2, 2),
        (None, "d", 15.0, 0.0, 1, 1, 1, 15, 1, 1),
    }
    assert "Expand" not in plan_of(stats)
    lines(spark, tmp_path)
    plain = Counter(tuple(r) for r in measures.roundtrip_pairs(Inputs(spark, str(tmp_path)).runs).collect())
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 100)
    dealt = measures.roundtrip_pairs(Inputs(spark, str(tmp_path)).runs)
    assert plan_of(dealt).count("Exchange") == 1
    assert Counter(tuple(r) for r in dealt.collect()) == plain


def test_pairs_by_car_are_made_where_they_are_grouped(spark):
    costs = [(f, n, 10.0 * abs(f - n)) for f in range(12) for n in range(12)]
    sources = [(f"a{i}", i % 12, 5 * (i % 7)) for i in range(40)]
    # each building by two nodes, the first also by a longer way
    egress = [(i % 12, f"a{i}", 7 * (i % 5) + more) for i in range(40) for more in (0, 40)] + [((i + 1) % 12, f"a{i}", 60) for i in range(40)]
    best = {}
    for src, node, access in sources:
        for f, n, d in costs:
            for at, building, out in egress:
                if f == node and at == n:
                    whole, between = access + 10 * d + out, 10 * d
                    if whole <= 200:
                        cost = math.floor(whole + 0.5)
                    elif between < 800:
                        cost = math.floor(200 + between + 0.5)
                    else:
                        cost = math.floor(200 + d * ((whole - 200) / between) / 0.6 + 0.5)
                    way = (0 if src == building else cost, int(whole > 200))
                    best[src, building] = min(best.get((src, building), way), way)
    df = car.car_od(
        spark.createDataFrame(sources, "src string, node long, access_m long"),
        spark.createDataFrame(costs, "src long, node long, d double"),
        spark.createDataFrame(egress, "node long, building string, egress_m long"),
        0.6,
    )
    plan = plan_of(df)
    # small in files or not, nothing is broadcast; and after the last join no pair moves
    assert "Broadcast" not in plan and plan.index("SortMergeJoin") < plan.index("Exchange")
    assert {(r["src"], r["building"]): (r["duration_s"], r["veh_legs"]) for r in df.collect()} == best


def test_legs_are_looked_up_once_for_journeys_by_the_same_ride(spark):
    shape = "src string, dep long, k int, place string, kind string, t long, start long, walk_s long, prev string, board_t long, trip string"
    labels = spark.createDataFrame(
        [("A", 0, 0, "s1", "s", 10, 0, 10, "A", None, None), ("A", 0, 1, "s2", "s", 90, 0, None, "s1", 30, "r_t")], shape
    )
    journeys = spark.createDataFrame([("A", 0, 1, f"B{i}", "s2", 5 + i) for i in range(50)] + [("A", 0, 0, "C", "A", 7)], "src string, dep long, k int, place string, prev string, walk_s long")
    df = P.unroll_journey(journeys, labels, 1)
    rows = {tuple(r) for r in df.select("place", "k", "walk_s", "r1_board", "r1_board_t", "r1_alight", "r1_alight_t", "r1_trip", "w1").collect()}
    assert rows == {(f"B{i}", 1, 5 + i, "s1", 30, "s2", 90, "r_t", 10) for i in range(50)} | {("C", 0, 7, None, None, None, None, None, None)}
    # the ways are looked up for distinct ends, to which the journeys are joined last
    assert "Deduplicate" in df._jdf.queryExecution().analyzed().toString()


# Java leaves methods of more bytes to its interpreter
COMPILED_BYTES = 8000


def largest_method(spark, df):
    sizes = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(df._jdf.queryExecution().executedPlan())
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", sizes))


def test_best_journeys_of_many_start_times_are_compiled(spark):
    from test_transit import Net

    limits = P.Limits(max_time=4000, schedule=True)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sources, events, footpaths, near = Net(5).frames(spark)
        for back in (False, True):
            found = P.search(sources, events, footpaths, near, 30600, limits, back)
            assert found.slots == 6 and largest_method(spark, found.journeys(walks=True)) < COMPILED_BYTES
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


LABELS = "src string, dep long, k int, place string, kind string, t long, start long, walk_s long, prev string, board_t long, trip string"
JOURNEYS = "src string, dep long, place string, kind string, duration long, transfers int, k int, t long, start long, walk_s long, prev string"


def test_trip_table_backwards_is_compiled(spark):
    labels = spark.createDataFrame([("A", 0, 0, "s1", "s", 10, 0, 10, "A", None, None), ("A", 0, 1, "s2", "s", 90, 0, None, "s1", 30, "r_t")], LABELS)
    journeys = spark.createDataFrame([("A", 0, f"B{i}", "b", 95 + i, 0, 1, 95 + i, 0, 5 + i, "s2") for i in range(3)], JOURNEYS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = P.trip_table(journeys.select("src").distinct(), journeys, labels, 30600, P.Limits(schedule=True), True)
        assert largest_method(spark, table) < COMPILED_BYTES
        assert {(r["Destination_aid"], r["Duration"], r["Line_ID1"], r["Destination_time"]) for r in table.collect()} == {
            *(("A", 95 + i, "r_t", "-1:59:40") for i in range(3)), ("A", 0, None, "08:30:00")
        }
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_journeys_are_found_once_for_their_legs(spark):
    labels = spark.createDataFrame([("A", 0, 0, "s1", "s", 10, 0, 10, "A", None, None), ("A", 0, 1, "s2", "s", 90, 0, None, "s1", 30, "r_t")], LABELS)
    journeys = spark.range(3).selectExpr("'A' AS src", "0L AS dep", "1 AS k", "concat('B', id) AS place", "'s2' AS prev", "5L + id AS walk_s")
    df = P.unroll_journey(journeys, labels, 1)
    assert "Range (" not in plan_of(df)
    assert {(r["place"], r["r1_trip"], r["w1"]) for r in df.collect()} == {(f"B{i}", "r_t", 10) for i in range(3)}


def test_opportunities_are_joined_without_broadcasts(spark):
    pairs = spark.createDataFrame([(1, 2, 100), (1, 3, 700), (2, 9, 50)], "star long, hash long, duration_s long")
    places = spark.createDataFrame([(1, 5), (2, 7), (3, 11)], "aid long, jobs long")
    out = measures.cumulative_opportunities(pairs, 600, 1200, places, ["jobs"])
    assert "BroadcastHashJoin" not in plan_of(out)
    assert {tuple(r) for r in out.select("star", "bin", "nbldg", "jobs").collect()} == {(1, 1, 2, 12), (1, 2, 3, 23), (2, 1, 2, 7), (2, 2, 2, 7)}
