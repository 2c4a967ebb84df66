"""What stays on disk: shuffle files, and the rows that move for a search."""

from pyspark.sql import functions as F

from wayreach.functions.scratch import Scratch
from wayreach.operators import profile
from wayreach.operators import transit as P

EVENTS = "route_id string, trip_id string, seq long, stop_id string, t long, t_first long"


def files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_shuffle_files_go_when_a_table_is_kept(spark):
    rows = spark.range(2000).repartition(4).groupBy((F.col("id") % 700).alias("g")).count()
    before, setting = files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    kept = Scratch(spark, "disk").keep(rows)
    assert files(spark) <= before and kept.count() == 700
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def town(spark, homes=300):
    """Stops in a row with a bus along them, and homes by each of them."""
    stops = [f"S{k}" for k in range(6)]
    trips = [("R", f"T{n}", k, s, 1000 + 300 * n + 100 * k, 1000 + 300 * n) for n in range(4) for k, s in enumerate(stops)]
    walks = [(f"{h}", "b", stops[h % 6], "s", 20 + h % 50) for h in range(homes)] + [(stops[h % 6], "s", f"{h}", "b", 20 + h % 50) for h in range(homes)]
    paths = spark.createDataFrame(walks, "from_id string, from_kind string, to_id string, to_kind string, walk_s long")
    sources = spark.createDataFrame([(f"{h}",) for h in range(homes)], "src string")
    near = spark.createDataFrame([("0", "6", 30), ("6", "0", 30)], "src string, place string, walk_s long")
    return sources, spark.createDataFrame(trips, EVENTS), paths, near


def test_ways_are_made_where_they_are_grouped(spark, monkeypatch):
    monkeypatch.setattr(profile, "SOURCES_PER_BLOCK", 8)
    monkeypatch.setattr(profile, "WALKS_PER_LIST", 7)
    sources, events, paths, near = town(spark)
    od = P.transit_from(sources, events, paths, near, 1000)
    rows = {(r.origin_aid, r.destination_aid): r.duration_s for r in od.collect()}
    plan = od._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "explode(walks" in plan and "Exchange" not in plan.split("explode(walks")[0]
    expected = {("0", "6"): 30, ("6", "0"): 30}
    for a in range(300):
        for b in range(300):
            if a % 6 < b % 6:
                # of four buses the first that is still there when the walk ends
                bus = next(n for n in range(4) if 300 * n + 100 * (a % 6) > 20 + a % 50)
                expected[f"{a}", f"{b}"] = 300 * bus + 100 * (b % 6) + 20 + b % 50
    assert rows == expected


def test_trips_that_no_arrival_can_catch_are_left_out(spark, monkeypatch):
    seen = []
    windows = profile.boarding_windows
    monkeypatch.setattr(profile, "boarding_windows", lambda events, wait, change: seen.append(events.count()) or windows(events, wait, change))
    events = spark.createDataFrame([("R", f"T{n:03d}", 1, "A", 60 * n, 60 * n) for n in range(500)], EVENTS)
    asked = spark.createDataFrame([("A", 6000), ("A", 6059), ("A", 6060), ("B", 6100)], "stop_id string, t long")
    got = sorted((r.t, r.trip_id, r.board_t) for r in P.board_next_trip(asked, events, 900).collect())
    assert got == [(6000, "T101", 6060), (6059, "T101", 6060), (6060, "T102", 6120)]
    assert seen == [16]
    assert P.board_next_trip(asked.where("false"), events, 900).collect() == []
