"""Whole jobs: feed to database to accessibility, round trips, car, and comparison."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from checks.derived import Inputs
from wayreach.operators import car, measures, transit
from wayreach.plans import access, build, scenario
from wayreach.sources import gtfs, tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF_DIR)


@pytest.fixture(scope="module")
def transit_db(spark, inputs, tmp_path_factory):
    i = inputs
    times = i.stop_times_txt.withColumn("departure_time", F.col("arrival_time"))
    # every ninth time is missing and has to be interpolated
    holes = (F.col("stop_sequence") == 2) & (F.length("trip_id") == 3)
    times = times.withColumn("arrival_time", F.when(~holes, F.col("arrival_time")))
    folder = str(tmp_path_factory.mktemp("feed"))
    gtfs.write_gtfs(
        {"stops": i.stops.select("stop_id", "stop_lat", "stop_lon"), "stop_times": times, "trips": i.trips,
         "routes": i.routes, "calendar": i.calendar, "calendar_dates": i.calendar_dates}, folder,
    )
    feed = build.clean_feed(gtfs.read_gtfs(spark, folder), 20240102)
    placed = feed["stops"].drop("x", "y").join(i.stops.select("stop_id", "x", "y"), "stop_id")
    feed["stops"] = placed
    db = build.transit_database(feed, i.roads, i.buildings, 300.0)
    out = str(tmp_path_factory.mktemp("db"))
    build.save(db, out)
    return build.load(spark, out, list(db)), feed


def test_feed_is_clean(transit_db, inputs):
    _, feed = transit_db
    times = feed["stop_times"]
    assert times.filter("t IS NULL").isEmpty()
    per_trip = times.groupBy("trip_id").agg(F.min("stop_sequence").alias("lo"), F.max("stop_sequence").alias("hi"), F.count("*").alias("n"))
    assert per_trip.filter("lo <> 1 OR hi <> n").isEmpty()
    # service 'O' is valid in January on Tuesdays, and so are 'F' and 'P'
    assert feed["trips"].select("service_id").distinct().count() == 3
    assert feed["routes"].join(feed["trips"], "route_id", "left_anti").isEmpty()
    text = build.feed_as_text(feed)["stop_times"]
    assert text.filter("arrival_time NOT RLIKE '^[0-9][0-9]:[0-9][0-9]:[0-9][0-9]$'").isEmpty()


@pytest.fixture(scope="module")
def sources(transit_db):
    db, _ = transit_db
    paths = db["footpaths"].filter("from_kind = 'b'")
    return paths.groupBy("to_id").agg(F.min("from_id").alias("src")).select("src").distinct()


def test_transit_reports(spark, transit_db, sources, inputs):
    db, _ = transit_db
    limits = transit.Limits(walk1=300, walk3=300)
    od = access.transit_od(db, sources, 30600, limits)
    assert od.count() > 0
    out = access.reports(access.pairs(od, False), 300, limits.max_time, inputs.buildings, ["jobs"])
    assert out["service_area"].groupBy("hash").count().filter("count > 1").isEmpty()
    wide = measures.cumulative_wide(out["cumulative"], "nbldg", limits.max_time, 300)
    assert wide.columns[1] == "5m" and wide.columns[-1] == "nbldg_total"
    # twice the walking speed never makes the round-0 walks longer
    fast = access.transit_od(db, sources, 30600, dataclasses.replace(limits, walk1=150, walk2=150, walk3=150), speed_kmh=7.2)
    assert fast.count() > 0


def test_transit_roundtrip(transit_db, sources):
    db, _ = transit_db
    limits = transit.Limits(walk1=300, walk3=300, max_time=5400)
    out = access.transit_roundtrip(
        db, sources, limits, 600, to_window=access.Window(28800, 29700, 900), from_window=access.Window(57600, 57600, 900), service_area=True
    )
    runs = out["runs"]
    assert sorted((r[0], r[1]) for r in runs.select("direction", "label").distinct().collect()) == [
        ("from", "16:00:00"), ("to", "08:00:00"), ("to", "08:15:00"),
    ]
    # each run keeps one source per building
    assert runs.groupBy("direction", "label", "d_id").count().filter("count > 1").isEmpty()
    assert out["strict"].count() <= out["standard"].count()
    assert "TO_08:15:00" in out["standard"].columns


def test_car(spark, inputs):
    i = inputs
    db = build.car_database(i.roads, i.buildings, i.classes, max_path=300.0)
    sources = db["access"].groupBy("node").agg(F.min("building").alias("src")).select("src")
    limits = car.CarLimits(max_time=900)
    od = access.car_od(db, sources, 0.6, limits).cache()
    assert od.count() > 0
    assert od.filter("src = building AND duration_s <> 0").isEmpty()
    assert od.filter(F.col("duration_s") > 900).isEmpty()
    # on the reversed graph a way TO a place equals the way FROM it on flipped directions
    back = access.car_od(db, sources, 0.6, limits, backward=True)
    assert back.count() > 0
    rows = car.car_rows(back, backward=True)
    assert rows.columns == ["Origin_aid", "Destination_aid", "Veh_legs", "Duration"]
    out = access.car_roundtrip(
        db, sources, tables.read_config(spark, "congestion"), limits, 300,
        to_window=access.Window(28800, 30600, 900), from_window=access.Window(61200, 61200, 900),
    )
    labels = {(r[0], r[1]) for r in out["runs"].select("direction", "label").distinct().collect()}
    assert labels == {("to", "08:00:00"), ("to", "08:15:00"), ("from", "17:00:00")}
    assert not out["standard"].isEmpty()


def test_scenarios(spark, inputs):
    schema = "position long, Parameter string, Value string"
    a = spark.createDataFrame([(1, "Mode", "Service area"), (2, "Accessibility", "FROM")], schema)
    b = spark.createDataFrame([(1, "Mode", "Service area"), (2, "Accessibility", "ROUNDTRIP")], schema)
    first, second = measures.service_area(inputs.pairs), measures.service_area(inputs.pairs2)
    out = scenario.compare_runs(first, second, a, a, cumulative=False)
    n = first.count()
    assert out["values"].count() + out["only_in_first"].count() == n
    assert out["parameters"].count() == 2
    with pytest.raises(ValueError, match="round trips"):
        scenario.compare_runs(first, second, a, b, cumulative=False)
