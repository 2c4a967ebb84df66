"""Readers, writers and small text operators on hand-written files."""

import json

import pytest

from wayreach.functions import expr as X
from wayreach.functions import scratch
from wayreach.operators import compare, gtfs_clean, measures, roads
from wayreach.sources import gtfs, tables

BOM = "﻿"


@pytest.fixture
def feed_dir(tmp_path):
    files = {
        "routes.txt": BOM + "route_id,route_short_name,route_desc,route_type\n 7 ,12,a-b-#,3\n8,14,longer text,3\n",
        "trips.txt": "route_id,service_id,trip_id,shape_id\n7,wk,t1,\n8,wk,t2,5.0\n",
        "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,8:00:00,8:00:00,01,1\nt1,,,02,2\nt1,25:10:00,25:10:00,03,3\nt2,9:00:00,9:00:00,01,1\n",
        "stops.txt": "stop_id,stop_lat,stop_lon\n01,32.1,34.8\n02,32.2,34.9\n03,32.3,34.9\n99,32.0,34.0\n",
        "calendar_dates.txt": "service_id,date,exception_type\nwk,20240205,1\nwk,bad,1\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_read_gtfs(spark, feed_dir):
    feed = gtfs.read_gtfs(spark, feed_dir)
    assert sorted(feed) == ["calendar_dates", "routes", "stop_times", "stops", "trips"]
    assert sorted(r[0] for r in feed["stops"].select("stop_id").collect()) == ["01", "02", "03"]
    assert feed["routes"].columns[0] == "route_id"
    # a feed with exceptions but no weekly calendar still has services
    services = gtfs_clean.services_on_date(None, feed["calendar_dates"], 20240205)
    assert [r[0] for r in services.collect()] == ["wk"]


def test_read_raw_keeps_text_and_trims(spark, feed_dir):
    raw = gtfs.read_gtfs_raw(spark, feed_dir, "routes")
    assert raw.collect()[0]["route_id"] == "7"
    times = {r["stop_sequence"]: r["arrival_time"] for r in gtfs.read_gtfs_raw(spark, feed_dir, "stop_times").filter("trip_id = 't1'").collect()}
    assert times == {"1": "8:00:00", "2": "", "3": "25:10:00"}
    assert gtfs.read_gtfs_raw(spark, feed_dir, "shapes") is None


def test_validate(spark, feed_dir, tmp_path):
    assert all(r["ok"] for r in gtfs.validate_gtfs(spark, feed_dir).collect())
    (tmp_path / "trips.txt").write_text("route_id,name\n")
    (tmp_path / "stops.txt").unlink()
    bad = {(r["file"], r["check"]) for r in gtfs.validate_gtfs(spark, feed_dir).collect() if not r["ok"]}
    assert bad == {("trips.txt", "has trip_id"), ("stops.txt", "exists"), ("stops.txt", "has header"), ("stops.txt", "has stop_id")}


def test_date_range(spark, feed_dir):
    raw = gtfs.read_gtfs_raw(spark, feed_dir, "calendar_dates")
    assert tuple(gtfs.gtfs_date_range(None, raw).first()) == ("20240205", "20240205", True)
    none = raw.filter("date = 'bad'")
    assert tuple(gtfs.gtfs_date_range(None, none).first()) == (None, None, False)


def test_geojson_and_wkt_features(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"aid": 1, "name": "a"}, "geometry": {"type": "Point", "coordinates": [3.5, 4.5]}},
        {"type": "Feature", "properties": {"aid": 2}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 2], [0, 2], [0, 0]], [[1, 1], [2, 1], [2, 1.5], [1, 1]]]}},
    ]
    (tmp_path / "f.json").write_text("\n".join(json.dumps(f) for f in features))
    got = {r["aid"]: (r["x"], r["y"]) for r in tables.read_features(spark, str(tmp_path / "f.json"), "geojson", "aid").collect()}
    assert got == {"1": (3.5, 4.5), "2": (2.0, 1.0)}
    (tmp_path / "w.csv").write_text('aid,geometry\n1,"POLYGON((0 0, 4 0, 4 2, 0 2))"\n2,POINT(7 -8.5)\n')
    got = {r["aid"]: (r["x"], r["y"]) for r in tables.read_features(spark, str(tmp_path / "w.csv"), "csv", "aid").collect()}
    assert got == {"1": (2.0, 1.0), "2": (7.0, -8.5)}


def test_config_from_file(spark, tmp_path):
    (tmp_path / "speed.csv").write_text(BOM + "seq,link_type,speed_km_h,priority,\n1,primary,70,2,\n")
    assert [tuple(r) for r in tables.read_config(spark, "road_classes", str(tmp_path / "speed.csv")).collect()] == [("primary", 70, 2)]
    assert tables.read_config(spark, "congestion").count() == 24
    assert tables.read_config(spark, "directions").count() == 4


def test_run_log(spark):
    text = ' [System] \nMode: a: "b"\n\n  plain \n'
    df = spark.createDataFrame([(text,)], "text string")
    assert [tuple(r) for r in tables.run_log(df).collect()] == [("[System]", ""), ("Mode", 'a: "b"'), ("plain", "")]
    assert tables.run_log_csv(df).collect()[1][0] == '"Mode","a: ""b"""'


def test_last_logged_time(spark):
    text = "Start at (hh:mm:ss):  8:30:00\nArrive before (hh:mm:ss): 09:00:00\nEarliest start time: soon"
    time, kind = X.last_logged_time("t")
    row = spark.createDataFrame([(text,), ("none",)], "t string").select(time.alias("a"), kind.alias("b")).collect()
    assert [tuple(r) for r in row] == [("09:00:00", "end"), (None, None)]


def test_normalize_id(spark):
    values = {"12.0": "12", " 7 ": "7", "a1 ": "a1", "1e3": "1000", "nan": "nan", "12abc": "12abc", "-3.9": "-3", "1d": "1d"}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r[0]: r[1] for r in df.select("v", X.normalize_id("v")).collect()} == values


def test_time_text(spark):
    df = spark.createDataFrame([("8:05:09",), ("25:00:00",), (None,), ("x",), ("8:05",)], "t string")
    got = [tuple(r) for r in df.select(X.time_to_seconds("t"), X.normalise_time("t")).collect()]
    assert got == [(29109, "08:05:09"), (90000, "25:00:00"), (None, None), (None, None), (None, None)]


def test_search_routes(spark):
    df = spark.createDataFrame([("1", "A", "short"), ("2", "b7", "the longest one")], "route_id string, route_short_name string, route_desc string")
    assert [r["route_id"] for r in gtfs_clean.search_routes(df, "B7 ,zz").collect()] == ["2"]
    assert gtfs_clean.search_routes(df, "").count() == 2
    assert gtfs_clean.search_routes(df, "a").first()["description"] == "short"


def test_frequencies_without_template(spark):
    trips = spark.createDataFrame([("r", "s", "t"), ("r", "s", "u")], "route_id string, service_id string, trip_id string")
    times = spark.createDataFrame([("t", 1, "a", 100), ("t", 2, "b", 160), ("u", 1, "a", 5)], "trip_id string, stop_sequence int, stop_id string, t long")
    runs = spark.createDataFrame([("t", 1000, 1250, 100), ("gone", 0, 10, 1), ("u", 50, 50, 10)], "trip_id string, start_s int, end_s int, headway_secs int")
    new_trips, new_times = gtfs_clean.expand_frequencies(trips, times, runs, keep_template=False)
    assert sorted(r["trip_id"] for r in new_trips.collect()) == ["t_f1000", "t_f1100", "t_f1200", "u"]
    assert sorted(r["t"] for r in new_times.filter("stop_id = 'b'").collect()) == [1060, 1160, 1260]


def test_patterns_and_repeated_stops(spark):
    trips = spark.createDataFrame([("r", "t1"), ("r", "t2"), ("r", "t3")], "route_id string, trip_id string")
    rows = [("t1", 1, "a"), ("t1", 2, "b"), ("t1", 3, "a"), ("t2", 1, "a"), ("t2", 2, "b"), ("t2", 3, "a"), ("t3", 1, "b"), ("t3", 2, "a")]
    times = spark.createDataFrame(rows, "trip_id string, stop_sequence int, stop_id string")
    got = {r["trip_id"]: r["pattern_id"] for r in gtfs_clean.trip_patterns(trips, times).collect()}
    assert got == {"t1": "r_1", "t2": "r_1", "t3": "r_2"}
    patterned = spark.createDataFrame([(p, t) for t, p in got.items()], "route_id string, trip_id string")
    stops = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "stop_id string, x double")
    fixed, more = gtfs_clean.dedupe_repeated_stops(patterned, times, stops)
    assert sorted(r["stop_id"] for r in fixed.filter("trip_id = 't2'").collect()) == ["a", "a#2", "b"]
    assert sorted(map(tuple, more.collect())) == [("a", 1.0), ("a#2", 1.0), ("b", 2.0)]


def test_shapes_come_in_pieces(spark):
    routes = spark.createDataFrame([("r", "n")], "route_id string, route_short_name string")
    trips = spark.createDataFrame([("r", "s")], "route_id string, shape_id string")
    shapes = spark.createDataFrame([("s", n, float(n), 0.0) for n in range(25, 0, -1)], "shape_id string, shape_pt_sequence int, x double, y double")
    pieces = gtfs_clean.routes_by_shape(routes, trips, shapes, piece=10).orderBy("piece_no").collect()
    assert [[p["x"] for p in r["path"]] for r in pieces] == [list(range(1, 12)), list(range(11, 22)), list(range(21, 26))]


def test_measures_edges(spark):
    assert measures.bin_bounds(2700, 600) == [600, 1200, 1800, 2400, 2700]
    assert measures.bin_bounds(1200, 300) == [300, 600, 900, 1200]
    assert measures.departure_times(0, 1800, 900) == [0, 900, 1800]
    assert measures.departure_times(0, 1800, 900, end_inclusive=False) == [0, 900]
    assert measures.departure_times(0, 0, 900, end_inclusive=False) == [0]
    assert measures.default_step_s(0, 3600) == 300 and measures.default_step_s(0, 4 * 3600) == 900
    pairs = spark.createDataFrame([(1, 2, 300), (1, 3, 301), (1, 4, 9999), (1, 1, 55)], "star long, hash long, duration_s long")
    got = [(r["bin"], r["nbldg"]) for r in measures.cumulative_opportunities(pairs, 300, 600).orderBy("bin").collect()]
    assert got == [(1, 2), (2, 3)]
    runs = spark.createDataFrame([], "o_id long, d_id long, direction string, label string, duration_s long")
    assert measures.roundtrip_bins(measures.roundtrip_pairs(runs), 600, 3000).count() == 0


def test_compare_params_cuts_and_pairs(spark):
    schema = "position long, Parameter string, Value string"
    one = spark.createDataFrame([(1, "Mode", "m1"), (2, "Speed", "3"), (3, "Start from the origin", "8"), (4, "[Processing]", ""), (5, "late", "x")], schema)
    two = spark.createDataFrame([(1, "Arrive to destination", "9"), (2, "Mode", "m2"), (3, "Other", "o"), (4, "[Processing]", "")], schema)
    got = [tuple(r)[1:] for r in compare.compare_params(one, two).orderBy("position").collect()]
    assert got == [("Accessibility computation options", "m1", "m2"), ("Speed", "3", "---"), ("Start/Arrival", "8", "9")]


def test_compare_values(spark):
    a = spark.createDataFrame([(1, 10, 0), (1, 11, 60)], "star long, hash long, duration_s long")
    b = spark.createDataFrame([(2, 10, 0), (2, 11, 30), (2, 12, 5)], "star long, hash long, duration_s long")
    got = {r["hash"]: (r["Ratio"], r["Difference"], r["Relative_difference"]) for r in compare.compare_service_area(a, b).collect()}
    assert got == {10: (0.0, 0, 0.0), 11: (2.0, 30, 100.0)}
    assert [r["hash"] for r in compare.only_in_second(a, b, "hash").collect()] == [12]
    text = spark.createDataFrame([("10.0",), (None,), ("13",)], "hash string")
    assert [r["hash"] for r in compare.only_in_first(text, b, "hash").collect()] == ["13"]


def test_quantiles_and_classes(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10)] + [(None,)], "v double")
    got = [(r["low"], r["high"]) for r in compare.quantile_classes(df, "v", 4).collect()]
    assert got == [(0.0, 2.0), (2.0, 5.0), (5.0, 8.0), (8.0, 9.0)]
    # repeated values, more classes than values, and nothing at all
    for values, classes in (([3.0] * 40 + [1.0, 2.0, 9.0] * 5 + [4.0], 7), ([5.0, 1.0], 5), ([7.0], 3), ([], 3)):
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        rows = sorted((r["class"], r["low"], r["high"]) for r in compare.quantile_classes(frame, "v", classes).collect())
        ordered, n = sorted(values), len(values)
        limits = [ordered[min(n - 1, round(k * (n / classes)))] for k in range(classes + 1)] if n else []
        assert rows == [(k + 1, limits[k], limits[k + 1]) for k in range(classes if n else 0)]
    limits = spark.createDataFrame([(v,) for v in (-601, -600, -60, 0, 60, 61, 900)], "v int")
    assert [r[0] for r in limits.select(compare.difference_class("v")).collect()] == [0, 0, 2, 3, 3, 4, 6]


def test_buildings_lose_holes_and_repeats(spark):
    def box(x, s):
        return [{"x": x - s, "y": -s}, {"x": x + s, "y": -s}, {"x": x + s, "y": s}, {"x": x - s, "y": s}]

    rows = [(1, [[box(0.0, 2.0), box(0.5, 0.5)], [box(50.0, 1.0)]]), (2, [[box(0.0, 7.0)]]), (3, None)]
    df = spark.createDataFrame(rows, "raw int, polygons array<array<array<struct<x:double,y:double>>>>")
    got = sorted((r["aid"], r["raw"], r["x"]) for r in roads.clean_buildings(df, ["raw"]).collect())
    assert got == [(1000000, 1, 0.0), (1000001, 1, 50.0)]


class Named:
    """Stands in for a session, to see which folder is chosen."""

    class conf:
        named = None

        @classmethod
        def get(cls, key, default=None):
            return cls.named if key == scratch.SETTING else default

    class sparkContext:
        master, applicationId = "local[2]", "app-1"

        @staticmethod
        def getConf():
            return {}


def test_scratch_folder_follows_the_session(spark, monkeypatch):
    monkeypatch.setattr(Named.conf, "named", "hdfs://cluster/shared/")
    assert scratch.shared_folder(Named) == "hdfs://cluster/shared"
    monkeypatch.setattr(Named.conf, "named", None)
    assert scratch.shared_folder(Named) == scratch.shared_folder(Named)
    monkeypatch.setattr(Named.sparkContext, "master", "yarn")
    with pytest.raises(ValueError):
        scratch.shared_folder(Named)
    kept = scratch.Scratch(spark, "x").keep(spark.range(3))
    assert kept.count() == 3 and scratch.shared_folder(spark) in kept.inputFiles()[0]


def test_write_table_casts_the_last_column(spark, tmp_path):
    df = spark.createDataFrame([("a", "5"), ("b", "x")], "k string, Duration string")
    tables.write_table(df, str(tmp_path), "r")
    assert {r["k"]: r["Duration"] for r in spark.read.parquet(f"{tmp_path}/r").collect()} == {"a": 5.0, "b": None}
    log = spark.createDataFrame([("a", "5")], "Parameter string, Value string")
    assert tables.numeric_last(log).dtypes[-1] == ("Value", "string")


def test_check_features(spark):
    df = spark.createDataFrame([(1,)], "aid int")
    assert tables.check_features(None, "n", spark=spark).first()["message"] == "Layer is not selected"
    assert not tables.check_features(df.filter("aid > 1"), "n").first()["ok"]
    assert tables.check_features(df, "n", "aid").first()["ok"]


def test_the_first_row_of_a_repeated_id_stays(spark):
    base = spark.createDataFrame([("a", "first"), ("b", "one"), ("a", "second")], "route_id string, route_desc string").coalesce(1)
    extra = spark.createDataFrame([("b", "other"), ("c", "first"), ("c", "second")], "route_id string, route_desc string").coalesce(1)
    rows = gtfs_clean._append(base, extra, ["route_id"]).collect()
    assert sorted(map(tuple, rows)) == [("a", "first"), ("b", "one"), ("c", "first")]


def test_the_first_row_is_that_of_the_files(spark, tmp_path):
    """Two files, the first by name small; and a semi join that shuffles the rows."""
    (tmp_path / "shapes.txt").mkdir()
    header = "shape_id,shape_pt_sequence,shape_pt_lat,shape_pt_lon\n"
    (tmp_path / "shapes.txt" / "a.csv").write_text(header + "".join(f"s{k},1,0.{k:04d},1\n" for k in range(200)))
    (tmp_path / "shapes.txt" / "b.csv").write_text(header + "".join(f"s{k},1,5.{k:04d},{n}\n" for n in range(30) for k in range(1000)))
    (tmp_path / "stops.txt").write_text("stop_id\n1\n")
    (tmp_path / "stop_times.txt").write_text("trip_id,stop_id,stop_sequence\nt0,1,1\n")
    (tmp_path / "trips.txt").write_text("route_id,trip_id,service_id,shape_id\n" + "".join(f"r{k % 2},t{k},wk,s{k}\n" for k in range(1000)))
    (tmp_path / "routes.txt").write_text("route_id\nr0\nr1\n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        feed = gtfs.read_gtfs(spark, str(tmp_path), ordered=True)
        kept, removed = gtfs_clean.delete_routes(feed, feed["routes"].filter("route_id = 'r1'").select("route_id"))
        rows = {r.shape_id: (r.shape_pt_lat, r.shape_pt_lon) for side in (kept, removed) for r in side["shapes"].collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 1000
    for k in range(1000):
        lat, lon = map(float, rows[f"s{k}"])
        assert (lat, lon) == ((float(f"0.{k:04d}"), 1) if k < 200 else (float(f"5.{k:04d}"), 0))
    out = tmp_path / "out"
    gtfs.write_gtfs(kept, str(out))
    assert gtfs.ORDER not in spark.read.csv(f"{out}/shapes.txt", header=True).columns


def test_a_feed_without_services_is_refused():
    with pytest.raises(ValueError, match="calendar"):
        gtfs_clean.services_on_date(None, None, 20240205)


def test_sources_count_themselves_and_may_reach_nothing(spark):
    pairs = spark.createDataFrame([(11, 22, 420), (11, 30, 60)], "star long, hash long, duration_s long")
    sources = spark.createDataFrame([(11,), (22,)], "star long")
    own = measures.with_own_pairs(pairs, sources)
    area = {r["hash"]: (r["star"], r["duration_s"]) for r in measures.service_area(own).collect()}
    assert area == {11: (11, 0), 22: (22, 0), 30: (11, 60)}
    jobs = spark.createDataFrame([(11, 1), (22, 10), (30, 100)], "aid long, jobs long")
    rows = measures.cumulative_opportunities(pairs, 300, 600, jobs, ["jobs"], sources=sources).collect()
    assert {(r["star"], r["bin"], r["nbldg"], r["jobs"]) for r in rows} == {(11, 1, 2, 101), (11, 2, 3, 111), (22, 1, 1, 10), (22, 2, 1, 10)}
