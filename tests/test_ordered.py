"""Chunked ordered work gives the same rows as plain windows, with one hot group."""

import random

import pytest
from pyspark.sql import functions as F

from wayreach.functions.ordered import OrderedGroups, number_rows
from wayreach.operators import gtfs_clean


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for n in range(3000):
        key = "hot" if n % 3 == 0 else f"k{rng.randrange(60)}"
        t = None if rng.random() < 0.4 else rng.randrange(20000, 60000)
        data.append((key, n, t, rng.randrange(5)))
    return spark.createDataFrame(data, "trip_id string, stop_sequence int, t long, w int").cache()


def both(df, run):
    plain = run(OrderedGroups(df, ["trip_id"], [F.col("stop_sequence")]))
    cut = OrderedGroups(df, ["trip_id"], [F.col("stop_sequence")], max_rows=50)
    assert cut.chunked
    chunked = run(cut)
    columns = sorted(plain.columns)
    return (sorted(map(str, x.select(columns).collect())) for x in (plain, chunked))


@pytest.mark.parametrize(
    "run",
    [
        lambda g: g.row_number("rn").result(),
        lambda g: g.lag("t", "before").result(),
        lambda g: g.running_sum("w", "total").result(),
        lambda g: g.row_number("__pos").known_around("t", "prev", "following").result(),
    ],
    ids=["row_number", "lag", "running_sum", "known_around"],
)
def test_chunks_change_nothing(rows, run):
    plain, chunked = both(rows, run)
    assert plain == chunked


def test_global_numbering(spark, rows):
    plain = number_rows(rows, [], [F.col("stop_sequence")])
    chunked = number_rows(rows, [], [F.col("stop_sequence")], max_rows=100)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, chunked.collect()), key=str)


def test_interpolation_against_brute_force(rows):
    got = {(r["trip_id"], r["stop_sequence"]): r["t"] for r in gtfs_clean.interpolate_times(rows, max_rows=64).collect()}
    trips = {}
    for r in rows.collect():
        trips.setdefault(r["trip_id"], []).append((r["stop_sequence"], r["t"]))
    for trip, stops in trips.items():
        stops.sort()
        known = [i for i, (_, t) in enumerate(stops) if t is not None]
        for i, (seq, t) in enumerate(stops):
            if t is None and known:
                before, after = [k for k in known if k < i], [k for k in known if k > i]
                if before and after:
                    a, b = before[-1], after[0]
                    t = int(stops[a][1] + (stops[b][1] - stops[a][1]) / (b - a) * (i - a) // 1)
                else:
                    t = stops[(before or after)[-1 if before else 0]][1]
            assert got[(trip, seq)] == t


def test_other_ordered_operators_do_not_depend_on_the_bound(rows):
    for op in (gtfs_clean.drop_nonmonotone_trips, gtfs_clean.renumber_sequence):
        a, b = op(rows, ["stop_sequence"]), op(rows, ["stop_sequence"], max_rows=40)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
