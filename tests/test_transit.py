"""Transit search against a plain one-source-at-a-time search on small networks."""

import random

import pytest

from wayreach.operators import timetable
from wayreach.operators import transit as P


class Net:
    """A random network in which trips overtake each other and times pass midnight."""

    def __init__(self, seed, base=28000):
        rng = random.Random(seed)
        self.stops = [f"S{i}" for i in range(9)]
        self.houses = [str(1000000 + i) for i in range(10)]
        self.events = []  # (route, trip, seq, stop, t)
        for r in range(7):
            path = rng.sample(self.stops, rng.randrange(3, 6))
            for n in range(5):
                t = base + rng.randrange(0, 4000)
                for seq, stop in enumerate(path, 1):
                    self.events.append((f"R{r}", f"R{r}T{n}", seq, stop, t))
                    t += rng.randrange(60, 700)
        self.walks = {}
        for h in self.houses:
            for s in rng.sample(self.stops, 2):
                d = rng.randrange(20, 500)
                self.walks[(h, s)] = self.walks[(s, h)] = d
        for a in self.stops:
            for b in self.stops:
                if a < b and rng.random() < 0.3:
                    self.walks[(a, b)] = self.walks[(b, a)] = rng.randrange(50, 500)
        self.near = {(a, b): rng.randrange(30, 600) for a in self.houses for b in self.houses if a != b and rng.random() < 0.15}

    def trips(self, key):
        by = {}
        for route, trip, seq, stop, t in self.events:
            by.setdefault(route, {}).setdefault(trip, []).append((seq, stop, t))
        return {r: sorted(ts.items(), key=lambda kv: key(kv[0], sorted(kv[1]))) for r, ts in by.items()}

    def frames(self, spark):
        def kind(p):
            return "s" if p.startswith("S") else "b"

        ev = spark.createDataFrame(self.events, "route_id string, trip_id string, stop_sequence int, stop_id string, t long")
        fp = spark.createDataFrame(
            [(a, kind(a), b, kind(b), d, d) for (a, b), d in self.walks.items()],
            "from_id string, from_kind string, to_id string, to_kind string, dist_m long, walk_s long",
        )
        near = spark.createDataFrame([(a, b, d) for (a, b), d in self.near.items()], "src string, place string, walk_s long")
        sources = spark.createDataFrame([(h,) for h in self.houses], "src string")
        return sources, timetable.stop_events(ev), fp, near


def search(net, src, dep, target, lim, back):
    """Labels per round {place: (t, anchor, walk)}; anchor = departure (forward) or arrival (back)."""
    sign = -1 if back else 1
    w_first, w_last = (lim.walk3, lim.walk1) if back else (lim.walk1, lim.walk3)
    trips = net.trips((lambda trip, st: (-st[-1][2], trip)) if back else (lambda trip, st: (st[0][2], trip)))
    late = dep + sign * lim.horizon
    labels = [{}]
    for (a, b), d in net.walks.items():
        if a == src and b.startswith("S") and d <= w_first:
            labels[0][b] = (dep + sign * d, dep, d)
    for (a, b), d in net.near.items():
        if a == src:
            labels[0][b] = (target - d, target, d) if back else (dep + d, dep, d)

    def better(new, old):
        # earlier (back: later) first, then the shorter span
        return old is None or (sign * new[0], -sign * new[1]) < (sign * old[0], -sign * old[1])

    for k in range(1, lim.max_transfers + 2):
        wait = lim.first_wait if k == 1 else lim.wait_transfer
        rides = {}
        for p, (t, anchor, walk) in labels[k - 1].items():
            if not p.startswith("S"):
                continue
            for route, ordered in trips.items():
                taken = set()
                for _, stops in ordered:
                    for seq, stop, u in stops:
                        if stop != p or seq in taken:
                            continue
                        if not (t + 1 <= u <= t + wait if not back else t - wait <= u <= t - 1):
                            continue
                        taken.add(seq)
                        for seq2, stop2, v in stops:
                            if (seq2 - seq) * sign > 0 and stop2 != p and sign * v <= sign * late:
                                a = u - sign * walk if lim.schedule and k == 1 else anchor
                                if better((v, a), rides.get(stop2)):
                                    rides[stop2] = (v, a, None)
        walked = {}
        for p, (t, anchor, _) in rides.items():
            for (a, b), d in net.walks.items():
                if a != p or b in rides:
                    continue
                more = k <= lim.max_transfers and d <= lim.walk2
                if (more or (not b.startswith("S") and d <= w_last)) and sign * (t + sign * d) <= sign * late:
                    if better((t + sign * d, anchor), walked.get(b)):
                        walked[b] = (t + sign * d, anchor, d)
        labels.append(rides | walked)
    out = {}
    for k, found in enumerate(labels):
        for p, (t, anchor, walk) in found.items():
            duration, transfers = sign * (t - anchor), max(k - 1, 0)
            if p.startswith("S") or p == src or walk is None or walk > w_last or transfers < lim.min_transfers:
                continue
            if lim.schedule:
                if duration > lim.max_time or (anchor < target if back else anchor > dep + lim.gap):
                    continue
            if p not in out or (duration, transfers) < out[p]:
                out[p] = (duration, transfers)
    return out


def brute(net, start, lim, back):
    want = {}
    for src in net.houses:
        best = {}
        for dep in P.schedule_starts(start, lim.gap, back) if lim.schedule else [start]:
            shifted = dep + (lim.gap if back and lim.schedule else 0)
            for p, (duration, transfers) in search(net, src, shifted, start, lim, back).items():
                if p not in best or duration < best[p][0]:
                    best[p] = (duration, transfers)
        for p, found in best.items():
            want[(p, src) if back else (src, p)] = found
    return want


CASES = {
    "default": P.Limits(),
    "three rides, uneven walks": P.Limits(max_transfers=2, walk1=450, walk2=200, walk3=350, max_time=5000),
    "short waits": P.Limits(wait=200, wait_transfer=300, max_time=4000),
    "at least one transfer": P.Limits(min_transfers=1, max_time=4500),
    "no transfer": P.Limits(max_transfers=0, max_time=4000),
    "schedule": P.Limits(schedule=True, max_time=3000),
    "schedule, two transfers": P.Limits(schedule=True, max_transfers=2, max_time=3500, gap=900),
}


@pytest.mark.parametrize("back", [False, True], ids=["from", "to"])
@pytest.mark.parametrize("name", CASES)
def test_against_plain_search(spark, name, back):
    lim = CASES[name]
    # the last network runs past midnight
    base, start = (28000, 28500) if name != "short waits" else (84000, 84500)
    net = Net(11 + len(name), base)
    start += 3500 if back else 0
    run = P.transit_to if back else P.transit_from
    od = run(*net.frames(spark), start, lim)
    got = {(r["origin_aid"], r["destination_aid"]): (r["duration_s"], r["transfers"]) for r in od.collect()}
    want = brute(net, start, lim, back)
    assert len(want) > 4
    assert got == want


def frames(spark, events, walks, near=()):
    ev = spark.createDataFrame(events, "route_id string, trip_id string, stop_sequence int, stop_id string, t long")
    rows = [(a, "b" if a.isdigit() else "s", b, "b" if b.isdigit() else "s", d, d) for a, b, d in walks]
    rows += [(r[2], r[3], r[0], r[1], r[4], r[5]) for r in rows]
    fp = spark.createDataFrame(rows, "from_id string, from_kind string, to_id string, to_kind string, dist_m long, walk_s long")
    nb = spark.createDataFrame(list(near), "src string, place string, walk_s long")
    return spark.createDataFrame([("1",)], "src string"), timetable.stop_events(ev), fp, nb


def durations(od):
    return {r["destination_aid"]: (r["duration_s"], r["transfers"]) for r in od.collect()}


def test_wait_window_and_trip_order(spark):
    # boarding needs one second; an overtaken trip that leaves first is still taken
    events = [("R", "A", 1, "S1", 100), ("R", "A", 2, "S2", 900), ("R", "B", 1, "S1", 101), ("R", "B", 2, "S2", 950), ("R", "C", 1, "S1", 150), ("R", "C", 2, "S2", 500)]
    args = frames(spark, events, [("1", "S1", 100), ("S2", "2", 10)])
    # at S1 at 100: trip A (100) is too early, B (101) is first in order though C arrives earlier
    assert durations(P.transit_from(*args, 0, P.Limits()))["2"] == (960, 0)
    # with a wait of 0 seconds nothing can be caught
    assert durations(P.transit_from(*args, 0, P.Limits(wait=0))) == {}


def test_no_walk_after_walk_and_rides_win_over_walks(spark):
    events = [("R", "A", 1, "S1", 100), ("R", "A", 2, "S2", 200), ("R", "A", 3, "S3", 900)]
    walks = [("1", "S1", 10), ("S2", "S3", 50), ("S3", "S4", 50), ("S3", "3", 5), ("S4", "4", 5)]
    found = durations(P.transit_from(*frames(spark, events, walks), 0, P.Limits()))
    # S3 is ridden to at 900 although walking from S2 would be there at 250; S4 only by two walks
    assert found == {"3": (905, 0)}


def test_schedule_mode_removes_the_first_wait(spark):
    events = [("R", "A", 1, "S1", 700), ("R", "A", 2, "S2", 900)]
    args = frames(spark, events, [("1", "S1", 100), ("S2", "2", 10)], [("1", "9", 77)])
    fixed = durations(P.transit_from(*args, 0, P.Limits()))
    schedule = durations(P.transit_from(*args, 0, P.Limits(schedule=True)))
    assert fixed == {"2": (910, 0), "9": (77, 0)}
    assert schedule == {"2": (310, 0), "9": (77, 0)}


def test_walk_speed_scales_footpaths(spark):
    fp = spark.createDataFrame([("a", "s", "b", "b", 100)], "from_id string, from_kind string, to_id string, to_kind string, dist_m long")
    assert P.walk_seconds(fp).first()["walk_s"] == 100
    assert P.walk_seconds(fp, 7.2).first()["walk_s"] == 50


def test_more_transfers_never_hurt(spark):
    net = Net(77)
    few = durations_all(P.transit_from(*net.frames(spark), 28500, P.Limits(max_time=4000)))
    many = durations_all(P.transit_from(*net.frames(spark), 28500, P.Limits(max_transfers=2, max_time=4000)))
    assert all(many[k] <= v for k, v in few.items())


def durations_all(od):
    return {(r["origin_aid"], r["destination_aid"]): r["duration_s"] for r in od.collect()}


@pytest.mark.parametrize("back", [False, True], ids=["from", "to"])
@pytest.mark.parametrize("schedule", [False, True], ids=["fixed", "schedule"])
def test_many_runs_in_one_search(spark, schedule, back):
    net, lim = Net(31), P.Limits(schedule=schedule, gap=900, max_time=3000)
    times = [28500, 28800, 29700] if not back else [31000, 31300, 32000]
    runs = P.transit_runs(*net.frames(spark), times, lim, back).collect()
    for t in times:
        got = {((r["place"], r["src"]) if back else (r["src"], r["place"])): (r["duration"], r["transfers"]) for r in runs if r["run"] == t}
        assert got == brute(net, t, lim, back)


def test_a_building_with_the_number_of_a_stop(spark):
    events = [("R", "T", 1, "5", 100), ("R", "T", 2, "6", 200)]
    walks = [
        ("1", "b", "5", "s", 10), ("6", "s", "9", "b", 20),
        # house 5 and house 6 lie elsewhere; stop 5 has no path to a stop 8
        ("5", "b", "8", "s", 5), ("6", "b", "7", "b", 1), ("6", "s", "6", "b", 30),
    ]
    ev = spark.createDataFrame(events, "route_id string, trip_id string, stop_sequence int, stop_id string, t long")
    fp = spark.createDataFrame([(*w, w[-1]) for w in walks], "from_id string, from_kind string, to_id string, to_kind string, dist_m long, walk_s long")
    near = spark.createDataFrame([], "src string, place string, walk_s long")
    sources = spark.createDataFrame([("1",), ("5",)], "src string")
    limits = P.Limits(max_transfers=0)
    found, labels = P.transit_journeys(sources, timetable.stop_events(ev), fp, near, 50, limits)
    assert {(r["src"], r["place"], r["duration"]) for r in found.collect()} == {("1", "9", 170), ("1", "6", 180)}
    every = P.all_destinations(labels, limits, include_stops=True).collect()
    assert ("1", "6", "b") in {(r["src"], r["place"], r["kind"]) for r in every}


def test_trip_table_shows_every_ride(spark):
    events = [(f"R{k}", f"T{k}", n, f"S{k + n - 1}", 1000 + 200 * k + 100 * n) for k in range(4) for n in (1, 2)]
    walks = [("1", "b", "S0", "s", 10), ("S4", "s", "2", "b", 20)]
    ev = spark.createDataFrame(events, "route_id string, trip_id string, stop_sequence int, stop_id string, t long")
    fp = spark.createDataFrame([(*w, w[-1]) for w in walks], "from_id string, from_kind string, to_id string, to_kind string, dist_m long, walk_s long")
    near = spark.createDataFrame([], "src string, place string, walk_s long")
    sources = spark.createDataFrame([("1",)], "src string")
    limits = P.Limits(max_transfers=3)
    found, labels = P.transit_journeys(sources, timetable.stop_events(ev), fp, near, 1000, limits)
    rows = P.trip_table(sources, found, labels, 1000, limits).collect()
    trip = next(r for r in rows if r["Destination_aid"] == "2")
    assert trip["Legs"] == 4 and [trip[f"Line_ID{k}"] for k in range(1, 5)] == [f"R{k}_T{k}" for k in range(4)]
    parts = sum(trip[f"{c}{k}"] or 0 for k in range(1, 5) for c in ("Walk_time", "Wait_time", "Ride_time"))
    assert parts + trip["DestWalk_time"] == trip["Duration"]
