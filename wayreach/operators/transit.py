"""Door-to-door travel times by public transport, for all sources and start times together.

Travel goes in rounds; round k adds one ride. A label says how a place is reached in
round k: (src, dep, k, place, kind, t, start, walk_s, prev, board_t, trip). Walk labels
have ``walk_s`` and come from ``prev``; ride labels have ``board_t`` and ``trip`` and
were boarded at ``prev``. ``dep`` is the start (or, going backwards, arrival) second.
The functions of one round work on labels; whole searches run in ``profile``, for all start
times together.

Travelling TO a place is the same search on mirrored time: events from
``timetable.mirrored``, starts as negative seconds, walk limits 1 and 3 swapped.
Only the functions at the end turn mirrored labels back.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.scratch import Scratch
from ..functions.skew import merge_join
from . import profile, timetable

CHANGE_S = 1
SCAN_STEP_S = 300
SCHEDULE_FIRST_WAIT_S = 600


@dataclasses.dataclass(frozen=True)
class Limits:
    """Search limits in seconds (walks too: metres divided by speed)."""

    max_transfers: int = 1
    min_transfers: int = 0
    walk1: int = 400
    walk2: int = 300
    walk3: int = 400
    wait: int = 900
    wait_transfer: int = 900
    max_time: int = 2700
    schedule: bool = False
    gap: int = 1800

    @property
    def horizon(self) -> int:
        return self.max_time + (self.gap if self.schedule else 0)

    @property
    def first_wait(self) -> int:
        return SCHEDULE_FIRST_WAIT_S if self.schedule else self.wait

    def swapped(self) -> Limits:
        return dataclasses.replace(self, walk1=self.walk3, walk3=self.walk1)


def walk_seconds(footpaths: DataFrame, speed_kmh: float = 3.6) -> DataFrame:
    """Footpaths (from_id, from_kind, to_id, to_kind, dist_m) with ``walk_s`` at a walking speed."""
    return footpaths.withColumn("walk_s", X.half_up(F.col("dist_m") * 3.6 / speed_kmh))


# -- one round ----------------------------------------------------------------------


def with_departures(sources: DataFrame, departures: Sequence[int]) -> DataFrame:
    starts = F.array(*[F.lit(int(d)).cast("long") for d in departures])
    return sources.select("src", F.explode(starts).alias("dep"))


def initial_access(sources: DataFrame, footpaths: DataFrame, limit: int) -> DataFrame:
    """Round 0: walk from each source to the stops around it. ``sources``: (src, dep)."""
    to_stops = footpaths.filter((F.col("from_kind") == "b") & (F.col("to_kind") == "s") & (F.col("walk_s") <= limit))
    return first_step(
        sources.join(to_stops, F.col("src") == F.col("from_id")).select(
            "src", "dep", F.col("to_id").alias("stop_id"), (F.col("dep") + F.col("walk_s")).alias("t"), "walk_s"
        )
    )


def first_step(access: DataFrame) -> DataFrame:
    """Round-0 labels from given access rows (src, dep, stop_id, t, walk_s)."""
    return access.select(
        "src",
        "dep",
        F.lit(0).alias("k"),
        F.col("stop_id").alias("place"),
        F.lit("s").alias("kind"),
        F.col("t").cast("long").alias("t"),
        F.col("dep").alias("start"),
        F.col("walk_s").cast("long").alias("walk_s"),
        F.col("src").alias("prev"),
        F.lit(None).cast("long").alias("board_t"),
        F.lit(None).cast("string").alias("trip"),
    )


def walk_only_trips(
    sources: DataFrame, near_buildings: DataFrame, leave_at: int | None = None
) -> DataFrame:
    """Round-0 labels of buildings reached on foot; ``near_buildings``: (src, place, walk_s).

    The walk starts at ``dep``, or at ``leave_at`` whatever the start time tried.
    """
    pairs = sources.join(near_buildings, "src").filter(F.col("src") != F.col("place"))
    leave = F.col("dep") if leave_at is None else F.lit(int(leave_at)).cast("long")
    labels = first_step(
        pairs.select(
            "src", "dep", F.col("place").alias("stop_id"), (leave + F.col("walk_s")).alias("t"), "walk_s"
        )
    )
    return labels.withColumn("kind", F.lit("b")).withColumn("start", leave)


def board_next_trip(arrivals: DataFrame, events: DataFrame, wait: int, change: int = CHANGE_S) -> DataFrame:
    """First trip of each route to board after each (stop_id, t): the time-bucketed range join.

    Of the trips that leave in ``[t + change, t + wait]`` the one first in route order is
    taken. Each event has the window of times from which it is that one, so the arrivals meet
    one row for each trip taken. Adds (route_id, trip_id, seq, board_t). Trips that no arrival
    can catch, since all come too early or too late, are left out first.
    """
    width = profile.bucket_width(wait, change)
    asked = Scratch(arrivals.sparkSession, "arrivals").keep(arrivals.select("stop_id", "t").distinct())
    first, last = asked.agg(F.min("t"), F.max("t")).first()
    in_time = F.col("t").between(F.lit(first) + change, F.lit(last) + wait)
    offered = profile.in_buckets(profile.boarding_windows(events.where(in_time), wait, change), width)
    asked = asked.withColumn("bucket", F.floor(F.col("t") / width))
    caught = asked.join(offered, ["stop_id", "bucket"]).filter(F.col("t").between(F.col("from_t"), F.col("to_t")))
    return caught.select("stop_id", "t", "route_id", "seq", "trip_id", "board_t")


def board_previous_trip(arrivals: DataFrame, events: DataFrame, wait: int, change: int = CHANGE_S) -> DataFrame:
    """Going backwards: the last trip that leaves one at the stop within ``[t - wait, t - change]``."""
    back = arrivals.select("stop_id", (-F.col("t")).alias("t"))
    found = board_next_trip(back, timetable.mirrored(events), wait, change)
    return found.select(
        "stop_id",
        (-F.col("t")).alias("t"),
        "route_id",
        (-F.col("seq")).alias("seq"),
        "trip_id",
        (-F.col("board_t")).alias("board_t"),
    )


def ride_options(boardings: DataFrame, events: DataFrame, horizon: int | None = None) -> DataFrame:
    """(stop_id, t, to_stop, alight_t, board_t, trip): earliest arrival per later stop.

    Equal arrivals take the later boarding, then the smaller trip id; ``trip`` names the
    line as ``<route>_<trip>``. Arrivals more than ``horizon`` after ``t`` are of no use.
    """
    on = events.select("trip_id", F.col("seq").alias("__seq"), F.col("stop_id").alias("to_stop"), F.col("t").alias("alight_t"))
    rides = boardings.join(on, "trip_id").filter(F.col("__seq") > F.col("seq"))
    if horizon is not None:
        rides = rides.filter(F.col("alight_t") <= F.col("t") + horizon)
    best = F.min(F.struct("alight_t", (-F.col("board_t")).alias("nb"), "trip_id", "route_id"))
    return (
        rides.filter(F.col("to_stop") != F.col("stop_id"))
        .groupBy("stop_id", "t", "to_stop")
        .agg(best.alias("b"))
        .select(
            "stop_id",
            "t",
            "to_stop",
            "b.alight_t",
            (-F.col("b.nb")).alias("board_t"),
            F.concat_ws("_", "b.route_id", "b.trip_id").alias("trip"),
        )
    )


def ride_round(
    labels: DataFrame, options: DataFrame, k: int, horizon: int, schedule: bool = False
) -> DataFrame:
    """Ride labels of round ``k`` from the stop labels of the round before."""
    from_stops = labels.filter("kind = 's'").select(
        "src", "dep", F.col("place").alias("stop_id"), "t", "start", F.col("walk_s").alias("__walk")
    )
    rides = from_stops.join(options, ["stop_id", "t"]).filter(
        F.col("alight_t") <= F.col("dep") + horizon
    )
    start = F.col("start")
    if schedule and k == 1:
        # no waiting before the first ride: the walk ends when the vehicle leaves
        start = F.col("board_t") - F.col("__walk")
    best = F.min(
        F.struct("alight_t", (-start).alias("ns"), F.col("stop_id").alias("prev"), "board_t", "trip")
    )
    return (
        rides.groupBy("src", "dep", "to_stop")
        .agg(best.alias("b"))
        .select(
            "src",
            "dep",
            F.lit(k).alias("k"),
            F.col("to_stop").alias("place"),
            F.lit("s").alias("kind"),
            F.col("b.alight_t").alias("t"),
            (-F.col("b.ns")).alias("start"),
            F.lit(None).cast("long").alias("walk_s"),
            "b.prev",
            "b.board_t",
            "b.trip",
        )
    )


# -- all rounds ----------------------------------------------------------------------


def travel_labels(
    sources: DataFrame,
    departures: Sequence[int],
    events: DataFrame,
    footpaths: DataFrame,
    near_buildings: DataFrame,
    limits: Limits,
    walk_at: int | None = None,
) -> DataFrame:
    """Labels of all rounds, from every source (src) at every departure; ``footpaths`` with ``walk_s``."""
    return profile.Search(sources, departures, events, footpaths, near_buildings, limits, CHANGE_S, walk_at).labels()


def backward_inputs(
    departures: Sequence[int], events: DataFrame, footpaths: DataFrame, limits: Limits
) -> tuple[list[int], DataFrame, DataFrame, Limits]:
    """The inputs of ``travel_labels`` for travelling TO the sources, arriving by ``departures``."""
    turned = footpaths.select(
        F.col("to_id").alias("from_id"),
        F.col("to_kind").alias("from_kind"),
        F.col("from_id").alias("to_id"),
        F.col("from_kind").alias("to_kind"),
        "walk_s",
    )
    shift = limits.gap if limits.schedule else 0
    return [-(d + shift) for d in departures], timetable.mirrored(events), turned, limits.swapped()


# -- journeys ---------------------------------------------------------------------------


def journey_metrics(labels: DataFrame) -> DataFrame:
    """Add ``duration`` and ``transfers`` (a walk without a ride counts 0 transfers)."""
    return labels.withColumn("duration", F.col("t") - F.col("start")).withColumn(
        "transfers", F.greatest(F.col("k") - 1, F.lit(0))
    )


def filter_journeys(journeys: DataFrame, limits: Limits, window: Column | None = None) -> DataFrame:
    """Journeys that end with an allowed walk, have enough transfers and suit the schedule."""
    ok = F.col("walk_s").isNotNull() & (F.col("walk_s") <= limits.walk3)
    ok = ok & (F.col("transfers") >= limits.min_transfers)
    kept = journeys.filter(ok)
    if limits.schedule:
        kept = kept.filter(F.col("duration") <= limits.max_time)
        kept = kept.filter((F.col("start") <= F.col("dep") + limits.gap) if window is None else window)
    return kept


def best_journey(journeys: DataFrame, keys: Sequence[str] = ("src", "dep", "place", "kind")) -> DataFrame:
    """Least duration, then fewest transfers, then the round with a ride."""
    rest = [c for c in journeys.columns if c not in (*keys, "duration", "transfers", "k")]
    best = F.min(F.struct("duration", "transfers", (-F.col("k")).alias("nk"), *rest)).alias("b")
    out = journeys.groupBy(*keys).agg(best)
    return out.select(
        *keys, "b.duration", "b.transfers", (-F.col("b.nk")).alias("k"), *[f"b.{c}" for c in rest]
    )


def all_destinations(
    labels: DataFrame, limits: Limits, include_stops: bool = False, window: Column | None = None
) -> DataFrame:
    """Best journey per (src, dep, place), for buildings or for all places."""
    reached = labels if include_stops else labels.filter("kind = 'b'")
    reached = reached.filter((F.col("place") != F.col("src")) | (F.col("kind") != "b"))
    return best_journey(filter_journeys(journey_metrics(reached), limits, window))


def schedule_starts(start: int, gap: int, backward: bool = False) -> list[int]:
    """Start times to try: every five minutes over the gap, at least one."""
    steps = max(1, gap // SCAN_STEP_S)
    return [start + (-1 if backward else 1) * i * SCAN_STEP_S for i in range(steps)]


def search(
    sources: DataFrame,
    events: DataFrame,
    footpaths: DataFrame,
    near_buildings: DataFrame,
    start: int,
    limits: Limits,
    backward: bool = False,
) -> profile.Search:
    """The search FROM the sources (src) at ``start``, or TO them by ``start`` (in mirrored time)."""
    starts = schedule_starts(start, limits.gap, backward) if limits.schedule else [start]
    latest = walk_at = None
    if backward:
        starts, events, footpaths, limits = backward_inputs(starts, events, footpaths, limits)
        walk_at = -start
        if limits.schedule:
            # mirrored start is minus the arrival; arrivals before the target time are dropped
            latest = -start
    return profile.Search(sources, starts, events, footpaths, near_buildings, limits, CHANGE_S, walk_at, latest)


def transit_journeys(
    sources: DataFrame,
    events: DataFrame,
    footpaths: DataFrame,
    near_buildings: DataFrame,
    start: int,
    limits: Limits,
    backward: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(journeys, labels) FROM the sources at ``start``, or TO them by ``start``.

    ``sources``: (src). Times are mirrored (negative) if ``backward``. In schedule mode the
    shortest journey of all start times is kept.
    """
    found = search(sources, events, footpaths, near_buildings, start, limits, backward)
    journeys = found.with_last_stop(found.journeys(walks=True))
    none = {"kind": F.lit("b"), "board_t": F.lit(None).cast("long"), "trip": F.lit(None).cast("string")}
    journeys = journeys.withColumns(none).select("src", "dep", "place", "kind", "duration", "transfers", "k", "t", "start", "walk_s", "prev", "board_t", "trip")
    return journeys, found.labels()


def transit_runs(
    sources: DataFrame,
    events: DataFrame,
    footpaths: DataFrame,
    near_buildings: DataFrame,
    times: Sequence[int],
    limits: Limits,
    backward: bool = False,
) -> DataFrame:
    """(src, place, run, duration, transfers) for many run times in one search.

    Each distinct start time is searched once, although in schedule mode neighbouring
    runs try the same ones; the runs share the ways and filter them separately.
    """
    spark = sources.sparkSession
    starts = {t: schedule_starts(t, limits.gap, backward) if limits.schedule else [t] for t in times}
    sign, shift = (-1, limits.gap if limits.schedule else 0) if backward else (1, 0)
    plan = [(int(t), int(sign * (d + shift))) for t, ds in starts.items() for d in ds]
    runs = spark.createDataFrame(plan, "run long, dep long")
    departures = sorted({d for ds in starts.values() for d in ds})
    walkers = with_departures(sources, times).withColumn("run", F.col("dep"))
    if backward:
        departures, events, footpaths, limits = backward_inputs(departures, events, footpaths, limits)
        walkers = walkers.withColumn("dep", -F.col("dep"))
    found = profile.Search(sources, departures, events, footpaths, near_buildings, limits, CHANGE_S)
    # the last walk is known only to keep its limit or not
    rode = found.arrivals().withColumn("walk_s", F.when(F.col("allowed"), limits.walk3)).drop("allowed").join(F.broadcast(runs), "dep")
    on_foot = walk_only_trips(walkers.select("src", "dep"), near_buildings).withColumn("run", sign * F.col("dep"))
    reached = rode.unionByName(on_foot.select(rode.columns)).filter(F.col("place") != F.col("src"))
    window = None
    if backward and limits.schedule:
        window = F.col("start") <= -F.col("run")
    kept = filter_journeys(journey_metrics(reached), limits, window)
    best = F.min(F.struct("duration", "dep", "transfers")).alias("b")
    return kept.groupBy("src", "place", "run").agg(best).select("src", "place", "run", "b.duration", "b.transfers")


def od_rows(journeys: DataFrame, backward: bool = False) -> DataFrame:
    """(origin_aid, destination_aid, duration_s, transfers)."""
    src, place = F.col("src"), F.col("place")
    return journeys.select(
        (place if backward else src).alias("origin_aid"),
        (src if backward else place).alias("destination_aid"),
        F.col("duration").alias("duration_s"),
        F.col("transfers").cast("int").alias("transfers"),
    )


def transit_from(sources, events, footpaths, near_buildings, start, limits=Limits()) -> DataFrame:
    return od_rows(search(sources, events, footpaths, near_buildings, start, limits).journeys())


def transit_to(sources, events, footpaths, near_buildings, start, limits=Limits()) -> DataFrame:
    return od_rows(search(sources, events, footpaths, near_buildings, start, limits, True).journeys(), True)


# -- journey table ------------------------------------------------------------------------


def unroll_journey(journeys: DataFrame, labels: DataFrame, rounds: int) -> DataFrame:
    """Add the ride and walk legs by looking labels up from the end to the source.

    New columns, numbered by round: ``r<k>_board, r<k>_board_t, r<k>_alight,
    r<k>_alight_t, r<k>_trip`` and ``w<k>``, the walk before ride k (``w1`` from the source).
    """
    # read twice below, so found only once
    journeys = Scratch(journeys.sparkSession, "unroll").keep(journeys, "journeys")
    rides = labels.filter("board_t IS NOT NULL")
    walks = labels.filter("walk_s IS NOT NULL AND kind = 's'")
    # journeys by the same last ride share their legs, which are looked up once
    ends = ["src", "dep", "k", "prev"]
    # __at is the stop at which the traveller stands, looking back from round k
    df = journeys.filter("k > 0").select(*ends).distinct().withColumn("__at", F.col("prev"))
    for k in range(rounds, 0, -1):
        r = rides.filter(F.col("k") == k).select(
            "src", "dep", F.col("k").alias("__k"), F.col("place").alias("__at"),
            F.col("prev").alias(f"r{k}_board"), F.col("board_t").alias(f"r{k}_board_t"),
            F.col("t").alias(f"r{k}_alight_t"), F.col("trip").alias(f"r{k}_trip"),
        )
        w = walks.filter(F.col("k") == k - 1).select(
            "src", "dep", F.col("place").alias(f"r{k}_board"), F.col("prev").alias("__from"), F.col("walk_s").alias(f"w{k}")
        )
        df = df.join(r, ["src", "dep", "__at"], "left")
        ridden = (F.col("k") >= k) & F.col("__k").isNotNull()
        for c in ("board", "board_t", "alight_t", "trip"):
            df = df.withColumn(f"r{k}_{c}", F.when(ridden, F.col(f"r{k}_{c}")))
        df = df.withColumn(f"r{k}_alight", F.when(ridden, F.col("__at"))).drop("__k")
        df = df.join(w, ["src", "dep", f"r{k}_board"], "left")
        df = df.withColumn(
            "__at", F.when(ridden_on(k), F.coalesce("__from", f"r{k}_board")).otherwise(F.col("__at"))
        ).drop("__from")
    return merge_join(journeys, df.drop("__at"), ends, "left").select(*journeys.columns, *[c for c in df.columns if c not in (*ends, "__at")])


def ridden_on(k: int) -> Column:
    return F.col(f"r{k}_board").isNotNull()


def trip_table(
    sources: DataFrame,
    journeys: DataFrame,
    labels: DataFrame,
    start: int,
    limits: Limits,
    backward: bool = False,
) -> DataFrame:
    """The detailed journey table: all rides with walks, waits and times as text.

    There are blocks of columns for three rides, or for as many as ``limits`` allow if
    these are more; with three, 31 columns FROM. TO has one more, the arrival limit.
    Sources themselves come as a row without legs, as ``Duration`` 0.
    """
    rounds = max(3, limits.max_transfers + 1)
    df = unroll_journey(journeys, labels, limits.max_transfers + 1)
    for k in range(limits.max_transfers + 2, rounds + 1):
        for c, kind in (("board", "string"), ("board_t", "long"), ("alight", "string"), ("alight_t", "long"), ("trip", "string")):
            df = df.withColumn(f"r{k}_{c}", F.lit(None).cast(kind))
        df = df.withColumn(f"w{k}", F.lit(None).cast("long"))
    n = F.col("k")
    legs = []
    for j in range(1, rounds + 1):
        # going backwards, ride j of the traveller is ride k+1-j of the search
        def pick(name, j=j):
            if not backward:
                return F.col(name.format(j))
            options = [(m, name.format(m - j + 1)) for m in range(j, rounds + 1)]
            return F.coalesce(*[F.when(n == m, F.col(c)) for m, c in options])

        def walk_before(j=j):
            if not backward:
                return F.col(f"w{j}")
            # the traveller's first walk is the search's last; the others shift by one
            if j == 1:
                return F.when(n >= 1, F.col("walk_s"))
            options = [(m, f"w{m - j + 2}") for m in range(j, rounds + 1)]
            return F.coalesce(*[F.when(n == m, F.col(c)) for m, c in options])

        if backward:
            board, alight = pick("r{}_alight"), pick("r{}_board")
            board_t, alight_t = -pick("r{}_alight_t"), -pick("r{}_board_t")
        else:
            board, alight = pick("r{}_board"), pick("r{}_alight")
            board_t, alight_t = pick("r{}_board_t"), pick("r{}_alight_t")
        legs.append((board, board_t, alight, alight_t, pick("r{}_trip"), walk_before()))

    last_walk = F.col("walk_s")
    if backward:
        last_walk = F.when(n == 0, F.col("walk_s")).otherwise(F.col("w1"))
        departs = -F.col("t")
        arrives = F.when(n == 0, F.lit(start)).otherwise(F.col("w1") - F.col("r1_board_t"))
    else:
        departs, arrives = F.col("start"), F.col("t")
    origin, target = ("place", "src") if backward else ("src", "place")
    out = [F.col(origin).cast("string").alias("Origin_aid"), X.seconds_to_time(departs).alias("Start_time")]
    before = departs
    for j, (board, board_t, alight, alight_t, trip, walk) in enumerate(legs, 1):
        walked = F.when(board.isNotNull(), F.coalesce(walk, F.lit(0)))
        if j == 1:
            walked = F.coalesce(walked, F.lit(0))
        stop = F.lit("s:")
        out += [
            walked.cast("long").alias(f"Walk_time{j}"),
            F.concat(stop, board).alias(f"BStop_ID{j}"),
            (board_t - before - F.coalesce(walk, F.lit(0))).cast("long").alias(f"Wait_time{j}"),
            X.seconds_to_time(board_t).alias(f"Bus_start_time{j}"),
            trip.alias(f"Line_ID{j}"),
            (alight_t - board_t).cast("long").alias(f"Ride_time{j}"),
            F.concat(stop, alight).alias(f"AStop_ID{j}"),
            X.seconds_to_time(alight_t).alias(f"Bus_finish_time{j}"),
        ]
        before = alight_t
    out += [
        F.coalesce(last_walk, F.lit(0)).cast("long").alias("DestWalk_time"),
        F.col(target).cast("string").alias("Destination_aid"),
        # with a function on an array Spark cuts this wide row into several methods; in one it is more code than Java compiles
        F.get(F.transform(F.array(arrives), X.seconds_to_time), 0).alias("Destination_time"),
    ]
    limit_name = "Earlest_arrival_time" if limits.schedule else "Arrive_before"
    if backward:
        out.append(X.seconds_to_time(F.lit(start)).alias(limit_name))
    out += [
        (F.col("transfers") + 1).cast("int").alias("Legs"),
        F.col("duration").cast("long").alias("Duration"),
    ]
    table = df.select(*out)
    now = X.seconds_to_time(F.lit(start))
    own = {"Origin_aid": F.col("src"), "Destination_aid": F.col("src"), "Start_time": now, "Destination_time": now}
    own |= {limit_name: now} | {c: F.lit(0) for c in ("Walk_time1", "DestWalk_time", "Legs", "Duration")}
    kinds = dict(table.dtypes)
    rows = sources.select(
        *[own.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in table.columns]
    )
    return table.unionByName(rows)
