"""Profile search: all start times of a source in one search.

A row (src, wave, place) says how a place is reached for every start time of its wave (up to
``SLOTS`` start times each): column ``p<i>`` holds, packed into one number, the seconds from
the start to the arrival, the seconds to the actual departure, and the stop before. The
smaller number is the better way (earliest arrival, then latest departure, then smallest
stop), so a round keeps the best ways of all start times by plain minima of numbers.

A ride is a row of ``connections``: whoever stands at ``stop_id`` between ``from_t`` and
``to_t`` boards at ``board_t`` and may alight at ``to_stop``. A trip's window ends where
another trip of its route comes first, so no choice between trips is left to the rounds; ways
that reach a stop at the same second share their rides whatever their start times.

What packing leaves out (trip, boarding time, walk) is looked up in ``labels``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import number_rows
from ..functions.scratch import Scratch
from ..functions.skew import merge_join, spread_join

SLOTS = 8
# layout of a packed way: arrival (18 bits), departure from the end (18 bits), stop (26 bits), walk over the last limit
TIME_BITS, STOP_BITS = 18, 26
START_AT = STOP_BITS + 1
ARRIVAL_AT = START_AT + TIME_BITS
TIME_MASK = (1 << TIME_BITS) - 1
STOP_MASK = (1 << STOP_BITS) - 1
BUCKETS_PER_WINDOW = 2
# Sources of a block, which are those with neighbouring home stops; walks of a list; ways with a walk that a task should make.
SOURCES_PER_BLOCK = 64
WALKS_PER_LIST = 512
WAYS_PER_TASK = 1_000_000


def boarding_windows(events: DataFrame, wait: int, change: int) -> DataFrame:
    """(route_id, trip_id, seq, stop_id, board_t, from_t, to_t): when one has to be at a stop to take a trip.

    Between ``change`` and ``wait`` seconds before it leaves, and not while a trip that comes
    first in route order can be had too. Windows are equally long, so that one which
    comes first cuts off the beginning, or the end if it leaves later: what is left is one
    window. Trips meet those of their route and stop that leave within ``wait`` seconds.
    """
    width = max(1, wait)
    t = F.col("t")
    own = events.select("route_id", "trip_id", "seq", "stop_id", "t", "t_first", F.floor(t / width).alias("__b"))
    near = F.explode(F.sequence(F.col("__b") - 1, F.col("__b") + 1))
    others = own.select("route_id", "seq", "stop_id", near.alias("__b"), F.col("t").alias("__t"), F.struct("t_first", "trip_id").alias("__order"))
    met = merge_join(own, others, ["route_id", "seq", "stop_id", "__b"])
    first = F.col("__order") < F.struct("t_first", "trip_id")
    cut = met.groupBy("route_id", "trip_id", "seq", "stop_id", "t").agg(
        F.max(F.when(first & (F.col("__t") <= t), F.col("__t"))).alias("before"),
        F.min(F.when(first & (F.col("__t") > t), F.col("__t"))).alias("after"),
    )
    windows = cut.select(
        "route_id", "trip_id", "seq", "stop_id", t.alias("board_t"),
        F.greatest(t - wait, F.col("before") - change + 1).alias("from_t"),
        F.least(t - change, F.col("after") - wait - 1).alias("to_t"),
    )
    return windows.where("from_t <= to_t")


def bucket_width(wait: int, change: int) -> int:
    return max(1, (wait - change + 1) // BUCKETS_PER_WINDOW)


def in_buckets(windows: DataFrame, width: int) -> DataFrame:
    """Each window once for every time bucket that it touches."""
    return windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("from_t") / width), F.floor(F.col("to_t") / width))))


def connections(events: DataFrame, wait: int, change: int) -> DataFrame:
    """(stop_id, from_t, to_t, board_t, route_id, trip_id, to_stop, alight_t): rides to all later stops of a trip."""
    on = events.select("trip_id", F.col("seq").alias("__seq"), F.col("stop_id").alias("to_stop"), F.col("t").alias("alight_t"))
    rides = merge_join(boarding_windows(events, wait, change), on, "trip_id").where((F.col("__seq") > F.col("seq")) & (F.col("to_stop") != F.col("stop_id")))
    return rides.drop("__seq", "seq")


class Search:
    """Ways from all sources at all departures. ``limits`` as in ``transit.Limits``.

    ``departures`` ascend; going backwards times are mirrored. Walks without a ride start at
    ``walk_at`` if given, else at the departure. ``latest_start``: journeys that leave later do not count.
    """

    def __init__(
        self,
        sources: DataFrame,
        departures: Sequence[int],
        events: DataFrame,
        footpaths: DataFrame,
        near_buildings: DataFrame,
        limits,
        change: int,
        walk_at: int | None = None,
        latest_start: int | None = None,
    ):
        self.limits, self.change, self.walk_at, self.latest_start = limits, change, walk_at, latest_start
        self.departures = sorted({int(d) for d in departures})
        self.horizon = limits.horizon
        if self.departures[-1] + self.horizon - self.departures[0] >= TIME_MASK:
            raise ValueError(f"a search covers less than {TIME_MASK} seconds")
        self.slots = min(SLOTS, len(self.departures))
        self.waves = -(-len(self.departures) // self.slots)
        self.rounds = limits.max_transfers + 1
        self.sources, self.near = sources.select("src").distinct(), near_buildings
        self.scratch = Scratch(sources.sparkSession, "profile")
        # rows dealt by block stay where they are when they are joined or grouped by more than the block
        sources.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self._number_stops(events, footpaths)

    def _number_stops(self, events: DataFrame, footpaths: DataFrame) -> None:
        """Stops by their rank; the walks that may be used, apart by what they join."""
        lim = self.limits
        first, last = self.departures[0], self.departures[-1] + self.horizon
        waits = max(lim.first_wait, lim.wait_transfer)
        events = events.where(F.col("t").between(first, last + waits))
        reach = max(lim.walk1, lim.walk2, lim.walk3)
        paths = footpaths.where(F.col("walk_s") <= reach).groupBy("from_id", "from_kind", "to_id", "to_kind").agg(F.min("walk_s").alias("walk_s"))
        paths = self.scratch.keep(paths, "paths")
        stops = reduce(
            DataFrame.unionByName,
            [events.select(F.col("stop_id").alias("id")), *[paths.where(f"{e}_kind = 's'").select(F.col(f"{e}_id").alias("id")) for e in ("from", "to")]],
        )
        numbered = number_rows(stops.where("id is not null").distinct(), [], [F.col("id")], "rn", settle=True)
        self.stops = self.scratch.keep(numbered.select("id", (F.col("rn") - 1).cast("long").alias("stop")), "stops")
        if self.stops.count() > STOP_MASK:
            raise ValueError(f"a search covers at most {STOP_MASK} stops")

        def rank(df: DataFrame, column: str) -> DataFrame:
            named = self.stops.withColumnsRenamed({"id": column, "stop": "__rank"})
            return merge_join(df, named, column).withColumn(column, F.col("__rank")).drop("__rank")

        self.events = self.scratch.keep(rank(events, "stop_id"), "events")
        access = paths.where((F.col("from_kind") == "b") & (F.col("to_kind") == "s") & (F.col("walk_s") <= lim.walk1))
        access = merge_join(access, self.sources.withColumnRenamed("src", "from_id"), "from_id", "left_semi")
        access = self.scratch.keep(rank(access, "to_id").select(F.col("from_id").alias("src"), F.col("to_id").alias("place"), "walk_s"), "near")
        homes = merge_join(self.sources, access.groupBy("src").agg(F.min("place").alias("home")), "src", "left")
        ordered = number_rows(homes, [], [F.col("home").asc_nulls_last(), F.col("src")], "rn", settle=True)
        self.sources = self.scratch.keep(ordered.select("src", F.floor((F.col("rn") - 1) / SOURCES_PER_BLOCK).alias("block")), "sources")
        self.access = self.scratch.keep(merge_join(access, self.sources, "src"), "access")
        between = paths.where((F.col("from_kind") == "s") & (F.col("to_kind") == "s") & (F.col("walk_s") <= lim.walk2))
        self.transfers = self.scratch.keep(rank(rank(between, "from_id"), "to_id").select(F.col("from_id").alias("place"), F.col("to_id").alias("to"), "walk_s"), "transfers")
        self.transfer_lists = self._lists(self.transfers, "transfers")
        out = paths.where((F.col("from_kind") == "s") & (F.col("to_kind") == "b") & (F.col("walk_s") <= max(lim.walk2, lim.walk3)))
        self.exit_lists = self._lists(rank(out, "from_id").select(F.col("from_id").alias("place"), F.col("to_id").alias("to"), "walk_s"), "exits")

    def _lists(self, walks: DataFrame, label: str) -> DataFrame:
        """(place, walks): the walks (to, walk_s) from each stop in lists of a bounded length."""
        fan = F.ceil(F.col("n") / WALKS_PER_LIST)
        counted = merge_join(walks, walks.groupBy("place").agg(F.count("*").alias("n")), "place").withColumn("part", F.pmod(F.xxhash64("to"), fan))
        made = counted.groupBy("place", "part").agg(F.collect_list(F.struct("to", F.col("walk_s").cast("long").alias("walk_s"))).alias("walks"))
        return self.scratch.keep(made.select("place", "walks"), f"{label}-lists")

    # -- packed ways ---------------------------------------------------------------

    def p(self, prefix: str = "p") -> list[str]:
        return [f"{prefix}{i}" for i in range(self.slots)]

    def departure(self, i: int) -> Column:
        """The departure of slot ``i``, null if the last wave has none."""
        if self.waves == 1:
            return F.lit(self.departures[i]).cast("long")
        every = F.array(*[F.lit(d).cast("long") for d in self.departures])
        return F.get(every, F.col("wave") * self.slots + i)

    @staticmethod
    def arrival(p: Column) -> Column:
        return F.shiftright(p, ARRIVAL_AT)

    @staticmethod
    def start(p: Column) -> Column:
        """Seconds from the departure tried to the actual one."""
        return TIME_MASK - F.shiftright(p, START_AT).bitwiseAND(TIME_MASK)


    # -- rounds ---------------------------------------------------------------------

    @cached_property
    def connections(self) -> list[tuple[DataFrame, int]]:
        """Rides of the first and of all later rounds, with the width of their time buckets."""
        made = {}
        last = self.departures[-1] + self.horizon
        for wait in {self.limits.first_wait, self.limits.wait_transfer}:
            rides = connections(self.events, wait, self.change).where(F.col("alight_t") <= last)
            made[wait] = (self.scratch.keep(rides, f"connections-{wait}"), bucket_width(wait, self.change))
        return [made[self.limits.first_wait], made[self.limits.wait_transfer]]

    @cached_property
    def zero(self) -> DataFrame:
        """Stops reached on foot from the sources."""
        every = self.access.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(self.waves - 1))))
        walk = F.col("walk_s").cast("long")
        way = F.shiftleft(walk, ARRIVAL_AT) + (TIME_MASK << START_AT)
        fits = walk <= self.horizon
        return self.scratch.keep(
            every.select("block", "src", "wave", "place", *[F.when(fits & self.departure(i).isNotNull(), way).alias(c) for i, c in enumerate(self.p())]), "k0"
        )

    def ride(self, labels: DataFrame, k: int) -> DataFrame:
        """(block, src, wave, place, p...): where one ride leads from the stops of ``labels``, in round ``k``."""
        rides, width = self.connections[0 if k == 1 else 1]
        first = self.departures[0]
        no_wait = self.limits.schedule and k == 1
        times, ways = [], []
        for i, c in enumerate(self.p()):
            p, late = F.col(c), F.shiftleft(self.departure(i) - first, ARRIVAL_AT)
            times.append(self.departure(i) + self.arrival(p))
            # a way is what the ride adds to this; without waiting the ride says the start too
            start = F.lit(0).cast("long") if no_wait else F.shiftleft(F.shiftright(p, START_AT).bitwiseAND(TIME_MASK), START_AT)
            ways.append(F.when(times[i] == F.col("t"), start + F.shiftleft("place", 1) - late).alias(c))
        # one row for each second at which some start time brings one to the stop
        legs = labels.withColumn("t", F.explode(F.array_distinct(F.array_compact(F.array(*times)))))
        legs = legs.select("block", "src", "wave", "place", "t", F.floor(F.col("t") / width).alias("bucket"), *ways)
        arrives = F.shiftleft(F.col("alight_t") - first, ARRIVAL_AT).alias("arrives")
        offered = in_buckets(rides.select(F.col("stop_id").alias("place"), "from_t", "to_t", "board_t", "to_stop", arrives), width)
        met = spread_join(legs, offered, ["place", "bucket"], "src").where(F.col("t").between(F.col("from_t"), F.col("to_t")))
        if no_wait:
            met = met.withColumn("arrives", F.col("arrives") + F.shiftleft(TIME_MASK - (F.col("board_t") - F.col("t")), START_AT))
        end = (self.horizon + 1) << ARRIVAL_AT
        found = met.select("block", "src", "wave", F.col("to_stop").alias("place"), *[(F.col("arrives") + F.col(c)).alias(c) for c in self.p()])
        found = found.groupBy("block", "src", "wave", "place").agg(*[F.min(F.when(F.col(c) < end, F.col(c))).alias(c) for c in self.p()])
        return found.where(F.coalesce(*self.p()).isNotNull())

    def tasks(self, rides: DataFrame, lists: DataFrame) -> int:
        """Over how many tasks to deal the blocks of ``rides`` that go on by the walks of ``lists``."""
        stops, walks = lists.agg(F.count_distinct("place"), F.sum(F.size("walks"))).first()
        ways = rides.count() * (walks or 0) // max(stops, 1)
        return max(int(rides.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ways // WAYS_PER_TASK))

    def walk(self, rides: DataFrame, lists: DataFrame, tasks: int, *more: str, allowed: Column | None = None, walks: bool = False) -> DataFrame:
        """(block, src, wave, to, p..., more): the best ways by a walk from the ends of rides, for each ``more``.

        With ``walks``, ``walk<i>`` is the walk of each way. The ways of a block of sources are made
        where they are grouped, and do not move: what is dealt by block are its rides, and the
        lists of walks from the stops that it reaches, once for all its sources.
        """
        # the same start, the stop walked from; the walk is added to the arrival
        left = [(F.shiftleft(F.shiftright(c, START_AT), START_AT) + F.shiftleft("place", 1)).alias(c) for c in self.p()]
        w = F.col("walk_s")
        reached = merge_join(rides.select("block", "place").distinct(), lists, "place").repartition(tasks, "block")
        ends = rides.select("block", "src", "wave", "place", *left, *more).repartition(tasks, "block")
        met = merge_join(ends, reached, ["block", "place"]).select("block", "src", "wave", *self.p(), *more, F.explode("walks").alias("x"))
        met = met.select("block", "src", "wave", "x.to", "x.walk_s", *self.p(), *more)
        if allowed is not None:
            met = met.where(allowed)
        add = F.shiftleft(w, ARRIVAL_AT) + F.when(w > self.limits.walk3, 1).otherwise(0).cast("long")
        ways = [F.when(F.col(c) < F.shiftleft(self.horizon + 1 - w, ARRIVAL_AT), F.col(c) + add) for c in self.p()]
        best = [F.min(way).alias(c) for c, way in zip(self.p(), ways, strict=True)]
        if walks:
            best += [F.min_by("walk_s", way).alias(c) for c, way in zip(self.p("walk"), ways, strict=True)]
        return met.groupBy("block", "src", "wave", "to", *more).agg(*best).where(F.coalesce(*self.p()).isNotNull())

    @cached_property
    def ways(self) -> list[tuple[DataFrame, DataFrame]]:
        """Of each round from 1: (rides, ways to stops that may be ridden on from).

        The latter hold rides and, where there is none, walks; ``walked`` has a bit for each slot that is one.
        """
        out, labels = [], self.zero
        for k in range(1, self.rounds + 1):
            rides = self.scratch.keep(self.ride(labels, k), f"rides{k}")
            if k < self.rounds:
                walks = self.walk(rides, self.transfer_lists, self.tasks(rides, self.transfer_lists)).withColumnRenamed("to", "place")
                nothing = [F.lit(None).cast("long").alias(c) for c in self.p()]
                both = rides.select("block", "src", "wave", "place", *self.p(), *[n.alias(c) for n, c in zip(nothing, self.p("w"), strict=True)]).unionByName(
                    walks.select("block", "src", "wave", "place", *nothing, *[F.col(c).alias(w) for c, w in zip(self.p(), self.p("w"), strict=True)])
                )
                merged = both.groupBy("block", "src", "wave", "place").agg(*[F.max(c).alias(c) for c in [*self.p(), *self.p("w")]])
                bits = [F.when(F.col(c).isNull() & F.col(w).isNotNull(), 1 << i).otherwise(0) for i, (c, w) in enumerate(zip(self.p(), self.p("w"), strict=True))]
                joined = [F.coalesce(c, w).alias(c) for c, w in zip(self.p(), self.p("w"), strict=True)]
                labels = self.scratch.keep(merged.select("block", "src", "wave", "place", *joined, reduce(lambda a, b: a + b, bits).alias("walked")), f"stops{k}")
            out.append((rides, labels))
        return out

    def exit_allowed(self, k: Column) -> Column:
        """Walks to buildings after ride ``k``: after the last one only within the last limit."""
        return (k < self.rounds) | (F.col("walk_s") <= self.limits.walk3)

    # -- journeys to buildings ----------------------------------------------------------

    def _rides(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [rides.withColumn("k", F.lit(k)) for k, (rides, _) in enumerate(self.ways, 1)])

    def _arrivals(self, tasks: int, walks: bool = False) -> DataFrame:
        """(block, src, wave, place, k, p...): the best way to each building after each round."""
        allowed = (F.col("to") != F.col("src")) & self.exit_allowed(F.col("k"))
        return self.walk(self._rides(), self.exit_lists, tasks, "k", allowed=allowed, walks=walks).withColumnRenamed("to", "place")

    def arrivals(self) -> DataFrame:
        """(src, place, dep, k, t, start, allowed): a row for each building, departure and round with a ride.

        ``allowed``: the last walk is within its limit.
        """
        one = [F.when(F.col(c).isNotNull(), F.struct(self.departure(i).alias("dep"), F.col(c).alias("p"))) for i, c in enumerate(self.p())]
        rows = self._arrivals(self.tasks(self._rides(), self.exit_lists)).select("src", "place", "k", F.explode(F.array_compact(F.array(*one))).alias("x")).select("src", "place", "k", "x.*")
        p = F.col("p")
        return rows.select("src", "place", "dep", "k", (F.col("dep") + self.arrival(p)).alias("t"), (F.col("dep") + self.start(p)).alias("start"), (p.bitwiseAND(1) == 0).alias("allowed"))

    def walkers(self) -> DataFrame:
        """(block, src, place, walk_s): buildings near the sources."""
        pairs = merge_join(self.near, self.sources, "src").where("src <> place")
        return pairs.groupBy("block", "src", "place").agg(F.min("walk_s").cast("long").alias("walk_s"))

    def journeys(self, walks: bool = False) -> DataFrame:
        """(src, place, dep, k, t, start, duration, transfers, stop): the best journey to each building.

        Least duration, then the first departure tried, then the fewest transfers, then with a
        ride. ``stop`` is the rank of the last stop; with ``walks``, ``walk_s`` is the walk from there.
        """
        lim = self.limits
        transfers = F.col("k") - 1
        rank = F.shiftleft(transfers.cast("long"), 10) + (1023 - F.col("k"))
        rest = ["p", "walk_s"] if walks else ["p"]
        tasks = self.tasks(self._rides(), self.exit_lists)
        rows = self._arrivals(tasks, walks).where(transfers >= lim.min_transfers)
        # a row for each slot: all slots in one expression are more code than Java compiles, and many times slower
        slots = [
            F.struct(self.departure(i).alias("dep"), F.lit(i).alias("slot"), F.col(c).alias("p"), *([F.col(f"walk{i}").alias("walk_s")] if walks else [])) for i, c in enumerate(self.p())
        ]
        rows = rows.select("block", "src", "place", "wave", "k", F.explode(F.array(*slots)).alias("x")).select("block", "src", "place", "wave", "k", "x.*")
        p = F.col("p")
        start = self.start(p)
        took = self.arrival(p) - start
        ok = p.isNotNull() & (p.bitwiseAND(1) == 0)
        if lim.schedule:
            in_time = start <= lim.gap if self.latest_start is None else F.col("dep") + start <= self.latest_start
            ok = ok & (took <= lim.max_time) & in_time
        # least duration, then first departure, then the rank of the round
        key = F.shiftleft(took, 40) + F.shiftleft((F.col("wave") * self.slots + F.col("slot")).cast("long"), 20) + rank
        best = rows.where(ok).select("block", "src", "place", key.alias("key"), *rest)
        best = best.groupBy("block", "src", "place").agg(F.min("key").alias("key"), *[F.min_by(c, "key").alias(c) for c in rest])
        on_foot = self.walkers().where(F.col("walk_s") <= lim.walk3)
        if lim.schedule:
            on_foot = on_foot.where(F.col("walk_s") <= lim.max_time)
        if lim.min_transfers > 0:
            on_foot = on_foot.where(F.lit(False))
        foot = {"key": F.shiftleft("walk_s", 40) + 1023, "p": F.lit(-1).cast("long"), "walk_s": F.col("walk_s")}
        on_foot = on_foot.select(*[F.col(c).alias(f"__{c}") for c in ("block", "src", "place")], *[foot[c].alias(f"__{c}") for c in ("key", *rest)])
        same = [F.col(c) == F.col(f"__{c}") for c in ("block", "src", "place")]
        best = merge_join(best, on_foot.repartition(tasks, "__block"), reduce(lambda a, b: a & b, same), "full")
        walked = F.col("key").isNull() | (F.col("__key") < F.col("key"))
        best = best.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in ("src", "place")], *[F.when(walked, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("key", *rest)])
        took, number, k = F.shiftright(F.col("key"), 40), F.shiftright(F.col("key"), 20).bitwiseAND((1 << 20) - 1), 1023 - F.col("key").bitwiseAND(1023)
        dep = F.get(F.array(*[F.lit(d).cast("long") for d in self.departures]), number.cast("int"))
        leave = dep if self.walk_at is None else F.lit(int(self.walk_at)).cast("long")
        start = F.when(k == 0, leave).otherwise(dep + self.start(F.col("p")))
        return best.select(
            "src", "place", dep.alias("dep"), k.cast("int").alias("k"), (start + took).alias("t"), start.alias("start"), took.alias("duration"),
            F.greatest(k - 1, F.lit(0)).cast("int").alias("transfers"), F.when(k > 0, F.shiftright(F.col("p"), 1).bitwiseAND(STOP_MASK)).alias("stop"),
            *rest[1:],
        )

    def with_last_stop(self, journeys: DataFrame) -> DataFrame:
        """Journeys with ``prev`` (the last stop, or the source) in place of ``stop``."""
        found = journeys.join(self.stops.withColumnRenamed("id", "prev"), "stop", "left")
        return found.withColumn("prev", F.coalesce("prev", "src")).drop("stop")

    # -- labels -------------------------------------------------------------------------

    def _unpacked(self, rows: DataFrame) -> DataFrame:
        """(src, dep, place, t, start, stop, walked): a row for each slot that has a way."""
        more = ["walk_s"] if "walk0" in rows.columns else []
        slots = [
            F.when(F.col(c).isNotNull(), F.struct(
                self.departure(i).alias("dep"), F.col(c).alias("p"), (F.shiftright(F.col("walked"), i).bitwiseAND(1) == 1 if "walked" in rows.columns else F.lit(False)).alias("walked"),
                *[F.col(f"walk{i}").alias(m) for m in more],
            ))
            for i, c in enumerate(self.p())
        ]
        flat = rows.select("src", "place", F.explode(F.array_compact(F.array(*slots))).alias("x")).select("src", "place", "x.*")
        p = F.col("p")
        return flat.select(
            "src", "dep", "place", (F.col("dep") + self.arrival(p)).alias("t"), (F.col("dep") + self.start(p)).alias("start"),
            F.shiftright(p, 1).bitwiseAND(STOP_MASK).alias("stop"), "walked", *more,
        )

    def labels(self) -> DataFrame:
        """(src, dep, k, place, kind, t, start, walk_s, prev, board_t, trip) of all rounds."""
        none_t, none_trip = F.lit(None).cast("long").alias("board_t"), F.lit(None).cast("string").alias("trip")
        no_walk = F.lit(None).cast("long").alias("walk_s")
        name = self.stops.select(F.col("stop").alias("place"), F.col("id").alias("__name"))
        before = self.stops.select("stop", F.col("id").alias("prev"))

        def named(rows: DataFrame) -> DataFrame:
            return rows.join(name, "place").withColumn("place", F.col("__name")).drop("__name")

        def shaped(rows: DataFrame, k: int, kind: str, *more: Column | str) -> DataFrame:
            return rows.select("src", "dep", F.lit(k).alias("k"), "place", F.lit(kind).alias("kind"), "t", "start", *more)

        out = []
        zero = self._unpacked(self.zero)
        reached = named(zero).withColumn("walk_s", F.col("t") - F.col("dep"))
        out.append(shaped(reached, 0, "s", "walk_s", F.col("src").alias("prev"), none_t, none_trip))
        every = F.explode(F.array(*[F.lit(d).cast("long") for d in self.departures]))
        leave = F.col("dep") if self.walk_at is None else F.lit(int(self.walk_at)).cast("long")
        on_foot = self.walkers().withColumn("dep", every).withColumn("start", leave).withColumn("t", leave + F.col("walk_s"))
        out.append(shaped(on_foot, 0, "b", "walk_s", F.col("src").alias("prev"), none_t, none_trip))
        for k, (rides, stops) in enumerate(self.ways, 1):
            offered = self.connections[0 if k == 1 else 1][0]
            stood = zero.select("src", "dep", F.col("place").alias("stop"), F.col("t").alias("__t"))
            taken = offered.select(F.col("stop_id").alias("stop"), F.col("to_stop").alias("place"), F.col("alight_t").alias("t"), "from_t", "to_t", "board_t", "route_id", "trip_id")
            ridden = merge_join(merge_join(self._unpacked(rides), stood, ["src", "dep", "stop"]), taken, ["stop", "place", "t"])
            ridden = ridden.where(F.col("__t").between(F.col("from_t"), F.col("to_t"))).groupBy("src", "dep", "place", "t", "start", "stop")
            # of equal arrivals the later boarding, then the smaller trip
            ridden = ridden.agg(F.min(F.struct((-F.col("board_t")).alias("nb"), "trip_id", "route_id")).alias("b"))
            ridden = named(ridden).join(before, "stop")
            out.append(shaped(ridden, k, "s", no_walk, "prev", (-F.col("b.nb")).alias("board_t"), F.concat_ws("_", "b.route_id", "b.trip_id").alias("trip")))
            if k < self.rounds:
                zero = self._unpacked(stops)
                between = self.transfers.select(F.col("place").alias("stop"), F.col("to").alias("place"), F.col("walk_s").cast("long").alias("walk_s"))
                walked = named(merge_join(zero.where("walked"), between, ["stop", "place"])).join(before, "stop")
                out.append(shaped(walked, k, "s", "walk_s", "prev", none_t, none_trip))
            homes = self.walk(rides, self.exit_lists, self.tasks(rides, self.exit_lists), allowed=self.exit_allowed(F.lit(k)), walks=True)
            at_homes = self._unpacked(homes.withColumnRenamed("to", "place")).join(before, "stop")
            out.append(shaped(at_homes, k, "b", "walk_s", "prev", none_t, none_trip))
        return reduce(DataFrame.unionByName, out)
