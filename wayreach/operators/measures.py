"""Accessibility measures over origin-destination durations.

``star`` is the side with the facilities (the sources), ``hash`` the other side; pairs
are (star, hash, duration_s). Long tables are the results; wide ones are pivots of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X


# -- time bins -----------------------------------------------------------------------


def bin_bounds(max_time: int, step_s: int) -> list[int]:
    """Upper bounds: whole steps up to ``max_time``, then the rest in whole minutes if any."""
    whole = int(max_time // step_s)
    bounds = [i * step_s for i in range(1, whole + 1)]
    rest = int((max_time % step_s) / 60)
    return bounds + ([whole * step_s + rest * 60] if rest > 0 else [])


def time_bins(spark: SparkSession, max_time: int, step_s: int) -> DataFrame:
    """(bin, bound_s, label) with 1-based bin numbers and labels such as ``5m``."""
    rows = [(i, b, f"{b // 60}m") for i, b in enumerate(bin_bounds(max_time, step_s), 1)]
    return spark.createDataFrame(rows, "bin int, bound_s int, label string")


def first_bin(duration: Column, bounds: Sequence[int]) -> Column:
    """Number of the first bin whose bound is not below the duration; null beyond the last."""
    reached = None
    for i, bound in enumerate(bounds, 1):
        test = duration <= bound
        reached = F.when(test, i) if reached is None else reached.when(test, i)
    return reached if reached is not None else F.lit(None).cast("int")


def _cumulate(per_bin: DataFrame, keys: Sequence[str], n_bins: int, sums: Sequence[str]) -> DataFrame:
    """Fill missing bins with zero and add up along the bins of each key.

    ``per_bin`` has at most ``n_bins`` rows per key, so the windows are small.
    """
    filled = (
        per_bin.groupBy(*keys)
        .agg(*[_by_bin(s, n_bins).alias(s) for s in sums])
        .select(*keys, F.posexplode(F.arrays_zip(*sums)).alias("bin", "v"))
    )
    running = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(
        *keys, (F.col("bin") + 1).alias("bin"), *[F.sum(F.col("v")[s]).over(running).alias(s) for s in sums]
    )


def _by_bin(value: str, n_bins: int) -> Column:
    """The per-bin totals of ``value`` as an array of ``n_bins`` entries."""
    return F.array(
        *[F.coalesce(F.sum(F.when(F.col("bin") == i, F.col(value))), F.lit(0)) for i in range(1, n_bins + 1)]
    )


def numeric_fields(attributes: DataFrame, fields: Sequence[str]) -> list[str]:
    """Of the wanted fields those that hold numbers; the others are left out."""
    numbers = {f.name for f in attributes.schema.fields if isinstance(f.dataType, T.NumericType)}
    return [f for f in fields if f in numbers]


def cumulative_opportunities(
    pairs: DataFrame,
    step_s: int,
    max_time: int,
    attributes: DataFrame | None = None,
    fields: Sequence[str] = (),
    include_self: bool = True,
    count: bool = True,
    sources: DataFrame | None = None,
) -> DataFrame:
    """(star, bin, bound_s, nbldg, <field>...): everything reached within each bound.

    Each pair is put into its first bin and summed there before the shuffle; the running
    sum over at most a few dozen bins per source then gives 'at most the bound'. The
    source itself counts once, at duration 0. ``attributes`` is (aid, fields...).
    ``sources`` (star) names all sources, also those that reach nothing else; without it
    only sources with pairs are known.
    """
    bounds = bin_bounds(max_time, step_s)
    rows = pairs.select("star", "hash", "duration_s")
    if include_self:
        rows = rows.filter(F.col("star") != F.col("hash"))
        own = (pairs if sources is None else sources).select("star").distinct()
        rows = rows.unionByName(own.select("star", F.col("star").alias("hash"), F.lit(0).cast("long").alias("duration_s")))
    rows = rows.withColumn("bin", first_bin(F.col("duration_s"), bounds))
    used = numeric_fields(attributes, fields) if attributes is not None else []
    if used:
        values = attributes.select(F.col("aid").alias("hash"), *used)
        # the layer grows with the pairs; Spark may take it for small by its files and build it on the driver
        rows = rows.join(values.hint("shuffle_hash"), "hash", "left")
    totals = [F.sum(F.coalesce(F.col(f), F.lit(0))).alias(f) for f in used]
    if count:
        totals = [F.count("bin").alias("nbldg"), *totals]
    names = (["nbldg"] if count else []) + used
    per_bin = rows.groupBy("star", "bin").agg(*totals)
    out = _cumulate(per_bin, ["star"], len(bounds), names)
    limits = F.array(*[F.lit(b) for b in bounds])
    return out.select("star", "bin", F.element_at(limits, F.col("bin").cast("int")).alias("bound_s"), *names)


def cumulative_wide(cumulative: DataFrame, value: str, max_time: int, step_s: int) -> DataFrame:
    """One row per star: ``<b>m`` (count), ``<b>m_<field>`` and ``<field>_total``."""
    bounds = bin_bounds(max_time, step_s)
    shown = ["nbldg"] if value == "nbldg" else ["nbldg", value]
    columns = []
    for i, b in enumerate(bounds, 1):
        for v in shown:
            name = f"{b // 60}m" + ("" if v == "nbldg" else f"_{v}")
            columns.append(F.max(F.when(F.col("bin") == i, F.col(v))).alias(name))
    total = F.max(F.when(F.col("bin") == len(bounds), F.col(value))).alias(f"{value}_total")
    return cumulative.groupBy("star").agg(*columns, total)


def aggregate_fields(
    pairs: DataFrame, attributes: DataFrame, fields: Sequence[str], step_s: int, max_time: int, hexes: bool = False
) -> DataFrame:
    """(star, bound_s, field, value) for the count and several fields at once.

    Fields that hold no numbers are skipped. On hexagon layers with fields the plain
    count is left out, since a hexagon is not a building.
    """
    used = numeric_fields(attributes, fields)
    names = used if hexes and used else ["nbldg", *used]
    wide = cumulative_opportunities(pairs, step_s, max_time, attributes, used)
    return wide.select("star", "bound_s", *[F.col(n).cast("double") for n in names]).unpivot(
        ["star", "bound_s"], names, "field", "value"
    )


# -- service areas ---------------------------------------------------------------------


def service_area(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per other-side building the pair of least duration; ties go to the smallest star.

    ``by`` names further keys, such as the run, for which this is done separately.
    """
    rest = [c for c in pairs.columns if c not in ("star", "hash", "duration_s", *by)]
    best = F.min(F.struct("duration_s", "star", *rest)).alias("b")
    found = pairs.groupBy("hash", *by).agg(best)
    return found.select("b.star", "hash", "b.duration_s", *by, *[f"b.{c}" for c in rest])


def with_own_pairs(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """``pairs`` (star, hash, duration_s) and each source (star) with itself at duration 0."""
    own = sources.select("star", F.col("star").alias("hash"), F.lit(0).cast("long").alias("duration_s")).distinct()
    others = pairs.filter(F.col("star") != F.col("hash"))
    return others.unionByName(own, allowMissingColumns=True)


def by_source(pairs: DataFrame, value: str = "duration_s") -> DataFrame:
    """(hash, star, <value>): the least value of each pair, for any number of sources."""
    return pairs.groupBy("hash", "star").agg(F.min(value).alias(value))


def pivot_by_source(pairs: DataFrame, sources: Sequence, value: str = "duration_s", prefix: str = "Duration_") -> DataFrame:
    """(hash, Duration_<star>...) with a column for each of the given sources."""
    named = pairs.filter(F.col("star").isin(list(sources)))
    cells = [F.min(F.when(F.col("star") == s, F.col(value))).alias(f"{prefix}{s}") for s in sources]
    return named.groupBy("hash").agg(*cells)


def destination_filter(
    pairs: DataFrame, destinations: DataFrame, stops: DataFrame | None = None, key: str = "hash"
) -> DataFrame:
    """Pairs whose other side is in the chosen layer (aid) and is not a stop (stop_id)."""
    kept = pairs.join(destinations.select(F.col("aid").alias(key)), key, "left_semi")
    if stops is not None:
        kept = kept.join(stops.select(F.col("stop_id").cast("long").alias(key)), key, "left_anti")
    return kept


def common_to_all_sources(pairs: DataFrame) -> DataFrame:
    """Buildings reached from every source."""
    n = pairs.agg(F.count_distinct("star")).first()[0]
    reached = pairs.groupBy("hash").agg(F.count_distinct("star").alias("n"))
    return reached.filter(F.col("n") == n).select("hash")


# -- round trips --------------------------------------------------------------------------


def roundtrip_pairs(runs: DataFrame) -> DataFrame:
    """Statistics of all TO x FROM combinations per pair, without forming them.

    ``runs``: (o_id, d_id, direction 'to'|'from', label, duration_s). The mean of sums is
    the sum of means, and their variance the sum of variances; everything comes from
    counts and power sums combined before the shuffle.
    """

    v = F.col("duration_s")
    # a row for each label first, so that labels are counted without a copy of the rows for each direction
    by_label = runs.groupBy("o_id", "d_id", "direction", "label").agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.min(v).alias("min")
    )

    def part(direction):
        mine = F.col("direction") == direction
        s = direction
        return [
            F.sum(F.when(mine, F.col("n"))).alias(f"n_{s}"),
            F.sum(F.when(mine, F.col("s"))).alias(f"s_{s}"),
            F.sum(F.when(mine, F.col("q"))).alias(f"q_{s}"),
            F.min(F.when(mine, F.col("min"))).alias(f"min_{s}"),
            F.count(F.when(mine, F.col("label"))).alias(f"labels_{s}"),
        ]

    sums = by_label.groupBy("o_id", "d_id").agg(*part("to"), *part("from"))
    both = sums.filter("n_to > 0 AND n_from > 0")
    mean_to, mean_from = F.col("s_to") / F.col("n_to"), F.col("s_from") / F.col("n_from")
    var = (F.col("q_to") / F.col("n_to") - mean_to * mean_to) + (
        F.col("q_from") / F.col("n_from") - mean_from * mean_from
    )
    return both.select(
        "o_id",
        "d_id",
        X.half_up(mean_to + mean_from, 2).alias("mean"),
        X.half_up(F.sqrt(F.greatest(var, F.lit(0.0))), 2).alias("std"),
        (F.col("n_to") * F.col("n_from")).alias("count"),
        F.col("n_to").alias("c_to"),
        F.col("n_from").alias("c_from"),
        (F.col("min_to") + F.col("min_from")).alias("best"),
        "labels_to",
        "labels_from",
    )


def roundtrip_filter(stats: DataFrame, runs: DataFrame, max_time: int, strict: bool = False) -> DataFrame:
    """Pairs with mean at most ``max_time``; strict keeps those present in every single run."""
    kept = stats.filter(F.col("mean") <= max_time)
    if strict:
        n = {
            r["direction"]: r["n"]
            for r in runs.groupBy("direction").agg(F.count_distinct("label").alias("n")).collect()
        }
        kept = kept.filter(
            (F.col("labels_to") == n.get("to", 0)) & (F.col("labels_from") == n.get("from", 0))
        )
    return kept


def roundtrip_best(stats: DataFrame) -> DataFrame:
    """Per d_id the o_id of least fastest-there plus fastest-back; ties to the smallest o_id."""
    rest = [c for c in stats.columns if c not in ("d_id", "best", "o_id")]
    return (
        stats.groupBy("d_id")
        .agg(F.min(F.struct("best", "o_id", *rest)).alias("b"))
        .select("d_id", *[F.col(f"b.{c}").alias(c) for c in stats.columns if c != "d_id"])
    )


def run_labels(runs: DataFrame, direction: str) -> list[str]:
    """The run labels of one direction, sorted; their number is the number of runs made."""
    rows = runs.filter(F.col("direction") == direction).select("label").distinct().orderBy("label")
    return [r[0] for r in rows.collect()]


def roundtrip_wide(
    stats: DataFrame,
    runs: DataFrame,
    to_labels: Sequence[str] | None = None,
    from_labels: Sequence[str] | None = None,
) -> DataFrame:
    """The statistics with one column per run: ``TO_<label>``, ``FROM_<label>``."""
    labels = {
        "to": run_labels(runs, "to") if to_labels is None else to_labels,
        "from": run_labels(runs, "from") if from_labels is None else from_labels,
    }
    cells = [
        F.max(F.when((F.col("direction") == d) & (F.col("label") == v), F.col("duration_s"))).alias(
            f"{d.upper()}_{v}"
        )
        for d in ("to", "from")
        for v in labels[d]
    ]
    wide = runs.groupBy("o_id", "d_id").agg(*cells)
    shown = stats.select(
        "o_id",
        "d_id",
        F.col("mean").alias("Duration_ave"),
        F.col("std").alias("Duration_std"),
        F.col("count").alias("Count"),
        F.col("c_to").alias("Count_to"),
        F.col("c_from").alias("Count_from"),
    )
    return shown.join(wide, ["o_id", "d_id"])


def roundtrip_bins(
    stats: DataFrame, step_s: int, max_time: int, weights: DataFrame | None = None
) -> DataFrame:
    """(o_id, bin, minutes, value): cumulative weight of the buildings by mean round trip.

    ``weights``: (aid, weight), 1 where absent. Bins past the maximum fall into the last.
    Bins nobody reached are not shown, except one more after the last if that is short of
    the maximum; values are rounded half up.
    """
    last = max_time // step_s - 1
    binned = stats.withColumn("bin", F.floor(F.col("mean") / step_s).cast("int"))
    binned = binned.withColumn("bin", F.when(F.col("bin") > last, last).otherwise(F.col("bin")))
    if weights is not None:
        given = weights.select(F.col("aid").alias("d_id"), F.col("weight").cast("double"))
        binned = binned.join(given, "d_id", "left")
        weight = F.coalesce("weight", F.lit(1.0))
    else:
        weight = F.lit(1.0)
    per_bin = binned.groupBy("o_id", "bin").agg(F.sum(weight).alias("value"))
    seen = [r[0] for r in per_bin.select("bin").distinct().orderBy("bin").collect()]
    if not seen:
        return per_bin.select("o_id", "bin", F.lit(0).alias("minutes"), F.col("value").cast("long"))
    if (seen[-1] + 1) * step_s // 60 < max_time // 60:
        seen.append(seen[-1] + 1)
    # number the shown bins 1..n, cumulate densely, then name them again
    position = F.create_map(*[F.lit(v) for i, b in enumerate(seen, 1) for v in (b, i)])
    numbered = per_bin.withColumn("bin", F.element_at(position, F.col("bin")))
    dense = _cumulate(numbered, ["o_id"], len(seen), ["value"])
    codes = F.array(*[F.lit(b) for b in seen])
    code = F.element_at(codes, F.col("bin").cast("int"))
    minutes = F.least(F.floor((code + 1) * step_s / 60), F.lit(max_time // 60))
    return dense.select("o_id", code.alias("bin"), minutes.cast("int").alias("minutes"), X.half_up("value").alias("value"))


def roundtrip_pivot(stats: DataFrame, sources: Sequence | None = None) -> DataFrame:
    """Mean round trips by source: (hash, star, mean), or with a list of sources (hash, Duration_mean_<o_id>...)."""
    pairs = stats.select(F.col("o_id").alias("star"), F.col("d_id").alias("hash"), "mean")
    return by_source(pairs, "mean") if sources is None else pivot_by_source(pairs, sources, "mean", "Duration_mean_")


def default_step_s(start: int, end: int) -> int:
    """Five minutes per started hour of the window, at most fifteen."""
    return min(900, math.ceil((end - start) / 3600) * 300)


def departure_times(start: int, end: int, step_s: int | None = None, end_inclusive: bool = True) -> list[int]:
    """Run times over a window; the first always runs (transit windows include the end)."""
    step = step_s or default_step_s(start, end)
    last = end if end_inclusive else end - 1
    return [start, *range(start + step, last + 1, step)] if step > 0 else [start]


def departure_grid(
    spark: SparkSession, start: int, end: int, step_s: int | None = None, end_inclusive: bool = True
) -> DataFrame:
    """(run, dep, label): one row per run, labelled with its time."""
    times = departure_times(start, end, step_s, end_inclusive)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "run int, dep int")
    return df.withColumn("label", X.seconds_to_time("dep"))


def one_way_limit(max_time: int) -> int:
    """Cap of each one-way run of a round trip: two thirds of the maximum."""
    return round(2 * max_time / 3)


# -- line statistics ------------------------------------------------------------------------


def route_frequency(trips: DataFrame, columns: Sequence[str] = ("Line_ID1", "Line_ID2", "Line_ID3")) -> DataFrame:
    """(route, count): how often each line (text before '_') appears in the journey table."""
    lines = trips.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("line"))
    route = X.text_before("line", "_", required=True)
    return count_values(lines.select(route.alias("route")).filter(F.col("route").isNotNull()))


def count_values(routes: DataFrame) -> DataFrame:
    """Counts by value, largest first, then by value."""
    counts = routes.groupBy("route").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "route")


def route_frequency_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same count over the non-empty lines of a text file."""
    text = F.regexp_replace(column, r"^\s+|\s+$", "")
    return count_values(lines.select(text.alias("route")).filter(F.col("route") != ""))


def label_routes(frequency: DataFrame, small: DataFrame, large: DataFrame) -> DataFrame:
    """Add ``route_short_name``: from the second list, else the code before '-' in the first.

    ``small``: (route_id, route_desc); ``large``: (route_id, route_short_name).
    """
    key = F.col("route").try_cast("long")
    code = small.select(
        F.col("route_id").try_cast("long").alias("__s"), X.text_before("route_desc", "-").alias("__code")
    )
    name = large.select(F.col("route_id").try_cast("long").alias("__l"), F.col("route_short_name").alias("__name"))
    joined = frequency.join(code, key == F.col("__s"), "left").join(name, key == F.col("__l"), "left")
    return joined.select(key.alias("route"), "count", F.coalesce("__name", "__code").alias("route_short_name"))


def id_difference(first: DataFrame, second: DataFrame, column: str = "route_id") -> DataFrame:
    """Sorted distinct ids of the first list that the second lacks; blanks and headers dropped."""

    def ids(df):
        text = F.trim(F.col(column).cast("string"))
        return df.select(text.alias("id")).filter((F.col("id") != "") & (F.col("id") != "route_id"))

    return ids(first).subtract(ids(second)).orderBy("id")
