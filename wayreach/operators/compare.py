"""Comparing two scenarios, and classes for mapping their values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.ordered import number_rows
from ..functions.scratch import Scratch

MISSING = "---"

# Parameters of which each scenario states one of a pair, and the row shown instead.
PAIRED_PARAMETERS = {
    "Start/Arrival": ("Arrive to destination", "Start from the origin"),
    "Earliest Start/Arrival": ("The earliest start", "The earliest arrival"),
}
MODE, MODE_TITLE, END_OF_PARAMETERS = "Mode", "Accessibility computation options", "[Processing]"

# Class limits in seconds for service areas and for their differences.
SERVICE_AREA_STEP_S = 300
DIFFERENCE_LIMITS_S = (-600, -300, -60, 60, 300, 600)


def _measures(a: Column, b: Column, rounded: bool) -> list[Column]:
    difference = a - b
    if rounded:
        difference = X.half_up(difference)
    zero = b == 0
    safe = F.nullif(b, F.lit(0))
    return [
        F.when(zero, 0.0).otherwise(a / safe).alias("Ratio"),
        difference.alias("Difference"),
        F.when(zero, 0.0).otherwise((a - b) / safe * 100).alias("Relative_difference"),
    ]


def compare_cumulative(first: DataFrame, second: DataFrame, value1: str | None = None, value2: str | None = None) -> DataFrame:
    """Join on ``star`` and compare a value (by default each table's last column)."""
    v1, v2 = value1 or first.columns[-1], value2 or second.columns[-1]
    both = first.select("star", F.col(v1).alias("value_1")).join(
        second.select("star", F.col(v2).alias("value_2")), "star"
    )
    return both.select("star", "value_1", "value_2", *_measures(F.col("value_1"), F.col("value_2"), True))


def compare_service_area(first: DataFrame, second: DataFrame, value: str = "duration_s") -> DataFrame:
    """Join on ``hash``; both stars are kept. Round trips compare ``Duration_ave``."""
    a = first.select("hash", F.col("star").alias("star_1"), F.col(value).alias("value_1"))
    b = second.select("hash", F.col("star").alias("star_2"), F.col(value).alias("value_2"))
    both = a.join(b, "hash")
    return both.select(
        "hash", "star_1", "star_2", "value_1", "value_2", *_measures(F.col("value_1"), F.col("value_2"), False)
    )


def only_in_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of the first table whose key the second lacks; rows without a key are dropped.

    Keys compare as numbers; text that is none becomes a null key and stays.
    """
    number = F.col(key).try_cast("double")
    rows = first.filter(F.col(key).isNotNull()).withColumn("__k", number)
    others = second.filter(F.col(key).isNotNull()).select(number.alias("__k")).distinct()
    return rows.join(others, rows["__k"].eqNullSafe(others["__k"]), "left_anti").drop("__k")


def only_in_second(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    return only_in_first(second, first, key)


def scenario_kinds(params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, from_mode, roundtrip, cumulative) read off runs' (Parameter, Value) tables."""

    def of(name):
        return F.coalesce(F.max(F.when(F.col("Parameter") == name, F.col("Value"))), F.lit(""))

    stated = params.groupBy(*keys).agg(F.upper(of("Accessibility")).alias("text"), F.lower(of(MODE)).alias("mode"))
    back = F.contains(F.col("text"), F.lit("ROUNDTRIP"))
    one_way = F.contains(F.col("text"), F.lit("FROM")) & ~F.contains(F.col("text"), F.lit("TO"))
    return stated.select(
        *keys,
        (back | one_way).alias("from_mode"),
        back.alias("roundtrip"),
        F.contains(F.col("mode"), F.lit("cumulative")).alias("cumulative"),
    )


def check_comparable(params1: DataFrame, params2: DataFrame) -> DataFrame:
    """One row (ok, message): both round trips or neither, both the same kind of measure."""
    both = params1.select("Parameter", "Value", F.lit(1).alias("run")).unionAll(
        params2.select("Parameter", "Value", F.lit(2).alias("run"))
    )
    pair = scenario_kinds(both, ["run"]).agg(
        *[F.count_distinct(c).alias(c) for c in ("roundtrip", "cumulative")]
    )
    message = (
        F.when(F.col("roundtrip") > 1, "Both scenarios must be round trips, or neither")
        .when(
            F.col("cumulative") > 1,
            "Both scenarios must be service areas, or both cumulative opportunities",
        )
        .otherwise("")
    )
    return pair.select((message == "").alias("ok"), message.alias("message"))


def compare_params(params1: DataFrame, params2: DataFrame) -> DataFrame:
    """(position, parameter, Result_1, Result_2), ordered as in the first run, then the second.

    Inputs are (position, Parameter, Value) with positions 1.. from a run log. The mode
    comes first; a parameter one side lacks shows '---'; paired parameters that differ
    share a row at the place of the first; everything from '[Processing]' on is cut.
    """

    def last_value(df, side):
        # a parameter stated twice keeps its first place and its last value
        rows = df.groupBy("Parameter").agg(
            F.min("position").alias(f"p{side}"), F.max(F.struct("position", "Value")).alias("m")
        )
        return rows.select(F.col("Parameter").alias("parameter"), f"p{side}", F.col("m.Value").alias(f"v{side}"))

    both = last_value(params1, 1).join(last_value(params2, 2), "parameter", "full_outer")
    both = both.withColumn("rank", F.struct(F.col("p1").isNull().alias("late"), F.coalesce("p1", "p2").alias("p")))
    shown, group = F.col("parameter"), F.lit(None).cast("string")
    for title, pair in PAIRED_PARAMETERS.items():
        group = F.when(F.col("parameter").isin(*pair), title).otherwise(group)
    both = both.withColumn("pair", group)
    filled = both.filter("pair IS NOT NULL").withColumns(
        {f"n{s}": F.when(F.coalesce(f"v{s}", F.lit("")) != "", F.col("parameter")) for s in (1, 2)}
    )
    # the arrival member of the first pair and the start member of the second take precedence
    preferred = [p[0] for p in PAIRED_PARAMETERS.values()]

    def stated(s, what):
        order = F.struct((~F.col("parameter").isin(*preferred)).alias("o"), F.col(what).alias("x"))
        return F.min(F.when(F.col(f"n{s}").isNotNull(), order))["x"]

    merged = filled.groupBy("pair").agg(
        *[stated(s, f"n{s}").alias(f"name{s}") for s in (1, 2)],
        *[stated(s, f"v{s}").alias(f"v{s}") for s in (1, 2)],
        F.min("rank").alias("rank"),
    )
    merged = merged.filter("name1 IS NOT NULL AND name2 IS NOT NULL AND name1 <> name2")
    plain = both.join(merged.select("pair"), "pair", "left_anti").select("rank", shown.alias("parameter"), "v1", "v2")
    rows = plain.unionByName(merged.select("rank", F.col("pair").alias("parameter"), "v1", "v2"))
    is_mode = F.col("parameter") == MODE
    rows = rows.withColumn("key", F.struct((~is_mode).alias("m"), "rank")).withColumn(
        "parameter", F.when(is_mode, MODE_TITLE).otherwise(F.col("parameter"))
    )
    # one small value: where the parameters end
    stop = rows.filter(F.col("parameter") == END_OF_PARAMETERS).agg(F.min("key")).first()[0]
    kept = rows
    if stop is not None:
        late, p = stop["rank"]
        place = F.struct(F.lit(late), F.lit(p).cast("long"))
        kept = rows.filter(F.col("key") < F.struct(F.lit(stop["m"]), place))
    numbered = number_rows(kept.select("key", "parameter", "v1", "v2"), [], [F.col("key")], "position")
    return numbered.select(
        "position",
        "parameter",
        F.coalesce("v1", F.lit(MISSING)).alias("Result_1"),
        F.coalesce("v2", F.lit(MISSING)).alias("Result_2"),
    )


# -- classes --------------------------------------------------------------------------------


def quantile_classes(values: DataFrame, column: str, classes: int = 7) -> DataFrame:
    """(class, low, high): limits are the sorted values at positions round(i * n / classes).

    Equal values are counted first, and the different ones dealt into ranges. The rows of
    each range tell which ranges hold a wanted position; only these are sorted. Nothing but
    the ranges' sizes is ever in one task, and no value leaves the cluster.
    """
    spark, scratch = values.sparkSession, Scratch(values.sparkSession, "quantiles")
    kept = values.select(F.col(column).try_cast("double").alias("v")).filter("v IS NOT NULL")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = kept.groupBy("v").agg(F.count("*").alias("n")).repartitionByRange(ranges, "v").withColumn("part", F.spark_partition_id())
    counted = scratch.keep(counted, "counted")
    sizes = counted.groupBy("part").agg(F.sum("n").alias("n"))
    order = Window.orderBy("part")
    sizes = sizes.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    wanted = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(classes))))
    # half to even, as positions are rounded in the classification
    place = F.least(F.col("total") - 1, F.bround(F.col("i") * (F.col("total") / classes)).cast("long")) + 1
    wanted = wanted.withColumn("at", place - F.col("upto") + F.col("n")).filter((F.col("at") > 0) & (F.col("at") <= F.col("n")))
    wanted = scratch.keep(wanted.select("part", "i", "at"), "wanted")
    held = counted.join(F.broadcast(wanted.select("part").distinct()), "part")  # as many rows as limits at most
    running = held.withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("v")))
    limits = running.join(F.broadcast(wanted), "part").filter((F.col("at") <= F.col("upto")) & (F.col("at") > F.col("upto") - F.col("n")))
    by_limit = Window.orderBy("i")
    out = limits.select((F.col("i") + 1).cast("int").alias("class"), F.col("v").alias("low"), F.lead("v").over(by_limit).alias("high"))
    return out.filter(F.col("class") <= classes)


def equal_classes(values: DataFrame, column: str, classes: int = 10) -> DataFrame:
    """(class, low, high): 0 to the rounded-up maximum in equal steps."""
    top = values.agg(X.round_up_magnitude(F.max(column)).alias("top"))
    steps = top.select("top", F.explode(F.sequence(F.lit(1), F.lit(classes))).alias("class"))
    step = F.col("top") / classes
    low = (F.col("class") - 1) * step
    return steps.select("class", low.alias("low"), F.least(low + step, F.col("top")).alias("high"))


def service_area_class(duration: Column | str, step_s: int = SERVICE_AREA_STEP_S) -> Column:
    """0-based class of five minutes; a value on a limit belongs to the class it ends."""
    d = X.col(duration)
    return F.greatest(F.ceil(d / step_s) - 1, F.lit(0)).cast("int")


def difference_class(difference: Column | str, limits: Sequence[int] = DIFFERENCE_LIMITS_S) -> Column:
    """0-based class between the limits; a value on a limit belongs to the class it ends."""
    d = X.col(difference)
    out = None
    for i, limit in enumerate(limits):
        out = F.when(d <= limit, i) if out is None else out.when(d <= limit, i)
    return F.when(d.isNotNull(), out.otherwise(len(limits)))


def max_values(values: DataFrame, column: str) -> DataFrame:
    """Largest value and largest absolute value; 0 if there are none."""
    c = F.col(column)
    return values.agg(
        F.coalesce(F.max(c), F.lit(0)).alias("max_value"), F.coalesce(F.max(F.abs(c)), F.lit(0)).alias("max_abs_value")
    )


def join_to_zones(zones: DataFrame, result: DataFrame, key: str) -> DataFrame:
    """Attach result values to every zone by ``aid``; zones without a result keep nulls."""
    return zones.join(result.withColumnRenamed(key, "aid"), "aid", "left")
