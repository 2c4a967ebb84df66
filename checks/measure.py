"""Measures over ready-made OD results, scenario comparison, map classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayreach.functions import expr as X
from wayreach.functions.scratch import Scratch
from wayreach.operators import compare as D
from wayreach.operators import measures as A

from .registry import check

MAX_TIME, STEP = 3400, 600
BOUNDS = A.bin_bounds(MAX_TIME, STEP)
BINS_SQL = "(VALUES " + ", ".join(f"({i}, {b})" for i, b in enumerate(BOUNDS, 1)) + ") n(bin, bound_s)"
# the part table gives the attributes of the destinations
PLACES_SQL = "SELECT 1000000 + p_partkey AS aid, p_size AS size, CAST(FLOOR(p_retailprice) AS BIGINT) AS price, p_brand AS brand FROM {part}"


def places(i):
    return i.part.select(
        (F.col("p_partkey") + 1000000).alias("aid"), F.col("p_size").alias("size"), F.floor("p_retailprice").alias("price"), F.col("p_brand").alias("brand")
    )


@check(
    "a1_time_bins",
    f"SELECT n.bin, n.bound_s, CONCAT(CAST(CAST(FLOOR(n.bound_s / 60) AS BIGINT) AS STRING), 'm') AS label, COUNT(*) AS pairs FROM {{pairs}} p JOIN {BINS_SQL} ON p.duration_s <= n.bound_s GROUP BY n.bin, n.bound_s",
)
def _(i):
    per_bin = i.pairs.select(A.first_bin(F.col("duration_s"), BOUNDS).alias("bin")).groupBy("bin").agg(F.count("bin").alias("pairs"))
    totals = A._cumulate(per_bin.withColumn("all", F.lit(1)), ["all"], len(BOUNDS), ["pairs"])
    return A.time_bins(i.spark, MAX_TIME, STEP).join(totals.drop("all"), "bin")


@check(
    "a2_service_area",
    "SELECT star, hash, duration_s FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY hash ORDER BY duration_s, star) AS rn FROM {pairs}) z WHERE rn = 1",
)
def _(i):
    return A.service_area(i.pairs)


CUMULATIVE_SQL = f"""
SELECT s.star, n.bin, n.bound_s, 1 + COUNT(p.hash) AS nbldg, CAST(COALESCE(MIN(o.size), 0) + COALESCE(SUM(a.size), 0) AS BIGINT) AS size,
       CAST(COALESCE(MIN(o.price), 0) + COALESCE(SUM(a.price), 0) AS BIGINT) AS price
FROM (SELECT DISTINCT star FROM {{pairs}}) s JOIN {BINS_SQL} ON TRUE
LEFT JOIN ({PLACES_SQL}) o ON o.aid = s.star
LEFT JOIN {{pairs}} p ON p.star = s.star AND p.hash <> s.star AND p.duration_s <= n.bound_s
LEFT JOIN ({PLACES_SQL}) a ON a.aid = p.hash GROUP BY s.star, n.bin, n.bound_s"""


@check("a3_cumulative_opportunities", CUMULATIVE_SQL)
def _(i):
    return A.cumulative_opportunities(i.pairs, STEP, MAX_TIME, places(i), ["size", "price"])


@check(
    "a3_cumulative_wide",
    "SELECT star, "
    + ", ".join(f'MAX(CASE WHEN bin = {k} THEN nbldg END) AS "{b // 60}m", MAX(CASE WHEN bin = {k} THEN price END) AS "{b // 60}m_price"' for k, b in enumerate(BOUNDS, 1))
    + f", MAX(CASE WHEN bin = {len(BOUNDS)} THEN price END) AS price_total FROM ({CUMULATIVE_SQL}) c GROUP BY star",
)
def _(i):
    long = A.cumulative_opportunities(i.pairs, STEP, MAX_TIME, places(i), ["price"])
    return A.cumulative_wide(long, "price", MAX_TIME, STEP)


@check(
    "a4_aggregate_fields",
    f"""SELECT star, bound_s, 'size' AS field, CAST(size AS DOUBLE) AS value FROM ({CUMULATIVE_SQL}) a
UNION ALL SELECT star, bound_s, 'price', CAST(price AS DOUBLE) FROM ({CUMULATIVE_SQL}) b""",
)
def _(i):
    return A.aggregate_fields(i.pairs, places(i), ["size", "brand", "price"], STEP, MAX_TIME, hexes=True)


@check("a5_by_source", "SELECT hash, star, MIN(duration_s) AS duration_s FROM {pairs} GROUP BY hash, star")
def _(i):
    return A.by_source(i.pairs)


# more than the ten that a report shows
WIDE_SOURCES = range(1000000, 1000025)


@check(
    "a5_pivot_by_source",
    "SELECT hash, " + ", ".join(f'MIN(CASE WHEN star = {k} THEN duration_s END) AS "Duration_{k}"' for k in WIDE_SOURCES)
    + f" FROM {{pairs}} WHERE star BETWEEN {WIDE_SOURCES[0]} AND {WIDE_SOURCES[-1]} GROUP BY hash",
)
def _(i):
    return A.pivot_by_source(i.pairs, WIDE_SOURCES)


@check(
    "a6_destination_filter",
    """SELECT star, hash, duration_s FROM {pairs} WHERE hash IN (SELECT aid FROM {buildings}) AND hash NOT IN (SELECT 1000000 + s_suppkey FROM {supplier})""",
)
def _(i):
    stops = i.supplier.select((F.col("s_suppkey") + 1000000).cast("string").alias("stop_id"))
    return A.destination_filter(i.pairs, i.buildings, stops)


ROUND_SQL = """
SELECT o_id, d_id, FLOOR((m_to + m_from) * 100 + 0.5) / 100 AS mean, FLOOR(SQRT(GREATEST(v_to + v_from, 0)) * 100 + 0.5) / 100 AS std,
       n_to * n_from AS count, n_to AS c_to, n_from AS c_from, best, labels_to, labels_from FROM (
  SELECT *, s_to / n_to AS m_to, s_from / n_from AS m_from, q_to / n_to - (s_to / n_to) * (s_to / n_to) AS v_to, q_from / n_from - (s_from / n_from) * (s_from / n_from) AS v_from FROM (
    SELECT o_id, d_id, COUNT(CASE WHEN direction = 'to' THEN 1 END) AS n_to, COUNT(CASE WHEN direction = 'from' THEN 1 END) AS n_from,
           CAST(SUM(CASE WHEN direction = 'to' THEN duration_s END) AS DOUBLE) AS s_to, CAST(SUM(CASE WHEN direction = 'from' THEN duration_s END) AS DOUBLE) AS s_from,
           CAST(SUM(CASE WHEN direction = 'to' THEN duration_s * duration_s END) AS DOUBLE) AS q_to, CAST(SUM(CASE WHEN direction = 'from' THEN duration_s * duration_s END) AS DOUBLE) AS q_from,
           MIN(CASE WHEN direction = 'to' THEN duration_s END) + MIN(CASE WHEN direction = 'from' THEN duration_s END) AS best,
           COUNT(DISTINCT CASE WHEN direction = 'to' THEN label END) AS labels_to, COUNT(DISTINCT CASE WHEN direction = 'from' THEN label END) AS labels_from
    FROM {runs} GROUP BY o_id, d_id) a WHERE n_to > 0 AND n_from > 0) b"""


@check("a7_roundtrip_pairs", ROUND_SQL)
def _(i):
    return A.roundtrip_pairs(i.runs)


# every combination of a run TO and a run FROM, formed outright
@check(
    "a7_roundtrip_combinations",
    """SELECT o_id, d_id, n, FLOOR(m * 10 + 0.5) / 10 AS mean FROM (
SELECT a.o_id, a.d_id, COUNT(*) AS n, AVG(a.duration_s + b.duration_s) AS m FROM {runs} a JOIN {runs} b ON b.o_id = a.o_id AND b.d_id = a.d_id
WHERE a.direction = 'to' AND b.direction = 'from' GROUP BY a.o_id, a.d_id) z""",
)
def _(i):
    stats = A.roundtrip_pairs(i.runs)
    return stats.select("o_id", "d_id", F.col("count").alias("n"), X.half_up(F.col("mean") + 1e-6, 1).alias("mean"))


@check("a8_roundtrip_filter", f"SELECT o_id, d_id, mean FROM ({ROUND_SQL}) z WHERE mean <= 2400")
def _(i):
    return A.roundtrip_filter(A.roundtrip_pairs(i.runs), i.runs, 2400).select("o_id", "d_id", "mean")


@check("a8_roundtrip_strict", f"SELECT o_id, d_id, mean FROM ({ROUND_SQL}) z WHERE mean <= 2400 AND labels_to = 4 AND labels_from = 4")
def _(i):
    return A.roundtrip_filter(A.roundtrip_pairs(i.runs), i.runs, 2400, strict=True).select("o_id", "d_id", "mean")


@check(
    "a9_roundtrip_best",
    f"SELECT o_id, d_id, best, mean FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY d_id ORDER BY best, o_id) AS rn FROM ({ROUND_SQL}) y) z WHERE rn = 1",
)
def _(i):
    return A.roundtrip_best(A.roundtrip_pairs(i.runs)).select("o_id", "d_id", "best", "mean")


@check(
    "a10_roundtrip_wide",
    f"SELECT s.o_id, s.d_id, mean AS Duration_ave, std AS Duration_std, count AS Count, c_to AS Count_to, c_from AS Count_from, "
    + ", ".join(f"{d.upper()}_T{k}" for d in ("to", "from") for k in range(4))
    + f" FROM ({ROUND_SQL}) s JOIN (SELECT o_id, d_id, "
    + ", ".join(f"MAX(CASE WHEN direction = '{d}' AND label = 'T{k}' THEN duration_s END) AS {d.upper()}_T{k}" for d in ("to", "from") for k in range(4))
    + " FROM {runs} GROUP BY o_id, d_id) w ON w.o_id = s.o_id AND w.d_id = s.d_id",
)
def _(i):
    return A.roundtrip_wide(A.roundtrip_pairs(i.runs), i.runs)


@check(
    "a11_roundtrip_bins",
    f"""
WITH b AS (SELECT o_id, LEAST(CAST(FLOOR(mean / 600) AS INTEGER), 4) AS bin, SUM(COALESCE(1 + p.size, 1)) AS w
           FROM ({ROUND_SQL}) r LEFT JOIN ({PLACES_SQL}) p ON p.aid = r.d_id AND p.aid - 1000000 IN (SELECT doc_id FROM {{labels}}) GROUP BY o_id, LEAST(CAST(FLOOR(mean / 600) AS INTEGER), 4)),
codes AS (SELECT DISTINCT bin FROM b UNION SELECT MAX(bin) + 1 FROM b HAVING (MAX(bin) + 1) * 600 // 60 < 3200 // 60)
SELECT o.o_id, c.bin, CAST(LEAST((c.bin + 1) * 600 // 60, 3200 // 60) AS INTEGER) AS minutes, CAST(COALESCE(SUM(b.w), 0) AS BIGINT) AS value
FROM (SELECT DISTINCT o_id FROM b) o JOIN codes c ON TRUE LEFT JOIN b ON b.o_id = o.o_id AND b.bin <= c.bin GROUP BY o.o_id, c.bin""",
)
def _(i):
    labelled = i.labels.select((F.col("doc_id") + 1000000).alias("aid"))
    weights = places(i).join(labelled, "aid", "left_semi").select("aid", (F.col("size") + 1).alias("weight"))
    return A.roundtrip_bins(A.roundtrip_pairs(i.runs), 600, 3200, weights)


@check(
    "a12_roundtrip_pivot",
    "SELECT d_id AS hash, " + ", ".join(f'MIN(CASE WHEN o_id = {k} THEN mean END) AS "Duration_mean_{k}"' for k in WIDE_SOURCES)
    + f" FROM ({ROUND_SQL}) r WHERE o_id BETWEEN {WIDE_SOURCES[0]} AND {WIDE_SOURCES[-1]} GROUP BY d_id",
)
def _(i):
    return A.roundtrip_pivot(A.roundtrip_pairs(i.runs), WIDE_SOURCES)


@check("a12_roundtrip_by_source", f"SELECT d_id AS hash, o_id AS star, mean FROM ({ROUND_SQL}) r")
def _(i):
    return A.roundtrip_pivot(A.roundtrip_pairs(i.runs))


@check(
    "a13_departure_grid",
    """SELECT n.run, n.dep, n.label, COUNT(t.trip_id) AS trips
FROM (VALUES (0, 28800, '08:00:00'), (1, 29400, '08:10:00'), (2, 30000, '08:20:00'), (3, 30600, '08:30:00'), (4, 31200, '08:40:00'), (5, 31800, '08:50:00'), (6, 32400, '09:00:00'),
             (7, 33000, '09:10:00'), (8, 33600, '09:20:00'), (9, 34200, '09:30:00'), (10, 34800, '09:40:00'), (11, 35400, '09:50:00'), (12, 36000, '10:00:00')) n(run, dep, label)
LEFT JOIN {trips} t ON t.dep0 >= n.dep AND t.dep0 < n.dep + 600 GROUP BY n.run, n.dep, n.label""",
)
def _(i):
    grid = A.departure_grid(i.spark, 28800, 36000)
    slot = F.floor((F.col("dep0") - 28800) / 600).cast("int")
    starts = i.trips.select(slot.alias("run")).groupBy("run").agg(F.count("*").alias("trips"))
    return grid.join(starts, "run", "left").fillna(0, ["trips"])


LINES_SQL = "SELECT CONCAT(route_id, '_', trip_id) AS line FROM {stop_times}"


@check(
    "a16_route_frequency",
    "SELECT route, COUNT(*) AS count FROM (SELECT route_id AS route FROM {trips} UNION ALL SELECT service_id FROM {trips}) z GROUP BY route",
)
def _(i):
    lines = i.trips.select(
        F.concat_ws("_", "route_id", "trip_id").alias("Line_ID1"), F.concat_ws("_", "service_id", "trip_id", "trip_id").alias("Line_ID2"), F.col("trip_id").alias("Line_ID3")
    )
    return A.route_frequency(lines)


@check("a17_route_frequency_lines", "SELECT route_id AS route, COUNT(*) AS count FROM {stop_times} GROUP BY route_id")
def _(i):
    path = f"{Scratch(i.spark, 'lines').root}/lines"
    text = F.when(F.col("stop_sequence") == 1, F.concat(F.lit("\n  "), F.col("route_id"), F.lit(" "))).otherwise(F.col("route_id"))
    i.stop_times.select(text.alias("value")).write.text(path)
    return A.route_frequency_lines(i.spark.read.text(path))


@check(
    "a18_label_routes",
    """SELECT r.route_key AS route, c.count, CASE WHEN r.route_key % 3 = 0 THEN r.route_short_name ELSE SPLIT_PART(r.route_desc, '-', 1) END AS route_short_name
FROM (SELECT route_id, COUNT(*) AS count FROM {stop_times} GROUP BY route_id) c JOIN {routes} r ON r.route_id = c.route_id""",
)
def _(i):
    frequency = A.count_values(i.stop_times.select(F.col("route_id").alias("route")))
    large = i.routes.withColumn("route_short_name", F.when(F.col("route_key") % 3 == 0, F.col("route_short_name")))
    return A.label_routes(frequency, i.routes, large)


@check(
    "a19_id_difference",
    "SELECT DISTINCT CAST(l_partkey AS STRING) AS id FROM {lineitem} WHERE l_partkey NOT IN (SELECT doc_id FROM {labels})",
)
def _(i):
    first = i.lineitem.select(F.concat(F.lit(" "), F.col("l_partkey").cast("string")).alias("route_id"))
    first = first.unionAll(i.lineitem.select(F.lit("route_id"))).unionAll(i.lineitem.select(F.lit("  ")))
    return A.id_difference(first, i.labels.select(F.col("doc_id").alias("route_id")))


@check(
    "a20_common_to_all_sources",
    "SELECT hash FROM (SELECT d_id AS hash, COUNT(DISTINCT o_id) AS n FROM {runs} GROUP BY d_id) z WHERE n = (SELECT COUNT(DISTINCT o_id) FROM {runs})",
)
def _(i):
    return A.common_to_all_sources(i.runs.select(F.col("o_id").alias("star"), F.col("d_id").alias("hash")))


# -- comparing -------------------------------------------------------------------------

TOTALS = "SELECT star, COUNT(*) AS nbldg, CAST(SUM(CASE WHEN duration_s <= 900 THEN 1 ELSE 0 END) AS BIGINT) AS nbldg_total FROM {%s} GROUP BY star"
FIRST_TOTALS, SECOND_TOTALS = TOTALS % "pairs", TOTALS % "pairs2"
COMPARED = "CASE WHEN b = 0 THEN 0 ELSE FLOOR(a / b * 1e6 + 0.5) / 1e6 END AS Ratio, a - b AS Difference, CASE WHEN b = 0 THEN 0 ELSE FLOOR((a - b) / b * 100 * 1e6 + 0.5) / 1e6 END AS Relative_difference"


def totals(pairs):
    near_by = F.sum(F.when(F.col("duration_s") <= 900, 1).otherwise(0)).alias("nbldg_total")
    return pairs.groupBy("star").agg(F.count("*").alias("nbldg"), near_by)


def rounded(df):
    return df.withColumn("Ratio", X.half_up("Ratio", 6)).withColumn("Relative_difference", X.half_up("Relative_difference", 6))


@check(
    "d1_compare_cumulative",
    f"SELECT star, a AS value_1, b AS value_2, {COMPARED} FROM (SELECT f.star, CAST(f.nbldg_total AS DOUBLE) AS a, CAST(s.nbldg_total AS DOUBLE) AS b FROM ({FIRST_TOTALS}) f JOIN ({SECOND_TOTALS}) s ON s.star = f.star) z",
)
def _(i):
    both = rounded(D.compare_cumulative(totals(i.pairs), totals(i.pairs2)))
    return both.withColumns({c: F.col(c).cast("double") for c in ("value_1", "value_2", "Difference")})


AREA = "SELECT star, hash, duration_s FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY hash ORDER BY duration_s, star) AS rn FROM {%s}) z WHERE rn = 1"


@check(
    "d2_compare_service_area",
    f"SELECT hash, star_1, star_2, a AS value_1, b AS value_2, {COMPARED} FROM (SELECT f.hash, f.star AS star_1, s.star AS star_2, f.duration_s AS a, s.duration_s AS b FROM ({AREA % 'pairs'}) f JOIN ({AREA % 'pairs2'}) s ON s.hash = f.hash) z",
)
def _(i):
    return rounded(D.compare_service_area(A.service_area(i.pairs), A.service_area(i.pairs2)))


@check("d3_only_in_first", f"SELECT star, nbldg FROM ({FIRST_TOTALS}) f WHERE star NOT IN (SELECT star FROM ({SECOND_TOTALS}) s)")
def _(i):
    return D.only_in_first(totals(i.pairs), totals(i.pairs2), "star").select("star", "nbldg")


@check("d3_only_in_second", f"SELECT star, nbldg FROM ({SECOND_TOTALS}) s WHERE star NOT IN (SELECT star FROM ({FIRST_TOTALS}) f)")
def _(i):
    return D.only_in_second(totals(i.pairs), totals(i.pairs2), "star").select("star", "nbldg")


@check(
    "d4_scenario_kind",
    """SELECT o_orderkey AS run_id, o_orderkey % 3 <> 1 AS from_mode, o_orderkey % 3 = 2 AS roundtrip, o_orderkey % 2 = 1 AS cumulative FROM {orders}""",
)
def _(i):
    from wayreach.sources import tables

    return D.scenario_kinds(tables.run_log(i.logs, "text", ["run_id"]), ["run_id"])


@check("d4_check_comparable", "SELECT COUNT(*) > 0 AS ok, '' AS message FROM {customer} UNION ALL SELECT COUNT(*) < 0, 'Both scenarios must be round trips, or neither' FROM {customer}")
def _(i):
    """The two parameter tables agree; with a ROUNDTRIP row added to one they do not."""
    one, two = i.params1.select("Parameter", "Value"), i.params2.select("Parameter", "Value")
    row = i.region.agg(F.max(F.lit("Accessibility")).alias("Parameter"), F.max(F.lit("ROUNDTRIP")).alias("Value"))
    return D.check_comparable(one, two).unionAll(D.check_comparable(one.unionAll(row), two))


PARAMS_SQL = """
WITH j AS (SELECT COALESCE(a.Parameter, b.Parameter) AS p, a.Value AS v1, b.Value AS v2, a.position IS NULL AS late, COALESCE(a.position, b.position) AS pos
           FROM {params1} a FULL JOIN {params2} b ON a.Parameter = b.Parameter),
k AS (SELECT CASE WHEN p IN ('Arrive to destination', 'Start from the origin') THEN 'Start/Arrival' WHEN p = 'Mode' THEN 'Accessibility computation options' ELSE p END AS parameter,
             MAX(v1) AS v1, MAX(v2) AS v2, MIN(CASE WHEN p = 'Mode' THEN -1 WHEN late THEN 1000000000 + pos ELSE pos END) AS o FROM j GROUP BY 1)
SELECT ROW_NUMBER() OVER (ORDER BY o) AS position, parameter, COALESCE(v1, '---') AS Result_1, COALESCE(v2, '---') AS Result_2 FROM k"""


@check("d5_compare_params", PARAMS_SQL)
def _(i):
    return D.compare_params(i.params1, i.params2)


# -- classes ----------------------------------------------------------------------------


@check(
    "v1_quantile_classes",
    """WITH s AS (SELECT CAST(duration_s AS DOUBLE) AS v, ROW_NUMBER() OVER (ORDER BY duration_s) AS rn, COUNT(*) OVER () AS n FROM {pairs})
SELECT CAST(c.i AS INTEGER) AS class, a.v AS low, b.v AS high FROM (SELECT UNNEST(GENERATE_SERIES(1, 7)) AS i) c
JOIN s a ON a.rn = LEAST(a.n - 1, CAST(ROUND_EVEN((c.i - 1) * (a.n / 7), 0) AS BIGINT)) + 1
JOIN s b ON b.rn = LEAST(b.n - 1, CAST(ROUND_EVEN(c.i * (b.n / 7), 0) AS BIGINT)) + 1""",
)
def _(i):
    return D.quantile_classes(i.pairs, "duration_s", 7)


@check(
    "v2_equal_classes",
    """SELECT CAST(i AS INTEGER) AS class, (i - 1) * (top / 10) AS low, LEAST((i - 1) * (top / 10) + top / 10, top) AS high FROM (
  SELECT UNNEST(GENERATE_SERIES(1, 10)) AS i, CEIL(m / POW(10, FLOOR(LOG10(m)))) * POW(10, FLOOR(LOG10(m))) AS top FROM (SELECT CAST(MAX(duration_s) AS DOUBLE) AS m FROM {pairs}) a) b""",
)
def _(i):
    return D.equal_classes(i.pairs, "duration_s", 10)


@check(
    "v3_fixed_classes",
    """SELECT a.hash, CAST(GREATEST(CEIL(a.duration_s / 300) - 1, 0) AS INTEGER) AS area_class,
       CASE WHEN d <= -600 THEN 0 WHEN d <= -300 THEN 1 WHEN d <= -60 THEN 2 WHEN d <= 60 THEN 3 WHEN d <= 300 THEN 4 WHEN d <= 600 THEN 5 ELSE 6 END AS difference_class
FROM (SELECT f.hash, f.duration_s, f.duration_s - s.duration_s AS d FROM ("""
    + AREA % "pairs" + ") f JOIN (" + AREA % "pairs2" + ") s ON s.hash = f.hash) a",
)
def _(i):
    both = D.compare_service_area(A.service_area(i.pairs), A.service_area(i.pairs2))
    return both.select("hash", D.service_area_class("value_1").alias("area_class"), D.difference_class("Difference").alias("difference_class"))


@check("v4_max_values", "SELECT MAX(s_acctbal - 3000) AS max_value, MAX(ABS(s_acctbal - 3000)) AS max_abs_value FROM {supplier}")
def _(i):
    return D.max_values(i.supplier.select((F.col("s_acctbal") - 3000).alias("v")), "v")


@check(
    "v5_join_to_zones",
    f"SELECT p.aid, p.brand, a.star, a.duration_s FROM ({PLACES_SQL}) p LEFT JOIN ({AREA % 'pairs2'}) a ON a.hash = p.aid",
)
def _(i):
    return D.join_to_zones(places(i).select("aid", "brand"), A.service_area(i.pairs2), "hash")
