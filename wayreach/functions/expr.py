"""Scalar column expressions: time text, ids, distances, projections, rings.

Everything here returns a ``Column`` built from Spark's own functions, so it
stays inside whole-stage code generation and can be pushed around by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sphere and ellipsoid used for distances and projections.
EARTH_RADIUS_M = 6371008.8
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563

# Metres per degree in the two unit conversions below.
METRES_PER_DEGREE_LON = 111320.0
METRES_PER_DEGREE = 111132.92

# Labels under which a run log states its start or arrival time.
LOG_START_LABELS = ("Start at (hh:mm:ss)", "Earliest start time")
LOG_END_LABELS = ("Arrive before (hh:mm:ss)", "Earliest arrival time")

NUMBER_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c: Column | str, digits: int = 0) -> Column:
    """Round half up by floor arithmetic, the same in every SQL engine."""
    scale = float(10**digits)
    if digits == 0:
        return F.floor(col(c) + F.lit(0.5)).cast("long")
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


# -- time ------------------------------------------------------------------


def time_to_seconds(c: Column | str) -> Column:
    """``H:MM:SS`` text to seconds after midnight; hours may pass 24; bad text is null."""
    parts = F.split(F.trim(col(c)), ":")
    h, m, s = (F.get(parts, F.lit(i)).try_cast("int") for i in range(3))
    return h * 3600 + m * 60 + s


def seconds_to_time(c: Column | str) -> Column:
    """Seconds after midnight to ``HH:MM:SS``; null stays null."""
    t = col(c).cast("long")
    text = F.format_string(
        "%02d:%02d:%02d",
        F.floor(t / 3600),
        F.floor(F.pmod(t, F.lit(3600)) / 60),
        F.pmod(t, F.lit(60)),
    )
    return F.when(t.isNotNull(), text)


def normalise_time(c: Column | str) -> Column:
    """Pad the hour of a time text to two digits; null and malformed text become null."""
    return seconds_to_time(time_to_seconds(c))


# -- ids and text ------------------------------------------------------------


def normalize_id(c: Column | str) -> Column:
    """Number-like text to integer text (``'12.0'`` -> ``'12'``), anything else trimmed."""
    text = col(c).cast("string")
    whole = F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double")).try_cast("long")
    return F.coalesce(whole.cast("string"), F.trim(text))


def strip_point_zero(c: Column | str) -> Column:
    """Remove every ``.0`` and surrounding blanks from an id column."""
    return F.trim(F.replace(col(c), F.lit(".0"), F.lit("")))


def text_before(c: Column | str, mark: str, required: bool = False) -> Column:
    """Text before the first ``mark``; without the mark the whole text, or null if required."""
    c = col(c)
    head = F.substring_index(c, mark, 1)
    return F.when(F.contains(c, F.lit(mark)) & (head != ""), head) if required else head


def last_logged_time(c: Column | str) -> tuple[Column, Column]:
    """(time text, 'start'|'end') of the last time statement in a run log."""

    def quoted(labels):
        return "|".join(label.replace("(", r"\(").replace(")", r"\)") for label in labels)

    pattern = rf"({quoted(LOG_START_LABELS + LOG_END_LABELS)}):\s+([0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}})"
    c = col(c)
    label = F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(-1))
    time = F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(2)), F.lit(-1))
    kind = F.when(label.isin(*LOG_START_LABELS), "start").when(label.isin(*LOG_END_LABELS), "end")
    return time, kind


# -- distances and projections ------------------------------------------------


def metres_to_degrees(metres: Column | str, lat: Column | str) -> Column:
    return F.abs(col(metres) / (F.lit(METRES_PER_DEGREE_LON) * F.cos(F.radians(col(lat)))))


def degrees_to_metres(degrees: Column | str, lat: Column | str) -> Column:
    return col(degrees) * F.lit(METRES_PER_DEGREE) * F.cos(F.radians(col(lat)))


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance on the mean sphere."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp, dl = p2 - p1, F.radians(col(lon2)) - F.radians(col(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def let(value: Column, body) -> Column:
    """Bind a value once and use it many times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def geodesic_m(lon1, lat1, lon2, lat2, rounds: int = 12) -> Column:
    """Ellipsoidal (WGS84) distance by Vincenty's published inverse formula.

    The longitude iteration runs as an ``aggregate`` over a constant sequence, and
    shared terms are bound once, so the expression stays small.
    """
    a, f = WGS84_A, WGS84_F
    b = a * (1 - f)

    def named(**fields):
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    def reduced(lat):
        return F.atan(F.lit(1 - f) * F.tan(F.radians(col(lat))))

    def angles(p, lam):
        """Terms that depend on the longitude difference on the sphere."""
        sin_s = F.sqrt(
            F.pow(p["cu2"] * F.sin(lam), 2)
            + F.pow(p["cu1"] * p["su2"] - p["su1"] * p["cu2"] * F.cos(lam), 2)
        )
        cos_s = p["su1"] * p["su2"] + p["cu1"] * p["cu2"] * F.cos(lam)
        first = let(named(ss=sin_s, cs=cos_s, sl=F.sin(lam)), lambda v: named(
            ss=v["ss"], cs=v["cs"], sigma=F.atan2(v["ss"], v["cs"]),
            sa=F.when(v["ss"] == 0, 0.0).otherwise(p["cu1"] * p["cu2"] * v["sl"] / F.nullif(v["ss"], F.lit(0.0))),
        ))
        second = let(first, lambda v: named(
            ss=v["ss"], cs=v["cs"], sigma=v["sigma"], sa=v["sa"], c2=F.lit(1.0) - v["sa"] * v["sa"],
        ))
        return let(second, lambda v: named(
            ss=v["ss"], cs=v["cs"], sigma=v["sigma"], sa=v["sa"], c2=v["c2"],
            cm=F.when(v["c2"] == 0, 0.0).otherwise(v["cs"] - 2 * p["su1"] * p["su2"] / F.nullif(v["c2"], F.lit(0.0))),
        ))

    def next_lam(p, lam):
        def bend(v):
            c = F.lit(f / 16) * v["c2"] * (4 + f * (4 - 3 * v["c2"]))
            return let(c, lambda c: p["span"] + (1 - c) * f * v["sa"] * (
                v["sigma"] + c * v["ss"] * (v["cm"] + c * v["cs"] * (2 * v["cm"] * v["cm"] - 1))
            ))

        return let(angles(p, lam), bend)

    def length(v):
        series = let(v["c2"] * F.lit((a * a - b * b) / (b * b)), lambda u: named(
            a=1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))),
            b=u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))),
        ))

        def finish(k):
            inner = v["cs"] * (2 * v["cm"] * v["cm"] - 1) - k["b"] / 6 * v["cm"] * (
                4 * v["ss"] * v["ss"] - 3
            ) * (4 * v["cm"] * v["cm"] - 3)
            return F.lit(b) * k["a"] * (v["sigma"] - k["b"] * v["ss"] * (v["cm"] + k["b"] / 4 * inner))

        return let(series, finish)

    def solve(p):
        steps = F.sequence(F.lit(1), F.lit(rounds))
        lam = F.aggregate(steps, p["span"], lambda lam, _: next_lam(p, lam))
        return let(let(lam, lambda lam: angles(p, lam)), length)

    terms = let(named(u1=reduced(lat1), u2=reduced(lat2)), lambda u: named(
        su1=F.sin(u["u1"]), cu1=F.cos(u["u1"]), su2=F.sin(u["u2"]), cu2=F.cos(u["u2"]),
        span=F.radians(col(lon2)) - F.radians(col(lon1)),
    ))
    return let(terms, solve)


def project_local(lon, lat, lon0: float, lat0: float) -> tuple[Column, Column]:
    """WGS84 to a local metric plane around (lon0, lat0): equirectangular."""
    scale = F.lit(EARTH_RADIUS_M)
    x = scale * F.cos(F.radians(F.lit(lat0))) * F.radians(col(lon) - lon0)
    y = scale * F.radians(col(lat) - lat0)
    return x, y


def project_tm(
    lon,
    lat,
    lon0: float,
    k0: float = 0.9996,
    false_east: float = 500000.0,
    false_north: float = 0.0,
) -> tuple[Column, Column]:
    """WGS84 to transverse Mercator (the UTM family) by the usual power series."""
    e2 = WGS84_F * (2 - WGS84_F)
    ep2 = e2 / (1 - e2)
    phi = F.radians(col(lat))
    n = WGS84_A / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t = F.pow(F.tan(phi), 2)
    c = ep2 * F.pow(F.cos(phi), 2)
    a = F.cos(phi) * F.radians(col(lon) - lon0)
    m = WGS84_A * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    x = false_east + k0 * n * (
        a
        + (1 - t + c) * F.pow(a, 3) / 6
        + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120
    )
    y = false_north + k0 * (
        m
        + n
        * F.tan(phi)
        * (
            a * a / 2
            + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24
            + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720
        )
    )
    return x, y


def point_distance(ax, ay, bx, by) -> Column:
    dx, dy = col(ax) - col(bx), col(ay) - col(by)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def closest_on_segment(px, py, ax, ay, bx, by) -> tuple[Column, Column, Column]:
    """(x, y, distance) of the point of segment a-b that lies nearest to p."""
    px, py, ax, ay, bx, by = (col(c).cast("double") for c in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    sq = dx * dx + dy * dy
    along = F.when(sq == 0, 0.0).otherwise(((px - ax) * dx + (py - ay) * dy) / F.nullif(sq, F.lit(0.0)))
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    qx, qy = ax + along * dx, ay + along * dy
    return qx, qy, F.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy))


# -- rings (array<struct<x,y>>) -------------------------------------------------


def _ring_sums(ring: Column) -> Column:
    """Twice the signed area and the two moment sums of a ring, open or closed."""
    n = F.size(ring)

    def add(acc, i):
        p = F.element_at(ring, i)
        q = F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))
        cross = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["mx"] + (p["x"] + q["x"]) * cross).alias("mx"),
            (acc["my"] + (p["y"] + q["y"]) * cross).alias("my"),
        )

    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("a", "mx", "my")])
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), zero, add))


def ring_area(ring: Column | str) -> Column:
    return F.abs(_ring_sums(col(ring))["a"]) / 2


def ring_centroid(ring: Column | str) -> Column:
    """struct<x,y>: area centroid; for rings without area the mean of the vertices."""
    ring = col(ring)
    sums = _ring_sums(ring)
    n = F.size(ring)

    def mean(axis):
        return F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[axis]) / n

    flat = sums["a"] == 0
    return F.when(
        n > 0,
        F.struct(
            F.when(flat, mean("x")).otherwise(sums["mx"] / (3 * F.nullif(sums["a"], F.lit(0.0)))).alias("x"),
            F.when(flat, mean("y")).otherwise(sums["my"] / (3 * F.nullif(sums["a"], F.lit(0.0)))).alias("y"),
        ),
    )


def round_up_magnitude(c: Column | str) -> Column:
    """Round up to one leading digit (4321 -> 5000); zero and below give 0."""
    x = col(c).cast("double")
    order = F.pow(F.lit(10.0), F.floor(F.log10(x)).cast("double"))
    return F.when(x <= 0, 0.0).otherwise(F.ceil(x / order).cast("double") * order)
