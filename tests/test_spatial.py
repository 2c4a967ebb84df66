"""Spatial operators against brute force on small random layouts."""

import math
import random

from pyspark.sql import functions as F

from wayreach.functions import expr as X
from wayreach.functions import hexes as H
from wayreach.operators import near, roads, zones
from wayreach.operators.relax import shortest


def on_segment(p, s):
    (px, py), (ax, ay, bx, by) = p, s
    dx, dy = bx - ax, by - ay
    t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(px - ax - t * dx, py - ay - t * dy)


def test_nearest_segment(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(-500, 500), rng.uniform(-500, 500)) for i in range(120)]
    points += [(1000 + i, 7.0, 7.0) for i in range(60)]  # one place holds a third of all points
    segs = []
    for i in range(40):
        ax, ay = rng.uniform(-500, 500), rng.uniform(-500, 500)
        segs.append((i, 0, ax, ay, ax + rng.uniform(-300, 300), ay + rng.choice([0.0, rng.uniform(-300, 300)])))
    df = spark.createDataFrame(points, "id int, x double, y double")
    sdf = spark.createDataFrame(segs, "link_id int, seg int, ax double, ay double, bx double, by double")
    got = {r["id"]: (r["link_id"], r["d"]) for r in near.nearest_segment(df, sdf, ["link_id", "seg"], 200.0, 13.0).collect()}
    for i, x, y in points:
        d, link = min((on_segment((x, y), s[2:]), s[0]) for s in segs)
        if d <= 200:
            assert abs(got[i][1] - d) < 1e-6
        else:
            assert i not in got


def test_nearest_point_without_limit_and_within_distance(spark):
    rng = random.Random(2)
    a = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(50)] + [(99, 5000.0, 5000.0)]
    b = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(40)]
    adf = spark.createDataFrame(a, "id int, x double, y double")
    bdf = spark.createDataFrame(b, "aid int, x double, y double")
    got = {r["id"]: r["aid"] for r in near.nearest_point(adf, bdf, "aid", None, 3.0).collect()}
    for i, x, y in a:
        assert got[i] == min((math.hypot(x - u, y - v), k) for k, u, v in b)[1]
    pairs = {(r["id"], r["aid"]) for r in near.within_distance(adf, bdf, 17.0).collect()}
    assert pairs == {(i, k) for i, x, y in a for k, u, v in b if math.hypot(x - u, y - v) <= 17.0}


def test_dense_places_get_smaller_cells(spark):
    df = spark.range(4000).select((F.col("id") % 100).cast("double").alias("x"), (F.col("id") / 100).alias("y"))

    def cells(size):
        return df.select(F.struct(near.cell("x", size), near.cell("y", size)).alias("c"))

    assert near.fitting_cell(cells, 200.0, 500) < 200.0
    assert near.fitting_cell(cells, 200.0, 10**6) == 200.0


def centre(q, r, s):
    return 1.5 * s * q, math.sqrt(3) * s * (r + q / 2)


def in_hex(x, y, cx, cy, s):
    h = math.sqrt(3) * s / 2
    return all(abs((x - cx) * math.cos(a) + (y - cy) * math.sin(a)) <= h for a in (math.pi / 2, math.pi / 6, 5 * math.pi / 6))


def test_hex_ids_contain_their_points(spark):
    rng = random.Random(3)
    pts = [(rng.uniform(-900, 900), rng.uniform(-900, 900)) for _ in range(400)]
    q, r = H.hex_of("x", "y", 70.0)
    for row in spark.createDataFrame(pts, "x double, y double").select("x", "y", q.alias("q"), r.alias("r")).collect():
        assert in_hex(row["x"], row["y"], *centre(row["q"], row["r"], 70.0001), 70.0001)


def test_hex_filter_finds_edges_and_insides(spark):
    s = 30.0
    big = [(-200.0, -150.0), (220.0, -170.0), (180.0, 190.0), (-210.0, 140.0)]
    small = [(500.0, 500.0), (503.0, 500.0), (503.0, 504.0)]
    rows = [([{"x": x, "y": y} for x, y in ring],) for ring in (big, small)]
    df = spark.createDataFrame(rows, "ring array<struct<x:double,y:double>>")
    got = {(r["q"], r["r"]) for r in zones.hex_filter(df, s).collect()}

    def inside(x, y, ring):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                odd = not odd
        return odd

    # a dense cloud of points of the polygons must fall into found hexagons only
    want = set()
    for ring, step in ((big, 3.0), (small, 0.25)):
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        x = min(xs)
        while x <= max(xs):
            y = min(ys)
            while y <= max(ys):
                if inside(x, y, ring):
                    for q in range(-15, 30):
                        for r in range(-20, 20):
                            cx, cy = centre(q, r, s)
                            if abs(cx - x) <= s and abs(cy - y) <= s and in_hex(x, y, cx, cy, s):
                                want.add((q, r))
                y += step
            x += step
    assert want <= got
    # anything else found only touches a border, so it lies next to a wanted one
    assert all(any((q + i, r + j) in want for i, j in H.HEX_AND_NEIGHBOURS) for q, r in got)
    assert len(got - want) <= 12


def test_hex_far_from_every_building_still_finds_the_nearest(spark):
    b = spark.createDataFrame([(5, 0.0, 0.0), (3, 1000.0, 0.0)], "aid int, x double, y double")
    hexes = spark.createDataFrame([(0, 0, 0.0, 0.0), (10, 0, 450.0, 260.0), (11, 0, 600.0, 0.0)], "q long, r long, cx double, cy double")
    got = {(r["q"], r["r"]): r["aid"] for r in zones.hex_nearest_building(hexes, b, 30.0).collect()}
    assert got == {(0, 0): 5, (10, 0): 5, (11, 0): 3}


def line(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def test_snap_joins_chains_of_ends(spark):
    links = [
        (1, line((0, 0), (10, 0))),
        (2, line((10.4, 0), (20, 0))),
        (3, line((10.8, 0), (10.8, 9))),  # within 0.5 of link 2 only: joined through it
        (4, line((30, 0), (40, 0))),
    ]
    df = spark.createDataFrame(links, "link_id int, geom array<struct<x:double,y:double>>")
    got = {r["link_id"]: (r["geom"][0]["x"], r["geom"][-1]["x"]) for r in roads.snap_endpoints(df, 0.5).collect()}
    assert got == {1: (0, 10), 2: (10, 20), 3: (10, 10.8), 4: (30, 40)}


def test_connected_components(spark):
    from wayreach.functions.scratch import Scratch

    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(40)] + [(rng.randrange(300, 330), rng.randrange(300, 330)) for _ in range(20)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "u int, v int")
    got = {r["node"]: r["root"] for r in roads.connected_components(df, Scratch(spark, "cc")).collect()}
    loners = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: find(n) for n in parent if n not in loners}


def test_break_crossings(spark):
    links = [
        (1, line((0, 0), (10, 0), (20, 0))),
        (2, line((5, -5), (5, 5))),  # crosses link 1 in its first segment
        (3, line((10, 0), (10, 7))),  # starts at link 1's inner vertex
        (4, line((100, 100), (110, 100))),
        (5, line((105, 100), (120, 100))),  # lies on link 4 from its middle on
    ]
    df = spark.createDataFrame(links, "link_id int, geom array<struct<x:double,y:double>>")
    got = {}
    for r in sorted(roads.break_crossings(df, 6.0).collect(), key=lambda r: (r["link_id"], r["seq"])):
        got.setdefault(r["link_id"], []).append((r["piece"], r["ax"], r["ay"], r["bx"], r["by"]))
    assert got[1] == [(1, 0, 0, 5, 0), (2, 5, 0, 10, 0), (3, 10, 0, 20, 0)]
    assert got[2] == [(1, 5, -5, 5, 0), (2, 5, 0, 5, 5)]
    assert got[3] == [(1, 10, 0, 10, 7)]
    assert got[4] == [(1, 100, 100, 105, 100), (2, 105, 100, 110, 100)]
    assert got[5] == [(1, 105, 100, 110, 100), (2, 110, 100, 120, 100)]


def test_shortest_against_dijkstra(spark):
    import heapq

    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60), rng.uniform(0, 9)) for _ in range(220)]
    edges += [(0, k, 5.0) for k in range(60)]  # a hub
    seeds = [(s, s, 0.0, 14.0) for s in (0, 3, 17, 41)]
    got = {
        (r["src"], r["node"]): r["d"]
        for r in shortest(
            spark.createDataFrame(seeds, "src int, node int, d double, budget double"),
            spark.createDataFrame(edges, "u int, v int, w double"),
            hops=3,
        ).collect()
    }
    for s, *_ in seeds:
        dist, heap = {}, [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in dist:
                continue
            dist[u] = d
            for a, b, w in edges:
                if a == u and b not in dist and d + w <= 14.0:
                    heapq.heappush(heap, (d + w, b))
        mine = {n: d for (src, n), d in got.items() if src == s}
        assert mine.keys() == dist.keys()
        assert all(abs(mine[n] - dist[n]) < 1e-9 for n in dist)


def test_ring_and_distances(spark):
    ring = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (6.0, 0.0), (6.0, 3.0), (0.0, 3.0))]
    df = spark.createDataFrame([(ring, ring[:1] * 2)], "a array<struct<x:double,y:double>>, p array<struct<x:double,y:double>>")
    r = df.select(
        X.ring_area("a").alias("area"), X.ring_centroid("a").alias("c"), X.ring_centroid("p").alias("pc"),
        # one degree of latitude at the equator and an arc along it, on the WGS84 ellipsoid
        X.geodesic_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("north"),
        X.geodesic_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("east"),
        X.geodesic_m(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("none"),
        X.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("sphere"),
    ).first()
    assert (r["area"], r["c"]["x"], r["c"]["y"], r["pc"]["x"]) == (18.0, 3.0, 1.5, 0.0)
    assert abs(r["north"] - 110574.389) < 0.01 and abs(r["east"] - 111319.491) < 0.01 and r["none"] == 0
    assert abs(r["sphere"] - 111195.08) < 0.1


def test_nearest_ends_without_targets_and_without_coordinates(spark):
    schema = "id int, x double, y double"
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 1e6, 1e6)], schema)
    none = spark.createDataFrame([], "aid long, x double, y double")
    found = near.nearest_point(points, none, "aid", None)
    assert found.count() == 0 and {"id", "aid", "d"} <= set(found.columns)
    targets = spark.createDataFrame([(7, 3.0, 4.0), (8, None, None)], "aid long, x double, y double")
    got = {r["id"]: (r["aid"], round(r["d"], 3)) for r in near.nearest_point(points, targets, "aid", None, 0.5).collect()}
    assert got == {1: (7, 5.0), 3: (7, round(math.hypot(1e6 - 3, 1e6 - 4), 3))}
    assert near.nearest_point(points.limit(0), targets, "aid", None).count() == 0
    hexes = spark.createDataFrame([(0, 0, 0.0, 0.0)], "q long, r long, cx double, cy double")
    assert zones.hex_nearest_building(hexes, none, 10.0).count() == 0
