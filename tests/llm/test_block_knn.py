"""Nearest vectors against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from wayreach.llm import block_knn

SCHEMA = "vec_id long, embedding array<float>, id string, v string, block int"


def brute(rows, k):
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[i] = min(sound.get(i, v), v)
    out = []
    for q, x in sound.items():
        if q % 50:
            continue
        a = np.array(x, np.float32).astype(float)
        scores = []
        for c, y in sound.items():
            if c != q and len(y) == len(x):
                b = np.array(y, np.float32).astype(float)
                scores.append((-(a * b).sum() / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum())), c))
        out += [(q, n, c, round(-s, 12)) for n, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def search(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "a", "b", 1) for i, v in rows], SCHEMA)
    found = block_knn.nearest(df, F.col("vec_id") % 50 == 0, k)
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in found.collect())


def test_random_ties_and_unusable(spark, monkeypatch):
    monkeypatch.setattr(block_knn, "BLOCK_VALUES", 64 * 6)  # several blocks
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(40)]  # copies of one vector
    rows += [(2000, [2 * x for x in rows[50][1]]), (2050, None), (2100, []), (2150, [0.0] * 6), (2200, [float("nan")] * 6), (2250, [1.0, None] * 3)]
    rows += [(2300, [float("inf")] * 6), (None, rows[0][1]), (2350, [1.0, 2.0]), (2400, [2.0, 1.0]), (2450, [1e30] * 6), (2500, [1e-30] * 6), rows[7], (100, rows[3][1])]
    assert search(spark, rows) == brute(rows, 5)


def test_fewer_candidates_than_asked(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])]
    assert search(spark, rows) == brute(rows, 5) and len(search(spark, rows)) == 2
    assert search(spark, rows[:1]) == [] and search(spark, [(3, [1.0])]) == [] and search(spark, []) == []


def test_bounds_hold():
    rng = np.random.default_rng(2)
    v = np.concatenate((rng.normal(size=(200, 33)), rng.normal(size=(50, 33)) ** 9))
    small, scale, error = block_knn.rounded(v)
    unit = v / np.sqrt((v * v).sum(1, keepdims=True))
    about = (small @ small.T) * scale[:, None] * scale
    assert (np.abs(about - unit @ unit.T) <= error[:, None] + (1 + error[:, None]) * error + 1e-9).all()


def test_no_side_is_built_on_the_driver(spark, monkeypatch):
    """The queries come with a copy for every block, so a broadcast of them grows faster than the table."""
    monkeypatch.setattr(block_knn, "BLOCK_VALUES", 64 * 6)
    rows = [(i, [float(i % 7 + 1), float(i % 5)]) for i in range(300)]
    df = spark.createDataFrame([(i, v, "a", "b", 1) for i, v in rows], SCHEMA)
    found = block_knn.nearest(df, F.col("vec_id") % 50 == 0)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
