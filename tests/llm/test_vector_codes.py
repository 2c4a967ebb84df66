import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from wayreach.llm import hot, queries, vector_codes


def plain_codes(rows, scale=1024, parts=4, entries=256, rounds=4):
    """The rule on Python's own integers; rows: (id, vector, label)."""
    kept = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = len(kept[0][1]) // parts
    first = sorted((i, v) for i, v, _ in kept)[:entries]
    books = [[v[k * dim : (k + 1) * dim] for _, v in first] for k in range(parts)]

    def find(piece, book):
        return min((sum((a - b) ** 2 for a, b in zip(piece, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for k, book in enumerate(books):
            members = {}
            for _, v, _ in kept:
                piece = v[k * dim : (k + 1) * dim]
                members.setdefault(find(piece, book)[1], []).append(piece)
            books[k] = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else entry for e, entry in enumerate(book)]
    out, totals = [], {}
    for i, v, y in kept:
        found = [find(v[k * dim : (k + 1) * dim], book) for k, book in enumerate(books)]
        error = sum(d for d, _ in found)
        totals[y] = totals.get(y, 0) + error
        out.append((i, y, "".join(f"{e:02x}" for _, e in found), error))
    sha = hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()
    return sorted((i, code, error, totals[y], sha) for i, y, code, error in out)


def test_limbs_give_exact_products():
    rng = np.random.default_rng(1)
    for top in (3, 1 << 20, 1 << 27, 1 << 29):
        x, y = rng.integers(-top, top, (50, 16)), rng.integers(-top, top, (30, 16))
        assert np.array_equal(vector_codes.products(x, y), x @ y.T)
    x = np.full((2, 16), -(1 << 28))
    assert np.array_equal(vector_codes.products(x, x), x @ x.T)
    far = np.array([[(1 << 27) - 1] * 16, [-(1 << 27)] * 16])
    assert vector_codes.nearest(far[:1], far[1:])[1].tolist() == [16 * ((1 << 28) - 1) ** 2]


def frame_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(5)


def result(frame):
    coded, books = vector_codes.compress(frame)
    sha = vector_codes.digest(books)
    return sorted((r.id, r.code.hex(), r.error, r.label_error, sha) for r in coded.collect())


def test_like_the_rule(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 0.2, (40, 16))
    rows = [(int(i) * 3, [float(np.float32(x)) for x in centres[i % 40] + rng.normal(0, 0.02, 16)], int(i % 3) if i % 7 else None) for i in rng.permutation(600)]
    rows += [(-5, [0.25] * 16, 1), (-4, [0.25] * 16, 1), (9000, [0.0] * 16, None), (9001, [-0.0005] * 16, 2), (9002, [100.0, -90000.0] * 8, 2)]
    bad = [(1, None, 1), (2, [float("nan")] * 16, 1), (4, [float("inf")] + [0.0] * 15, 1), (5, [None] + [0.0] * 15, 1), (7, [], 1)]
    assert result(frame_of(spark, rows + bad)) == plain_codes(rows)


def test_few_rows_ties_and_repeated_rows(spark):
    rows = [(3, [1.0, 0.0, 0.0, 0.0], 1), (1, [0.0, 0.0, 0.0, 1.0], 1), (1, [0.0, 0.0, 0.0, 1.0], 1), (2, [0.5, 0.5, 0.5, 0.5], None)]
    assert result(frame_of(spark, rows, "double")) == plain_codes(rows)


def test_rows_that_cannot_be_coded(spark):
    rows = [(1, [0.5] * 6, 1), (2, [0.25] * 6, 1), (3, [0.5] * 5, 1), (4, [1e300] * 6, 2), (None, [0.5] * 6, 1)]
    coded, books = vector_codes.compress(frame_of(spark, rows, "double"))
    found = {r.id: (r.code and r.code.hex(), r.error, r.label_error) for r in coded.collect()}
    # six components are filled up to eight, so that the last part is all zeros
    assert found == {1: ("00000000", 0, 0), 2: ("01010100", 0, 0), 3: (None, None, 0), 4: (None, None, None), None: (None, None, 0)}
    assert [b.shape for b in books] == [(2, 2)] * 4


def test_empty_and_clashing_names(spark):
    assert result(frame_of(spark, []).limit(0)) == []
    frame = frame_of(spark, [(1, [1.0, 2.0, 3.0, 4.0], 5)]).withColumns({"v": F.lit(1), "id": F.lit("x"), "code": F.lit(0), "rows": F.lit(0)})
    assert [r[:4] for r in result(frame)] == [(1, "00000000", 0, 0)]


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(hot, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(i, None if i % 2 else i % 7) for i in range(300)], "a long, k long")
    totals = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("a").alias("s"))
    found = sorted((r.a, r.s) for r in hot.join_totals(rows, totals, "k", "n").collect())
    sums = {r.k: r.s for r in totals.collect()}
    assert found == [(i, sums[None if i % 2 else i % 7]) for i in range(300)]


def test_query_over_all_vectors(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    found = sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in queries.op11_vector_codes(spark, path).collect())
    assert found == plain_codes(rows)
