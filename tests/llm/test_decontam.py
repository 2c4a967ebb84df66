"""Leaks of benchmark items against a plain alignment of every pair."""

import random
import re

import numpy as np

from wayreach.llm import decontam

DOCS, ITEMS = "doc_id long, text string, score double, item_id string", "item_id long, text string, extra string"


def brute_score(item, doc):
    last, best = [0] * (len(doc) + 1), 0
    for a in item:
        now = [0]
        for j, b in enumerate(doc):
            now.append(max(0, last[j] + (1 if a == b else -1), last[j + 1] - 1, now[j] - 1))
        best, last = max(best, *now), now
    return best


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def found(spark, docs, items):
    d = spark.createDataFrame([(*r, 0.0, "x") for r in docs], DOCS)
    b = spark.createDataFrame([(*r, "x") for r in items], ITEMS)
    return {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in decontam.leaks(d, b).collect()}


def corpus():
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(80)]
    text = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [text(rng.randrange(12, 50)) for _ in range(20)]
    docs = []
    for k in range(120):
        body = text(rng.randrange(0, 200))
        if k % 2:
            passage = []
            for w in items[k % 20]:
                chance = rng.random() * 100
                passage += [] if chance < k / 20 else ["other"] if chance < k / 10 else [w, "more"] if chance < k / 8 else [w]
            body[len(body) // 2 : len(body) // 2] = passage
        docs.append((k, " ".join(body)))
    return docs, [(k, " ".join(x)) for k, x in enumerate(items)]


def test_against_every_pair(spark):
    docs, items = corpus()
    expected = {}
    for d, text in docs:
        for i, item in items:
            score = brute_score(words(item), words(text)) / len(words(item))
            if score >= decontam.THRESHOLD:
                expected[d, i] = round(score, 9)
    got = found(spark, docs, items)
    assert len(expected) > 50
    assert got.keys() <= expected.keys()
    # a passage at the threshold may hold no five words unchanged
    assert all(got.get(pair) == score for pair, score in expected.items() if score >= 0.6)


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    docs, items = corpus()
    whole = found(spark, docs, items)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 900)
    assert found(spark, docs, items) == whole


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, item), (1, item), (2, None), (3, ""), (4, "alpha beta"), (None, item), (5, "x " * 200_000 + item.upper() + " y" * 10), (6, " ".join([item] * 30))]
    items = [(7, item), (8, item), (9, None), (10, "alpha"), (None, item), (11, "")]
    assert found(spark, docs, items) == {(d, i): 1.0 for d in (1, 5, 6) for i in (7, 8)}
    assert found(spark, docs, []) == {} and found(spark, [], items) == {}


def test_alignment():
    rng = np.random.default_rng(9)
    queries = [rng.integers(0, 6, n).astype(np.uint64) for n in (1, 5, 12, 20)]
    parts = [rng.integers(0, 6, n).astype(np.uint64) for n in (30, 1, 7, 40)]
    score, _ = decontam.aligned(queries, parts)
    assert score.tolist() == [brute_score(a.tolist(), b.tolist()) for a, b in zip(queries, parts, strict=True)]


def test_regular_edits_down_to_the_threshold(spark):
    """Copies whose unchanged runs are two to four words, in documents of their own words."""
    rng = random.Random(10)
    pool = [f"w{k}" for k in range(60)]
    items = [(k, [rng.choice(pool) for _ in range(rng.randrange(12, 60))]) for k in range(12)]
    edits = {
        "put in after 4": lambda k, w: [w, f"new{k}"] if k % 4 == 3 else [w],
        "put in after 3": lambda k, w: [w, f"new{k}"] if k % 3 == 2 else [w],
        "put in after 2": lambda k, w: [w, f"new{k}"] if k % 2 == 1 else [w],
        "replace each 5th": lambda k, w: [f"new{k}"] if k % 5 == 4 else [w],
        "replace each 4th": lambda k, w: [f"new{k}"] if k % 4 == 3 else [w],
        "leave out each 4th": lambda k, w: [] if k % 4 == 3 else [w],
        "leave out each 5th": lambda k, w: [] if k % 5 == 4 else [w],
    }
    docs, runs = [], set()
    for name, edit in edits.items():
        for i, item in items:
            copy = [x for k, w in enumerate(item) for x in edit(k, w)]
            body = [rng.choice(pool) if rng.random() < 0.5 else f"own{rng.randrange(500)}" for _ in range(80)]
            docs.append((len(docs), " ".join([*body[:40], *copy, *body[40:]])))
            runs.add((name, len(docs) - 1, i))
    expected = {}
    for d, text in docs:
        for i, item in items:
            score = brute_score(item, words(text)) / len(item)
            if score >= decontam.THRESHOLD:
                expected[d, i] = round(score, 9)
    assert {name for name, d, i in runs if (d, i) in expected} == edits.keys()
    assert found(spark, docs, [(k, " ".join(x)) for k, x in items]) == expected


def test_long_parts_in_pieces(spark):
    item = " ".join(f"a{k % 3}" for k in range(12))
    text = " ".join(f"a{k % 3}" if k % 4 else "b" for k in range(3000)) + " " + item
    score = brute_score(words(item), words(text)) / 12
    assert found(spark, [(1, text)], [(2, item)]) == {(1, 2): score}
