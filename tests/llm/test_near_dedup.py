"""Groups of near copies against all pairs, and the signatures against exact similarities."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wayreach.functions.scratch import Scratch
from wayreach.llm import near_dedup
from wayreach.llm.links import components

SCHEMA = "doc_id long, text string, class_id string, n int"


def shingle_set(text):
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Least id of each group, by comparing all pairs."""
    sets = {k: shingle_set(t) for k, t in rows if k is not None}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {k: find(k) for k in keys}


def found(spark, rows):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    return {r["doc_id"]: r["class_id"] for r in near_dedup.groups(df).collect()}


def edited(rng, words, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base = [[f"w{rng.randrange(3000)}" for _ in range(220)] for _ in range(25)]
    rows, k = [], 0
    for words in base:
        for changes in [0, 0, 2, 3, 4, 9, 60]:
            rows.append((k, edited(rng, words, changes)))
            k += 1
    # chains: each is near its neighbour, not near the first
    words = base[0]
    for _ in range(12):
        words = edited(rng, words, 4).split()
        rows.append((k, " ".join(words)))
        k += 1
    # many copies of one text around the threshold
    for _ in range(60):
        rows.append((k, edited(rng, base[1], 3)))
        k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "!?"), (k + 3, "Two words"), (k + 4, "two WORDS!"), (k + 5, "one"), (k + 6, "a b c d e"), (k + 7, "A b, c d e")]
    return rows


def test_groups_equal_brute_force(spark, corpus):
    # the signatures promise pairs well above the threshold; the rest of each group hangs on them
    assert found(spark, corpus) == brute(corpus)


def test_small_blocks_change_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "HUB_ROWS", 4)
    assert found(spark, corpus) == brute(corpus)


def test_one_of_each_group_stays(spark, corpus):
    rows = [*corpus, corpus[0], (None, "x"), (None, "x")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    kept = near_dedup.representatives(df)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == df.columns and ids.count(None) == 2
    assert sorted(i for i in ids if i is not None) == sorted({*brute(corpus).values()})


def test_empty_and_long(spark):
    assert found(spark, []) == {}
    long = " ".join(f"w{k}" for k in range(200_000))
    assert found(spark, [(5, long), (3, long + " end"), (4, long[: len(long) // 2])]) == {5: 3, 3: 3, 4: 4}


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_similarity(weighted):
    rng = np.random.default_rng(5)
    x = rng.integers(1, 6, 400).astype(float) if weighted else np.ones(400)
    y = x.copy()
    y[:60] = rng.integers(1, 6, 60) if weighted else 0
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    exact = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    keep = y > 0
    sig = near_dedup.signatures(np.concatenate((pool, pool[keep])), np.concatenate((x, y[keep])), np.array([0, 400, 400 + keep.sum()]), k=2000)
    assert abs((sig[0] == sig[1]).mean() - exact) < 4 * (exact * (1 - exact) / 2000) ** 0.5


def test_weights_count_occurrences(spark):
    rows = [(1, "a b c d e f " * 3), (2, "a b c d e f " * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["class_id"] for r in near_dedup.groups(df).collect()} == {1}
    assert {r["class_id"] for r in near_dedup.groups(df, weighted=True).collect()} == {1, 2}


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)]
    rows = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    root = {k: k for e in edges for k in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["id"]: r["group"] for r in rows} == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert len(rows) == len({r["id"] for r in rows})


def test_words_and_shingles_follow_the_definition():
    texts = ["One two, three-four FIVE six", "", "é 1_2 a b c d", "x", "one two three four five six"]
    data, offsets = near_dedup.text_bytes(pa.array(texts), lower=True)
    sets, _, bounds = near_dedup.shingles(*near_dedup.words(data, offsets))
    sizes = np.diff(bounds).tolist()
    assert sizes == [len(shingle_set(t)) for t in texts]
    assert set(sets[bounds[0] : bounds[1]]) == set(sets[bounds[4] : bounds[5]])
