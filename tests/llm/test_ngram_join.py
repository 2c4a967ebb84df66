import random
import re

import pytest
from pyspark.sql import functions as F

from wayreach.llm import hot, ngram_join, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=3):
    found = WORD.findall((text or "").translate(UPPER))
    if len(found) < size:
        return {tuple(found)} if found else set()
    return {tuple(found[k : k + size]) for k in range(len(found) - size + 1)}


def plain_join(rows, size=3, percent=90):
    """All pairs of rows, compared one by one; (id, n, component) of each row."""
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            if a is not None and rows[j][0] is not None and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * len(sets[i] | sets[j]):
                    group[top(i)] = top(j)
    least = {}
    for k, (a, _) in enumerate(rows):
        if a is not None:
            least[top(k)] = min(a, least.get(top(k), a))
    return sorted(((a, len(sets[k]), None if a is None else least[top(k)]) for k, (a, _) in enumerate(rows)), key=repr)


def result(frame, **options):
    return sorted((tuple(r) for r in ngram_join.join(frame, **options).collect()), key=repr)


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    rows = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 90, 300]))]
        if rng.random() < 0.5:
            # copies of earlier texts with some words changed, left out or put in
            words = rng.choice(rows)[1].split() if rows else words
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(len(words)) if words else 0
                words[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[at], "new"]]) if words else []
        elif rng.random() < 0.3:
            words = passage + words[:12]
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_all_pairs(spark, seed):
    rows = corpus(seed)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == plain_join(rows)


def test_hot_postings_and_small_blocks(spark, monkeypatch):
    """A large group of near copies, two groups of it that do not link, and blocks of a few rows."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "HUB_ROWS", 5)
    monkeypatch.setattr(hot, "HOT_ROWS", 10)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(80)]
    other = base[:66] + [f"o{k}" for k in range(14)]
    rows = []
    for k in range(260):
        words = list(rng.choice([base, base, other]))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((1000 - k, " ".join(words[: rng.choice([80, 80, 78, 70, 60])])))
    expected = plain_join(rows)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == expected
    assert len({c for _, _, c in expected}) > 5


def test_borders_of_the_threshold(spark):
    """Pairs of exactly 90 per cent link, pairs just below do not; sizes in exact proportion too."""
    rows, k = [], 0
    for n in range(3, 60):
        words = [f"t{n}x{i}" for i in range(n + 2)]
        for cut in range(1, 8):
            rows += [(k, " ".join(words)), (k + 1, " ".join(words[:-cut]))]
            words = [w + f"c{cut}" for w in words]
            k += 2
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == plain_join(rows)


def test_edge_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\ttwo"), (8, "two one"), (9, "one two three"), (10, "a b c d"), (10, "a b c d"),
        (11, "x y z q"), (11, "p q r s"), (12, "P q R s"), (None, "a b c d"), (None, None), (13, "É a b"), (14, "é a b"), (15, "a b c d"), (16, "a\x1cb c d"), (17, "one one one one"), (18, "one one one"),
        (19, "long " + " ".join(str(i) for i in range(60_000))), (20, "Long " + " ".join(str(i) for i in range(59_990))), (-3, "a B c D"),
    ]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == plain_join(rows)


def test_parameters_names_and_empty_table(spark):
    rows = corpus(3, 150)
    frame = spark.createDataFrame(rows, "id long, body string").withColumns({"n": F.lit("x"), "g": F.lit(1), "a": F.lit(2), "grams": F.lit(3)})
    assert result(frame, id_col="id", text_col="body", size=2, percent=70) == plain_join(rows, 2, 70)
    assert result(frame.limit(0), id_col="id", text_col="body") == []


def test_query_over_all_documents(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op12_ngram_join(spark, path).collect()), key=repr) == plain_join(rows)
