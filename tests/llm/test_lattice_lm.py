"""Spelling likelihoods by listing all segmentations, and the query against plain counting."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from wayreach.llm import lattice_lm, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


def spell(model, text, at=0):
    """Probabilities of all ways to spell text[at:]."""
    if at == len(text):
        return [1.0]
    out = []
    for i, piece in enumerate(model.pieces):
        if text.startswith(piece, at):
            out += [math.exp(model.log_p[i]) * p for p in spell(model, text, at + len(piece))]
    if text[at] not in {p for p in model.pieces if len(p) == 1}:
        own = math.exp(sum(model.log_p[len(model.pieces) + 1 + b] for b in text[at].encode()))
        out += [own * p for p in spell(model, text, at + 1)]
    return out


def small():
    pieces = ["▁", "a", "b", "ab", "▁a", "aba", "bb"]
    weights = np.arange(1.0, len(pieces) + 258)
    return lattice_lm.Spelling(pieces, np.log(weights / weights.sum()))


@pytest.mark.parametrize("word", ["a", "abab", "xaé", "bbbba", "abaabb"])
def test_all_segmentations(word):
    model = small()
    total = sum(spell(model, "▁" + word)) * math.exp(model.log_p[len(model.pieces)])
    assert math.isclose(model.log_likelihood(word), math.log(total), rel_tol=1e-9)


def test_expectation_raises_likelihood(spark):
    words = ["abab", "ab", "bba", "xab", "aba"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    before, after = small(), lattice_lm.expected_pieces(df, small())
    assert math.isclose(np.exp(after.log_p).sum(), 1)
    assert sum(map(after.log_likelihood, words)) > sum(map(before.log_likelihood, words))
    counts = [0.0] * len(before.log_p)
    before.expect("aba", counts)
    # every segmentation spells the four characters once
    assert math.isclose(sum(n * len(p) for n, p in zip(counts, before.pieces, strict=False)), 4)


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lattice_lm, "FREQUENT", 3)  # most words are joined
    texts = ["The cat\tsat", "the CAT  ran\x0b\x0cfar", None, "", "É é the", "the the the dog", "x" * 3000, "zyx the cat"] * 4
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(None, "the cat", "en", "s"), (3, "", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, word string, row string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op8_lattice_lm(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    split = lambda t: [w for w in lower(t).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").split(" ") if w]
    learned = [(split(t)) for k, t, *_ in rows if not held(k)]
    counts = Counter(w for t in learned for w in t)
    end, total, kinds = len(learned), counts.total() + len(learned), len(counts) + 1
    base = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    expected = sorted((str(k), held(k), len(split(t)) + 1, sum(counts[w] > 0 for w in split(t)) + 1, total, round(sum(base(counts[w]) for w in split(t)) + base(end), 6)) for k, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == expected
    assert all(-1e5 < r["score"] < 0 for r in out)


def test_without_rows(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    none = lattice_lm.score(docs, F.lit(True), PATH).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in none} == {(1, 3, 0, 0), (2, 1, 0, 0)}
    assert lattice_lm.score(docs.limit(0), F.lit(False), PATH).count() == 0


def test_every_round_sees_all_words(spark, monkeypatch):
    rounds, expect = [], lattice_lm.expected_pieces

    def counted(words, spelling):
        rounds.append(words.count())
        return expect(words, spelling)

    monkeypatch.setattr(lattice_lm, "expected_pieces", counted)
    docs = spark.range(80).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.col("id") * 1000, F.col("id") * 1000 + 999), lambda k: F.hex(k))).alias("text"))
    assert lattice_lm.score(docs, F.lit(False), PATH).count() == 80
    assert rounds == [80_000] * 4
