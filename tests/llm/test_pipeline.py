"""The pipeline on a small corpus whose outcome is known, and each stage on odd rows."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from wayreach.llm import line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, n_lines string"
BENCHMARK = "item_id long, text string"
SYLLABLES = {"en": ["th", "er", "on", "an", "re", "he", "in", "ed"], "de": ["sch", "ein", "ung", "ich", "au", "zu", "pf", "tz"]}


def make(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    item = make(rng, "en", 40)
    rows, kept = [], {}

    def add(text, lang="en", source="a", stays=True, becomes=None):
        k = len(rows)
        rows.append((k, text, lang, source, len(text or ""), "mine", 0.5, "x"))
        if stays:
            kept[k] = text if becomes is None else becomes
        return k

    for k in range(40):
        body = make(rng, "en" if k % 3 else "de", 60)
        add("buy now\n" + body, "en" if k % 3 else "de", becomes=body)
    base = make(rng, "en", 120)
    add(base, source="b")
    words = base.split()
    add(base, source="b", stays=False)
    add(" ".join([*words[:60], "changed", *words[61:]]), source="c", stays=False)
    add(f"{make(rng, 'en', 20)} {item} {make(rng, 'en', 20)}", source="c", stays=False)
    edited = item.split()
    edited[10], edited[25] = "xx", "yy"
    add(f"{make(rng, 'de', 20)} {' '.join(edited)}", source="c", stays=False)
    add(None, stays=False)
    add("", stays=False)
    add("12 34 !!", stays=False)
    return rows, kept, [(1, item), (2, None), (3, "ab")]


def test_run(spark, corpus, tmp_path, monkeypatch):
    rows, kept, items = corpus
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, BENCHMARK).write.parquet(f"{tmp_path}/benchmark.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {k: library.encode(text, add_special_tokens=False).ids for k, text in kept.items()}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    assert {r["doc_id"]: r["ids"] for r in out.collect()} == expected
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {k: len(v) for k, v in expected.items()}


def test_stages_keep_columns_and_values(spark, corpus, tmp_path):
    rows, _, items = corpus
    spark.createDataFrame(items, BENCHMARK).write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = [(None, None, None, None, None, None, None, None), (None, "the end", None, None, 7, None, None, None), rows[0], rows[0], (900, "ther " * 50_000, "en", None, 1, "m", 1.0, "y")]
    docs = spark.createDataFrame([*rows, *odd], SCHEMA)
    originals = {(r[0], r[2], r[3], r[5], r[6], r[7]) for r in [*rows, *odd]}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema == docs.schema
        assert {(r["doc_id"], r["lang"], r["source"], r["lang_pred"], r["score"], r["n_lines"]) for r in out.collect()} <= originals
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, str(tmp_path)).count() == docs.count() and last(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_clean_documents_stay(spark):
    """On the given tables no clean document goes in the first two stages, and few lines do."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    named = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    assert named.count() >= 0.995 * docs.count()
    assert corpus_pipeline.STAGES[1][1](spark, named, folder).count() == named.count()
    assert np.mean([r["n_dropped"] / r["n_lines"] for r in line_dedup.dedup(docs).collect()]) < 0.05
