"""Code lengths against a plain context tree, and accuracy on rows not learned from."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from wayreach.llm import language, queries
from wayreach.llm.columns import text_bytes

SF_DIR = "/root/testdata/sf0.01"


def brute_tree(texts):
    tree = defaultdict(Counter)
    for text in texts:
        data = text.lower().encode()
        for i, byte in enumerate(data):
            for order in range(min(i, language.ORDER) + 1):
                tree[data[i - order : i]][byte] += 1
    return tree


def brute_bits(tree, text):
    data, bits = text.lower().encode(), 0.0
    for i, byte in enumerate(data):
        for order in range(min(i, language.ORDER), -1, -1):
            followers = tree.get(data[i - order : i])
            if followers:
                n, kinds = sum(followers.values()), len(followers)
                if byte in followers:
                    bits -= math.log2(followers[byte] / (n + kinds))
                    break
                bits -= math.log2(kinds / (n + kinds))
        else:
            bits += 8
    return bits


def test_code_lengths(spark):
    rng = random.Random(7)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    learned = {"x": [make("abc ", 300), make("abé", 50)], "y": [make("bcd ", 200)]}
    rows = [(k, t, lang) for lang, texts in learned.items() for k, t in enumerate(texts)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [make("abcdé zQ", n) for n in (0, 1, 2, 3, 7, 200)]
    bits = model.lengths(*text_bytes(pa.array(texts), lower=True))
    trees = [brute_tree(learned[lang]) for lang in model.langs]
    assert np.allclose(bits, [[brute_bits(tree, t) for tree in trees] for t in texts], rtol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = queries.op2_language_ppm(spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_texts(spark):
    learned = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, None, "en"), (3, "der hund und die katze", "de"), (4, "text", None)], "doc_id long, text string, lang string")
    model = language.train(learned)
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "123 !", "c"), (4, "the dog", "d"), (4, "the dog", "d"), (None, "und die", None), (6, "the " * 100_000, "e")], "doc_id long, text string, lang_pred string")
    out = [(r["doc_id"], r["lang_pred"]) for r in language.predict(docs, model).collect()]
    assert out == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (6, "en")]
    nothing = language.predict(docs, language.train(learned.limit(0)))
    assert {(r["lang_pred"], r["score"]) for r in nothing.collect()} == {("und", 0.0)}
    assert language.predict(docs.limit(0), model).count() == 0
