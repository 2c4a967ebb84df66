import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wayreach.llm import infill, queries
from wayreach.llm.columns import text_bytes


def plain_fim(doc_id, text, seed=7, rate=100, spm=50):
    """The rule for one text, on strings."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "one\n", "a\nb\nc\nd\n", "a\nb\nc\nd", "ä€😀\nöü\n\n😀", "with <P> mark\nx\n", "near <P mark>\nP>\n<", "<", "S>\n<S", "\r\n\r\n",
    "tail <M>", "x\n" * 3000, "very long line " * 200_000 + "\nend", "<S>",
]


def result(frame):
    made = infill.transform(frame)
    rows = made.withColumn("restored", infill.restore(F.col("output"), F.col("form"))).collect()
    return [tuple(r) for r in rows]


def test_like_the_rule_and_back(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 6)] + [(3, "same id\nx\ny\n"), (3, "same id\nx\ny\n"), (None, "no id\nx\ny\n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(((d, *plain_fim(d, t), t or "") for d, t in rows), key=repr)
    assert sorted(result(frame), key=repr) == expected
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}


def test_windows_carry_their_sums(spark, monkeypatch):
    texts = pa.array([t for t in TEXTS if t is None or len(t) < 10_000])
    data, bounds = text_bytes(texts)
    hashes = np.array([[int(hashlib.sha256(f"{k}{j}".encode()).hexdigest()[:8], 16) for j in range(4)] for k in range(len(texts))])
    n, form, a, b = infill.split(data, bounds, hashes, 100, 50)
    whole = infill.transform_bytes(data, bounds, form, a, b)
    monkeypatch.setattr(infill, "WINDOW", 7)
    parts = infill.transform_bytes(data, bounds, form, a, b)
    assert np.array_equal(whole[0], parts[0])
    back, at = infill.restore_bytes(*parts, form)
    assert np.array_equal(back, data) and np.array_equal(at, bounds)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\n<PSM>é😀", max_size=30), min_size=1, max_size=8), st.integers(0, 2**32 - 1))
def test_round_trip_of_any_texts(texts, seed):
    data, bounds = text_bytes(pa.array(texts))
    hashes = np.array([[int(hashlib.sha256(f"{seed}{k}{j}".encode()).hexdigest()[:8], 16) for j in range(4)] for k in range(len(texts))])
    n, form, a, b = infill.split(data, bounds, hashes, 80, 50)
    output, at = infill.transform_bytes(data, bounds, form, a, b)
    for k, text in enumerate(texts):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        i, j = sorted(int(h) % (len(units) + 1) for h in hashes[k, :2])
        p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
        expected = [text, f"<P>{p}<S>{s}<M>{m}", f"<S>{s}<P>{p}<M>{m}"][form[k]]
        assert output[at[k] : at[k + 1]].tobytes().decode() == expected
    back, _ = infill.restore_bytes(output, at, form)
    assert back.tobytes() == data.tobytes()


def test_parameters_names_and_empty_table(spark):
    rows = [(i, "a\nb\nc\n", "x") for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, body string, output string")
    forms = [r.form for r in infill.transform(frame, "id", "body", seed=1, rate=40, spm=0).collect()]
    assert set(forms) == {"plain", "psm"} and 50 < forms.count("psm") < 110
    assert infill.transform(frame.limit(0), "id", "body").collect() == []
    assert [r[0] for r in frame.limit(1).select(infill.restore(F.lit(None).cast("string"), F.lit("psm"))).collect()] == [None]


def test_query_over_all_documents(spark):
    rows = {r.doc_id: r for r in queries.op13_infill(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n, form, prefix, middle, output = plain_fim(d.doc_id, d.text)
        r = rows[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
