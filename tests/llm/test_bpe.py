"""BPE encoding, decoding and token tables against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayreach.llm import bpe, columns, queries, token_table

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "a  b", "a \n b", "tail ", "\x1c x", "a <|endoftext|> b", "é中🙂 é", "it's we'll 12 345", "ab" * 3000, "   " * 400, "x" * 5000, "  y　z"]


def ids_of(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert np.frombuffer(bpe.vocabulary(PATH).encode(text), np.int32).tolist() == ids_of(text)
    assert token_table.library_ids([text], PATH, None) == [np.array(ids_of(text), np.int32).tobytes()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcehinorst ' \n\t.,!0é中🙂\x1c\xa0"), max_size=60))
def test_random_texts(text):
    assert np.frombuffer(bpe.vocabulary(PATH).encode(text), np.int32).tolist() == ids_of(text)
    assert token_table.library_ids([text], PATH, None) == [np.array(ids_of(text), np.int32).tobytes()]


def test_every_token_encodes_to_itself():
    v = bpe.vocabulary(PATH)
    for token, i in list(LIBRARY.get_vocab().items())[::7]:
        if i not in v.added.values():
            assert v.merge_exactly(token) == [i]


def test_null_and_foreign_ids(spark):
    df = spark.createDataFrame([(1, [64, 65, 10**6, -1, None]), (2, None), (3, [])], "k int, ids array<int>")
    assert [r[0] for r in df.select(bpe.decode(F.col("ids"), PATH)).collect()] == ["ab", None, ""]
    text = spark.createDataFrame([("ab",), (None,)], "text string")
    assert [r[0] for r in text.select(bpe.encode(F.col("text"), PATH)).collect()] == [ids_of("ab"), None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bpe"))
    rows = [(k, text, "en", "s", 0) for k, text in enumerate([*ODD, None])]
    spark.createDataFrame([*rows, rows[2]], "doc_id long, text string, lang string, ids string, start long").write.parquet(f"{path}/documents.parquet")
    return path


def test_encoding_query(spark, folder):
    found = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op4_bpe_backtracking(spark, folder).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = {(k, len(ids_of(t)), sha(",".join(map(str, ids_of(t)))), sha(LIBRARY.decode(ids_of(t), skip_special_tokens=False))) for k, t in enumerate([*ODD, ""])}
    assert found == expected


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_table(spark, folder, tmp_path, encoding):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    token_table.write(docs, str(tmp_path / "t"), PATH, 0, encoding)
    rows = sorted(token_table.read(spark, str(tmp_path / "t")).select("start", "doc_id", "n_tokens", token_table.checksum(F.col("ids")).alias("crc")).collect())
    texts = sorted([*enumerate(ODD), (2, ODD[2]), (len(ODD), "")])
    start = 0
    for row, (k, text) in zip(rows, texts, strict=True):
        ids = np.array([*ids_of(text), 0], "<u4")
        assert tuple(row) == (start, k, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_empty_tables(spark, folder, tmp_path):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    token_table.write(none, str(tmp_path / "t"), PATH)
    assert token_table.read(spark, str(tmp_path / "t")).count() == 0
    assert none.select(bpe.encode(F.col("text"), PATH)).count() == 0


def test_rows_in_slices(spark, monkeypatch):
    """The form for long jobs, with slices of a few rows and texts cut at every kind of line end."""
    monkeypatch.setattr(bpe, "slices", lambda bounds: columns.slices(bounds, 200))
    texts = ["one\ntwo", "one\n\ntwo", "one\n two", "one \ntwo", "one\r\ntwo\x1c\nthree", "\none\n", None, "", "a\n'll\nb", "word " * 30_000 + "\nend\n" * 3, "é\nü\u0085\nx"] * 3
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    rows = {r.id: r for r in bpe.tokens(frame, PATH, "id", "body").collect()}
    for k, text in enumerate(texts):
        expected = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert (rows[k].ids, rows[k].n_tokens, rows[k].exact) == (expected, len(expected), True)
