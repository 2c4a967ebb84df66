"""Boilerplate lines against a count by hand and the SQL."""

import duckdb

import corpus_pipeline
from wayreach.llm import line_dedup

SCHEMA = "doc_id long, text string, source string, n_lines string, __host string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_boilerplate_goes(spark):
    rows = [(k, f" menu \nown {k}\n\nmenu", "a") for k in range(9)] + [(20, "menu\nfree", "b"), (21, None, None), (22, "", "a"), (23, "own 1", None)]
    rows += [(30, "own 3", "a"), (30, "own 3", "a")]
    found = {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup(pages(spark, rows), ratio=0.5).collect()}
    assert found == {(k, f"own {k}\n", 4, 2) for k in range(9)} | {(20, "menu\nfree", 2, 0), (21, None, 0, 0), (22, "", 1, 0), (23, "own 1", 1, 0), (30, "own 3", 1, 0)}


def test_a_line_counts_once_for_a_page_and_the_ratio_is_exceeded(spark):
    rows = [(k, "tie\ntie" if k < 5 else f"own {k}", "a") for k in range(10)]
    assert {r["n_dropped"] for r in line_dedup.dedup(pages(spark, rows), ratio=0.5).collect()} == {0}
    assert {r["n_dropped"] for r in line_dedup.dedup(pages(spark, rows), ratio=0.49).collect()} == {0, 2}


def test_empty_and_long(spark):
    assert line_dedup.dedup(pages(spark, []).limit(0)).count() == 0
    long = "word " * 200_000
    assert line_dedup.dedup(pages(spark, [(1, long, "a")])).first()["text"] == long


def test_sql_says_the_same(spark):
    rows = [(k, f"menu\nown {k % 4}\n {k % 3}", f"host{k % 2}" if k % 5 else None) for k in range(60)] + [(99, None, "host1"), (98, "", "host1")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    spark_rows = sorted((r["doc_id"], str(r["text"]), r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup(pages(spark, rows)).collect())
    assert spark_rows == sorted((a, str(b), c, d) for a, b, c, d in con.execute(line_dedup.sql()).fetchall())
    assert any(r[3] for r in spark_rows)


def test_lines_of_a_few_hundredths_of_a_host_go(spark):
    """By default: 2 and 5 % of 400 pages go, 1 % stays; four pages of a small host stay."""
    rows = [(k, "\n".join([f"own {k}", *["five"] * (k < 20), *["two"] * (k < 8), *["one"] * (k < 4)]), "a") for k in range(400)]
    rows += [(1000 + k, "\n".join([f"own {k}", *["few"] * (k < 4)]), "b") for k in range(20)]
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup(pages(spark, rows)).collect()}
    assert found == {k: "\n".join([f"own {k}", *["one"] * (k < 4)]) for k in range(400)} | {1000 + k: "\n".join([f"own {k}", *["few"] * (k < 4)]) for k in range(20)}


def test_copies_are_no_boilerplate_in_the_pipeline(spark):
    rows = [(k, f"menu\nown {k}", "a") for k in range(60)] + [(100 + k, "menu\nfirst\nsecond", "a") for k in range(30)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, n_chars long")
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_site_lines(spark, docs, "").collect()}
    assert found == {k: f"own {k}" for k in range(60)} | {100 + k: "first\nsecond" for k in range(30)}
