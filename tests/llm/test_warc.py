"""Archives written, read back and indexed."""

import gzip
import hashlib
import random
from pathlib import Path

import duckdb
import pytest

from wayreach.functions.scratch import Scratch
from wayreach.llm import queries, warc

SCHEMA = "page_id long, url string, html string, digest string, salt int"
BIG = "<p>é big</p>" * 200
ROWS = [
    (1, "http://b.example/x", BIG), (9, "http://www.a.example:80/y?z=1", BIG), (3, None, BIG), (4, "nonsense", "small"), (5, "http://b.example/x", "small"),
    (6, "http://b.example/\r\nWARC-Type: x", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40), (7, "http://c.example/", None), (8, "http://c.example/", ""),
    (None, "http://d.example/", BIG), (10, "http://d.example/", "x" * 999), (11, "http://d.example/", "x" * 999), (12, "u", "y" * 300_000), (12, "u", "y" * 300_000),
]


def expected(rows):
    largest = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if page is not None and len(payload) >= 1000:
            largest[payload] = max(page, largest.get(payload, page))
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        first = largest.get(payload)
        again = first is not None and page != first
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_query_on_odd_pages(spark, tmp_path):
    spark.createDataFrame([(*r, "d", 3) for r in ROWS], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    rows = [tuple(r) for r in queries.op3_warc_index(spark, str(tmp_path)).collect()]
    assert sorted(rows, key=str) == expected(ROWS)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.execute(warc.sql()).fetchall(), key=str) == expected(ROWS)


def test_index_is_ordered_over_all_partitions(spark, tmp_path):
    warc.write(spark.createDataFrame([(*r, "d", 3) for r in ROWS * 5], SCHEMA), f"{tmp_path}/w")
    records = Scratch(spark, "t").keep(warc.read(spark, f"{tmp_path}/w"))
    rows = warc.merge_index(records).collect()
    keys = [(r["url_key"], r["date"], -1 if r["page_id"] is None else r["page_id"]) for r in rows]
    assert keys == sorted(keys) and len(keys) == 5 * len(ROWS)
    assert {"example,a)/y?z=1", "example,b)/x"} <= {k[0] for k in keys}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op3_warc_index(spark, str(tmp_path)).count() == 0


def test_archives_are_standard(spark, tmp_path):
    warc.write(spark.createDataFrame([(*r, "d", 3) for r in ROWS[:5]], SCHEMA).coalesce(1), f"{tmp_path}/w")
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(f"{tmp_path}/w").glob("part-*.gz"))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(gzip.compress(text[:-10]), "f"))


def test_loser_tree():
    rng = random.Random(3)
    for k in [0, 1, 2, 3, 5, 8, 13]:
        runs = [sorted((rng.randrange(20), n, r) for n in range(rng.randrange(30))) for r in range(k)]
        assert list(warc.merged(runs)) == sorted((x for run in runs for x in run), key=lambda x: (x[0], x[2], x[1]))
