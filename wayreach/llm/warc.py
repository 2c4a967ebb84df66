"""WARC archives of pages, and one capture index merged from the archives' sorted runs.

``write`` stores each page as a record of WARC 1.1; payloads of at least ``MIN_REVISIT``
bytes that occur more than once are stored once (with the largest id) and revisited by the
others. Each file is sorted by URL key, time and id. ``read`` parses archives into one row
for each record, so that a file's rows are a sorted run. ``merge_index`` deals runs by key
range and merges them with a loser tree: the result is ordered over all its partitions.

Null html: empty payload. Null url: no target and an empty key. Null id: the record carries
none; it may revisit but is never revisited. Repeated ids: each row gives a record; all rows
that share the largest id of a payload are responses. Line breaks in a url become spaces.
Empty input: no record.

Files are written by Spark's text writer: what stands between two records is the blank
lines that end a WARC record, so they serve as its line separator.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 1000
END = "\r\n\r\n"
SALTS = 16
RECORDS_PER_FILE = 20_000
INDEX_ROWS_PER_PARTITION = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNDATED = "1970-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then the rest: sites and their parts sort together."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:www\d*\.)?([^/?#:]*)", 1)
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def record_name(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def write(pages: DataFrame, path: str, date: Column | None = None) -> None:
    """Archives of ``pages`` (page_id, url, html) below ``path``, gzipped as a whole."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace("url", r"[\r\n]", " ").alias("url"),
        F.coalesce(date if date is not None else F.lit(UNDATED), F.lit(UNDATED)).cast("string").alias("date"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    twice = rows.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    # a payload may be that of a third of all pages: pages are salted, the few repeated digests copied
    twice = twice.where("n > 1").select("digest", "first", F.explode(F.array([F.lit(k) for k in range(SALTS)])).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    known = salted.join(twice, ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    body = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", record_name(F.col("page_id"))),
        header("WARC-Date", F.col("date")),
        header("WARC-Target-URI", F.col("url")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        header("WARC-Profile", F.when(revisit, PROFILE)),
        header("WARC-Refers-To", F.when(revisit, record_name(F.col("first")))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        header("Content-Length", F.octet_length("body").cast("string")),
        F.lit("\r\n"),
        "body",
    )
    ordered = known.withColumn("body", body).sortWithinPartitions(url_key(F.col("url")), "date", "page_id")
    writer = ordered.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


RECORDS = "file string, offset long, length long, page_id long, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def parse(content: bytes, file: str) -> Iterator[tuple]:
    """The records of one archive, in order; digests of payloads are computed anew."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)
    at = 0
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"{file} has no record at {at}")
        size, fields = len(line), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode().partition(": ")
            fields[name] = value.rstrip("\r\n")
        length = int(fields["Content-Length"])
        block = stream.read(length)
        if len(block) < length or stream.read(4) != END.encode():
            raise ValueError(f"{file} is cut off in the record at {at}")
        http, _, payload = block.partition(END.encode())
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        n_bytes = len(payload)
        if fields["WARC-Type"] == "revisit":
            n_bytes = int(http.rpartition(b"Content-Length: ")[2])
        elif hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{file}: digest of the record at {at} does not hold")
        size += 2 + length + 4
        yield (
            file, at, size, _page(fields.get("WARC-Record-ID")), fields.get("WARC-Target-URI"), fields["WARC-Date"], fields["WARC-Type"],
            n_bytes, digest, _page(fields.get("WARC-Refers-To")),
        )
        at += size


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_RECORDS = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()),
     ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives below ``path``; offsets count unpacked bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                content = batch.column("content")[row].as_py()
                yield from batches_of(parse(content, batch.column("path")[row].as_py()), _RECORDS)

    return files.mapInArrow(records, RECORDS).withColumn("url_key", url_key(F.col("url")))


def merged(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs of (key, ...) tuples with a loser tree.

    Inner node i holds the run that lost the match there; node 0 holds the winner. After a
    run gives its head, only the matches on its way to the root are played again.
    """
    k = len(runs)
    sources = [iter(run) for run in runs]
    done = (1,)

    def head(run: int) -> tuple:
        row = next(sources[run], None)
        return done if row is None else (0, row[0], run, row)

    heads = [head(run) for run in range(k)]
    losers: list[int | None] = [None] * k

    def play(run: int) -> None:
        winner, node = run, (run + k) // 2
        while node:
            other = losers[node]
            if other is None:  # the first match here waits for its opponent
                losers[node] = winner
                return
            if heads[other] < heads[winner]:
                winner, losers[node] = other, winner
            node //= 2
        losers[0] = winner

    for run in range(k):
        play(run)
    while k and heads[winner := losers[0]] != done:
        yield heads[winner][3]
        heads[winner] = head(winner)
        play(winner)


def merge_index(records: DataFrame) -> DataFrame:
    """``records`` in the order of URL key, date and id, over all partitions.

    ``records`` should be a written table: its keys are sampled first. Ranges end inside a
    much captured URL where needed, since date and id belong to the key.
    """
    names = records.columns
    partitions = max(1, -(-records.count() // INDEX_ROWS_PER_PARTITION))
    partitions = max(partitions, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = records.repartitionByRange(partitions, "url_key", "date", "page_id")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                named = dict(zip(names, row, strict=True))
                page = named["page_id"]
                key = (named["url_key"], named["date"], -(1 << 63) if page is None else page)
                runs.setdefault(named["file"], []).append((key, named["offset"], row))
        for run in runs.values():
            run.sort(key=lambda x: x[1])  # a file's records are in order already
        if schema is not None:
            yield from batches_of((row for _, _, row in merged(list(runs.values()))), schema)

    return dealt.mapInArrow(merge, records.schema)


def sql() -> str:
    """What the records of ``pages`` say, in DuckDB."""
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, '')))::BIGINT AS bytes FROM pages),
f AS (SELECT *, CASE WHEN bytes >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY payload) END AS first FROM p)
SELECT page_id, bytes AS payload_bytes, sha1(payload) AS payload_digest,
    CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
