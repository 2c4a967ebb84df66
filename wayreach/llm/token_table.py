"""Token ids as Parquet list columns that can be read selectively.

``write`` encodes documents and stores one row per document, in ascending order of id:
``shard`` (number of the file), ``doc_id``, ``start_in_shard``, ``n_tokens``, ``ids``. Row groups and pages have
set sizes, ids are dictionary or delta encoded, and Parquet's page indexes let a reader
skip pages by id and leave out ``ids`` altogether. ``read`` adds ``start``, the number of
ids of all documents before.

Null text: only the end id. Rows with equal ids are stored in order of their text; a null
id comes first. Empty input gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayreach.llm.bpe import CONTROL, Seen, id_lists, lines

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
DOCUMENTS_PER_FILE = 50_000
ROWS_AT_ONCE = 500
CACHED_BYTES = 256 << 20  # of pieces met so far, in each Python worker


@lru_cache(2)
def _library(path: str):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    added = {i: x.content for i, x in library.get_added_tokens_decoder().items()}
    # bytes of each token: byte-level tokens have one letter for each byte
    sizes = np.zeros(max([*library.get_vocab().values()], default=-1) + 1, np.int64)
    for token, i in library.get_vocab().items():
        sizes[i] = len(added[i].encode()) if i in added else len(token)
    return library, sizes, Seen(CACHED_BYTES)


def library_ids(texts: list[str | None], tokenizer: str, end_id: int | None) -> list[bytes]:
    """Ids of each text by the tokenizers library, packed; a piece that comes again is not encoded again."""
    library, sizes, seen = _library(tokenizer)
    rows = [seen.find(x or "") for x in texts]
    cut = [[(k, lines(piece)) for k, piece in missing] for _, missing in rows]
    parts = {part for missing in cut for _, pieces in missing for part in pieces}
    new: dict[str, bytes | None] = {part: seen.get(part) for part in parts}
    unknown = [part for part, ids in new.items() if ids is None]
    # pieces that begin with a space do not touch their neighbours, nor do pieces between line
    # feeds; they go as one text, and the bytes of the tokens tell where each piece ends
    plain = [p for p in unknown if not CONTROL.search(p) and p.strip()]
    spaced = [p for p in plain if p[:1] == " " and p[1:2].strip()]
    others = [p for p in plain if p[:1].strip() and p[-1:].strip()]
    for pieces, between in ((spaced, ""), (others, "\n")):
        for k in range(0, len(pieces), 20_000):
            part = pieces[k : k + 20_000]
            ids = np.array(library.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, np.int32)
            bytes_before = np.cumsum([len(p.encode()) + len(between) for p in part]) - len(between)
            ends = np.searchsorted(np.cumsum(sizes[ids]), bytes_before) + 1
            packed, at = ids.tobytes(), 0
            for piece, end in zip(part, (4 * ends).tolist(), strict=True):
                new[piece] = packed[at:end]
                at = end + 4 * len(between)
    for piece in unknown:
        if new[piece] is None:
            new[piece] = np.array(library.encode(piece, add_special_tokens=False).ids, np.int32).tobytes()
        seen.keep(piece, new[piece])
    end = b"" if end_id is None else np.array([end_id], np.int32).tobytes()
    for (found, _), missing in zip(rows, cut, strict=True):
        for k, pieces in missing:
            found[k] = b"".join([new[part] for part in pieces])
        found.append(end)
    return [b"".join(found) for found, _ in rows]


def checksum(ids: Column) -> Column:
    """Unsigned crc32 of the ids as little-endian 32-bit integers."""

    @F.arrow_udf("long")
    def crc(column: pa.Array) -> pa.Array:
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy().astype("<u4", copy=False)
        return pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64())

    return crc(ids)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, encoding: str = "dictionary") -> None:
    """Store the ids of ``docs`` (doc_id, text) below ``path``.

    ``encoding``: ``dictionary`` for repeated ids, ``delta`` for packed differences.
    """
    files = max(1, math.ceil(docs.count() / DOCUMENTS_PER_FILE))
    files = max(files, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select("doc_id", "text").repartitionByRange(files, "doc_id", F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions("doc_id", "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                ids = id_lists(library_ids(part.column("text").to_pylist(), tokenizer, end_id))
                sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard, np.int32)), part.column("doc_id"), pa.array(starts), pa.array(sizes), ids], names=names)

    names = ["shard", "doc_id", "start_in_shard", "n_tokens", "ids"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = ordered.mapInArrow(encoded, f"shard int, doc_id {kind}, start_in_shard long, n_tokens long, ids array<int>")
    (
        table.write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "v2" if encoding == "delta" else "v1")
        .option("parquet.page.write-checksum.enabled", "true")
        .option("compression", "zstd")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, n_tokens, ids, and start.

    The starts need the total of each file only, which is read from the narrow columns and
    added up over the files (one number for each).
    """
    table = spark.read.parquet(path)
    totals = table.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    # two numbers for each file, so the ids need not be shuffled for them
    return table.join(F.broadcast(totals), "shard").withColumn("start", F.col("start_in_shard") + F.col("first")).drop("first", "start_in_shard")
