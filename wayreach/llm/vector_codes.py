"""Product codes of vectors by exact integer arithmetic.

Components become integers, floor(``SCALE`` * x), and vectors are cut into ``PARTS``
consecutive parts. Each part position has a codebook of up to ``ENTRIES`` integer vectors;
it starts as that part of the vectors with the smallest ids. ``ROUNDS`` times all parts go to
their nearest entry, and entries become the floor of their parts' mean.

Squared distances are exact. Integers are broken into limbs so narrow that no sum of
products of two limbs reaches 2^53: the float64 matrix products of limbs are then whole
numbers, which are shifted and added up in int64. Of equal distances the first entry counts.

Each round is one pass over the vectors that were written once. A task adds up its own parts
by entry, in int64; only these sums, a number for each entry and component, are shuffled. The
codebooks (``ENTRIES`` vectors in all) are the only thing that goes through the driver.

Left out: vectors that are null, empty, or hold null or non-finite components. The first
kept vector sets the number of components; a length that ``PARTS`` does not divide is filled
up with zeros. Kept vectors of another length, or so large that the exact error could leave
64 bits (beyond 2^27 / SCALE at 64 components), take no part in learning and get a null code
and error; so do rows without an id. Equal ids: the smaller vector first. Repeated rows are
separate rows. Empty input: empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayreach.functions.scratch import Scratch
from wayreach.llm.hot import join_totals

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
ROWS_AT_ONCE = 4096
EXACT_BITS = 53


def sound(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def limit(dim: int) -> int:
    """The largest integer component: dim squared differences of such numbers stay below 2^62."""
    return 1 << ((62 - math.ceil(math.log2(max(dim, 2)))) // 2 - 1)


def limbs(x: np.ndarray, width: int) -> list[np.ndarray]:
    """``x`` as float64 limbs of ``width`` bits, the lowest first; the highest one bears the sign."""
    out = []
    while x.size and (x.min() < -(1 << width) or x.max() > 1 << width):
        out.append((x & ((1 << width) - 1)).astype(np.float64))
        x = x >> width
    return [*out, x.astype(np.float64)]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of two integer matrices, exactly, by float64 products of limbs."""
    width = (EXACT_BITS - 1 - math.ceil(math.log2(max(x.shape[1], 2)))) // 2
    total = np.zeros((len(x), len(y)), np.int64)
    right = limbs(y, width)
    for i, a in enumerate(limbs(x, width)):
        for j, b in enumerate(right):
            total += (a @ b.T).astype(np.int64) << (width * (i + j))
    return total


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first nearest entry, squared distance) of each row of ``parts``."""
    apart = (book * book).sum(1) - 2 * products(parts, book)
    best = apart.argmin(1)
    return best, apart[np.arange(len(parts)), best] + (parts * parts).sum(1)


def integers(column: pa.Array, dim: int, scale: int = SCALE, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can be coded, their integer components, filled up to a multiple of ``parts``)."""
    sizes, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.flatnonzero(sizes == dim)
    of = np.repeat(sizes == dim, sizes)
    with np.errstate(over="ignore"):
        scaled = np.floor(values[of].reshape(-1, dim) * scale)
    small = (np.abs(scaled) <= limit(dim)).all(1)
    ints = np.zeros((int(small.sum()), -(-dim // parts) * parts), np.int64)
    ints[:, :dim] = scaled[small]
    return rows[small], ints


def _usable(table: DataFrame, dim: int) -> DataFrame:
    bound = limit(dim)
    return table.where(F.col("id").isNotNull() & (F.size("v") == dim) & F.forall("v", lambda x: (x.cast("double") * SCALE >= -bound) & (x.cast("double") * SCALE < bound + 1)))


def first_books(table: DataFrame, dim: int) -> list[np.ndarray]:
    """The codebooks to begin with: the parts of the ``ENTRIES`` smallest ids, at most that many rows."""
    rows = _usable(table, dim).select("id", "v").orderBy("id", "v").limit(ENTRIES).toArrow()
    _, ints = integers(rows["v"].combine_chunks(), dim) if len(rows) else (None, np.zeros((0, -(-dim // PARTS) * PARTS), np.int64))
    return np.split(ints, PARTS, axis=1)


def _sums(books: list[np.ndarray], dim: int):
    """Rows (part, entry, place, total, n): what this task's vectors add to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                _, ints = integers(batch.column("v").slice(at, ROWS_AT_ONCE), dim)
                for k, part in enumerate(np.split(ints, PARTS, axis=1)):
                    best, _ = nearest(part, books[k])
                    np.add.at(totals[k], best, part)
                    counts[k] += np.bincount(best, minlength=len(books[k]))
        for k, book in enumerate(books):
            used = np.flatnonzero(counts[k])
            width = book.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used) * width, k, np.int32)), pa.array(np.repeat(used, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))),
                 pa.array(totals[k][used].ravel()), pa.array(np.repeat(counts[k][used], width))],
                names=["part", "entry", "place", "total", "n"],
            )

    return run


def learn(table: DataFrame, dim: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds; ``table``: (id, v)."""
    books = first_books(table, dim)
    if not len(books[0]):
        return books
    rows = table.where(F.col("id").isNotNull()).select("v")
    for _ in range(rounds):
        parts = rows.mapInArrow(_sums(books, dim), "part int, entry int, place int, total long, n long")
        # sums over all tasks may pass 64 bits
        whole = F.sum(F.col("total").cast("decimal(38,0)"))
        means = parts.groupBy("part", "entry", "place").agg(whole.alias("total"), F.sum("n").alias("n"))
        for r in means.collect():  # at most ENTRIES * dim rows
            books[r.part][r.entry, r.place] = int(r.total) // r.n
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def assign(table: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """``table`` (id, v, more) without ``v``, with ``code`` (a byte for each part) and ``error``."""
    rest = [f for f in table.schema.fields if f.name != "v"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest) + ", code binary, error long"
    names = [*[f.name for f in rest], "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows, ints = integers(part.column("v"), dim)
                there = part.column("id").is_valid().to_numpy(zero_copy_only=False)[rows]
                rows, ints = rows[there], ints[there]
                codes, error = np.zeros((len(rows), PARTS), np.uint8), np.zeros(len(rows), np.int64)
                for k, piece in enumerate(np.split(ints, PARTS, axis=1) if len(rows) else []):
                    best, apart = nearest(piece, books[k])
                    codes[:, k] = best
                    error += apart
                known = np.zeros(len(part), bool)
                known[rows] = True
                all_codes, errors = np.zeros((len(part), PARTS), np.uint8), np.zeros(len(part), np.int64)
                all_codes[rows], errors[rows] = codes, error
                code = [c.tobytes() if k else None for c, k in zip(all_codes, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in rest], pa.array(code, pa.binary()), pa.array(errors, mask=~known)], names=names)

    return table.mapInArrow(run, schema)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error, label_error), codebooks); one row for each sound vector.

    ``label_error``: the errors of all rows of the same label (null is a label) added up.
    """
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    kept = vectors.where(sound(F.col(vector_col)))
    table = scratch.keep(kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")), "vectors")
    first = table.where("id is not null").select("id", "v").orderBy("id", "v").limit(1).collect()
    dim = len(first[0].v) if first else 1
    books = learn(table, dim)
    coded = scratch.keep(assign(table, books, dim), "codes")
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("rows"))
    sums = scratch.keep(sums.select("label", F.col("sum").try_cast("long").alias("label_error"), "rows"), "labels")
    return join_totals(coded, sums, "label", "rows"), books
