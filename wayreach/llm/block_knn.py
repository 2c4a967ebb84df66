"""Nearest vectors by a block matrix join with int8 tiles.

Vectors are grouped into blocks; each block of queries meets each block of candidates of
the same dimension once. In such a tile, vectors scaled to unit length and rounded to int8
give approximate cosines with a proven error; only pairs that may still be among the ``k``
best of the tile are computed from the original components in double precision, and heaps
keep the best of each tile and then of all tiles. The result is exact.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
do rows without an id. Rows that share an id count as one (the smallest vector). A vector is
compared with vectors of its own length only. Equal scores: the smaller id first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayreach.functions.skew import merge_join

BLOCK_VALUES = 1 << 20  # components of a block of candidates
QUERIES_PER_BLOCK = 1024


def usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & sound & F.exists(vector, lambda x: x != 0)


def in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """(dim, block, ids, values): the rows (id, v) of each block as two lists."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        dim, block = table["dim"][0], table["block"][0]
        ids, values = table["id"].to_pylist(), table["v"].combine_chunks().flatten()
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim.as_py()], pa.int32()), pa.array([block.as_py()], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
             pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(pa.float64()))],
            names=["dim", "block", "ids", "vals"],
        )

    dealt = rows.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    return dealt.groupBy("dim", "block").applyInArrow(build, "dim int, block int, ids array<long>, vals array<double>")


def rounded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values as float32, scale, error): unit vectors as scale * int8, and the length of what is lost.

    Sums of products of int8 values are exact in float32 up to some thousand components;
    longer vectors use float64.
    """
    peak = np.abs(vectors).max(1, keepdims=True)
    unit = vectors / peak
    unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - small * scale[:, None]) ** 2).sum(1))
    return small.astype(np.float32 if vectors.shape[1] <= 1000 else np.float64), scale, error


def best_of_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query, id, cosine) of the k nearest of each query among the vectors of one block."""
    q8, q_scale, q_error = rounded(queries)
    c8, c_scale, c_error = rounded(vectors)
    q_norm, c_norm = np.sqrt((queries * queries).sum(1)), np.sqrt((vectors * vectors).sum(1))
    for part in range(0, len(query_ids), 128):
        chosen = slice(part, part + 128)
        about = (q8[chosen] @ c8.T).astype(np.float64) * q_scale[chosen, None] * c_scale
        # |e_q . c| + |q' . e_c|, with |q'| <= 1 + |e_q|; the last term covers rounding
        slack = q_error[chosen, None] + (1 + q_error[chosen, None]) * c_error + 1e-9
        about[query_ids[chosen, None] == ids] = -np.inf
        lowest = about - slack
        kept = min(k, lowest.shape[1])
        bound = np.partition(lowest, lowest.shape[1] - kept, axis=1)[:, -kept]
        for row in range(len(about)):
            alive = np.flatnonzero((about[row] + slack[row] >= bound[row]) & (about[row] > -np.inf))
            q = queries[part + row]
            # summed row by row, so that equal vectors get equal scores
            exact = (vectors[alive] * q).sum(1) / (c_norm[alive] * q_norm[part + row])
            if len(alive) > 4 * k:
                least = np.partition(exact, len(exact) - k)[-k]
                alive, exact = alive[exact >= least], exact[exact >= least]
            pairs = zip(exact.tolist(), ids[alive].tolist(), strict=True)
            for score, vec in heapq.nsmallest(k, pairs, key=lambda x: (-x[0], x[1])):
                yield int(query_ids[part + row]), vec, score


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                def get(name: str, row=row, batch=batch) -> np.ndarray:
                    return batch.column(name)[row].values.to_numpy()

                dim = batch.column("dim")[row].as_py()
                found = list(best_of_tile(get("q_ids"), get("q_vals").reshape(-1, dim), get("ids"), get("vals").reshape(-1, dim), k))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ([], [], []), RESULT.types, strict=True)], schema=RESULT)

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each query, the k best so far: a heap whose top is the worst of them
        best: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for query, vec, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heap = best.setdefault(query, [])
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -vec))
        rows = [(q, rank, -vec, score) for q, heap in best.items() for rank, (score, vec) in enumerate(sorted(heap, reverse=True), 1)]
        names, types = ["query_id", "rank", "vec_id", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 10_000], strict=True), types, strict=True)], names=names)

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row that meets ``queries``."""
    sound = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    marked = sound.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), queries.alias("asked"))
    rows = marked.groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked"))
    n, dim, asked = marked.agg(F.count("*"), F.max(F.size("v")), F.count_if("asked")).first()
    per_block = max(64, BLOCK_VALUES // max(dim or 1, 1))
    blocks = max(1, -(-n // per_block))
    candidates = in_blocks(rows, blocks)
    asking = in_blocks(rows.where("asked"), max(1, -(-asked // min(QUERIES_PER_BLOCK, per_block))))
    asking = asking.select("dim", F.col("ids").alias("q_ids"), F.col("vals").alias("q_vals"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # sorted: Spark takes lists for a few bytes each and would build one side, with a copy of the queries for every block, on the driver
    tiles = merge_join(asking, candidates, ["dim", "block"]).select("dim", "q_ids", "q_vals", "ids", "vals")
    found = tiles.mapInArrow(_tiles(k), "query_id long, vec_id long, score double")
    return found.repartition("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
