"""Groups of near copies by DartMinHash signatures.

A text is the set of its runs of ``SHINGLE`` words, each with a weight (1, or with
``weighted`` the number of its occurrences). Darts fall on the plane of weight and rank at
places given by hashes of the element and the region; a set owns the darts below the
weights of its elements, and of the darts of each of the ``k`` coordinates the one of lowest
rank is kept. Only about k (ln k + 2) darts are looked at, whatever the size of the set.
Two sets agree in a coordinate with the probability of their (weighted) Jaccard similarity.

``BANDS`` bands of ``ROWS`` coordinates propose pairs; similarities are then computed from
the shingles themselves, and pairs of at least ``THRESHOLD`` are links. A group is what
links connect.

1. Texts of equal shingles are one class (its least id stands for it).
2. In each bucket of a band, all classes are compared with its least and its greatest.
3. In buckets that still hold more than one group, all classes are compared with the one
   that is nearest to the most frequent signature, such as the text that copies stem from.
4. Buckets that are still apart are searched in blocks: every class outside the bucket's
   largest group is compared with all others by signature; where the signatures promise
   ``THRESHOLD`` by ``SLACK`` standard deviations, the shingles decide.

So no pair of a bucket that could join two groups goes unseen, and a large group of copies
costs some comparisons a member, not one a pair.

Null text or a text without words: a group of its own. Texts of fewer than SHINGLE words:
their words are one shingle. A null id: null group, never linked. Repeated rows: each is
reported; rows that share an id stand for one document. Empty input: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayreach.functions.scratch import Scratch
from wayreach.llm.columns import STEP, grams, mixed, slices, spans, text_bytes, uniform, words
from wayreach.llm.links import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
SLACK = 4.0
BLOCK = 1024
HUB_ROWS = 2048
SALTS = 16


def shingles(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles of each text in ascending order, their numbers, offsets)."""
    found, at = grams(hashes, offsets, SHINGLE)
    owner = spans(offsets)[at]
    sizes = np.diff(offsets)
    for text in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
        own = hashes[offsets[text] : offsets[text + 1]]
        whole = mixed(own + np.arange(1, len(own) + 1, dtype=np.uint64) * np.uint64(STEP)).sum(dtype=np.uint64, keepdims=True)
        found, owner = np.append(found, whole), np.append(owner, text)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(found)))
    return found[first], n, np.searchsorted(owner[first], np.arange(len(offsets)))


@lru_cache(64)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson number up to where they reach one."""
    top = int(mean + 12 * math.sqrt(mean) + 20)
    logs = [i * math.log(mean) - mean - math.lgamma(i + 1) for i in range(top)]
    return np.cumsum(np.exp(logs))


def _cells(limit: float, smallest: float) -> Iterator[tuple[int, float, float]]:
    """Doubling intervals (number, from, to) that cover [0, limit)."""
    low, high, number = 0.0, smallest, 0
    while low < limit:
        yield number, low, high
        low, high, number = high, 2 * high, number + 1


def signatures(elements: np.ndarray, weights: np.ndarray, offsets: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """k coordinates of each set; zeros for an empty one.

    One dart falls on a unit of area (weight x rank) on average. A dart's rank counts for
    its own coordinate, so a set of total weight w finds its k winners below rank
    k (ln k + 2) / w nearly always; the few sets that do not look twice as far.
    """
    sets = len(offsets) - 1
    owner = spans(offsets)
    total = np.bincount(owner, weights=weights, minlength=sets)
    reach = np.where(total > 0, k * (math.log(k) + 2) / np.maximum(total, 1e-300), 0)
    out = np.zeros((sets, k), np.uint64)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        active = np.zeros(sets, bool)
        active[todo] = True
        rows = np.flatnonzero(active[owner])
        ids, ranks, whose = _darts(elements[rows], weights[rows], owner[rows], reach)
        place = whose * k + (mixed(ids ^ np.uint64(STEP)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((ids, ranks, place))
        place, ids = place[order], ids[order]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        won = np.zeros(sets * k, np.uint64)
        won[place[first]] = ids[first] | np.uint64(1)
        won = won.reshape(sets, k)
        full = todo[(won[todo] > 0).all(1)]
        out[full] = won[full]
        todo = np.setdiff1d(todo, full)
        reach[todo] *= 2
    return out


def _darts(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, rank, set) of all darts that the sets own within their reach."""
    found = []
    for w_cell, w_low, w_high in _cells(float(weights.max()), 1.0):
        tall = np.flatnonzero(weights > w_low)
        for r_cell, r_low, r_high in _cells(float(reach[owner].max()), 0.125):
            rows = tall[reach[owner[tall]] > r_low]
            seed = mixed(elements[rows] + np.uint64((w_cell * 64 + r_cell + 1) * STEP & (1 << 64) - 1))
            n = np.searchsorted(_poisson((w_high - w_low) * (r_high - r_low)), uniform(seed), "right")
            of = np.repeat(rows, n)
            number = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            ids = mixed(np.repeat(seed, n) + (number + 1).astype(np.uint64) * np.uint64(STEP))
            rank = r_low + (r_high - r_low) * uniform(mixed(ids))
            height = w_low + (w_high - w_low) * uniform(mixed(ids + np.uint64(1)))
            own = (rank < reach[owner[of]]) & (height < weights[of])
            found.append((ids[own], rank[own], owner[of[own]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def bands(signature: np.ndarray) -> np.ndarray:
    """One key for each band of each signature."""
    keys = np.zeros((len(signature), BANDS), np.uint64)
    for row in range(ROWS):
        keys = mixed(keys * np.uint64(STEP) + signature[:, row::ROWS][:, :BANDS] + np.uint64(row))
    return mixed(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(STEP))


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values).cast(kind))


def _sketch(weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"), lower=True)
            for a, b in slices(bounds):
                found, n, offsets = shingles(*words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]))
                sizes = np.diff(offsets)
                signature = signatures(found, n.astype(float) if weighted else np.ones(len(n)), offsets)
                keys = bands(signature)
                # two sums of scrambled shingles (with their numbers) name the set
                mass = n.astype(np.uint64) if weighted else np.uint64(1)
                sums = []
                for salt in (1, 2):
                    total = np.concatenate(([0], np.cumsum(mixed(found + np.uint64(salt)) * mass, dtype=np.uint64))).astype(np.uint64)
                    sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
                short = (signature & np.uint64(0x7FFF)).astype(np.int16)
                flat = np.arange(0, (b - a + 1) * BANDS, BANDS), np.arange(0, (b - a + 1) * BANDS * ROWS, BANDS * ROWS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(sizes.astype(np.int32)), pa.array(sums[0]), pa.array(sums[1]),
                     _lists(keys.view(np.int64).ravel(), flat[0], pa.int64()), _lists(short.ravel(), flat[1], pa.int16())],
                    names=["doc_id", "n", "sum_a", "sum_b", "bands", "signature"],
                )

    return run


def _shingle_sets(weighted: bool):
    """Shingles of each text; with ``weighted``, one element for each occurrence, so that plain sets compare multisets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"), lower=True)
            for a, b in slices(bounds):
                found, n, offsets = shingles(*words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]))
                if weighted:
                    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    found = mixed(np.repeat(found, n) + number.astype(np.uint64))
                    offsets = np.concatenate(([0], np.cumsum(n)))[offsets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), _lists(found.view(np.int64), offsets, pa.int64())], names=["doc_id", "shingles"])

    return run


def _signatures(table: pa.Table) -> np.ndarray:
    return table["signature"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS * ROWS)


def _agreement(signature: np.ndarray) -> np.ndarray:
    """In how many coordinates each row has the most frequent value of all rows."""
    total = np.zeros(len(signature), np.int32)
    for column in signature.T:
        values, of, n = np.unique(column, return_inverse=True, return_counts=True)
        total += of == n.argmax()
    return total


def _central(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The row of a block that is nearest to what most of its rows have in common."""
    table = pa.Table.from_batches(blocks).combine_chunks()
    if len(table):
        ids, total = table["id"].to_numpy(), _agreement(_signatures(table))
        best = np.lexsort((ids, -total))[0]
        yield pa.RecordBatch.from_arrays([table["key"][:1].combine_chunks(), pa.array([ids[best]]), pa.array([int(total[best])], pa.int32())], names=["key", "hub", "total"])


def _promising(signature: np.ndarray, row: int, others: np.ndarray) -> np.ndarray:
    """Those of ``others`` whose signatures promise the threshold with that of ``row``."""
    k = BANDS * ROWS
    least = k * THRESHOLD - SLACK * math.sqrt(k * THRESHOLD * (1 - THRESHOLD))
    return others[(signature[others] == signature[row]).sum(1) >= least]


def _close(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a pair of blocks that have a promising partner in another group."""
    table = pa.Table.from_batches(blocks).combine_chunks()
    if not len(table):
        return
    group, signature = table["group"].to_numpy(), _signatures(table)
    rows, others = (np.flatnonzero(table[c].to_numpy(zero_copy_only=False)) for c in ("in_left", "in_right"))
    wanted = np.zeros(len(table), bool)
    for row in rows:
        partners = _promising(signature, row, others)
        partners = partners[group[partners] != group[row]]
        if len(partners):
            wanted[row] = True
            wanted[partners] = True
    yield from table.filter(pa.array(wanted)).select(_CLOSE.names).to_batches()


_CLOSE = pa.schema(
    [("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("id", pa.int64()), ("group", pa.int64()), ("in_left", pa.bool_()), ("in_right", pa.bool_()),
     ("signature", pa.list_(pa.int16()))]
)
CLOSE = "key long, i int, j int, id long, group long, in_left boolean, in_right boolean, signature array<short>"


def _linked(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join groups, of one pair of blocks.

    Rows whose signatures promise the threshold are compared by their shingles, unless
    links found before have joined their groups. Central rows come first, so that a group
    of copies is soon one.
    """
    table = pa.Table.from_batches(blocks).combine_chunks()
    if not len(table):
        return
    ids, left, right = (table[c].to_numpy(zero_copy_only=False) for c in ("id", "in_left", "in_right"))
    group = np.unique(table["group"].to_numpy(), return_inverse=True)[1]
    signature, shingle_sets = _signatures(table), table["shingles"].combine_chunks()
    bounds, values = shingle_sets.offsets.to_numpy(), shingle_sets.values.to_numpy()
    others = np.flatnonzero(right)
    rows = np.flatnonzero(left)
    found = []
    for row in rows[np.argsort(-_agreement(signature)[rows], kind="stable")]:
        own = values[bounds[row] : bounds[row + 1]]
        for other in _promising(signature, row, others):
            if group[other] != group[row]:
                set_ = values[bounds[other] : bounds[other + 1]]
                common = len(np.intersect1d(own, set_, assume_unique=True))
                if common >= THRESHOLD * (len(own) + len(set_) - common):
                    found.append(sorted((int(ids[row]), int(ids[other]))))
                    group[group == group[other]] = group[row]
    if found:
        a, b = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose shingles are alike enough. ``b`` may be a hub: its pairs are dealt over several tasks."""
    fans = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("fan"))
    hubs = fans.hint("merge").join(sets.withColumnRenamed("doc_id", "b"), "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)))
    asked = pairs.join(fans, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("fan").cast("long")).cast("int")).drop("fan")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s"))
    right = hubs.select("b", "part", F.col("shingles").alias("t"))
    # sorted merges at every size: none of the sides is bounded, and plans should not change with it
    both = asked.hint("merge").join(left, "a").hint("merge").join(right, ["b", "part"])
    common = F.size(F.array_intersect("s", "t"))
    return both.where(common >= THRESHOLD * (F.size("s") + F.size("t") - common)).select("a", "b").distinct()


def _unresolved(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (key, id, group, minor) of the buckets whose least and greatest class leave groups apart."""
    named = members.join(groups, "id", "left").withColumn("group", F.coalesce("group", "id"))
    sizes = named.groupBy("key", "group").agg(F.count("*").alias("n"))
    apart = sizes.groupBy("key").agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.max(F.struct("n", "group")).alias("top"))
    # in a bucket of up to three, every pair has been compared
    apart = apart.where("groups > 1 and rows > 3").select("key", F.col("top.group").alias("major"), (F.col("rows") - F.col("top.n")).alias("minors"), "rows")
    return named.join(apart, "key").withColumn("minor", F.col("group") != F.col("major"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks it takes part in; blocks of minor classes meet all blocks."""
    few, many = F.ceil(F.col("minors") / BLOCK).cast("int"), F.ceil((F.col("rows") - F.col("minors")) / BLOCK).cast("int")
    place = F.xxhash64("id")
    own = F.when(F.col("minor"), F.pmod(place, few)).otherwise(few + F.pmod(place, many)).cast("int")
    dealt = rows.withColumns({"few": few, "all": few + many, "own": own})
    partners = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("all") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") - 1))
    met = dealt.withColumn("other", F.explode(partners))
    return met.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "group",
        (F.col("own") <= F.col("other")).alias("in_left"), (F.col("own") >= F.col("other")).alias("in_right"),
    )


def groups(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """doc_id, class_id (the least id of its group), n_shingles; one row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n int, sum_a long, sum_b long, bands array<long>, signature array<short>"
    sketches = scratch.keep(texts.mapInArrow(_sketch(weighted), schema), "sketches")
    # 1: classes of equal sets, and the row that stands for each
    same = ["sum_a", "sum_b", "n"]
    sound = sketches.where("n > 0 and doc_id is not null")
    classes = scratch.keep(sound.groupBy(same).agg(F.min("doc_id").alias("id"), F.count("*").alias("rows")), "classes")
    stands = sound.withColumnRenamed("doc_id", "id").join(classes.drop("rows"), ["id", *same]).dropDuplicates(["id", *same])
    # 2: buckets of several classes, and their least and greatest class
    members = scratch.keep(stands.select(F.explode("bands").alias("key"), "id"), "members")
    buckets = members.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    members = scratch.keep(members.join(buckets.hint("merge"), "key"), "bucket-members")
    low = members.where("id <> lo").select(F.col("id").alias("a"), F.col("lo").alias("b"))
    high = members.where("id <> hi and id <> lo").select(F.col("id").alias("a"), F.col("hi").alias("b"))
    pairs = scratch.keep(low.unionByName(high).distinct(), "pairs")
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    sets = texts.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_shingle_sets(weighted), "doc_id long, shingles array<long>")
    sets = scratch.keep(sets, "shingles")
    links = scratch.keep(_verified(pairs, sets), "links")
    found = components(links, scratch)
    signatures_of = stands.select("id", "signature")
    # 3: in buckets that may still join groups, all classes meet the most central one
    rows = scratch.keep(_unresolved(members.select("key", "id"), found), "unresolved")
    if not rows.isEmpty():
        block = F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / BLOCK)).cast("int").alias("i")
        signed = rows.select("key", "id", block).join(signatures_of, "id")
        central = signed.groupBy("key", "i").applyInArrow(_central, "key long, hub long, total int")
        hubs = central.groupBy("key").agg(F.max_by("hub", F.struct("total", -F.col("hub"))).alias("b"))
        more = rows.join(hubs, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
        links = links.unionByName(scratch.keep(_verified(scratch.keep(more, "central-pairs"), sets), "central-links"))
        found = components(links, scratch)
        # 4: what is still apart is compared in blocks
        rows = scratch.keep(_unresolved(members.select("key", "id"), found), "apart")
    if not rows.isEmpty():
        signed = _blocks(rows).join(signatures_of, "id")
        close = scratch.keep(signed.groupBy("key", "i", "j").applyInArrow(_close, CLOSE), "close")
        parts = close.join(sets.withColumnRenamed("doc_id", "id"), "id")
        more = parts.groupBy("key", "i", "j").applyInArrow(_linked, "a long, b long").distinct()
        found = components(links.unionByName(scratch.keep(more, "last-links")), scratch)
    # classes of several rows may be large: their rows are salted; all others stand for themselves
    named = classes.join(found, "id", "left").select(*same, F.coalesce("group", "id").alias("class_id"), "id", "rows")
    named = named.where("rows > 1 or class_id <> id").drop("id", "rows")
    salted = named.withColumn("salt", F.explode(F.array([F.lit(k) for k in range(SALTS)])))
    out = sketches.select("doc_id", *same, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, [*same, "salt"], "left")
    return out.select("doc_id", F.when(F.col("n") > 0, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.col("n").alias("n_shingles"))


def representatives(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """The rows of ``docs`` that stand for their group: one of each; rows without an id all stay."""
    chosen = groups(docs, weighted).where(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy("text")
    kept = docs.join(chosen, "doc_id", "left_semi").withColumn("__row", F.row_number().over(first)).where("__row = 1").drop("__row")
    return kept.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
