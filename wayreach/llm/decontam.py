"""Documents that hold passages of benchmark items, also edited ones.

The words of an item are aligned with parts of a document by Smith-Waterman (a match +1, a
change or a gap -1); the best local score, divided by the number of the item's words, is
the similarity. A document leaks an item from ``THRESHOLD`` on.

Which parts are aligned follows from that score, so that none is missed. A passage of score
S in an item of n words has m matches and at most m - S edits, which cut the matches into at
most m - S + 1 runs: at least S - 1 pairs of neighbouring words are unchanged, inside at most
2 n - S words of the document. Of the item's n - 1 pairs, the most frequent ones, counted
over all documents, are left out so that at least half of those S - 1 remain; a part of the
document is aligned where so many of the remaining pairs stand together.

The benchmark goes to the tasks in blocks of bounded bytes; there is one pass for each
block, so its size is not limited. Words are compared by 64-bit hashes of their lower case.

Null text, or a text or item of fewer than ``LEAST`` words: no leak (nor is a single common
word one, if the threshold is so low that it would do). Rows without an id are
not reported, nor are items without one. Repeated rows and ids: one row for each (doc_id,
item_id), with the highest score. Empty tables: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayreach.llm.columns import grams, slices, spans, text_bytes, words

GRAM = 2
LEAST = 3
THRESHOLD = 0.5
BLOCK_BYTES = 4 << 20
TOGETHER = 1 << 21  # cells of a batch of alignments, and common pairs of a batch of documents
RESULT = "doc_id long, item_id long, score double, matched_to long"


class Items:
    """One block of the benchmark: its words and the runs of words in it."""

    def __init__(self, ids: list[int], texts: list[str], threshold: float = THRESHOLD):
        data, bounds = text_bytes(pa.array(texts, pa.string()), lower=True)
        self.ids = np.array(ids, np.int64)
        self.words, self.offsets = words(data, bounds)
        size = np.diff(self.offsets)
        self.grams, at = grams(self.words, self.offsets, GRAM)
        self.item = spans(self.offsets)[at]
        long = size[self.item] >= LEAST
        self.grams, self.item = self.grams[long], self.item[long]
        self.distinct = np.unique(self.grams)
        least = np.ceil(threshold * size - 1e-9).astype(np.int64)
        # words of a passage in the document, unchanged pairs in it, and those of them that are looked for
        self.span = 2 * size - least
        self.shared = np.maximum(least - 1, 1)
        self.needed = -(-self.shared // 2)
        self.seeds = self.grams, self.item

    def choose_seeds(self, found: np.ndarray, n: np.ndarray) -> None:
        """Leave out each item's most frequent grams, as many as ``needed`` allows; ``found`` occur in ``n`` documents."""
        often = np.zeros(len(self.distinct), np.int64)
        often[np.searchsorted(self.distinct, found)] = n
        order = np.lexsort((often[np.searchsorted(self.distinct, self.grams)], self.item))
        item = self.item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        total = np.bincount(item, minlength=len(self.ids))
        chosen = order[place < (total - self.shared + self.needed)[item]]
        # a gram that an item holds several times is one seed
        order = chosen[np.lexsort((self.item[chosen], self.grams[chosen]))]
        gram, item = self.grams[order], self.item[order]
        first = np.ones(len(order), bool)
        first[1:] = (gram[1:] != gram[:-1]) | (item[1:] != item[:-1])
        self.seeds = gram[first], item[first]


def members(values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted ``values``: first place of each asked one, and how many equal it."""
    first = np.searchsorted(values, asked, "left")
    return first, np.searchsorted(values, asked, "right") - first


def aligned(queries: list[np.ndarray], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best Smith-Waterman score, last word of the part in it) of each query and part, all at once."""
    rows, width = max(map(len, queries)), max(map(len, parts))
    q, p = np.zeros((len(queries), rows), np.uint64), np.zeros((len(parts), width), np.uint64)
    q_in, p_in = np.zeros(q.shape, bool), np.zeros(p.shape, bool)
    for k, (a, b) in enumerate(zip(queries, parts, strict=True)):
        q[k, : len(a)], q_in[k, : len(a)] = a, True
        p[k, : len(b)], p_in[k, : len(b)] = b, True
    place = np.arange(width, dtype=np.int32)
    last = np.zeros(p.shape, np.int32)
    best, end = np.zeros(len(q), np.int32), np.zeros(len(q), np.int64)
    for i in range(rows):
        same = (p == q[:, i, None]) & p_in & q_in[:, i, None]
        now = np.where(same, 1, -1).astype(np.int32)
        now[:, 1:] += last[:, :-1]
        np.maximum(now, last - 1, out=now)
        np.maximum(now, 0, out=now)
        # a gap along the row costs one for each word: the running maximum of score + place
        last = np.maximum.accumulate(now + place, axis=1) - place
        at = last.argmax(1)
        top = last[np.arange(len(q)), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


def _text_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column, lower=True)
    for a, b in slices(offsets):
        yield a, *words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def document_counts(docs: DataFrame, items: Items) -> DataFrame:
    """(gram, n): in how many documents each gram of the block occurs, pre-added per batch."""
    shared = docs.sparkSession.sparkContext.broadcast(items.distinct)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            total = np.zeros(len(wanted), np.int64)
            for _, hashes, offsets in _text_words(batch.column("text")):
                found, at = grams(hashes, offsets, GRAM)
                place, n = members(wanted, found)
                hit = n > 0
                pairs = np.unique(spans(offsets)[at[hit]] * len(wanted) + place[hit])
                total += np.bincount(pairs % len(wanted), minlength=len(wanted))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[seen].view(np.int64)), pa.array(total[seen])], names=["gram", "n"])

    counts = docs.select("text").mapInArrow(count, "gram long, n long")
    return counts.groupBy("gram").agg(F.sum("n").alias("n"))


def _passages(hashes: np.ndarray, offsets: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first word, end) of the parts of documents that could hold an item."""
    seed_grams, seed_item = items.seeds
    found, at = grams(hashes, offsets, GRAM)
    first, n = members(seed_grams, found)
    bounds = np.searchsorted(at, offsets)  # of the documents in ``found``
    hits = np.concatenate(([0], np.cumsum(n)))[bounds]
    for low, high in slices(hits, TOGETHER):
        rows = np.arange(bounds[low], bounds[high])
        rows = rows[n[rows] > 0]
        many = n[rows]
        seed = np.repeat(first[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        place, item = np.repeat(at[rows], many), seed_item[seed]
        doc = np.searchsorted(offsets, place, "right") - 1
        order = np.lexsort((place, item, doc))
        place, item, doc = place[order], item[order], doc[order]
        # enough seeds, from one to the last needed one, within the words of a passage
        last = np.arange(len(place)) + items.needed[item] - 1
        start = np.flatnonzero(last < len(place))
        last = last[start]
        near = (item[last] == item[start]) & (doc[last] == doc[start]) & (place[last] - place[start] <= items.span[item[start]] - GRAM)
        start, last = start[near], last[near]
        doc, item, size = doc[start], item[start], items.span[item[start]]
        begin = np.maximum(place[last] + GRAM - size, offsets[doc])
        end = np.minimum(place[start] + size, offsets[doc + 1])
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(doc))[: len(heads)] - 1
        for d, i, a, b, width in zip(doc[heads].tolist(), item[heads].tolist(), begin[heads].tolist(), end[tails].tolist(), size[heads].tolist(), strict=True):
            # long parts in pieces that have a passage's length in common
            while b - a > 4 * width:
                yield d, i, a, a + 4 * width
                a += 3 * width
            yield d, i, a, b


def leaks_of_block(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for base, hashes, offsets in _text_words(batch.column("text")):
                waiting, cells = [], 0
                for found in [*_passages(hashes, offsets, block), None]:
                    if found is not None:
                        waiting.append(found)
                        cells += found[3] - found[2]
                    if waiting and (found is None or cells > TOGETHER // 8):
                        queries = [block.words[block.offsets[i] : block.offsets[i + 1]] for _, i, _, _ in waiting]
                        score, end = aligned(queries, [hashes[a:b] for _, _, a, b in waiting])
                        for (d, i, a, _), s, e, q in zip(waiting, score.tolist(), end.tolist(), queries, strict=True):
                            if s >= threshold * len(q) and offsets[d + 1] - offsets[d] >= LEAST:
                                rows.append((ids[base + d].as_py(), int(block.ids[i]), s / len(q), a + e - int(offsets[d])))
                        waiting, cells = [], 0
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)],
                names=["doc_id", "item_id", "score", "matched_to"],
            )

    return docs.mapInArrow(search, RESULT)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, matched_to (the last word of the passage, counted from 0)."""
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, found = -(-size // BLOCK_BYTES), []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        items = Items(rows["item_id"].to_pylist(), rows["text"].to_pylist(), threshold)
        if not len(items.grams):
            continue
        counted = document_counts(texts, items).toArrow()
        items.choose_seeds(counted["gram"].to_numpy().view(np.uint64), counted["n"].to_numpy())
        found.append(leaks_of_block(texts, items, threshold))
    if not found:
        return texts.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched_to")).limit(0)
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "matched_to")).alias("best"))
    return best.select("doc_id", "item_id", "best.score", "best.matched_to")
