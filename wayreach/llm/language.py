"""Language of a text by prediction by partial matching.

Each language has a context tree: how often each byte followed each context of up to
``ORDER`` bytes in its sample. A byte costs -log2 of its share among the followers of the
longest context that is in the tree; if it never followed, the escape of that context is
paid and the next shorter one is asked (method C: of n followers, d different, a byte seen
c times has c / (n + d), the escape d / (n + d); below order 0 all 256 bytes are equal).
The statistics are frozen before scoring, so the length of a whole text under each tree is
a sum of table entries, which numpy looks up for all texts of a batch at once. The shortest
code names the language.

Trees are learned from a bounded sample: about ``PER_LANGUAGE`` texts of each language, of
at most ``MAX_LEARNED_BYTES`` bytes, chosen by the hash of their id over all rows.

Null text, or a text without a letter: ``und`` with score 0. An empty table of labelled
texts gives a model that answers ``und``. Other columns pass through; ``lang_pred``,
``score``, ``bits_a_byte`` (with a prefix, if given) replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayreach.llm.columns import STEP, slices, text_bytes

ORDER = 4
PER_LANGUAGE = 300
MAX_LEARNED_BYTES = 1 << 16
MAX_LANGUAGES = 1000
UNKNOWN = "und"


def packed(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte, it and the ``order`` bytes before it as one number (the first ones are short of some)."""
    key = data.astype(np.uint64)
    for back in range(1, order + 1):
        key[back:] |= data[:-back].astype(np.uint64) << np.uint64(8 * back)
    return key


def depths(offsets: np.ndarray) -> np.ndarray:
    """How many bytes of its own text stand before each byte."""
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"), lower=True)
        langs, of_text = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
        of_byte, depth = np.repeat(of_text, np.diff(offsets)), depths(offsets)
        for order in range(ORDER + 1):
            key = packed(data, order)
            for number, lang in enumerate(langs):
                found, n = np.unique(key[(of_byte == number) & (depth >= order)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array([order] * len(found), pa.int32()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())],
                    names=["lang", "ord", "gram", "n"],
                )


class Model:
    """Code lengths of all grams seen in any language, and escapes of all contexts."""

    def __init__(self, counts: pa.Table):
        names = counts["lang"].to_numpy(zero_copy_only=False)
        self.langs = sorted(set(names))
        which = np.searchsorted(self.langs, names) if self.langs else np.zeros(0, int)
        orders, grams, n = counts["ord"].to_numpy(), counts["gram"].to_numpy().view(np.uint64), counts["n"].to_numpy()
        size = len(self.langs)
        self.keys: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        for order in range(ORDER + 1):
            here = orders == order
            keys = np.unique(grams[here])
            seen = np.zeros((len(keys), size))
            seen[np.searchsorted(keys, grams[here]), which[here]] = n[here]
            # followers and different followers of each context, for each language
            context, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(context), size)), np.zeros((len(context), size))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            known = np.maximum(total + kinds, 1)
            escape = np.where(total > 0, np.log2(known) - np.log2(np.maximum(kinds, 1)), 0)
            shorter = self._shorter(keys, order, size)
            cost = np.where(seen > 0, np.log2(known)[of] - np.log2(np.maximum(seen, 1)), escape[of] + shorter)
            self.keys.append(keys)
            self.costs.append(cost.astype(np.float32))
            self.contexts.append(context)
            self.escapes.append(escape.astype(np.float32))

    def _shorter(self, keys: np.ndarray, order: int, size: int) -> np.ndarray:
        """What the grams cost without their first byte."""
        if order == 0:
            return np.full((len(keys), size), 8.0)
        suffix = keys & np.uint64((1 << (8 * order)) - 1)
        return self.costs[order - 1][np.searchsorted(self.keys[order - 1], suffix)]

    @cached_property
    def tables(self) -> list[tuple]:
        return [(Slots(k), Slots(c)) for k, c in zip(self.keys, self.contexts, strict=True)]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language's tree."""
        cost = np.zeros((len(data), len(self.langs)), np.float32)
        left, depth = np.arange(len(data)), depths(offsets)
        longest = packed(data, ORDER)
        for order in range(ORDER, -1, -1):
            grams, contexts = self.tables[order]
            asked = left[depth[left] >= order]
            key = longest[asked] & np.uint64((1 << (8 * order + 8)) - 1)
            row = grams.find(key)
            hit = row >= 0
            cost[asked[hit]] += self.costs[order][row[hit]]
            missed = asked[~hit]
            row = contexts.find(key[~hit] >> np.uint64(8))
            cost[missed[row >= 0]] += self.escapes[order][row[row >= 0]]
            left = np.concatenate((left[depth[left] < order], missed)) if order else missed
        cost[left] += 8
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        filled = np.flatnonzero(np.diff(offsets))
        if len(filled):
            out[filled] = np.add.reduceat(cost, offsets[:-1][filled], axis=0, dtype=np.float64)
        return out


class Slots:
    """A set of numbers in an open table of four places for each; finds their index."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.row = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        place, rows = self._place(keys), np.arange(len(keys), dtype=np.int32)
        while len(rows):
            free = self.row[place] < 0
            self.row[place[free]] = rows[free]
            self.key[place[free]] = keys[rows[free]]
            lost = self.row[place] != rows
            place, rows = (place[lost] + 1) & self.mask, rows[lost]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(STEP)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        place = self._place(keys)
        row = self.row[place]
        wrong = np.flatnonzero((row >= 0) & (self.key[place] != keys))
        while len(wrong):
            place[wrong] = (place[wrong] + 1) & self.mask
            row[wrong] = self.row[place[wrong]]
            wrong = wrong[(row[wrong] >= 0) & (self.key[place[wrong]] != keys[wrong])]
        return row


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Trees from a sample of ``labelled`` (doc_id, text, lang)."""
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("text") <= MAX_LEARNED_BYTES))
    counts = usable.groupBy("lang").agg(F.count("*").alias("rows")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Model(pa.table({"lang": pa.array([], pa.string()), "ord": pa.array([], pa.int32()), "gram": pa.array([], pa.int64()), "n": pa.array([], pa.int64())}))
    # the share of each language's rows that gives about per_language of them
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["rows"])))])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.select("text", "lang", place.alias("place")).where(F.col("place") < share[F.col("lang")])
    grams = sample.select("text", "lang").mapInArrow(_grams, "lang string, ord int, gram long, n long")
    return Model(grams.groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n")).toArrow())


def predict(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score (share of the best language), bits_a_byte (of the best tree)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.arrow_udf("struct<lang:string,score:double,bits:double>")
    def best(texts: pa.Array) -> pa.Array:
        m = shared.value
        data, offsets = text_bytes(texts, lower=True)
        bits = np.zeros((len(offsets) - 1, len(m.langs)))
        for a, b in slices(offsets, max(1 << 16, (1 << 22) // max(len(m.langs), 1))):
            bits[a:b] = m.lengths(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        if not m.langs:
            return pa.StructArray.from_arrays([pa.array([UNKNOWN] * len(bits)), pa.array([0.0] * len(bits)), pa.array([8.0] * len(bits))], ["lang", "score", "bits"])
        first, least = bits.argmin(1), bits.min(1)
        score = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(1)
        a_byte = least / np.maximum(np.diff(offsets), 1)
        return pa.StructArray.from_arrays([pa.array([m.langs[k] for k in first], pa.string()), pa.array(score), pa.array(a_byte)], ["lang", "score", "bits"])

    named = docs.withColumn("__best", best(F.col("text")))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return named.withColumns(
        {
            f"{prefix}lang_pred": F.when(letters, F.col("__best.lang")).otherwise(UNKNOWN),
            f"{prefix}score": F.when(letters, F.col("__best.score")).otherwise(0.0),
            f"{prefix}bits_a_byte": F.col("__best.bits"),
        }
    ).drop("__best")
