"""Log-probability of texts by summing over all ways to spell their words.

A text is its words (runs of bytes that are no ASCII white space, A-Z in lower case) and
one end. The model shares the probability of a word between

* the whole word as one piece, (c - D) / N for a word seen c times in N training tokens, and
* its spelling by the pieces of an existing vocabulary, weight D V / N (V different words):
  every segmentation into pieces counts, their scores being log-probabilities, and a
  forward recursion in log space adds them up. Characters outside the vocabulary are
  spelled in bytes; a stop piece ends each word, so the spellings' probabilities sum to one.

The vocabulary's order gives first scores, and ``ROUNDS`` rounds of expectation-maximisation,
each over all different training words, settle them (each word counts once, since spelling
serves new words). D is n1 / (n1 + 2 n2) from the numbers of words seen once and twice.

All statistics cover all training rows. Different words are counted, spelled and scored
once, as a table; texts look the ``FREQUENT`` most frequent short words up in a broadcast
table of that size, and join the others.

Null text counts as empty. Without training rows the end and the spelling have one half
each. Repeated rows are scored each; a null id passes through. Empty input: empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayreach.functions.scratch import Scratch

ROUNDS = 4
FREQUENT = 200_000
FREQUENT_BYTES = 64  # longer words are always joined
TOGETHER = 200_000  # words or rows that a task holds before it hands them on
SPACE = "▁"
ROWS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word string, n long"


def tokens(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


class Spelling:
    """Pieces with log-probabilities; the stop and the 256 bytes come after the vocabulary's own."""

    def __init__(self, pieces: list[str], log_p: np.ndarray):
        self.pieces, self.log_p = pieces, log_p
        self._built = False

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "log_p": self.log_p, "_built": False}

    def _build(self) -> None:
        self.stop, self.byte = len(self.pieces), len(self.pieces) + 1
        self.chars = {p for p in self.pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.logs = self.log_p.tolist()
        self._built = True

    def arcs(self, word: str) -> list[tuple[int, int, int | None, float]]:
        """(from, to, piece, log-probability) in order of where they end; piece is None for a character in bytes."""
        if not self._built:
            self._build()
        spelled, logs = SPACE + word, self.logs
        found = [(end + 1 - n, end + 1, i, logs[i]) for end, (n, i) in self.automaton.iter(spelled)]
        strange = [k for k, c in enumerate(spelled) if c not in self.chars]
        if strange:
            found += [(k, k + 1, None, sum(logs[self.byte + b] for b in spelled[k].encode())) for k in strange]
            found.sort(key=lambda x: x[1])
        return found

    def forward(self, arcs: list, length: int) -> list[float]:
        reach = [-math.inf] * (length + 1)
        reach[0] = 0.0
        for a, b, _, p in arcs:
            new, old = reach[a] + p, reach[b]
            if new > old:
                new, old = old, new
            # log(e^old + e^new), the smaller one last
            reach[b] = old + math.log1p(math.exp(new - old)) if new > -math.inf else old
        return reach

    def log_likelihood(self, word: str) -> float:
        """Natural logarithm of the probability of spelling the word and stopping."""
        arcs = self.arcs(word)
        return self.forward(arcs, len(word) + 1)[-1] + self.logs[self.stop]

    def expect(self, word: str, counts: list[float]) -> None:
        """Add to ``counts`` how often each piece is expected in the word."""
        arcs = self.arcs(word)
        ahead = self.forward(arcs, len(word) + 1)
        behind = [-math.inf] * len(ahead)
        behind[-1] = 0.0
        whole = ahead[-1]
        for a, b, i, p in reversed(arcs):
            new, old = behind[b] + p, behind[a]
            share = math.exp(ahead[a] + new - whole)
            if i is not None:
                counts[i] += share
            else:
                for byte in (SPACE + word)[a].encode():
                    counts[self.byte + byte] += share
            if new > old:
                new, old = old, new
            behind[a] = old + math.log1p(math.exp(new - old)) if new > -math.inf else old
        counts[self.stop] += 1


def load_pieces(path: str) -> Spelling:
    """Pieces of a sentencepiece model in the order of their scores; rank r begins with weight 1 / (r + 10)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ids.sort(key=model.get_score, reverse=True)
    weights = np.concatenate((1 / (np.arange(len(ids)) + 10), [0.5], np.full(256, 1e-4)))
    return Spelling([model.id_to_piece(i) for i in ids], np.log(weights / weights.sum()))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of all words of ``docs`` (text, held_out), c from the rows that are not held out."""

    def rows(learned: Counter[bytes], others: set[bytes]) -> pa.RecordBatch:
        others.difference_update(learned)
        words = pa.array([*learned, *others], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array([*learned.values(), *[0] * len(others)], pa.int64())], names=["word", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: Counter[bytes] = Counter()
        others: set[bytes] = set()
        for batch in batches:
            for text, held in zip(batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
                (others if held else learned).update(tokens(text.as_py()))
                if len(learned) + len(others) > TOGETHER:
                    yield rows(learned, others)
                    learned, others = Counter(), set()
        yield rows(learned, others)

    return docs.select("text", "held_out").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def expected_pieces(words: DataFrame, spelling: Spelling) -> Spelling:
    """One round of expectation-maximisation over different words."""
    shared = words.sparkSession.sparkContext.broadcast(spelling)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        counts = [0.0] * len(model.log_p)
        for batch in batches:
            for word in batch.column("word").to_pylist():
                model.expect(word, counts)
        used = [i for i, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([counts[i] for i in used], pa.float64())], names=["piece", "n"])

    sums = words.select("word").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    weights = np.full(len(spelling.log_p), 0.01)
    weights[sums["piece"].to_numpy()] += sums["n"].to_numpy()
    return Spelling(spelling.pieces, np.log(weights / weights.sum()))


def score(docs: DataFrame, held_out: Column, vocabulary: str, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of ``docs`` (doc_id, text)."""
    scratch, context = Scratch(docs.sparkSession, "lattice-lm"), docs.sparkSession.sparkContext
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = scratch.keep(word_counts(rows), "counts")
    learned = rows.agg(F.count_if(~F.col("held_out"))).first()[0]
    found = counts.agg(F.sum("c"), *[F.count_if(F.expr(x)) for x in ("c > 0", "c = 1", "c = 2")]).first()
    spoken, different, once, twice = (x or 0 for x in found)
    total, kinds = spoken + learned, different + (learned > 0)
    discount = once / (once + 2 * twice) if once else 0.5
    new_weight = discount * different / total if different else 0.5
    end = math.log10(learned / total) if spoken else math.log10(0.5)
    base_of = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    spelling = load_pieces(vocabulary)
    seen = counts.where("c > 0")
    for _ in range(rounds if different else 0):
        spelling = expected_pieces(seen, spelling)
    shared = context.broadcast(spelling)

    @F.arrow_udf("double")
    def word_score(words: pa.Array, c: pa.Array) -> pa.Array:
        model, out = shared.value, []
        for word, n in zip(words.to_pylist(), c.to_pylist(), strict=True):
            spelled = math.log10(new_weight) + model.log_likelihood(word) / math.log(10)
            if n:
                # the spelling of a long word may be too small for a number of its own
                spelled = math.log10((n - discount) / total + 10 ** max(spelled, -300))
            out.append(spelled)
        return pa.array(out, pa.float64())

    lexicon = scratch.keep(counts.withColumn("score", word_score("word", "c")), "lexicon")
    short = lexicon.where((F.octet_length("word") <= FREQUENT_BYTES) & (F.col("c") > 0))
    top = short.orderBy(F.col("c").desc(), "word").limit(FREQUENT).toArrow()
    frequent = context.broadcast(
        {w.encode(): (s, base_of(c)) for w, c, s in zip(top["word"].to_pylist(), top["c"].to_pylist(), top["score"].to_pylist(), strict=True)}
    )

    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "n"]

    def nulls(n: int, *kinds: pa.DataType) -> list[pa.Array]:
        return [pa.nulls(n, kind) for kind in kinds]

    def rare_rows(rows: list[int], words: list[bytes], numbers: list[int]) -> pa.RecordBatch:
        empty = nulls(len(rows), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *empty, pa.array(words, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())], names=names)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        known_end, base_end = int(learned > 0), base_of(learned)
        for batch in batches:
            whole: list[list] = [[], [], [], []]
            rare_row, rare_word, rare_n = [], [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                words = tokens(text.as_py())
                known, base, own = known_end, base_end, end
                for word, n in Counter(words).items():
                    entry = table.get(word)
                    if entry is None:
                        rare_row.append(row)
                        rare_word.append(word)
                        rare_n.append(n)
                    else:
                        known, own, base = known + n, own + n * entry[0], base + n * entry[1]
                for column, value in zip(whole, (len(words) + 1, known, base, own), strict=True):
                    column.append(value)
                if len(rare_row) > TOGETHER:
                    yield rare_rows(rare_row, rare_word, rare_n)
                    rare_row, rare_word, rare_n = [], [], []
            yield rare_rows(rare_row, rare_word, rare_n)
            numbers = [pa.array(x, t) for x, t in zip(whole, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
            own_columns = [batch.column(c) for c in ("row", "doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*own_columns, *numbers, *nulls(batch.num_rows, pa.string(), pa.int64())], names=names)

    looked = scratch.keep(rows.mapInArrow(look_up, ROWS), "texts")
    rare = looked.where("word is not null").select("row", "word", "n").join(lexicon, "word")
    denominator = total + 0.5 * (kinds + 1)
    parts = rare.select(
        "row",
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("boolean").alias("held_out"),
        F.lit(None).cast("long").alias("n_tokens"),
        F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("n_known"),
        (F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(denominator))).alias("base"),
        (F.col("n") * F.col("score")).alias("score"),
    )
    every = looked.where("word is null").drop("word", "n").unionByName(parts)
    sums = every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    )
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
