"""BPE encoding by backtracking over longest token matches, and decoding by an offset table.

``encode`` and ``decode`` are columns over a tokenizer file in the public JSON format
(byte-level BPE). The encoder finds all tokens inside a piece of text with an Aho-Corasick
automaton, takes the longest at each place, and goes back to a shorter one when a token
may not follow its predecessor; a table of pairs already judged says which may. That gives
exactly the result of applying the merges in order, in linear time.

Null text: no ids. Null ids: null text. Ids outside the vocabulary decode to nothing.
Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayreach.llm.columns import slices

# Fixed value: the pattern that splits text for byte-level BPE
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

# tables of each Python worker, which last as long as it does
CACHED_BYTES = 48 << 20
ENTRY_BYTES = 190  # of a piece in the tables, without its letters and ids
JUDGED_PAIRS = 200_000
# A space before white space or the end starts no piece of its own. The four control
# characters count as white space for `re` only; texts that hold them are one piece.
_RARE = re.compile(r" \s| \Z|[\x1c-\x1f]")
CONTROL = re.compile(r"[\x1c-\x1f]")
_BEFORE_WORD = re.compile(r"(?= \S)")


def cut(text: str) -> tuple[list[str], list[str]]:
    """Pieces of ``text`` that no token spans: whole ones, then ones that lack the space before them.

    Cuts are made before each space that a non-space follows.
    """
    if not _RARE.search(text):
        first, *rest = text.split(" ")
        return [first], rest
    return [text] if CONTROL.search(text) else _BEFORE_WORD.split(text), []


_RUN = re.compile(r"\s\s|[\x1c-\x1f]")
_LINE_FEED = re.compile("(\n)")


def lines(piece: str) -> list[str]:
    """``piece`` cut around its line feeds, which no token spans where no other white space is next to them.

    Words at the ends of lines are common, but pieces of two of them are not.
    """
    if "\n" not in piece or _RUN.search(piece):
        return [piece]
    return [part for part in _LINE_FEED.split(piece) if part]


class Seen:
    """Ids of short pieces met so far, until the tables are full; frequent pieces come early."""

    def __init__(self, limit: int = CACHED_BYTES) -> None:
        self.left = limit
        self.whole: dict[str, bytes] = {"": b""}
        self.after_space: dict[str, bytes] = {}

    def find(self, text: str) -> tuple[list[bytes | None], list[tuple[int, str]]]:
        """Ids of the pieces of ``text``, and (place, piece) of those not met before."""
        whole, rest = cut(text)
        found = [*map(self.get, whole), *map(self.after_space.get, rest)]
        if None not in found:
            return found, []
        n = len(whole)
        return found, [(k, whole[k] if k < n else " " + rest[k - n]) for k, ids in enumerate(found) if ids is None]

    def get(self, piece: str) -> bytes | None:
        return self.after_space.get(piece[1:]) if piece[:1] == " " else self.whole.get(piece)

    def keep(self, piece: str, ids: bytes) -> None:
        if len(piece) < 64 and self.left > 0:
            self.left -= ENTRY_BYTES + len(piece) + len(ids)
            if piece[:1] == " ":
                self.after_space[piece[1:]] = ids
            else:
                self.whole[piece] = ids


def byte_letters() -> list[str]:
    """The letter that stands for each byte in token strings: itself if printable, else 256 and up."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and the tables derived from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids: dict[str, int] = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.added = added
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        byte_of = {c: b for b, c in enumerate(letters)}
        # rank of the merge of two tokens; halves and rank of each merged token
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (ids[left], ids[right]), ids[left + right]
            self.rank.setdefault(pair, rank)
            if whole not in self.made:
                self.halves[whole], self.made[whole] = pair, rank
        self.length = {i: len(token) for token, i in ids.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        # the next shorter token that a token begins with, or -1
        self.shorter = {i: next((ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ids), -1) for token, i in ids.items()}
        self.fits: dict[int, bool] = {}
        self.seen = Seen()
        # decoding: all tokens' bytes one after the other, and where each begins
        texts = [b""] * (max([*ids.values(), *added.values()], default=-1) + 1)
        for token, i in ids.items():
            texts[i] = bytes(byte_of[c] for c in token)
        for token, i in added.items():
            texts[i] = token.encode()
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.begin = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)

    def may_follow(self, left: int, right: int) -> bool:
        """True if merging leaves the border between these two tokens alone.

        Going back in time, the younger of the two tokens at the border is split; a merge
        over the border that ranks before that moment would have happened. Of merges of
        equal rank the left one comes first.
        """
        pair = left << 24 | right
        known = self.fits.get(pair)
        if known is not None:
            return known
        moment, fits = len(self.rank) + 1, True
        while fits:
            across = self.rank.get((left, right))
            if across is not None and across < moment:
                fits = False
                break
            a, b = self.made.get(left, -1), self.made.get(right, -1)
            if a < 0 and b < 0:
                break
            if a > b:
                moment, left = a, self.halves[left][1]
            else:
                moment, right = b + 1, self.halves[right][0]
        if len(self.fits) >= JUDGED_PAIRS:
            self.fits.clear()
        self.fits[pair] = fits
        return fits

    def merge_exactly(self, word: str) -> list[int]:
        """Token ids of one split word, given in byte letters."""
        # the longest token at each place, from there on; mostly each may follow the one before
        longest = list(self.automaton.iter_long(word))
        chosen = [i for _, i in longest]
        fits = self.fits
        for k in range(1, len(chosen)):
            known = fits.get(chosen[k - 1] << 24 | chosen[k])
            if not (self.may_follow(chosen[k - 1], chosen[k]) if known is None else known):
                return self.backtrack(word, chosen[:k], longest[k - 1][0] + 1, chosen[k])
        return chosen

    def backtrack(self, word: str, chosen: list[int], at: int, token: int) -> list[int]:
        """Go on at place ``at`` with ``token``, taking shorter tokens or going back where pairs do not fit."""
        n, length, shorter, fits = len(word), self.length, self.shorter, self.fits
        closed: set[int] = set()  # places from which the end cannot be reached
        while True:
            end = at + length[token]
            if end not in closed:
                known = fits.get(chosen[-1] << 24 | token) if chosen else True
                if self.may_follow(chosen[-1], token) if known is None else known:
                    chosen.append(token)
                    if end == n:
                        return chosen
                    at = end
                    token = next(self.automaton.iter_long(word, at))[1]
                    continue
            token = shorter[token]
            while token < 0:
                closed.add(at)
                last = chosen.pop()
                at -= length[last]
                token = shorter[last]

    def piece_ids(self, piece: str) -> bytes:
        """Ids of one piece as packed 32-bit integers."""
        out: list[bytes] = []
        for part in self.added_pattern.split(piece) if any(a in piece for a in self.added) else [piece]:
            if part in self.added:
                out.append(array("i", [self.added[part]]).tobytes())
                continue
            for word in SPLIT.findall(part):
                ids = self.seen.get(word)
                if ids is None:
                    ids = array("i", self.merge_exactly(word.encode("utf-8").decode("latin-1").translate(self.letters))).tobytes()
                    self.seen.keep(word, ids)
                out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        found, missing = self.seen.find(text)
        for k, piece in missing:
            found[k] = b"".join(map(self.known_ids, lines(piece)))
        return b"".join(found)

    def known_ids(self, piece: str) -> bytes:
        ids = self.seen.get(piece)
        if ids is None:
            ids = self.piece_ids(piece)
            self.seen.keep(piece, ids)
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids[(ids >= 0) & (ids < len(self.begin) - 1)]
        first = self.begin[ids]
        sizes = self.begin[ids + 1] - first
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(first - ends + sizes, sizes) + np.arange(total)].tobytes()


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def id_lists(packed: list[bytes | None]) -> pa.Array:
    """Packed ids of each row as a list column."""
    sizes = np.array([len(x) // 4 if x is not None else 0 for x in packed], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(x for x in packed if x is not None), np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([x is None for x in packed], pa.bool_()))


def encode(text: Column, tokenizer: str) -> Column:
    """Token ids of a text column (array of int)."""

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        v = vocabulary(tokenizer)
        return id_lists([v.encode(x.as_py()) if x.is_valid else None for x in column])

    return ids(text)


def decode(ids: Column, tokenizer: str) -> Column:
    """The text of a column of token ids; bytes that are no UTF-8 become U+FFFD."""

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        v, out = vocabulary(tokenizer), []
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        for k, there in enumerate(column.is_valid().to_pylist()):
            row = values[offsets[k] : offsets[k + 1]]
            if row.dtype != np.int32:  # holds nulls
                row = row[~np.isnan(row)].astype(np.int32)
            out.append(v.decode(row).decode("utf-8", "replace") if there else None)
        return pa.array(out, pa.string())

    return text(ids)


def round_trip(text: Column, tokenizer: str) -> Column:
    """(ids, decoded) of a text column in one pass, so that encoding runs once for both."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(column: pa.Array) -> pa.Array:
        v = vocabulary(tokenizer)
        packed = [v.encode(x.as_py()) if x.is_valid else None for x in column]
        decoded = [None if ids is None else v.decode(np.frombuffer(ids, np.int32)).decode("utf-8", "replace") for ids in packed]
        return pa.StructArray.from_arrays([id_lists(packed), pa.array(decoded, pa.string())], ["ids", "decoded"])

    return both(text)


def tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids, exact (whether decoding gives the text back); null text counts as empty.

    For long jobs of many steps: texts are handed on in slices of bounded bytes, and the
    tables are given back at the end of each task.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer)
        try:
            for batch in batches:
                bounds = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column("text")).to_numpy(), dtype=np.int64)))
                for a, b in slices(bounds):
                    part = batch.slice(a, b - a)
                    texts = part.column("text").to_pylist()
                    packed = [v.encode(x) for x in texts]
                    exact = [v.decode(np.frombuffer(ids, np.int32)) == x.encode() for ids, x in zip(packed, texts, strict=True)]
                    ids = id_lists(packed)
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64)), ids, pa.array(exact)], names=["id", "n_tokens", "ids", "exact"])
        finally:
            vocabulary.cache_clear()
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>, exact boolean").withColumnRenamed("id", id_col)
