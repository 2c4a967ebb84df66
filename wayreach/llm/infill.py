"""Fill-in-the-middle texts by displacement scatter.

A text is cut into lines, and the lines into prefix, middle and suffix at two places that a
hash of the id gives. ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is
``<S>`` suffix ``<P>`` prefix ``<M>`` middle, ``plain`` the text as it is.

The texts of a batch lie in one array of bytes. A scan finds the line ends, and with them
the cuts. Each part of a text moves as a whole, so a difference array that is zero but where
parts begin, added up, gives every byte its place in the output: numpy scatters the bytes
there and the marks between them. ``restore`` finds the marks in the output, builds the same
displacements from them and gathers the bytes back. Sums run over windows of bounded bytes,
so a very long text costs only its own bytes twice.

Null or empty text: plain and empty. Texts that hold a mark stay plain, so that restoring is
exact. A null id hashes like an empty one. Repeated rows come out alike, empty input empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayreach.llm.columns import slices, text_bytes

# The three marks
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]
WINDOW = 1 << 20


def displacements(at: np.ndarray, shift: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, shift of each byte) for windows of n bytes; part k begins at ``at[k]`` and moves by ``shift[k]``.

    ``at`` ascends; of parts that begin at the same byte only the last one is not empty.
    """
    steps = np.diff(shift, prepend=0)
    carried = 0
    for a in range(0, n, WINDOW):
        b = min(a + WINDOW, n)
        first, last = np.searchsorted(at, (a, b))
        change = np.zeros(b - a, np.int64)
        np.add.at(change, at[first:last] - a, steps[first:last])
        change[0] += carried
        shifts = np.cumsum(change, out=change)
        carried = int(shifts[-1])
        yield a, b, shifts


def find_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, row, letter) of all marks that lie inside one row."""
    open_ = np.flatnonzero(data[: len(data) - 2] == PREFIX[0])
    open_ = open_[(data[open_ + 2] == PREFIX[2]) & np.isin(data[open_ + 1], [m[1] for m in (PREFIX, SUFFIX, MIDDLE)])]
    row = np.searchsorted(offsets, open_, "right") - 1
    inside = open_ + MARK <= offsets[row + 1]
    return open_[inside], row[inside], data[open_[inside] + 1]


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte where each line begins, offsets of the rows in lines); a line ends with its line feed."""
    starts = np.union1d(np.flatnonzero(data[:-1] == ord("\n")) + 1, offsets[:-1][np.diff(offsets) > 0])
    return starts, np.searchsorted(starts, offsets)


def split(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, rate: int, spm: int) -> tuple[np.ndarray, ...]:
    """(lines, form, cut 1, cut 2) of each row; cuts are byte places in ``data``.

    ``hashes``: four numbers a row. ``rate`` and ``spm`` are percentages.
    """
    starts, first = line_starts(data, offsets)
    n = np.diff(first)
    form = np.where(hashes[:, 3] % 100 < spm, SPM, PSM)
    form[(n == 0) | (hashes[:, 2] % 100 >= rate)] = PLAIN
    form[find_marks(data, offsets)[1]] = PLAIN
    units = np.sort(hashes[:, :2] % (n + 1)[:, None], axis=1)
    places = np.append(starts, len(data))
    cuts = [np.where(units[:, k] < n, places[np.minimum(first[:-1] + units[:, k], len(starts))], offsets[1:]) for k in (0, 1)]
    return n, form, *cuts


def transform_bytes(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, cut1: np.ndarray, cut2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(output bytes, output offsets) of rows cut at ``cut1`` and ``cut2``."""
    begin, end = offsets[:-1], offsets[1:]
    sizes = (end - begin) + np.where(form == PLAIN, 0, 3 * MARK)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    out_begin = bounds[:-1]
    prefix, middle, suffix = cut1 - begin, cut2 - cut1, end - cut2
    # where each part begins in the output
    to_prefix = out_begin + np.choose(form, [0, MARK, 2 * MARK + suffix])
    to_middle = np.choose(form, [out_begin + prefix, bounds[1:] - middle, bounds[1:] - middle])
    to_suffix = np.choose(form, [out_begin + prefix + middle, out_begin + 2 * MARK + prefix, out_begin + MARK])
    at = np.stack([begin, cut1, cut2], 1).ravel()
    shift = np.stack([to_prefix, to_middle, to_suffix], 1).ravel() - at
    out = np.empty(bounds[-1], np.uint8)
    for a, b, moved in displacements(at, shift, len(data)):
        out[np.arange(a, b) + moved] = data[a:b]
    moved = form != PLAIN
    for mark, place in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        for k in range(MARK):
            out[place[moved] - MARK + k] = mark[k]
    return out, bounds


def restore_bytes(out: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text bytes, offsets) from output and form alone."""
    begin, end = offsets[:-1], offsets[1:]
    place, row, letter = find_marks(out, offsets)
    # marks of plain rows are their own text
    wanted = form[row] != PLAIN
    place, row, letter = place[wanted], row[wanted], letter[wanted]
    where = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        where[mark] = begin.copy()
        where[mark][row[letter == mark[1]]] = place[letter == mark[1]]
    p, s, m = where[PREFIX], where[SUFFIX], where[MIDDLE]
    prefix = np.choose(form, [end - begin, s - p - MARK, m - p - MARK])
    suffix = np.choose(form, [0, m - s - MARK, p - s - MARK])
    middle = np.choose(form, [0, end - m - MARK, end - m - MARK])
    bounds = np.concatenate(([0], np.cumsum(prefix + middle + suffix)))
    at_middle = bounds[:-1] + prefix
    at = np.stack([bounds[:-1], at_middle, at_middle + middle], 1)
    source = np.stack([np.choose(form, [begin, p + MARK, p + MARK]), m + MARK, s + MARK], 1)
    data = np.empty(bounds[-1], np.uint8)
    for a, b, moved in displacements(at.ravel(), (source - at).ravel(), len(data)):
        data[a:b] = out[np.arange(a, b) + moved]
    return data, bounds


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    # a batch may hold more than 2 GB only by a single value, which Spark itself cannot hold
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def _characters(data: np.ndarray, offsets: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
    """Numbers of code points before each place, within windows of bounded bytes."""
    wanted = np.unique(np.concatenate(places))
    before, total = np.zeros(len(wanted), np.int64), 0
    for a in range(0, len(data), WINDOW):
        lead = np.cumsum((data[a : a + WINDOW] & 0xC0) != 0x80)
        first, last = np.searchsorted(wanted, (a, a + len(lead)), "right")
        before[first:last] = total + lead[wanted[first:last] - a - 1]
        total += int(lead[-1])
    return [before[np.searchsorted(wanted, place)] for place in places]


def hash_numbers(id_column: Column, seed: int = 7) -> Column:
    """Four numbers from the SHA-256 of ``<seed>:<id>``, as an array of long."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """id, n (lines), form, prefix_chars, middle_chars (null if plain), output; one row for each of ``docs``.

    ``rate`` per cent of the texts are transformed, ``spm`` per cent of these as spm.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), hash_numbers(F.col(id_col), seed).alias("h"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            hashes = batch.column("h").flatten().to_numpy().reshape(-1, 4)
            for a, b in slices(bounds):
                part, offsets = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                n, form, cut1, cut2 = split(part, offsets, hashes[a:b], rate, spm)
                output, out_bounds = transform_bytes(part, offsets, form, cut1, cut2)
                begin, first, second = _characters(part, offsets, offsets[:-1], cut1, cut2)
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(np.array(FORMS)[form]), pa.array(first - begin, mask=plain),
                     pa.array(second - first, mask=plain), _strings(output, out_bounds)],
                    names=names,
                )

    out = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made; null if either is null."""

    @F.arrow_udf("string")
    def back(texts: pa.Array, forms: pa.Array) -> pa.Array:
        data, bounds = text_bytes(texts)
        number = np.array([FORMS.index(f) if f is not None else PLAIN for f in forms.to_pylist()], np.int64)
        parts = []
        for a, b in slices(bounds):
            parts.append(_strings(*restore_bytes(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], number[a:b])))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.when(output.isNotNull() & form.isNotNull(), back(output, form))


def sql(seed: int = 7, rate: int = 100, spm: int = 50) -> str:
    """DuckDB counterpart of the query over ``documents``."""
    number = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::UBIGINT AS h{k + 1}" for k in range(4))
    return f"""
    WITH hashed AS (
        SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
    ), cut AS (
        SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS l, {number} FROM hashed
    ), counted AS (
        SELECT *, len(l) AS n FROM cut
    ), parts AS (
        SELECT *, l[1:least(h1 % (n + 1), h2 % (n + 1))] AS p,
            l[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))] AS m,
            l[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:] AS s,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {rate} THEN 'plain'
                WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
        FROM counted
    ), joined AS (
        SELECT doc_id, t, n, form, coalesce(array_to_string(p, ''), '') AS p, coalesce(array_to_string(m, ''), '') AS m, coalesce(array_to_string(s, ''), '') AS s FROM parts
    )
    SELECT doc_id, n::BIGINT AS n, form,
        CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM joined
    """
