"""Similarity join of texts on their n-grams by rare-first prefix filtering.

A text is the set of its runs of ``SIZE`` words. Two texts link when ``PERCENT`` per cent of
the union of their sets is common to both. The join returns what links connect.

1. Texts of equal sets are one class. All following steps are about classes.
2. A class of which more than 100 - PERCENT per cent of the n-grams occur nowhere else has no
   partner. A quarter of all n-grams, chosen by hash, already shows that for most classes.
3. N-grams of the others are ordered by document frequency, the rarest first. Of n of them a
   class needs its first n - ceil(PERCENT n / 100) + 1 only: partners share one of these
   (prefix filter). They are the postings by which classes are joined.
4. In each posting all classes are compared with the one that has the fewest n-grams of its
   own, such as the text that copies stem from.
5. Postings that still hold several components are searched whole, in blocks of classes whose
   sizes may link (length filter). The common n-gram is taken for the first one that a pair
   has in common; then what follows it in both sets bounds the overlap, by its length
   (positional filter) and by its numbers in ``BINS`` hash bins (suffix filter). What passes
   is compared by the sets themselves, in the posting of a pair's first common n-gram only,
   and only as long as the two are not in one component.

No link between different components goes unseen, and no step lists the pairs of a group:
tasks hand on classes and links. Large groups of copies cost one comparison a member.

Texts of fewer than SIZE words: their whole sequence of words is the one n-gram. Null text or
one without words: an empty set, a component of its own. A null id: null component, no link.
Rows are documents: repeated rows, and rows that share an id, are each compared and reported.
Empty input: empty result. Sets are sets of 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayreach.functions.scratch import Scratch
from wayreach.llm.columns import BASE, STEP, grams, mixed, slices, spans, text_bytes, words
from wayreach.llm.hot import join_totals
from wayreach.llm.links import components

SIZE = 3
PERCENT = 90
SAMPLE = 4  # one of so many n-grams is counted first
BINS = 32
BLOCK = 512
HUB_ROWS = 2048
POSTINGS_AT_ONCE = 20_000

_BYTES = np.arange(256)
SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
LOWER = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES + 32, _BYTES).astype(np.uint8)


def sets(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams of each text in ascending order, offsets) of texts in bytes."""
    hashes, at = words(LOWER[data], offsets, ~SPACE)
    found, first = grams(hashes, at, size)
    owner = spans(at)[first]
    counts = np.diff(at)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            there = counts[short] > k
            whole[there] = whole[there] * np.uint64(BASE) + hashes[at[short[there]] + k]
        # the number of words keeps short texts and n-grams apart
        whole = mixed(whole + counts[short].astype(np.uint64) * np.uint64(STEP))
        found, owner = np.concatenate((found, whole)), np.concatenate((owner, short))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.searchsorted(owner[new], np.arange(len(offsets)))


def _sums(found: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """Two sums of scrambled n-grams, which name a set together with its size."""
    out = []
    for salt in (1, 2):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(found + np.uint64(salt)), dtype=np.uint64)))
        out.append(pa.array((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)))
    return out


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _read(size: int, chosen: int):
    """Rows (doc_id, n, a, b, grams) of texts; only one of ``chosen`` n-grams is handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            for a, b in slices(bounds):
                found, at = sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], size)
                n = np.diff(at)
                kept = found % np.uint64(chosen) == 0
                numbers = np.concatenate(([0], np.cumsum(kept)))[at]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n.astype(np.int32)), *_sums(found, at), _lists(found[kept], numbers)], names=["doc_id", "n", "a", "b", "grams"])

    return run


SETS = "doc_id long, n int, a long, b long, grams array<long>"


def least_overlap(n, percent: int):
    """The n-grams of a set of n that a partner must share."""
    return F.ceil(n * percent / F.lit(100.0)).cast("int") if isinstance(n, Column) else -(-n * percent // 100)


def joint_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The common n-grams that sets of n and m need to link."""
    return -(-(n + m) * percent // (100 + percent))


def survivors(sketches: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The classes that may have a partner, judged by the chosen n-grams."""
    seen = sketches.where("n > 0 and doc_id is not null").select(F.explode("grams").alias("g"), "a", "n")
    # unique to a class: the same name wherever it occurs
    own = seen.groupBy("g").agg(F.min("a").alias("a"), F.max("a").alias("z"), F.min("n").alias("n")).where("a = z")
    lonely = own.groupBy("a", "n").agg(F.count("*").alias("own"))
    lonely = lonely.where(F.col("own") > F.col("n") - least_overlap(F.col("n"), percent)).select("a", "n")
    return classes.join(lonely.hint("merge"), ["a", "n"], "left_anti")


def class_sets(texts: DataFrame, alive: DataFrame, size: int) -> DataFrame:
    """(id, n, grams) of each class in ``alive``, from the text of a document that it holds."""
    asked = alive.select(F.col("doc").alias("doc_id"), "id", F.col("a").alias("want_a"), F.col("b").alias("want_b"))
    # a sorted merge at every size: neither side is bounded
    found = texts.join(asked.hint("merge"), "doc_id").mapInArrow(_read_wanted(size), "id long, n int, grams array<long>")
    return found.dropDuplicates(["id"])


def _read_wanted(size: int):
    """Rows (id, n, grams) of the texts that have the sums wanted; an id may belong to several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            for a, b in slices(bounds):
                found, at = sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], size)
                rows = batch.slice(a, b - a)
                right = pc.and_(*[pc.equal(rows.column(f"want_{c}"), x) for c, x in zip("ab", _sums(found, at), strict=True)])
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(np.diff(at).astype(np.int32)), _lists(found, at)], names=["id", "n", "grams"]).filter(right)

    return run


def ordered_sets(whole: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(id, n, own, grams): n-grams found in several classes, the rarest first, and how many are its own.

    Classes with too many of their own are left out.
    """
    flat = whole.select("id", "n", F.explode("grams").alias("g"))
    shared = scratch.keep(flat.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    counted = join_totals(flat, shared.withColumn("rows", F.col("df")), "g", "rows", "inner")
    sets_ = counted.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("s"))
    sets_ = sets_.select("id", "n", (F.col("n") - F.size("s")).alias("own"), F.col("s.g").alias("grams"))
    return sets_.where(F.col("own") <= F.col("n") - least_overlap(F.col("n"), percent))


def _postings(percent: int):
    """Rows (g, id, n, own, at, bins): an n-gram of the prefix, its place, and the bins of all that follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("grams")
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            ids, n, own = (batch.column(c).to_numpy().astype(np.int64) for c in ("id", "n", "own"))
            counts = np.minimum(n - least_overlap(n, percent) + 1 - own, np.diff(bounds))
            ends = np.cumsum(counts)
            for a, b in slices(np.concatenate(([0], ends)), POSTINGS_AT_ONCE):
                sizes = counts[a:b]
                rows = np.repeat(np.arange(a, b), sizes)
                place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                after = [rest_by_bin(values[bounds[k] : bounds[k + 1]], int(counts[k])) for k in range(a, b)]
                flat = pa.array(np.concatenate(after).ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[bounds[rows] + place]), pa.array(ids[rows]), *[pa.array(x.astype(np.int32)) for x in (n[rows], own[rows], own[rows] + place)],
                     pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BINS, dtype=np.int32)), flat)],
                    names=["g", "id", "n", "own", "at", "bins"],
                )

    return run


def rest_by_bin(grams_: np.ndarray, count: int) -> np.ndarray:
    """For each of the first ``count`` n-grams, how many of those behind it fall into each bin."""
    bins = (mixed(grams_.view(np.uint64) ^ np.uint64(STEP)) % np.uint64(BINS)).astype(np.int64)
    return np.bincount(bins, minlength=BINS).astype(np.int32) - np.cumsum(np.eye(BINS, dtype=np.int32)[bins[:count]], axis=0, dtype=np.int32)


def _near(n: Column, m: Column, percent: int) -> Column:
    """Length filter."""
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def hub_pairs(postings: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): the classes of each posting, and its class with the fewest n-grams of its own."""
    hub = F.min(F.struct("own", "id", "n", "at")).alias("hub")
    hubs = scratch.keep(postings.groupBy("g").agg(hub, F.count("*").alias("rows")).where("rows > 1"), "hubs")
    met = join_totals(postings.select("g", "id", "n", "at"), hubs, "g", "rows", "inner").where("id <> hub.id")
    needed = F.ceil((F.col("n") + F.col("hub.n")) * percent / (100.0 + percent))
    # at most what lies before the common one, and from it on
    most = F.least(F.col("at"), F.col("hub.at")) + F.least(F.col("n") - F.col("at"), F.col("hub.n") - F.col("hub.at"))
    fits = _near(F.col("n"), F.col("hub.n"), percent) & (most >= needed)
    return met.where(fits).select(F.col("id").alias("a"), F.col("hub.id").alias("b")).distinct()


def linked(n: Column, m: Column, common: Column, percent: int) -> Column:
    return common * 100 >= (n + m - common) * percent


def verified(pairs: DataFrame, sets_: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose sets link. A hub ``b`` of many pairs is dealt over several tasks."""
    fans = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("fan"))
    hubs = fans.join(sets_.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("grams").alias("t")), "b")
    hubs = hubs.select("b", "m", "t", "fan", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("part"))
    asked = pairs.hint("merge").join(sets_.select(F.col("id").alias("a"), "n", F.col("grams").alias("s")), "a")
    # a row of ``asked`` knows its part only with the hub's fan; few hubs have more than one
    wide = hubs.where("fan > 1").select("b", "fan").distinct()
    asked = asked.join(wide, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("fan", F.lit(1)).cast("long")).cast("int")).drop("fan")
    both = asked.hint("merge").join(hubs.drop("fan"), ["b", "part"])
    return both.where(linked(F.col("n"), F.col("m"), F.size(F.array_intersect("s", "t")), percent)).select("a", "b")


def apart(postings: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """The postings, with the component of each row, that hold more than one."""
    named = postings.select("g", "id").join(groups, "id", "left").select("g", "id", F.coalesce("group", "id").alias("group"))
    mixed_ = named.groupBy("g").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("rows")).where("lo < hi and rows > 2")
    return join_totals(named, scratch.keep(mixed_.select("g", "rows", "lo"), "mixed"), "g", "rows", "inner").drop("lo")


def blocks(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Each row (g, id, group, n) once for every pair of blocks it takes part in.

    Rows of a posting are dealt by steps of size, of which only neighbours may link, and by
    hash where a step holds more than a block. Blocks meet those of their own step (i, j from
    0) and, as i below 0, those of the step above.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / min(percent, 99)) + 1e-9).cast("int")
    dealt = rows.withColumn("k", F.struct("g", step.alias("step")))
    counts = dealt.groupBy("k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.count("*").alias("rows"))
    counts = scratch.keep(counts, "steps")

    def other(by: int, name: str) -> DataFrame:
        return counts.select(F.struct(F.col("k.g").alias("g"), (F.col("k.step") + by).alias("step")).alias("k"), F.col("parts").alias(name))

    counts = scratch.keep(counts.join(other(-1, "above"), "k", "left").join(other(1, "below"), "k", "left").fillna(0, ["above", "below"]), "neighbours")
    dealt = join_totals(dealt, counts, "k", "rows", "inner").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def task(step: Column | int, i: Column, j: Column, left: Column, right: Column) -> Column:
        return F.struct((F.col("k.step") + step).alias("step"), i.cast("int").alias("i"), j.cast("int").alias("j"), left.alias("in_left"), right.alias("in_right"))

    def upto(n: str) -> Column:
        return F.filter(F.sequence(F.lit(0), F.col(n)), lambda k: k < F.col(n))

    yes, no = F.lit(True), F.lit(False)
    own = F.transform(upto("parts"), lambda k: task(0, F.least("own", k), F.greatest("own", k), F.col("own") <= k, F.col("own") >= k))
    guest = F.transform(upto("above"), lambda k: task(1, -1 - F.col("own"), k, yes, no))
    host = F.transform(upto("below"), lambda k: task(0, -1 - k, F.col("own"), no, yes))
    return dealt.withColumn("t", F.explode(F.concat(own, guest, host))).select("g", "t.*", "id", "group")


def _overlap_bounds(n: np.ndarray, at: np.ndarray, bins: np.ndarray, row: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``others`` that may link with ``row`` if the posting's n-gram is the first they share."""
    m = n[others]
    fits = (m * 100 >= n[row] * percent) & (n[row] * 100 >= m * percent)  # length
    others, m = others[fits], m[fits]
    needed = joint_overlap(n[row], m, percent)
    fits = np.minimum(n[row] - at[row], m - at[others]) >= needed  # position
    others, needed = others[fits], needed[fits]
    return others[1 + np.minimum(bins[others], bins[row]).sum(1) >= needed]  # suffix


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[c].to_numpy(zero_copy_only=False) for c in names]


CLOSE = "g long, step int, i int, j int, id long, group long, in_left boolean, in_right boolean, n int, at int, bins array<int>"


def _close(percent: int):
    """The rows of a pair of blocks that pass all filters with one of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        if not len(table):
            return
        n, at, group, left, right = _columns(table, "n", "at", "group", "in_left", "in_right")
        n, at, bins = n.astype(np.int64), at.astype(np.int64), table["bins"].combine_chunks().flatten().to_numpy().reshape(-1, BINS)
        others, wanted = np.flatnonzero(right), np.zeros(len(table), bool)
        for row in np.flatnonzero(left):
            partners = _overlap_bounds(n, at, bins, row, others[group[others] != group[row]], percent)
            wanted[partners] = True
            wanted[row] |= len(partners) > 0
        yield from table.filter(pa.array(wanted)).to_batches()

    return run


def _links(percent: int):
    """Links that join components, of one pair of blocks; rows come with their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        if not len(table):
            return
        ids, n, at, own, left, right = _columns(table, "id", "n", "at", "own", "in_left", "in_right")
        n, at = n.astype(np.int64), at.astype(np.int64)
        bins = table["bins"].combine_chunks().flatten().to_numpy().reshape(-1, BINS)
        group = np.unique(table["group"].to_numpy(), return_inverse=True)[1]
        lists = table["grams"].combine_chunks()
        bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        found, others = [], np.flatnonzero(right)
        rows = np.flatnonzero(left)
        for row in rows[np.lexsort((ids[rows], own[rows]))]:
            mine = values[bounds[row] : bounds[row + 1]]
            before = mine[: at[row] - own[row]]
            for other in _overlap_bounds(n, at, bins, row, others[group[others] != group[row]], percent):
                if group[other] == group[row]:
                    continue
                its = values[bounds[other] : bounds[other + 1]]
                if np.intersect1d(before, its[: at[other] - own[other]], assume_unique=True).size:
                    continue  # compared in the posting of an n-gram before
                common = np.intersect1d(mine, its, assume_unique=True).size
                if common * 100 >= (n[row] + n[other] - common) * percent:
                    found.append((int(ids[row]), int(ids[other])))
                    group[group == group[other]] = group[row]
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(texts: DataFrame, classes: DataFrame, sketches: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """(id, group): the components of the classes that link."""
    alive = scratch.keep(survivors(sketches, classes, percent), "alive")
    whole = scratch.keep(class_sets(texts, alive, size), "sets")
    ordered = scratch.keep(ordered_sets(whole, percent, scratch), "ordered")
    schema = "g long, id long, n int, own int, at int, bins array<int>"
    postings = scratch.keep(ordered.mapInArrow(_postings(percent), schema), "postings")
    pairs = scratch.keep(hub_pairs(postings, percent, scratch), "pairs")
    first = scratch.keep(verified(pairs, ordered, percent), "links")
    found = scratch.keep(components(first, scratch), "components")
    rows = scratch.keep(apart(postings, found, scratch), "apart")
    if rows.isEmpty():
        return found
    detail = postings.select("g", "id", "n", "at", "bins")
    sized = rows.join(ordered.select("id", "n"), "id")
    dealt = blocks(sized, percent, scratch).join(detail, ["g", "id"])
    close = dealt.select(*[c.split()[0] for c in CLOSE.split(", ")]).groupBy("g", "step", "i", "j").applyInArrow(_close(percent), CLOSE)
    close = scratch.keep(close, "close").join(ordered.select("id", "own", "grams"), "id")
    more = close.groupBy("g", "step", "i", "j").applyInArrow(_links(percent), "a long, b long").distinct()
    return components(first.unionByName(scratch.keep(more, "more-links")), scratch)


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the least id that links reach); one row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = scratch.keep(texts.mapInArrow(_read(size, SAMPLE), SETS), "sketches")
    same = ["a", "b", "n"]
    classes = sketches.where("n > 0 and doc_id is not null").groupBy(same).agg(F.min("doc_id").alias("doc"), F.count("*").alias("rows"))
    # written, so that the numbers stay
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    groups = scratch.keep(links(texts, classes, sketches, scratch, size, percent), "groups")
    named = scratch.keep(classes.join(groups, "id", "left").withColumn("group", F.coalesce("group", "id")), "named")
    least = scratch.keep(named.groupBy("group").agg(F.min("doc").alias("component_id"), F.count("*").alias("rows")), "components")
    named = join_totals(named.select("group", F.struct(*same).alias("set"), F.col("rows").alias("members")), least, "group", "rows")
    named = scratch.keep(named, "members")
    found = join_totals(sketches.select("doc_id", F.col("n").alias("n_shingles"), F.struct(*same).alias("set")), named.select("set", "component_id", F.col("members").alias("rows")), "set", "rows")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id")))
    return found.select(F.col("doc_id").alias(id_col), F.col("n_shingles").cast("long").alias("n_shingles"), component.alias("component_id"))
