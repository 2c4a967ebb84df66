"""Lines that many pages of a site carry, dropped by their relative frequency.

A line is boilerplate for its host if more than ``ratio`` of the host's pages, and at least
``min_pages`` of them, contain it. Pages are rows; a line counts once for each page, lines
are compared without the spaces around them, and blank lines always stay. Without ``copies``
the pages of a host that have the same text count as one, so that a page that was copied
often is not taken for boilerplate itself.

Null text: stays null. Null host: the pages without a host are one host (as is the empty
name). Repeated rows: each is a page, unless copies do not count. Empty input: empty result. Other columns pass through;
``n_lines`` and ``n_dropped`` replace columns of those names.

Only built-in functions are used. A line that occurs on more than a share r of the pages is
one of fewer than (lines a page) / r lines of its host, so the list of a host is small;
pages of large hosts are salted where that list has to be joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayreach.functions.scratch import Scratch

# A page's own sentences recur on single pages; what one page in a hundred shares comes from the site.
RATIO = 0.01
MIN_PAGES = 5
SALTS = 16
HOST, SALT, BAD, LINES = "__host", "__salt", "__bad", "__lines"


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """(host, line hashes) of the hosts that have boilerplate."""
    named = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias(HOST), F.col(text).alias("t"))
    same = F.xxhash64("t")
    pages_of = named if copies else named.select(HOST, same.alias("same")).distinct()
    totals = pages_of.groupBy(HOST).agg(F.count("*").alias("pages"))
    shown = F.filter(F.split("t", "\n"), lambda x: F.trim(x) != "")
    keys = F.array_distinct(F.transform(shown, line_key))
    held = named.select(HOST, F.explode(keys).alias("key")) if copies else named.select(HOST, same.alias("same"), F.explode(keys).alias("key")).distinct()
    counts = held.groupBy(HOST, "key").agg(F.count("*").alias("n"))
    frequent = counts.where(F.col("n") >= min_pages).join(totals, HOST)
    return frequent.where(F.col("n") > ratio * F.col("pages")).groupBy(HOST).agg(F.collect_list("key").alias(BAD))


def dedup(
    pages: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = True, copies: bool = True
) -> DataFrame:
    """``pages`` without their boilerplate lines; with ``counts`` also ``n_lines`` and ``n_dropped``."""
    lists = Scratch(pages.sparkSession, "line-dedup").keep(boilerplate(pages, text, host, ratio, min_pages, copies))
    salted = lists.withColumn(SALT, F.explode(F.array([F.lit(k) for k in range(SALTS)])))
    rows = pages.withColumns(
        {HOST: F.coalesce(F.col(host).cast("string"), F.lit("")), SALT: F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")}
    ).join(salted, [HOST, SALT], "left")
    lines = F.split(F.col(text), "\n")
    kept = F.when(
        F.col(BAD).isNull(), lines
    ).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(BAD, line_key(x))))
    rows = rows.withColumn(LINES, kept)
    if counts:
        n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
        n_kept = F.when(F.col(text).isNull(), 0).otherwise(F.size(LINES))
        rows = rows.withColumns({"n_lines": n_lines, "n_dropped": n_lines - n_kept})
    return rows.withColumn(text, F.array_join(LINES, "\n")).drop(HOST, SALT, BAD, LINES)


def sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, '') AS host FROM documents),
lines AS (
    SELECT r, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM docs WHERE text IS NOT NULL),
counts AS (SELECT host, trim(line) AS k, count(DISTINCT r) AS n FROM lines WHERE trim(line) <> '' GROUP BY ALL),
totals AS (SELECT host, count(*) AS pages FROM docs GROUP BY ALL),
bad AS (SELECT host, k FROM counts JOIN totals USING (host) WHERE n >= {min_pages} AND n > {ratio}::DOUBLE * pages),
kept AS (
    SELECT r, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY i) AS text
    FROM lines l WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.host = l.host AND b.k = trim(l.line)) GROUP BY r),
whole AS (SELECT r, count(*) AS n FROM lines GROUP BY r)
SELECT doc_id, CASE WHEN docs.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
    coalesce(n, 0)::BIGINT AS n_lines, (coalesce(n, 0) - coalesce(n_kept, 0))::BIGINT AS n_dropped
FROM docs LEFT JOIN kept USING (r) LEFT JOIN whole USING (r)
"""
