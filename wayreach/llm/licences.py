"""Licence texts found by the digest of their canonical form.

``canonical`` brings a text to one form: lower case, lines that begin with a copyright
notice left out, punctuation and white space as single spaces, and one spelling of words
that have several. ``scan`` looks up the SHA-256 of each whole text, and of each of its
lines taken as a text, among the digests of known licences (equality joins).

Null text counts as empty; an empty canonical form matches nothing. Licences whose
canonical forms are equal are all reported. Repeated rows each get a result.
Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayreach.functions.scratch import Scratch
from wayreach.llm.licence_texts import TEXTS

# Spellings that count as equal
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("non commercial", "noncommercial"),
    ("optimisation", "optimization"),
    ("organisation", "organization"),
    ("owner", "holder"),  # alone, as "copyright owner" may be cut by the end of a line
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]
# Words that go on with a sentence after "copyright", so that its line is no notice
NO_HOLDER = (
    "a act also an and any are as assignment before but by can claim claims control disclaimer disclaimers doctrine doctrines for from has holder holders "
    "if in infringement interest interests is it its law laws like license licensed licenses line lines material may message messages notice notices of on only or owner "
    "owners ownership patent patents permission permissions protection related resulting right rights shall similar statement statements status term terms than that the this "
    "to trademark trademarks treaty treaties under was which will with work works year years"
).split()


# ASCII without small letters and digits; classes of all letters would make the pattern too large for DuckDB
APART = r"\x00-\x2f\x3a-\x60\x7b-\x7f"


def other_word(words: list[str]) -> str:
    """Pattern of the rest of any word but these (without lookahead, which DuckDB has not)."""
    heads = sorted({w[0] for w in words if w})
    ways = [f"[^{APART}{''.join(heads)}][^{APART}]*"]
    for head in heads:
        rest = [w[1:] for w in words if w[:1] == head]
        ways.append(f"{head}{other_word(rest)}" + ("" if "" in rest else "?"))
    return f"(?:{'|'.join(ways)})"


# A notice has a year, (c) or a holder after the word; "(c)" alone may be the item of a list.
NO_LETTER = r"[^\p{L}\p{N}\n]"
NOTICE = (
    rf"^[^\p{{L}}\p{{N}}(©]*(copyright[^\p{{L}}\p{{N}}\n.;]+{other_word(NO_HOLDER)}({NO_LETTER}|$)"
    rf"|copyright{NO_LETTER}*©|copyright the [^\n]*(authors|contributors|developers|project|team){NO_LETTER}*$"
    rf"|\(c\){NO_LETTER}*(\d{{4}}|copyright)|©|all rights reserved)[^\n]*$"
)
NO_WORD = r"[^\p{L}\p{N}]+"


def canonical_line(line: Column) -> Column:
    words = F.regexp_replace(F.regexp_replace(F.lower(line), NOTICE, " "), NO_WORD, " ")
    padded = F.concat(F.lit(" "), F.trim(words), F.lit(" "))
    for spelling, chosen in SPELLINGS:
        padded = F.replace(padded, F.lit(f" {spelling} "), F.lit(f" {chosen} "))
    return F.trim(padded)


def canonical_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(F.transform(lines, canonical_line), lambda x: x != "")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, digest) of licence texts, by default those of this package."""
    rows = spark.createDataFrame(list((TEXTS if texts is None else texts).items()), "license_id string, text string")
    whole = rows.select("license_id", F.array_join(canonical_lines(F.col("text")), " ").alias("text"))
    return whole.where("text <> ''").select("license_id", digest(F.col("text")).alias("digest"))


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, digest, license_ids of the whole text, and of its lines."""
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    binary = lambda x: F.unhex(digest(x))
    digests = lines.select("doc_id", binary(F.array_join("lines", " ")).alias("digest"), F.array_distinct(F.transform("lines", binary)).alias("parts"))
    kept = Scratch(docs.sparkSession, "licences").keep(digests, "digests")
    known_as = licences.select("license_id", F.unhex("digest").alias("unit"))
    whole = kept.select("doc_id", "digest", F.col("digest").alias("unit"), F.lit(True).alias("entire"))
    part = kept.select("doc_id", "digest", F.explode("parts").alias("unit"), F.lit(False).alias("entire"))
    found = whole.unionByName(part).join(known_as, "unit")
    # sorted sets of at most as many ids as there are licences
    sets = found.groupBy(F.col("doc_id").alias("d"), F.col("digest").alias("g")).agg(
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("entire"), F.col("license_id"))))).alias("license_ids"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(~F.col("entire"), F.col("license_id"))))).alias("line_license_ids"),
    )
    rows = kept.select("doc_id", "digest").join(sets, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    return rows.select(
        "doc_id", F.lower(F.hex("digest")).alias("digest"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("license_ids", "line_license_ids")]
    )


def sql() -> str:
    """The same in DuckDB; canonical forms line by line."""

    def form(line: str) -> str:
        words = f"regexp_replace(regexp_replace(lower({line}), '{NOTICE}', ' ', 'g'), '{NO_WORD}', ' ', 'g')"
        out = f"concat(' ', trim({words}), ' ')"
        for spelling, chosen in SPELLINGS:
            out = f"replace({out}, ' {spelling} ', ' {chosen} ')"
        return f"trim({out})"

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in TEXTS.items())
    return f"""
WITH texts AS (
    SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, NULL AS license_id, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT 'l', row_number() OVER (), NULL, k, v FROM (VALUES {values}) t(k, v)),
lines AS (
    SELECT kind, r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM texts),
forms AS (SELECT kind, r, i, {form("line")} AS form FROM lines),
wholes AS (
    SELECT kind, r, sha256(coalesce(string_agg(form, ' ' ORDER BY i) FILTER (form <> ''), '')) AS digest FROM forms GROUP BY kind, r),
known AS (
    SELECT license_id, digest FROM wholes JOIN texts USING (kind, r) WHERE kind = 'l' AND digest <> sha256('')),
parts AS (
    SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM forms JOIN known ON sha256(form) = digest
    WHERE kind = 'd' AND form <> '' GROUP BY r),
hits AS (
    SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM wholes JOIN known USING (digest)
    WHERE kind = 'd' GROUP BY r)
SELECT doc_id, wholes.digest, coalesce(hits.ids, '') AS license_ids, coalesce(parts.ids, '') AS line_license_ids
FROM texts JOIN wholes USING (kind, r) LEFT JOIN hits USING (r) LEFT JOIN parts USING (r) WHERE kind = 'd'
"""
