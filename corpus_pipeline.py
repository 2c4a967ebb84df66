"""Documents to training tokens, as five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the cluster's shared folder and gives the table to the next stage. All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayreach.functions.scratch import Scratch
from wayreach.llm import bpe, decontam, language, line_dedup, near_dedup
from wayreach.llm.queries import BYTE_BPE, table

# A text whose best language model needs more bits a byte than plain storage is in none of them.
MOST_BITS_A_BYTE = 8.0


def numbered(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number of its own for each row, whatever its id.

    Rows of Parquet tables are told by file and place in it; others are written first. Only
    the list of files is numbered by a single task.
    """
    try:
        places = docs.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__place"))
    except AnalysisException:
        return Scratch(spark, "numbered").keep(docs.withColumn(name, F.monotonically_increasing_id()))
    files = places.select("__path").distinct().withColumn("__file", F.row_number().over(Window.orderBy("__path")))
    files = Scratch(spark, "files").keep(files)
    return places.join(files, "__path").withColumn(name, F.shiftleft(F.col("__file").cast("long"), 40) + F.col("__place")).drop("__path", "__file", "__place")


def free_name(docs: DataFrame) -> str:
    taken = {c.lower() for c in docs.columns}
    return next(c for c in (f"row_{k}" for k in range(len(taken) + 1)) if c not in taken)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, or that no language model explains (if any could be learned)."""
    model = language.train(docs.select("doc_id", "text", "lang"))
    if not model.langs:
        return docs
    named = language.predict(docs, model, prefix="__")
    kept = named.where((F.col("__lang_pred") != language.UNKNOWN) & (F.col("__bits_a_byte") <= MOST_BITS_A_BYTE))
    return kept.select(docs.columns)


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that many unlike documents of a source carry; copies are for the next stage."""
    return line_dedup.dedup(docs, counts=False, copies=False).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies; rows are documents, whatever their ids."""
    row = free_name(docs)
    rows = numbered(spark, docs, row)
    groups = near_dedup.groups(rows.select(F.col(row).alias("doc_id"), "text"))
    kept = groups.where("doc_id = class_id").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    row = free_name(docs)
    rows = numbered(spark, docs, row)
    leaks = decontam.leaks(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(leaks.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids; kept only if decoding gives the text back, which it always does."""
    return bpe.tokens(docs, public_tokenizers.path(BYTE_BPE)).where("exact").select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language", keep_known_languages),
    ("lines", drop_site_lines),
    ("near_copies", keep_one_of_each_group),
    ("benchmark", drop_benchmark_leaks),
    ("tokens", encode_tokens),
]

# Language models, near copies and tokens are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
