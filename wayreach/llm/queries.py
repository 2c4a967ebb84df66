"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayreach.functions.scratch import Scratch
from wayreach.llm import block_knn, bpe, decontam, infill, language, lattice_lm, licences, line_dedup, near_dedup, ngram_join, token_table, vector_codes, warc
from wayreach.llm.columns import id_hash

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op4_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    decoded = docs.select("doc_id", bpe.round_trip(F.col("text"), path).alias("b")).select("doc_id", "b.ids", "b.decoded")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query()
def op6_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = Scratch(spark, "token-table").path("tokens")
    token_table.write(docs, path, public_tokenizers.path(BYTE_BPE), end_id=0)
    rows = token_table.read(spark, path)
    return rows.select("doc_id", "start", "n_tokens", token_table.checksum(F.col("ids")).alias("ids_crc32"))


@query(line_dedup.sql())
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query(licences.sql())
def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known(spark))


@query()
def op10_block_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_knn.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query()
def op2_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_hash(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = language.train(docs.where(~held_out).select("doc_id", "text", "lang"))
    named = language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return named.select("doc_id", "held_out", "lang_pred", "score", "bits_a_byte")


@query(warc.sql())
def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    warc.write(table(spark, sf_dir, "pages"), path)
    index = warc.merge_index(scratch.keep(warc.read(spark, path), "runs"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"))


@query()
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_hash(F.col("doc_id")) % 5 == 1
    return lattice_lm.score(table(spark, sf_dir, "documents"), held_out, public_tokenizers.path(PIECES))


@query(infill.sql())
def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(table(spark, sf_dir, "documents"))
    restored = made.withColumn("restored", infill.restore(F.col("output"), F.col("form")))
    return restored.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


@query()
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select(
        F.col("id").alias("vec_id"),
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(vector_codes.digest(books)).alias("codebooks_sha256"),
    )


@query()
def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))
