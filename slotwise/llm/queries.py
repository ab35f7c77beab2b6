"""Registered queries of this subpackage and the SQL that some can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import chat, decontaminate, importance, licenses, line_dedup, ngram_join, oracles, packing, repetition, warc, wrapper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files(name: str = "byte_bpe_50k") -> dict[str, str]:
    """Where the public tokenizer's files are installed."""
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path(f"{name}.json"), "ranks": public_tokenizers.path(f"{name}.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", extra), (-7, 1, "assistant", extra)], "conv_id long, turn long, role string, text string")
    messages = rows.unionByName(added).withColumn("parts", chat.text_part("text"))
    return chat.digests(chat.format_conversations(messages))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", "lines_removed", "lines_left")


def op4_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("longest_repeat")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer_files())


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("n_links")


def document_paths(documents: DataFrame) -> DataFrame:
    """documents as files: source/id.txt. The source is the only directory that the table knows; without one there is no path."""
    path = F.when(F.col("source") != "", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return documents.select("doc_id", "text", path.alias("path"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = licenses.scan_notices(document_paths(table(spark, sf_dir, "documents")), keep=["doc_id", "path"])
    # no file is named as a licence here: only a text that is little else speaks for its source, not a short one that ends in a notice
    return licenses.inherit(own, file_coverage=0.9)


def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {f.__name__: f for f in (op1_importance_resampling, op2_chat_format, op3_line_dedup, op4_repetition_rules, op5_best_fit_packing, op6_warc_index, op7_ngram_jaccard, op8_license_scan, op9_wrapper_induction, op10_decontaminate)}
ORACLE = {"op2_chat_format": oracles.CHAT, "op4_repetition_rules": oracles.REPETITION, "op6_warc_index": oracles.WARC, "op7_ngram_jaccard": oracles.JACCARD, "op10_decontaminate": oracles.BENCHMARK}
