"""Documents to training sequences: quality, lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns that they were given, whatever their names, so documents may have more of them.
A document that line deduplication empties is a repetition as a whole and goes; others keep their id
with the text that is left, and n_chars follows it where there is such a column.

Null texts are empty documents: their weight is 0, they have no lines, no shingles and no passages, and
give one end id. Rows with a null id are never dropped as near duplicates. Rows that repeat an id are one
document to the stages of lines and near duplicates: the latter keeps or drops them together. Empty
tables give empty results at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import decontaminate, importance, line_dedup, ngram_join, packing
from slotwise.llm.queries import table, tokenizer_files
from slotwise.session import written


def _same_columns(docs: DataFrame, run: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """run(docs, id, text) on docs under names that clash with none of an operator's, with the old names after it."""
    place = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    done = run(docs.toDF(*place.values()), place["doc_id"], place["text"])
    return done.select(*[F.col(p).alias(c) for c, p in place.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return _same_columns(docs, lambda d, doc_id, text: importance.resampled_rows(d, labels, text=text, doc_id=doc_id))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def run(d: DataFrame, doc_id: str, text: str) -> DataFrame:
        done = line_dedup.dedup_lines(d, text=text, doc_id=doc_id).where((F.col("lines_removed") == 0) | (F.col("lines_left") > 0))
        if "n_chars" in docs.columns:
            n = f"in_{docs.columns.index('n_chars')}"
            done = done.withColumn(n, F.when(F.col("lines_removed") > 0, F.char_length(text).cast("long")).otherwise(F.col(n)))
        return done

    return _same_columns(docs, run)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_ids: int = 1_000_000) -> DataFrame:
    """The document with the smallest id of each group stays; groups are linked by four fifths of their shingles of five words."""
    groups = ngram_join.near_duplicates(docs, width=5, percent=80)
    gone = written(groups.where(F.col("component_id") < F.col("doc_id")).select("doc_id"), "gone")
    few = gone.limit(broadcast_ids + 1).count() <= broadcast_ids
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return _same_columns(docs, lambda d, doc_id, text: decontaminate.decontaminate(d, items, text=text).where(~F.col("contaminated")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, **tokenizer_files())


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
