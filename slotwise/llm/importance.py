"""Quality classifier by importance resampling over hashed n-grams.

Two generative models over hashed unigrams and bigrams (letters and marks are tokens of their own):
one of target text, the labelled good rows, one of all raw text. An n-gram counts once in a document,
for words come in bursts. A document's log weight is the sum of log(p_target / p_raw) over its n-grams,
without those whose ratio is near one, so that long clean documents gather no noise. How near, and the
smoothing, are chosen among a few values by how well weights separate labelled rows, each row's own
counts left out of the models. Documents are drawn without replacement by Gumbel top-k: the k largest of
sharpness * log weight + Gumbel noise, the noise taken from a hash of the id; at sharpness 1, the default,
the first drawn is any document with a chance in proportion to its weight, and so on among those left.
k is given, or a share of all rows, or else the number of documents whose weight passes the threshold
that separates the labelled rows best (weights are held within 250 of 0 when that threshold is sought).

Both models are fitted on counts of all rows; the labelled sample is at most max_labels rows (those with
the smallest hash of their id), small enough to broadcast. The k-th largest key comes from counts of
keys by leading bits, twice, so nothing is sorted globally.

Null and empty texts have no n-grams, weight 0. Equal rows tie in weight; equal keys are settled by id.
Rows with a null id take part with the noise of a null. Empty tables keep nothing; without labels of
either kind the threshold is -inf and every row is kept. Clashing input columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.arrow import add_columns, column, without
from slotwise.llm.text import WORD_OR_MARK, blocks, mix, tokens
from slotwise.session import ship_package, written


def ngrams(data: np.ndarray, offsets: np.ndarray, bits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each row, 2**bits[0] of unigrams and then 2**bits[1] of bigrams, and the row of each."""
    words, _, first = tokens(data, offsets, WORD_OR_MARK, lower=True)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    size = (1 << bits[0]) + (1 << bits[1])
    key = (words >> np.uint64(64 - bits[0])).astype(np.int64) + row * size
    if len(words) > 1:
        with np.errstate(over="ignore"):
            two = mix(words[:-1] * np.uint64(0x9FB21C651E98DF25) + words[1:]) >> np.uint64(64 - bits[1])
        two = two.astype(np.int64) + (1 << bits[0]) + row[:-1] * size
        key = np.concatenate([key, two[row[:-1] == row[1:]]])
    key = np.unique(key)
    return key % size, key // size


def count_ngrams(df: DataFrame, text: str, target: str, bits: tuple[int, int]) -> DataFrame:
    """Rows bucket, raw, target: counts over all rows and over those where the boolean column target is true."""
    ship_package(df.sparkSession)
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("raw", T.LongType()), T.StructField("target", T.LongType())])
    size = (1 << bits[0]) + (1 << bits[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            chosen = np.array([bool(x) for x in column(batch, target).to_pylist()], bool)
            for lo, hi, data, offsets in blocks(column(batch, text)):
                bucket, row = ngrams(data, offsets, bits)
                raw += np.bincount(bucket, minlength=size)
                good += np.bincount(bucket[chosen[lo:hi][row]], minlength=size)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(good[at])], names=schema.names)

    counts = df.select(F.col(f"`{text}`").cast("string").alias(text), F.col(f"`{target}`").alias(target)).mapInArrow(run, schema)
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(raw: np.ndarray, target: np.ndarray, unigrams: int, smoothing: float, least: float) -> np.ndarray:
    """Two rows of log(p_target / p_raw) by bucket, 0 where it is under `least`: for rows outside the target, and inside.

    Additive smoothing in proportion to the models' sizes. An n-gram counts once in a row, so the row's own count
    can be left out of the models exactly; that is what keeps labelled rows comparable with others.
    """
    out = np.zeros((2, len(raw)), np.float32)
    others = np.maximum(raw - 1, 0)
    for part in (slice(0, unigrams), slice(unigrams, None)):
        share = target[part].sum() / max(1, raw[part].sum())
        if share:
            for k in (0, 1):
                ratio = np.log((np.maximum(target[part] - k, 0) + smoothing * share) / (share * (others[part] + smoothing)))
                out[k, part] = np.where(np.abs(ratio) >= least, ratio, 0.0)
    return out


def label_sample(labels: DataFrame, max_labels: int, doc_id: str = "doc_id") -> DataFrame:
    """At most max_labels labelled rows, those with the smallest hash of their id: doc_id, good."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    rows = labels.where(F.col("quality").isNotNull() & F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("doc_id")).agg(F.min(good).alias("good"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)


def best_threshold(bins: list[tuple[int, int, int]], good_weight: float, step: float) -> tuple[float, float]:
    """(value, threshold) from (bin, good rows, other rows) in order: the threshold that separates them best, midway between bins.

    The value is good_weight times the share of good rows that pass, and the share of others that don't.
    """
    good, other = sum(g for _, g, _ in bins), sum(o for _, _, o in bins)
    if not good or not other:
        return 0.0, float("-inf")
    best, threshold = -1.0, float("-inf")
    passed_good = passed_other = 0
    last = None
    for b, g, o in bins:  # threshold just under this bin
        value = good_weight * (good - passed_good) / good + passed_other / other
        if value > best + 1e-12:
            best, threshold = value, (b if last is None else (last + 1 + b) / 2) * step
        passed_good, passed_other, last = passed_good + g, passed_other + o, b
    return best, threshold


def kth_largest(keys: DataFrame, k: int) -> tuple[float, float]:
    """(lower, upper) bounds of the key range that holds the k-th largest, narrow after two counts of at most 4096 bins."""
    span = keys.agg(F.min("key").alias("a"), F.max("key").alias("b")).first()
    lo, hi = span["a"], span["b"]
    above = 0
    for _ in range(2):
        width = (hi - lo) / 4096
        if width <= 0:
            break
        bin_ = F.least(F.lit(4095), F.floor((F.col("key") - lo) / width))
        rows = keys.where((F.col("key") >= lo) & (F.col("key") <= hi)).groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("x"), F.max("key").alias("y")).orderBy(F.desc("b")).collect()
        for r in rows:
            if above + r["n"] >= k:
                lo, hi = r["x"], r["y"]
                break
            above += r["n"]
    return lo, hi


def _unit(seed: int, doc_id: str = "doc_id") -> F.Column:
    return (F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _key(weight: F.Column, sharpness: float, seed: int, doc_id: str = "doc_id") -> F.Column:
    """sharpness * log weight + Gumbel noise."""
    return weight * sharpness - F.log(-F.log(_unit(seed, doc_id)))


def _weights(df: DataFrame, tables, bits: tuple[int, int], text: str, name: str, keep: list[str], good: str) -> DataFrame:
    """df's columns `keep` and the list of each row's log weights under that name, one for each of the broadcast tables."""

    def weigh(batch: pa.RecordBatch) -> list:
        of = tables.value
        inside = np.array([bool(x) for x in column(batch, good).to_pylist()], np.int64)
        out = np.zeros((batch.num_rows, len(of)))
        for lo, hi, data, offsets in blocks(column(batch, text)):
            bucket, row = ngrams(data, offsets, bits)
            side = inside[lo:hi][row]
            for i, t in enumerate(of):
                out[lo:hi, i] = np.bincount(row, t[side, bucket], hi - lo)
        return [list(np.round(out, 6))]

    return add_columns(df, weigh, [T.StructField(name, T.ArrayType(T.DoubleType()))], keep, [text, good])


@dataclass
class Draw:
    """Fitted models and the draw made with them: scored rows (doc_id, log_weight, key), k, and the last key and id drawn."""

    scored: DataFrame
    tables: object
    sample: DataFrame
    k: int
    last: tuple | None

    def drawn(self, key: F.Column, doc_id: F.Column) -> F.Column:
        if self.last is None:
            return F.lit(False)
        last = F.struct(F.lit(-self.last[0]).alias("a"), F.lit(self.last[1]).cast(self.scored.schema["doc_id"].dataType).alias("b"))
        return F.struct((-key).alias("a"), doc_id.alias("b")) <= last


def draw(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int | None = None, share: float | None = None, bits: tuple[int, int] = (18, 16), smoothing: tuple[float, ...] = (1.0, 3.0, 10.0), least_ratio: tuple[float, ...] = (1.0, 1.5, 2.0), good_weight: float = 6.0, sharpness: float = 1.0, max_labels: int = 20_000, seed: int = 1, step: float = 0.25) -> Draw:
    """smoothing and least_ratio: choices, of which the pair that separates the labelled rows best is taken; k rows are drawn, or a share of them."""
    spark = df.sparkSession
    sample = written(label_sample(labels, max_labels), "labelled")  # at most max_labels rows
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    joined = rows.join(F.broadcast(sample), "doc_id", "left")
    size = (1 << bits[0]) + (1 << bits[1])
    raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
    counts = count_ngrams(joined, "text", "good", bits).toArrow()  # at most one row a bucket
    at = counts["bucket"].to_numpy()
    raw[at], target[at] = counts["raw"].to_numpy(), counts["target"].to_numpy()
    choices = [log_ratios(raw, target, 1 << bits[0], x, y) for x in smoothing for y in least_ratio]

    tried = spark.sparkContext.broadcast(choices)
    labelled = _weights(rows.join(F.broadcast(sample), "doc_id"), tried, bits, "text", "w", ["good"], "good")
    binned = labelled.select("good", F.posexplode("w").alias("choice", "w")).groupBy("choice", F.floor(F.greatest(F.least("w", F.lit(250.0)), F.lit(-250.0)) / step).alias("b"))
    found: dict[int, list] = {}
    for r in binned.agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("o")).orderBy("choice", "b").collect():  # at most 2001 bins a choice
        found.setdefault(r["choice"], []).append((r["b"], r["g"], r["o"]))
    tried.destroy()  # workers let go of it too
    value, threshold, choice = max(((*best_threshold(bins, good_weight, step), -c) for c, bins in found.items()), key=lambda x: (x[0], x[2]), default=(0.0, float("-inf"), 0))

    tables = spark.sparkContext.broadcast([choices[-choice]])
    scored = _weights(joined, tables, bits, "text", "w", ["doc_id"], "good").select("doc_id", F.col("w")[0].alias("log_weight"))
    scored = written(scored.withColumn("key", _key(F.col("log_weight"), sharpness, seed)), "weights")
    rows_in = scored.count()
    if k is None:
        k = round(share * rows_in) if share is not None else scored.where(F.col("log_weight") >= threshold).count()
    k = min(k, rows_in)
    if k <= 0:
        return Draw(scored, tables, sample, 0, None)
    lo, hi = kth_largest(scored, k)
    sure = scored.where(F.col("key") > hi).count()
    edge = scored.where(F.col("key").between(lo, hi)).orderBy(F.desc("key"), "doc_id").limit(max(0, k - sure)).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    last = edge.orderBy("_key", F.desc("_id")).first()
    return Draw(scored, tables, sample, k, (last["_key"], last["_id"]))


def resample(df: DataFrame, labels: DataFrame, **settings: object) -> DataFrame:
    """One row for each of df: doc_id, log_weight, gumbel_key and kept. It is written to the shared folder first."""
    made = draw(df, labels, **settings)
    return made.scored.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), made.drawn(F.col("key"), F.col("doc_id")).alias("kept"))


def resampled_rows(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: tuple[int, int] = (18, 16), sharpness: float = 1.0, seed: int = 1, **settings: object) -> DataFrame:
    """The drawn rows of df with all their columns; weights are computed again in the scan, which shuffles no text."""
    made = draw(df, labels, text, doc_id, bits=bits, sharpness=sharpness, seed=seed, **settings)
    mine = made.sample.select(F.col("doc_id").alias("_labelled"), F.col("good").alias("_good"))
    joined = without(df, ["_labelled", "_good", "_log_weight"]).join(F.broadcast(mine), F.col(f"`{doc_id}`") == F.col("_labelled"), "left")
    names = [c for c in joined.columns if c not in ("_labelled", "_good")]
    weighed = _weights(joined, made.tables, bits, text, "_log_weight", names, "_good")
    return weighed.where(made.drawn(_key(F.col("_log_weight")[0], sharpness, seed, doc_id), F.col(f"`{doc_id}`"))).select(*[F.col(f"`{c}`") for c in names])
