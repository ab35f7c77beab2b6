"""Errors, folds, purging and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import time as t


def percentage_error(y: Column, p: Column, strict: bool = True) -> Column:
    """|y - p| / |y| where y can be scored, else NULL. strict: a missing prediction of a scored label is an error."""
    scored = y.isNotNull() & ~F.isnan(y) & (F.abs(y) > 1e-8)
    bad = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    value = F.abs(y - p) / F.abs(F.nullif(y, F.lit(0.0)))
    return F.when(scored & bad, F.raise_error(F.lit("prediction is not finite")).cast("double") if strict else F.lit(None).cast("double")).when(scored, value)


def error_by(df: DataFrame, by: list[str], y: str = "y", p: str = "p", strict: bool = True) -> DataFrame:
    e = percentage_error(F.col(y), F.col(p), strict)
    return df.withColumn("_e", e).groupBy(*by).agg(F.avg("_e").alias("mape"), F.count("_e").alias("n_scored"), F.count_if(F.col("_e").isNull()).alias("n_unscored"))


def macro_error(df: DataFrame, by: list[str], over: list[str], y: str = "y", p: str = "p", strict: bool = True) -> DataFrame:
    """Mean over groups `over` of their errors, not of pooled cells."""
    return error_by(df, [*by, *over], y, p, strict).groupBy(*by).agg(F.avg("mape").alias("macro_mape"), F.sum("n_scored").cast("long").alias("n_scored"))


def safe_error(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Denominators are at least 1 % of the group's median |y|."""
    floor = df.groupBy(*by).agg(F.greatest(0.01 * F.median(F.abs(F.col(y))), F.lit(1e-9)).alias("_floor"))
    x = df.join(F.broadcast(floor), by)
    return x.groupBy(*by).agg(F.avg(F.abs(F.col(y) - F.col(p)) / F.greatest(F.abs(F.col(y)), F.col("_floor"))).alias("safe_mape"))


def band_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Macro errors of horizons up to 8, up to 48, beyond, and of the last one."""
    per = error_by(df, [*by, "h"], strict=False)
    band = F.when(F.col("h") <= 8, "short").when(F.col("h") <= 48, "middle").otherwise("long")
    bands = per.groupBy(*by, band.alias("band")).agg(F.avg("mape").alias("mape"))
    return bands.unionByName(per.where("h = 96").select(*by, F.lit("end").alias("band"), "mape"))


def daily_error(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean by day of each origin's mean over its horizons."""
    e = df.withColumn("_e", percentage_error(F.col("y"), F.col("p"), False)).groupBy(*by, "b").agg(F.avg("_e").alias("_m"))
    return e.groupBy(*by, F.to_date("b").alias("day")).agg(F.avg("_m").alias("mape"))


def expanding_folds(slots: DataFrame, count: int, size: int, least: int) -> DataFrame:
    """Rows fold, train_end, test_start, test_end, n_train from the last `count` blocks of `size` distinct slots; folds with too little history are left out."""
    n = slots.agg(F.countDistinct("b").alias("n")).first()["n"]
    ranked = slots.select("b").distinct().withColumn("_r", F.row_number().over(Window.orderBy("b")))  # slots of one grid: as many as time has
    folds = [(k, n - (count - k) * size) for k in range(count) if n - (count - k) * size >= least]
    spark = slots.sparkSession
    if not folds:
        return spark.createDataFrame([], "fold int, train_end timestamp_ntz, test_start timestamp_ntz, test_end timestamp_ntz, n_train long")
    dim = spark.createDataFrame([(k, s) for k, s in folds], "fold int, n_train long")
    x = ranked.crossJoin(F.broadcast(dim))  # a few folds
    return x.groupBy("fold", "n_train").agg(F.max(F.when(F.col("_r") <= F.col("n_train"), F.col("b"))).alias("train_end"), F.min(F.when(F.col("_r") > F.col("n_train"), F.col("b"))).alias("test_start"), F.max(F.when(F.col("_r") <= F.col("n_train") + size, F.col("b"))).alias("test_end")).select("fold", "train_end", "test_start", "test_end", "n_train")


def purge(labelled: DataFrame, cutoff: Column) -> DataFrame:
    """Rows whose label had been observed at the cutoff."""
    return labelled.where(F.col("target_ts") <= cutoff)


def mask_after(labelled: DataFrame, end: Column, y: str = "y") -> DataFrame:
    return labelled.withColumn(y, F.when(F.col("target_ts") <= end, F.col(y)))


def purged_blocks(df: DataFrame, hours: int = 6, embargo_hours: int = 2) -> DataFrame:
    """Each row's block, and for each block which rows may train its model: (block, train rows, test rows, embargoed rows)."""
    x = df.withColumn("block", t.block(F.col("b"), hours * 3_600_000_000))
    sizes = x.groupBy("block").agg(F.count(F.lit(1)).alias("n_test"))
    margin = embargo_hours * 3_600_000_000
    us = t.micros(F.col("b"))
    into = us - F.col("block") * hours * 3_600_000_000
    # rows within the embargo of a block lie in its neighbours
    before = x.where(into >= hours * 3_600_000_000 - margin).select((F.col("block") + 1).alias("block"))
    after = x.where(into < margin).select((F.col("block") - 1).alias("block"))
    near = before.union(after).groupBy("block").agg(F.count(F.lit(1)).alias("_near"))
    total = x.agg(F.count(F.lit(1)).alias("_all"))
    out = sizes.join(near, "block", "left").crossJoin(F.broadcast(total))
    return out.select("block", "n_test", F.coalesce("_near", F.lit(0)).cast("long").alias("n_embargoed"), (F.col("_all") - F.col("n_test") - F.coalesce("_near", F.lit(0))).cast("long").alias("n_train"))


def leave_one_out(df: DataFrame, fold: str, by: list[str], value: str) -> DataFrame:
    """Mean of value over all other folds, by sums: no fold is read twice."""
    sums = df.groupBy(*by, fold).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    w = Window.partitionBy(*by)
    return sums.select(*by, fold, ((F.sum("_s").over(w) - F.col("_s")) / F.nullif(F.sum("_n").over(w) - F.col("_n"), F.lit(0))).alias("others_mean"), F.col("_n").alias("n"))


def paired_improvement(scores: DataFrame, base: str, by: list[str], value: str = "mape") -> DataFrame:
    """Per member against the base on the same groups: how often better, mean, deviation, worst gain, 10th percentile."""
    b = scores.where(F.col("member") == base).select(*by, F.col(value).alias("_b"))
    x = scores.where(F.col("member") != base).join(b, by).withColumn("_g", F.col("_b") - F.col(value))
    return x.groupBy("member").agg(F.count("_g").alias("n"), F.count_if(F.col("_g") > 1e-9).alias("n_better"), F.avg("_g").alias("gain_mean"), F.stddev_samp("_g").alias("gain_std"), F.min("_g").alias("gain_min"), F.percentile("_g", F.lit(0.1)).alias("gain_p10"))


def day_gate(daily: DataFrame, base: str, challenger: str, by: list[str], share: float = 2 / 3, worst: float = 0.005) -> DataFrame:
    """Passes if better on at least two thirds of days, better on average, and nowhere worse than half a point."""
    wide = daily.groupBy(*by, "day").pivot("member", [base, challenger]).agg(F.first("mape"))
    x = wide.withColumn("_g", F.col(f"`{base}`") - F.col(f"`{challenger}`"))
    return x.groupBy(*by).agg(F.count("_g").alias("n_days"), F.count_if(F.col("_g") > 0).alias("n_better"), F.avg("_g").alias("gain_mean"), F.min("_g").alias("gain_min")).withColumn("passed", (F.col("n_better") >= share * F.col("n_days")) & (F.col("gain_mean") > 0) & (F.col("gain_min") > -worst))


def score_points(mape: Column, worst: float = 0.312, floor: float = 0.688) -> Column:
    """50 + 50 (accuracy - floor) / worst, accuracy = 1 - error."""
    return 50 + 50 * ((1 - mape) - floor) / worst


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeated ones as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def replay(query, rows: DataFrame, at: str, until, decided: str) -> bool:
    """Prefix causality: query over the rows up to `until` gives the same decisions up to there as over all rows."""
    whole = query(rows).where(F.col(decided) <= F.lit(until).cast("timestamp_ntz"))
    return same_rows(whole, query(rows.where(F.col(at) <= F.lit(until).cast("timestamp_ntz"))).where(F.col(decided) <= F.lit(until).cast("timestamp_ntz")))
