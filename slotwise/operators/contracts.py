"""Contracts of tables and packages: joining parts, required shapes, independent scores, rubric, selection of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import time as t
from slotwise.operators import validate


def combine(train: DataFrame, test: DataFrame, key: list[str], cutoff: Column) -> DataFrame:
    """Training rows up to the cutoff and test rows after it; the same key on both sides is an error."""
    both = train.where(F.col("b") <= cutoff).withColumn("part", F.lit("train")).unionByName(test.where(F.col("b") > cutoff).withColumn("part", F.lit("test")))
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return both.withColumn("_n", n).where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a time stands in both parts or twice")).cast("boolean"))).drop("_n")


def every_nth(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """Rows 1, n + 1, 2 n + 1, ... of each group: the sampling step of a member's training rows."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_r") % n == 1 if n > 1 else F.lit(True)).drop("_r")


def latest(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def core_columns(columns: list[str], core: list[str], kinds: tuple[str, ...] = (), sensors: tuple[str, ...] = ()) -> list[str]:
    """Columns of the core signals, and of further sensors only those of the kinds asked for; in table order."""
    own = lambda c, names: any(c == n or c.startswith(f"{n}_") for n in names)
    return [c for c in columns if own(c, core) or own(c, sensors) and any(c.endswith(f"_{k}") for k in kinds)]


def by_priority(columns: list[str], first: list[str], words: tuple[str, ...], most: int) -> list[str]:
    """At most `most` columns: those in first, then those whose names hold one of the words, then the rest, each in table order."""
    said = [c for c in columns if any(w in c.lower() for w in words)]
    return list(dict.fromkeys([*[c for c in first if c in columns], *said, *columns]))[:most]


def check_predictions(df: DataFrame, steps: list[int], expected: int) -> DataFrame:
    """One row of findings on predictions (series, b, h, p): rows, missing, infinite, negative and repeated ones, steps and origins that lack."""
    key = ["series", "b", "h"]
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("p"))
    bad = F.isnan("p") | (F.abs("p") == float("inf"))
    per = repeated.groupBy("series").agg(
        F.sum("n").alias("n_rows"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.count_if(F.col("p").isNull()).alias("n_missing"),
        F.count_if(bad).alias("n_not_finite"),
        F.count_if(F.col("p") < 0).alias("n_negative"),
        F.count_if(~F.col("h").isin(steps)).alias("n_other_steps"),
        F.count_distinct("b").alias("n_origins"),
    )
    ok = (F.col("n_rows") == expected * len(steps)) & (F.col("n_origins") == expected) & (F.col("n_repeated") + F.col("n_missing") + F.col("n_not_finite") + F.col("n_negative") + F.col("n_other_steps") == 0)
    return per.withColumn("passed", ok)


def check_frame(df: DataFrame, name: str, raw: list[str] = (), prefix: str | None = None, time: str = "datetime") -> DataFrame:
    """One row of findings on a delivered wide table: rows, repeated times, cells that are missing or not finite, and columns other than the
    raw ones whose names lack the prefix. A table without its time column is an error."""
    if time not in df.columns:
        raise ValueError(f"{name} has no column {time}")
    columns = [c for c in df.columns if c != time]
    x = lambda c: F.col(f"`{c}`").cast("double")
    bad = sum(((x(c).isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf"))).cast("long") for c in columns), F.lit(0).cast("long"))
    misnamed = sum(c not in raw and not c.startswith(prefix) for c in columns) if prefix else 0
    per = df.withColumn("_bad", bad).groupBy(F.col(f"`{time}`").alias("_t")).agg(F.count(F.lit(1)).alias("_n"), F.sum("_bad").alias("_bad"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    found = per.agg(zero(F.sum("_n")).alias("n_rows"), zero(F.sum(F.col("_n") - 1)).alias("n_repeated"), zero(F.sum("_bad")).alias("n_not_finite"))
    found = found.select(F.lit(name).alias("name"), "*", F.lit(misnamed).cast("long").alias("n_misnamed"))
    return found.withColumn("passed", (F.col("n_rows") > 0) & (F.col("n_repeated") + F.col("n_not_finite") + F.col("n_misnamed") == 0))


def delivery_points(df: DataFrame, raw: list[str], first: Column, last: Column, fences: DataFrame, time: str = "b", least_features: int = 20, step_us: int = t.STEP_US) -> DataFrame:
    """Rows check, points, n_faults of a delivered input: unique times (5), the origins from first to last (5), finite values (10), names of
    features (5), raw columns (15), and outliers repaired with an indicator for each raw column (10). fences has a row a series."""
    there = [c for c in raw if c in df.columns]
    features = [c for c in df.columns if c.startswith("feat_")]
    numbers = [c for c in df.columns if c != time]
    x = lambda c: F.col(f"`{c}`").cast("double")
    limits = {r["series"]: (r["fence_low"], r["fence_high"]) for r in fences.collect()}  # a row a raw column
    bad = sum(((x(c).isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf"))).cast("long") for c in numbers), F.lit(0).cast("long"))
    out = sum((F.coalesce(~x(c).between(*limits[c]), F.lit(False)).cast("long") for c in there if c in limits), F.lit(0).cast("long"))
    expected = (t.micros(last) - t.micros(first)) / step_us + 1
    inside = F.col(time).between(first, last) & ((t.micros(F.col(time)) - t.micros(first)) % step_us == 0)
    per = df.select(F.col(time), bad.alias("_bad"), out.alias("_out")).groupBy(time).agg(F.count(F.lit(1)).alias("_n"), F.sum("_bad").alias("_bad"), F.sum("_out").alias("_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    found = per.agg(zero(F.sum(F.col("_n") - 1)).alias("u"), zero(F.count_if(~inside) + expected - F.count_if(inside)).alias("o"), zero(F.sum("_bad")).alias("b"), zero(F.sum("_out")).alias("x"))
    named = sum(c not in raw and c not in features for c in numbers) + max(0, least_features + 1 - len(features))
    marked = max(0, len(raw) - sum(c.endswith("_outlier") for c in features))
    checks = [("unique times", 5.0, F.col("u")), ("origins", 5.0, F.col("o")), ("finite values", 10.0, F.col("b")), ("feature names", 5.0, F.lit(named)), ("raw columns", 15.0, F.lit(len(raw) - len(there))), ("outliers", 10.0, F.col("x") + marked)]
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.when(n == 0, F.lit(p)).otherwise(F.lit(0.0)).alias("points"), n.cast("long").alias("n_faults")) for k, p, n in checks])
    return found.select(F.inline(rows))


def rescore(predictions: DataFrame, recorded: DataFrame, by: list[str], tolerance: float = 5.1e-7) -> DataFrame:
    """Independent errors beside recorded ones (column mape), and whether they agree."""
    own = validate.error_by(predictions, by, strict=False).select(*by, F.col("mape").alias("own_mape"))
    x = own.join(recorded.select(*by, F.col("mape").alias("recorded_mape")), by)
    return x.withColumn("agrees", F.abs(F.col("own_mape") - F.col("recorded_mape")) <= tolerance)


def rubric(checks: DataFrame, mape: Column) -> DataFrame:
    """Points of a delivered table: 50 for its form, shared by checks (boolean column passed), and 50 for accuracy."""
    form = checks.agg((50.0 * F.avg(F.col("passed").cast("double"))).alias("form_points"))
    return form.withColumn("accuracy_points", F.greatest(F.lit(0.0), 50.0 * (1 - mape)))


def shrink_select(errors: DataFrame, by: list[str], choice: str, error: str) -> DataFrame:
    """Per group the setting of least mean error over all cutoffs but one, for each cutoff left out, and its error on that one.

    errors has a row for each (by, cutoff, choice); sums over cutoffs are taken once.
    """
    w = Window.partitionBy(*by, choice)
    others = errors.withColumn("_others", (F.sum(error).over(w) - F.col(error)) / F.nullif(F.count(error).over(w) - 1, F.lit(0)))
    best = others.groupBy(*by, "cutoff").agg(F.min_by(F.struct(choice, error), F.struct("_others", choice)).alias("_b"))
    return best.select(*by, "cutoff", F.col(f"_b.{choice}").alias(choice), F.col(f"_b.{error}").alias("left_out_error"))


def stack_rows(predictions: DataFrame, names: list[str]) -> DataFrame:
    """One row for each (series, b, h) with the members' forecasts, their mean, spread and the clock: what a stacked learner reads."""
    wide = predictions.groupBy("series", "b", "h", "y").pivot("member", names).agg(F.first("p"))
    values = F.array(*names)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / len(names)
    return wide.withColumns({"member_mean": mean, "member_spread": F.array_max(values) - F.array_min(values), "slot": t.slot_of_day(F.col("b"))})
