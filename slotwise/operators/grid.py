"""Time grids: right-closed resampling, gaps, fills, long and wide form.

The canonical table is long: series, b (right edge of a 15-minute slot), raw (NULL where nothing was
observed: a label), v (filled forward, then 0: a feature). A series is at most as long as its time span,
so windows by series stay small however many rows fall into a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import time as t


def by_time():
    """The window that all features of a series share."""
    return Window.partitionBy("series").orderBy("b")


def so_far():
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def clean_number(value: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def collapse_duplicates(obs: DataFrame) -> DataFrame:
    """One row per (series, ts): the mean of observations at the same instant."""
    return obs.groupBy("series", "ts").agg(F.avg(clean_number(F.col("value"))).alias("value"))


def resample(obs: DataFrame, how: str = "mean", step_us: int = t.STEP_US) -> DataFrame:
    """Rows series, b, raw. how: mean (of means by instant), sum (exact for cents) or last (latest non-null)."""
    keyed = obs.withColumn("value", clean_number(F.col("value"))) if how != "mean" else collapse_duplicates(obs)
    keyed = keyed.withColumn("b", t.right_bucket(F.col("ts"), step_us))
    if how == "mean":
        value = F.avg("value")
    elif how == "sum":
        value = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    elif how == "last":
        tie = [F.col("event_id")] if "event_id" in obs.columns else [F.col("value")]
        value = F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("ts", *tie)))
    else:
        raise ValueError(f"unknown resampling: {how}")
    return keyed.groupBy("series", "b").agg(value.alias("raw"))


def full_grid(slots: DataFrame, step_us: int = t.STEP_US, until: str | None = None) -> DataFrame:
    """Every series at every slot from the first to the last of all, or to `until` if that is later; raw is NULL in gaps."""
    last = F.max("b") if until is None else F.greatest(F.max("b"), F.lit(until).cast("timestamp_ntz"))
    span = slots.agg(F.min("b").alias("lo"), last.alias("hi"))  # one row
    names = slots.select("series").distinct().crossJoin(F.broadcast(span))
    every = names.select("series", F.explode(F.sequence("lo", "hi", F.expr(f"interval {step_us // 1_000_000} seconds"))).alias("b"))
    return every.join(slots, ["series", "b"], "left")


def fill(grid: DataFrame, raw: str = "raw", out: str = "v") -> DataFrame:
    return grid.withColumn(out, F.coalesce(F.last(raw, ignorenulls=True).over(so_far()), F.lit(0.0)))


def fill_both_ways(df: DataFrame, column: str, window: Window, out: str) -> DataFrame:
    back = F.first(column, ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(F.last(column, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)), back))


def gap_report(slots: DataFrame, step_us: int = t.STEP_US) -> DataFrame:
    """Per series: rows, first, last, breaks of the step and slots missing between first and last."""
    step = (t.micros(F.col("b")) - t.micros(F.lag("b").over(by_time()))) / step_us
    return (
        slots.withColumn("_step", step)
        .groupBy("series")
        .agg(F.count(F.lit(1)).alias("n_slots"), F.min("b").alias("first_slot"), F.max("b").alias("last_slot"), F.count_if(F.col("_step") != 1).alias("n_breaks"), F.sum(F.greatest(F.coalesce(F.col("_step"), F.lit(1.0)) - 1, F.lit(0.0))).cast("long").alias("n_missing"), F.count_if(F.col("raw").isNull()).alias("n_null"))
    )


def to_wide(grid: DataFrame, names: list[str], value: str = "raw") -> DataFrame:
    return grid.groupBy("b").pivot("series", names).agg(F.first(value))


def to_long(wide: DataFrame, names: list[str]) -> DataFrame:
    return wide.unpivot(["b"], names, "series", "raw").where("raw is not null")


def non_negative(df: DataFrame, column: str, name: Column) -> DataFrame:
    """Clips at 0 unless the series' name says that it may be negative."""
    return df.withColumn(column, F.when(name.rlike("(?i)temp|delta|diff"), F.col(column)).otherwise(F.greatest(F.col(column), F.lit(0.0))))


def coalesce_columns(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(a), F.col(b)))


def join_sources(sources: list[DataFrame], key: str = "b") -> DataFrame:
    """Full outer join of wide sources on the key in one shuffle; of a column that several have, the first source's value that is there.

    Each source has one row a key (see collapse_duplicates); more than one give any of their values.
    """
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    every = tagged[0]
    for s in tagged[1:]:
        every = every.unionByName(s, allowMissingColumns=True)
    names = [c for c in every.columns if c not in (key, "_source")]
    return every.groupBy(key).agg(*[F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col("_source"))).alias(c) for c in names])


def daily_mean(grid: DataFrame, value: str = "raw") -> DataFrame:
    """Left-closed days, days without values left out."""
    return grid.groupBy("series", F.to_date("b").alias("day")).agg(F.avg(value).alias("mean")).where("mean is not null")


def rolling_origins(grid: DataFrame, last: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Distinct slots: the last n, or a closed range."""
    slots = grid.select("b").distinct()
    if since is not None:
        slots = slots.where(F.col("b") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        slots = slots.where(F.col("b") <= F.lit(until).cast("timestamp_ntz"))
    return slots.orderBy(F.desc("b")).limit(last) if last else slots


def corner_origins(df: DataFrame, by: list[str], at: str = "b") -> DataFrame:
    """First, middle and last row of each group by time: the ones that replays are checked on."""
    w = Window.partitionBy(*by)
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(at))
    x = df.withColumns({"_n": n, "_i": i}).where("_i in (1, _n div 2 + 1, _n)")
    return x.withColumn("corner", F.when(F.col("_i") == 1, "first").when(F.col("_i") == F.col("_n"), "last").otherwise("middle")).drop("_n", "_i")


def profile_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, range of time and missing values of each column, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min("b").alias("first_slot"), F.max("b").alias("last_slot"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns])
