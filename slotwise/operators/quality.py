"""Data quality: bounds, fences, breaks, audits, schemas found from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import time as t
from slotwise.operators.grid import by_time
from slotwise.session import written


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], n_bins: int = 4096) -> DataFrame:
    """Rows by, quantiles: exact quantiles of each group, linear between neighbours, NULLs left out.

    Distinct values are counted first, with map-side sums. Counts of bins of equal width tell which bins hold the
    wanted ranks; only values of these are put in order, so no task holds a group.
    """
    counts = written(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n")), "distinct-values")
    span = counts.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_n").alias("_all"))
    wide = F.col("_hi") - F.col("_lo")
    binned = counts.join(span, by).withColumn("_bin", F.when(wide > 0, F.least(F.lit(n_bins - 1), F.floor((F.col("_x") - F.col("_lo")) / wide * n_bins))).otherwise(0).cast("int"))
    bins = binned.groupBy(*by, "_bin").agg(F.sum("_n").alias("_in_bin"), F.first("_all").alias("_all"))
    bins = bins.withColumn("_before", F.sum("_in_bin").over(Window.partitionBy(*by).orderBy("_bin")) - F.col("_in_bin"))  # at most n_bins rows a group
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * (F.col("_all") - 1)).alias("at")) for i, s in enumerate(shares)])
    ranks = bins.withColumn("_w", F.explode(wanted)).withColumn("_rank", F.explode(F.array(F.floor("_w.at"), F.ceil("_w.at"))))
    ranks = ranks.where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_in_bin"))).select(*by, "_bin", "_before", F.col("_w.i").alias("_i"), F.col("_w.at").alias("_at"), "_rank").distinct()
    held = binned.join(ranks.select(*by, "_bin", "_before").distinct(), [*by, "_bin"])
    held = held.withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_bin").orderBy("_x")))
    found = held.select(*by, "_bin", "_x", "_to").join(ranks.drop("_before"), [*by, "_bin"]).where(F.col("_to") > F.col("_rank")).groupBy(*by, "_i", "_at", "_rank").agg(F.min("_x").alias("_x"))
    each = found.groupBy(*by, "_i", "_at").agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    each = each.select(*by, "_i", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias("_q"))
    return each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias("quantiles"))


def bounds(df: DataFrame, by: str, value: str, caps: dict[str, float] | None = None) -> DataFrame:
    """Per group [0, max(q99.9, q3 + 6 IQR, 1)], with exact quantiles; caps name groups whose upper bound is known."""
    known = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[F.col(by)] if caps else F.lit(None).cast("double")
    q = quantiles(df, [by], value, [0.25, 0.75, 0.999]).withColumnRenamed("quantiles", "_q")
    return q.select(by, F.lit(0.0).alias("low"), F.coalesce(known, F.greatest(F.col("_q")[2], F.col("_q")[1] + 6 * (F.col("_q")[1] - F.col("_q")[0]), F.lit(1.0))).alias("high"))


def outside_to_null(df: DataFrame, dim: DataFrame, by: str, value: str) -> DataFrame:
    """value where it lies in its group's bounds (a small dimension), else NULL."""
    return df.join(F.broadcast(dim), by, "left").withColumn(value, F.when(F.col(value).between(F.col("low"), F.col("high")), F.col(value))).drop("low", "high")


def tukey_fence(df: DataFrame, by: list[str], value: str, width: float = 1.5) -> DataFrame:
    """Rows by, fence_low, fence_high, middle; a degenerate spread gives the median."""
    q = quantiles(df, by, value, [0.25, 0.5, 0.75]).withColumnRenamed("quantiles", "_q")
    iqr = F.col("_q")[2] - F.col("_q")[0]
    return q.select(*by, F.when(iqr > 0, F.col("_q")[0] - width * iqr).otherwise(F.col("_q")[1]).alias("fence_low"), F.when(iqr > 0, F.col("_q")[2] + width * iqr).otherwise(F.col("_q")[1]).alias("fence_high"), F.col("_q")[1].alias("middle"))


def inward(fences: DataFrame) -> DataFrame:
    """Fences one single-precision step inwards, so that values written as singles stay inside; fences that would cross are their upper value."""
    single = lambda c: F.col(c).cast("float")
    step = lambda way, c: F.java_method(F.lit("java.lang.Math"), F.lit(way), single(c)).cast("float").cast("double")
    low, high, flat = step("nextUp", "fence_low"), step("nextDown", "fence_high"), single("fence_high").cast("double")
    return fences.withColumns({"fence_low": F.when(high > low, low).otherwise(flat), "fence_high": F.when(high > low, high).otherwise(flat)})


def valid(y: Column, base: Column, cap: Column | float) -> Column:
    """Whether a label can be learned from: finite, above zero, at most the cap, with a base to compare with."""
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    return F.coalesce(~F.isnan(y) & (y > 0) & (y <= cap) & (y < float("inf")) & base.isNotNull() & ~F.isnan(base), F.lit(False))


def regime_window(df: DataFrame, breaks: DataFrame, by: str, at: str, least: int = 288) -> DataFrame:
    """Rows from their group's break on (breaks: by, break_day; a row a group), of groups with at least that many rows there."""
    since = df.join(F.broadcast(breaks.select(by, "break_day")), by).where(F.col(at) >= F.col("break_day").cast("timestamp_ntz")).drop("break_day")
    long = since.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(by)
    return since.join(F.broadcast(long), by, "left_semi")


def repair(df: DataFrame, overall: DataFrame, recent: DataFrame, by: list[str], value: str) -> DataFrame:
    """value clipped to the union of two fences, median where missing, and whether it was changed."""
    both = overall.join(recent.withColumnsRenamed({"fence_low": "_l", "fence_high": "_h", "middle": "_m"}), by, "left")
    both = both.select(*by, F.least("fence_low", "_l").alias("_low"), F.greatest("fence_high", "_h").alias("_high"), F.coalesce("_m", "middle").alias("_mid"))
    joined = df.join(F.broadcast(both), by, "left")
    kept = F.least(F.greatest(F.coalesce(F.col(value), F.col("_mid")), F.col("_low")), F.col("_high"))
    return joined.withColumns({"repaired": kept, "outlier": (F.col(value).isNull() | (F.col(value) < F.col("_low")) | (F.col(value) > F.col("_high"))).cast("int")}).drop("_low", "_high", "_mid")


def structural_break(daily: DataFrame, by: str, day: str, mean: str, least_ratio: float = 1.5, least_days: int = 3) -> DataFrame:
    """Per group the day whose split of daily means has the largest ratio of means, at least so many days on each side; NULL below the ratio."""
    order = Window.partitionBy(by).orderBy(day)
    whole = Window.partitionBy(by)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = daily.withColumns({"_n": F.count(mean).over(before), "_s": F.sum(mean).over(before), "_count": F.count(mean).over(whole), "_sum": F.sum(mean).over(whole)})
    left, right = F.col("_s") / F.nullif(F.col("_n"), F.lit(0)), (F.col("_sum") - F.col("_s")) / F.nullif(F.col("_count") - F.col("_n"), F.lit(0))
    x = x.where((F.col("_n") >= least_days) & (F.col("_count") - F.col("_n") >= least_days)).withColumn("_r", F.greatest(left / F.nullif(right, F.lit(0.0)), right / F.nullif(left, F.lit(0.0))))
    best = x.groupBy(by).agg(F.max("_r").alias("ratio"), F.max_by(day, F.struct("_r", F.unix_date(F.col(day)) * -1)).alias("_day"))
    return best.select(by, F.when(F.col("ratio") >= least_ratio, F.col("_day")).alias("break_day"), "ratio")


def change_scale(df: DataFrame, value: str = "v", step: int = 4) -> DataFrame:
    """Per series max(median |change over step|, .005 median |value|, 1e-4)."""
    d = df.withColumn("_d", F.abs(F.col(value) - F.lag(value, step).over(by_time())))
    return d.groupBy("series").agg(F.greatest(F.coalesce(F.median("_d"), F.lit(0.0)), 0.005 * F.median(F.abs(F.col(value))), F.lit(1e-4)).alias("scale"))


def active_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with two values or more, in one pass."""
    row = df.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(columns)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"a{i}"] is not None and row[f"a{i}"] != row[f"b{i}"]]


def column_fingerprints(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row per column: name and a hash of all (key, value) pairs, whatever their order."""
    row = df.agg(*[F.bit_xor(F.xxhash64(*key, F.col(c).cast("string"))).alias(c) for c in columns])
    return row.unpivot([], columns, "column", "fingerprint")


def duplicate_columns(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Columns equal to an earlier one: column, duplicate_of. Equal fingerprints are confirmed by comparing all rows."""
    order = {c: i for i, c in enumerate(columns)}
    prints = column_fingerprints(df, key, columns).collect()  # one row a column
    groups: dict[int, list[str]] = {}
    for r in sorted(prints, key=lambda r: order[r["column"]]):
        groups.setdefault(r["fingerprint"], []).append(r["column"])
    pairs = [(g[0], c) for g in groups.values() for c in g[1:]]
    schema = "column string, duplicate_of string"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    differ = df.agg(*[F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]).first()
    return df.sparkSession.createDataFrame([(b, a) for i, (a, b) in enumerate(pairs) if not differ[f"d{i}"]], schema)


def audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: n, missing, negative, zero, constant, z-scores over 3 and values beyond 1.5 IQR."""
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    long = df.select(*[v.alias(c) for c, v in x.items()]).unpivot([], columns, "column", "value")
    quartiles = {r["column"]: r["quantiles"] for r in quantiles(long, ["column"], "value", [0.25, 0.75]).collect()}  # a row a column
    moments = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x.values())], *[F.stddev_samp(v).alias(f"s{i}") for i, v in enumerate(x.values())]).first()

    def counts(i: int, c: str) -> Column:
        v, m, s = x[c], moments[f"m{i}"], moments[f"s{i}"]
        q1, q3 = quartiles.get(c, (None, None))
        far = F.abs((v - F.lit(m)) / F.lit(s)) > 3 if s else F.lit(None).cast("boolean")
        out = (v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1)) if q1 is not None else F.lit(None).cast("boolean")
        same = F.coalesce(F.min(v) == F.max(v), F.lit(True))
        return F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(v.isNull()).alias("n_missing"), F.count_if(v < 0).alias("n_negative"), F.count_if(v == 0).alias("n_zero"), same.alias("is_constant"), F.count_if(far).alias("n_z3"), F.count_if(out).alias("n_iqr"))

    # one wide pass: a row is read once, whatever the number of columns
    return df.agg(F.array(*[counts(i, c) for i, c in enumerate(columns)]).alias("_c")).select(F.inline("_c"))


def quantile_knots(df: DataFrame, by: str, value: str, count: int) -> DataFrame:
    return quantiles(df, [by], value, [i / (count - 1) for i in range(count)]).withColumnRenamed("quantiles", "knots")


def quantile_position(df: DataFrame, knots: DataFrame, by: str, value: str, out: str = "quantile") -> DataFrame:
    """Position of value among its group's knots in [0, 1]: linear between them, the middle of equal knots, 0 at the least and 1 at the greatest."""
    joined = df.join(F.broadcast(knots), by, "left")  # a row a group
    x, n = F.col(value), F.size("knots")
    below = F.size(F.filter("knots", lambda y: y < x))
    upto = F.size(F.filter("knots", lambda y: y <= x))
    lo, hi = F.get("knots", below - 1), F.get("knots", below)
    between = below - 1 + (x - lo) / F.nullif(hi - lo, F.lit(0.0))
    middle = (below + upto - 1) / 2
    at = F.when(x <= F.get("knots", F.lit(0)), F.lit(0.0)).when(x >= F.get("knots", n - 1), F.lit(1.0)).otherwise(F.when(upto > below, middle).otherwise(between) / (n - 1))
    return joined.withColumn(out, F.when(x.isNotNull(), at)).drop("knots")


def quantile_transform(df: DataFrame, knots: DataFrame, by: str, value: str, out: str = "quantile") -> DataFrame:
    """Position of value among its group's knots, linear between them, in [0, 1]."""
    joined = df.join(F.broadcast(knots), by, "left")
    k, x, n = F.col("knots"), F.col(value), F.size("knots")
    below = F.size(F.filter(k, lambda y: y <= x))
    lo, hi = F.get(k, below - 1), F.get(k, below)
    at = F.when(below == 0, F.lit(0.0)).when(below >= n, F.lit(1.0)).otherwise((below - 1 + (x - lo) / F.nullif(hi - lo, F.lit(0.0))) / (n - 1))
    return joined.withColumn(out, F.when(x.isNotNull(), at)).drop("knots")


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, hash) of a table whatever the order of its rows; repeated rows count."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash"))


def changed_cells(before: DataFrame, after: DataFrame, key: list[str], columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Cells of each column that differ by more than the tolerance, or are missing on one side only."""
    a = before.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns])
    joined = a.join(after.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns]), key)
    far = lambda c: F.when(F.col(f"a_{c}").isNull() | F.col(f"b_{c}").isNull(), ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).otherwise(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > tolerance)
    return joined.agg(*[F.count_if(far(c)).alias(c) for c in columns]).unpivot([], columns, "column", "n_changed")


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """df; the query fails where ok is not true."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def delivered_audit(delivered: DataFrame, original: DataFrame, overall: DataFrame, recent: DataFrame, n_origins: int) -> DataFrame:
    """Findings on a delivered table (series, b, value, outlier): rows, repeats, breaks of the grid, numbers that are none, cells outside
    the union of both fences, repaired cells, and repaired ones whose original value (series, b, value) the recent fence calls normal."""
    both = overall.join(recent.withColumnsRenamed({"fence_low": "_l", "fence_high": "_h", "middle": "_m"}), "series", "left")
    fences = both.select("series", F.least("fence_low", "_l").alias("_low"), F.greatest("fence_high", "_h").alias("_high"), "_l", "_h")
    x = delivered.join(original.select("series", "b", F.col("value").alias("_was")), ["series", "b"], "left").join(F.broadcast(fences), "series", "left")
    step = (t.micros(F.col("b")) - t.micros(F.lag("b").over(by_time()))) / t.STEP_US
    x = x.withColumn("_step", step)
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    found = x.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_step") == 0).alias("n_repeated"),
        F.count_if(F.col("_step") > 1).alias("n_breaks"),
        F.count_if(bad).alias("n_not_finite"),
        F.count_if(~F.col("value").between(F.col("_low"), F.col("_high"))).alias("n_outside"),
        F.count_if(F.col("outlier") == 1).alias("n_repaired"),
        F.count_if((F.col("outlier") == 1) & F.col("_was").between(F.col("_l"), F.col("_h"))).alias("n_normal_repaired"),
    )
    ok = (F.col("n_rows") == n_origins) & (F.col("n_repeated") + F.col("n_breaks") + F.col("n_not_finite") + F.col("n_outside") + F.col("n_normal_repaired") == 0)
    return found.withColumn("passed", ok)
