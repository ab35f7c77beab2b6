"""Forecast members. All give rows series, b (origin), h, member, p; none reads past its origin."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.functions import time as t
from slotwise.operators import features
from slotwise.operators.grid import by_time, fill_both_ways
from slotwise.operators.quality import content_hash, quantiles
from slotwise.session import written

DAY, WEEK = t.SLOTS_PER_DAY, 7 * t.SLOTS_PER_DAY


def _rows(ahead: DataFrame, name: str, p: Column) -> DataFrame:
    return ahead.select("series", "b", "h", F.lit(name).alias("member"), p.cast("double").alias("p"))


def persistence(ahead: DataFrame) -> DataFrame:
    """ahead: the grid's origins for each horizon (features.horizons)."""
    return _rows(ahead, "persistence", F.col("v"))


def averages(ahead: DataFrame, spans: list[int]) -> DataFrame:
    """Exponential averages that stand in columns ema_<span>."""
    return ahead.select("series", "b", "h", F.explode(F.array(*[F.struct(F.lit(f"ema_{s}").alias("member"), F.col(f"ema_{s}").alias("p")) for s in spans])).alias("_m")).select("series", "b", "h", "_m.member", "_m.p")


def lookup(ahead: DataFrame, grid: DataFrame, at: Column, name: str, value: str = "v") -> DataFrame:
    """ahead with the grid's value at another time of the same series, by an equality join."""
    other = grid.select(F.col("series").alias("_s"), F.col("b").alias("_t"), F.col(value).alias(name))
    return ahead.withColumn("_at", at).join(other, (F.col("series") == F.col("_s")) & (F.col("_at") == F.col("_t")), "left").drop("_s", "_t", "_at")


def seasonal(ahead: DataFrame, grid: DataFrame) -> DataFrame:
    """The observed value a day before the target; the current one where that is missing."""
    x = lookup(ahead, grid, t.shift(F.col("target_ts"), -DAY), "_y", "raw")
    return _rows(x, "seasonal", F.coalesce("_y", "v"))


def seasonal_blend(ahead: DataFrame, grid: DataFrame, weights: tuple[float, float, float] = (0.72, 0.18, 0.10), name: str = "seasonal_blend") -> DataFrame:
    """Day before, week before, median of the last eight; what is missing falls back to the next."""
    recent = grid.withColumn("_recent", _median_of_past(8))
    x = ahead.join(recent.select("series", "b", "_recent"), ["series", "b"])
    x = lookup(x, grid, t.shift(F.col("target_ts"), -DAY), "_day", "raw")
    x = lookup(x, grid, t.shift(F.col("target_ts"), -WEEK), "_week", "raw")
    day = F.coalesce("_day", "_recent")
    return _rows(x, name, weights[0] * day + weights[1] * F.coalesce(F.col("_week"), day) + weights[2] * F.col("_recent"))


def seasonal_future(ahead: DataFrame, grid: DataFrame) -> DataFrame:
    """The blend for slots beyond the data: .75 of the day before, .15 of the week before, .10 of the recent median, not below zero."""
    return seasonal_blend(ahead, grid, (0.75, 0.15, 0.10), "seasonal_future").withColumn("p", F.greatest(F.col("p"), F.lit(0.0)))


def _median_of_past(n: int) -> Column:
    a = F.sort_array(F.collect_list("v").over(features.previous(n)))
    k = F.size(a)
    half = F.floor(k / 2).cast("int")
    return F.when(k % 2 == 1, F.get(a, half)).otherwise((F.get(a, half - 1) + F.get(a, half)) / 2)


def ar1(grid: DataFrame, cutoff: Column) -> DataFrame:
    """Per series phi and rho: correlation of changes with those one and two slots before, up to the cutoff."""
    d = F.col("v") - F.lag("v").over(by_time())
    x = grid.withColumn("_d", d)
    x = x.withColumns({"_d1": F.lag("_d", 1).over(by_time()), "_d2": F.lag("_d", 2).over(by_time())}).where(F.col("b") <= cutoff)
    phi, two = F.corr("_d", "_d1"), F.corr("_d", "_d2")
    x = x.groupBy("series").agg(phi.alias("phi"), two.alias("_two"))
    return x.select("series", F.coalesce("phi", F.lit(0.0)).alias("phi"), F.least(F.greatest(F.coalesce(F.col("_two") / F.nullif(F.col("phi"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(0.95)).alias("rho"))


def momentum(ahead: DataFrame, grid: DataFrame, coefficients: DataFrame) -> DataFrame:
    x = ahead.join(grid.withColumn("_d", F.coalesce(F.col("v") - F.lag("v").over(by_time()), F.lit(0.0))).select("series", "b", "_d"), ["series", "b"])
    x = x.join(F.broadcast(coefficients), "series")
    return _rows(x, "momentum", F.col("v") + F.col("phi") * F.pow("rho", F.col("h") - 1) * F.col("_d"))


def profile(grid: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows series, slot, level: mean by slot of day of observed values in (start, end], gaps filled from neighbours."""
    mean = grid.where((F.col("b") > start) & (F.col("b") <= end)).groupBy("series", t.slot_of_day(F.col("b")).alias("slot")).agg(F.avg("raw").alias("_level"))
    slots = grid.select("series").distinct().select("series", F.explode(F.sequence(F.lit(0), F.lit(DAY - 1))).alias("slot"))
    full = slots.join(mean, ["series", "slot"], "left")
    return fill_both_ways(full, "_level", Window.partitionBy("series").orderBy("slot"), "level").drop("_level")


def diurnal(ahead: DataFrame, levels: DataFrame) -> DataFrame:
    x = ahead.withColumn("slot", t.slot_of_day(F.col("target_ts"))).join(F.broadcast(levels), ["series", "slot"], "left")
    return _rows(x, "profile", F.coalesce("level", "v"))


def anchored(ahead: DataFrame, grid: DataFrame, levels: DataFrame) -> DataFrame:
    """Profile at the target scaled by the mean of the last four values over the profile now."""
    now = grid.withColumns({"_recent": F.avg("v").over(features.previous(4)), "slot": t.slot_of_day(F.col("b"))}).join(F.broadcast(levels), ["series", "slot"], "left").select("series", "b", "_recent", F.col("level").alias("_now"))
    x = ahead.join(now, ["series", "b"]).withColumn("slot", t.slot_of_day(F.col("target_ts"))).join(F.broadcast(levels), ["series", "slot"], "left")
    return _rows(x, "anchored_profile", F.coalesce(F.col("level") * F.col("_recent") / F.nullif(F.col("_now"), F.lit(0.0)), F.col("v")))


def simple_members(ahead: DataFrame, grid: DataFrame, levels: DataFrame, coefficients: DataFrame, spans: list[int]) -> DataFrame:
    """All members without a fit of their own as rows series, b, h, y, member, p: one wide row an origin and horizon, two lookups, one unpivot.

    grid and ahead hold ema_<span>; what a member needs of the past stands in the origin's row before horizons multiply it.
    """
    past = {"_median": _median_of_past(8), "_mean": F.avg("v").over(features.previous(4)), "_d": F.coalesce(F.col("v") - F.lag("v").over(by_time()), F.lit(0.0))}
    now = grid.withColumns({**past, "slot": t.slot_of_day(F.col("b"))}).join(F.broadcast(levels.withColumnRenamed("level", "_now")), ["series", "slot"], "left").select("series", "b", *past, "_now")
    x = ahead.join(now, ["series", "b"])
    x = lookup(x, grid, t.shift(F.col("target_ts"), -DAY), "_day", "raw")
    x = lookup(x, grid, t.shift(F.col("target_ts"), -WEEK), "_week", "raw")
    x = x.withColumn("slot", t.slot_of_day(F.col("target_ts"))).join(F.broadcast(levels), ["series", "slot"], "left").join(F.broadcast(coefficients), "series", "left")
    day = F.coalesce("_day", "_median")
    made = {
        "persistence": F.col("v"),
        **{f"ema_{s}": F.col(f"ema_{s}") for s in spans},
        "seasonal": F.coalesce("_day", "v"),
        "seasonal_blend": 0.72 * day + 0.18 * F.coalesce(F.col("_week"), day) + 0.10 * F.col("_median"),
        "momentum": F.col("v") + F.col("phi") * F.pow("rho", F.col("h") - 1) * F.col("_d"),
        "profile": F.coalesce("level", "v"),
        "anchored_profile": F.coalesce(F.col("level") * F.col("_mean") / F.nullif(F.col("_now"), F.lit(0.0)), F.col("v")),
    }
    wide = x.select("series", "b", "h", "y", *[c.cast("double").alias(f"_p_{n}") for n, c in made.items()])
    return wide.select("series", "b", "h", "y", *[F.col(f"_p_{n}").alias(n) for n in made]).unpivot(["series", "b", "h", "y"], list(made), "member", "p")


def drift(ahead: DataFrame, labelled: DataFrame, cutoff: Column, strength: float = 0.5) -> DataFrame:
    """v (1 + strength * weighted median of relative changes), fitted per (series, h) on labels up to the cutoff."""
    x = labelled.where((F.col("target_ts") <= cutoff) & (F.col("y") > 0) & (F.col("v") > 0)).select("series", "h", (F.col("y") / F.col("v") - 1).alias("x"), F.col("v").alias("w"))
    m = weighted_median(x, ["series", "h"], "x", "w")
    return _rows(ahead.join(F.broadcast(m), ["series", "h"], "left"), "drift", F.col("v") * (1 + strength * F.coalesce("median", F.lit(0.0))))


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Per group the first value at which half of the weight is reached. Equal values are summed before they are ordered."""
    x = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    order = Window.partitionBy(*by).orderBy(value)
    x = x.withColumns({"_cum": F.sum("_w").over(order), "_all": F.sum("_w").over(Window.partitionBy(*by))})
    return x.where(F.col("_cum") >= 0.5 * F.col("_all")).groupBy(*by).agg(F.min(value).alias("median"))


# -- fitted members: normal equations are summed by Spark, solved one small system a group --


def gram(df: DataFrame, by: list[str], x: list[str], y: str, weight: Column | None = None) -> DataFrame:
    """Per group the sums that a (weighted) linear fit with intercept needs, as one array of n, Sw, Swx, Swy, Swxx, Swxy, Swyy."""
    w = weight if weight is not None else F.lit(1.0)
    columns = [F.col(c).cast("double") for c in x]
    target = F.col(y).cast("double")
    sums = [F.count(F.lit(1)).cast("double"), F.sum(w), *[F.sum(w * c) for c in columns], F.sum(w * target)]
    sums += [F.sum(w * a * b) for i, a in enumerate(columns) for b in columns[i:]] + [F.sum(w * c * target) for c in columns] + [F.sum(w * target * target)]
    return df.groupBy(*by).agg(F.array(*sums).alias("sums"))


def solve_ridge(sums: list[float], k: int, alpha: float) -> tuple[float, list[float]]:
    """(intercept, coefficients) of min sum w (y - b0 - x b)^2 + alpha |b|^2 on standardised x."""
    s = np.asarray(sums, float)
    total, mx, my = s[1], s[2 : 2 + k] / s[1], s[2 + k] / s[1]
    upper = s[3 + k : 3 + k + k * (k + 1) // 2]
    xx = np.zeros((k, k))
    xx[np.triu_indices(k)] = upper
    xx = xx + np.triu(xx, 1).T
    xy = s[3 + k + k * (k + 1) // 2 : 3 + k + k * (k + 1) // 2 + k]
    cov, cross = xx - total * np.outer(mx, mx), xy - total * mx * my
    scale = np.sqrt(np.maximum(np.diag(cov) / total, 0))
    live = scale > 1e-9
    coefficients = np.zeros(k)
    if live.any():
        d = scale[live]
        a = cov[np.ix_(live, live)] / np.outer(d, d) + alpha * np.eye(live.sum())
        coefficients[live] = np.linalg.solve(a, cross[live] / d) / d
    return float(my - mx @ coefficients), coefficients.tolist()


def ridge(train: DataFrame, by: list[str], x: list[str], y: str, alpha: float = 100.0, weight: Column | None = None) -> DataFrame:
    """Rows by, intercept, coefficients."""
    k = len(x)

    @F.udf("intercept double, coefficients array<double>")  # once a group, on a few hundred sums
    def solve(sums):
        return solve_ridge(sums, k, alpha)

    return gram(train, by, x, y, weight).select(*by, solve("sums").alias("_f")).select(*by, "_f.*")


def save_fit(fit: DataFrame, path: str, columns: list[str], settings: dict) -> None:
    """Fitted parameters as a table, with the columns and settings that they belong to."""
    stated = json.dumps({"columns": columns, "settings": settings}, sort_keys=True)
    fit.withColumn("_facts", F.lit(stated)).write.parquet(path)


def load_fit(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A saved fit, and {columns, settings}."""
    kept = spark.read.parquet(path)
    first = kept.select("_facts").first()
    return kept.drop("_facts"), json.loads(first["_facts"]) if first else {"columns": [], "settings": {}}


def warm_start(spark: SparkSession, path: str, train: DataFrame, columns: list[str], settings: dict, make) -> DataFrame:
    """The fit kept under path if it was made from the same rows, columns and settings (else an error), or a new one, which is kept."""
    rows = content_hash(train.select(*sorted(train.columns))).first()
    facts = settings | {"rows": f"{rows['n_rows']}:{rows['hash']}"}
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(to):
        fit, known = load_fit(spark, path)
        if known != {"columns": columns, "settings": facts}:
            raise ValueError("the kept fit is of other rows, columns or settings")
        return fit
    save_fit(make(), path, columns, facts)
    return load_fit(spark, path)[0]


def estimators(slot: object) -> tuple:
    """A member's fits, however they were kept: none, one, or a list of seeds' fits with gaps."""
    return () if slot is None else tuple(x for x in slot if x is not None) if isinstance(slot, (list, tuple)) else (slot,)


def linear(df: DataFrame, fit: DataFrame, by: list[str], x: list[str]) -> Column:
    """Prediction column for df joined with fit (intercept, coefficients)."""
    return sum((F.col("coefficients")[i] * F.col(c).cast("double") for i, c in enumerate(x)), F.col("intercept"))


def robust_ridge(train: DataFrame, by: list[str], x: list[str], y: str, alpha: float = 100.0, rounds: int = 8) -> DataFrame:
    """Iteratively reweighted ridge towards least absolute error, floor max(.2, .15 median |residual|)."""
    train = written(train, "robust-rows")
    fit = written(ridge(train, by, x, y, alpha), "robust-fit")
    for _ in range(rounds):  # a fit is a row a group, written so that the plan of a round doesn't hold the rounds before
        residual = train.join(F.broadcast(fit), by).withColumn("_r", F.abs(F.col(y) - linear(train, fit, by, x))).drop("intercept", "coefficients")
        floor = quantiles(residual, by, "_r", [0.5]).select(*by, F.greatest(0.15 * F.col("quantiles")[0], F.lit(0.2)).alias("_floor"))
        weighed = residual.join(F.broadcast(floor), by).withColumn("_w", 1 / F.greatest("_r", "_floor"))
        fit = written(ridge(weighed, by, x, y, alpha, F.col("_w")), "robust-fit")
    return fit


def relative_ridge(train: DataFrame, by: list[str], x: list[str], y: str, base: str, alpha: float = 100.0) -> DataFrame:
    """Ridge on y / base - 1 with weight base squared: absolute errors count."""
    level = F.greatest(F.col(base), F.lit(1.0))
    return ridge(train.withColumn("_y", F.col(y) / level - 1), by, x, "_y", alpha, level * level)


def local_ridge(train: DataFrame, by: list[str], x: list[str], y: str, state: str, centres: list[float], bandwidth: float, alpha: float = 300.0) -> list[DataFrame]:
    """A global fit and one for each centre of the state, weighted by a Gaussian gate."""
    gates = [F.exp(-0.5 * F.pow((F.col(state) - c) / bandwidth, 2)) for c in centres]
    total = sum(gates[1:], gates[0])
    return [ridge(train, by, x, y, alpha), *[ridge(train, by, x, y, alpha, g / total) for g in gates]]


def centres_of(train: DataFrame, state: str, count: int) -> tuple[list[float], float]:
    """Centres at even quantiles of the state, and their mean distance as the gates' width."""
    shares = [(i + 0.5) / count for i in range(count)]
    q = quantiles(train.withColumn("_one", F.lit(1)), ["_one"], state, shares).first()["quantiles"]
    return q, max((q[-1] - q[0]) / max(1, count - 1), 1e-9)


def local_forecast(test: DataFrame, fits: list[DataFrame], by: list[str], x: list[str], state: str, centres: list[float], width: float, share: float = 0.8) -> DataFrame:
    """test with p: (1 - share) of the global fit and share of the experts, each by its gate."""
    parts = []
    for i, fit in enumerate(fits):
        test = test.join(F.broadcast(fit.withColumnsRenamed({"intercept": f"_i{i}", "coefficients": f"_c{i}"})), by, "left")  # a row a group
        parts.append(sum((F.col(f"_c{i}")[k] * F.col(c).cast("double") for k, c in enumerate(x)), F.col(f"_i{i}")))
    gates = [F.exp(-0.5 * F.pow((F.col(state) - c) / width, 2)) + 1e-12 for c in centres]
    total = sum(gates[1:], gates[0])
    local = sum((g / total * p for g, p in zip(gates, parts[1:], strict=True)), F.lit(0.0))
    return test.withColumn("p", (1 - share) * parts[0] + share * local).drop(*[f"_{k}{i}" for i in range(len(fits)) for k in "ic"])


def periodic_refit(labelled: DataFrame, by: list[str], x: list[str], y: str, every: int, alpha: float = 100.0) -> DataFrame:
    """Predictions series, b, h, p: each block of `every` origins uses a fit on labels that matured before its first origin.

    Sums are taken by block and accumulated, so every refit costs one small solve, not another pass over history.
    """
    k = len(x)
    length = every * t.STEP_US
    block = t.block(F.col("b"), length)
    ready = t.block(F.col("target_ts"), length) + 1  # first block that may use the label
    usable = labelled.where(F.col(y).isNotNull()).withColumn("_block", ready)
    parts = gram(usable, [*by, "_block"], x, y).select(*by, "_block", F.posexplode("sums").alias("_i", "_x"))
    wanted = labelled.select(*by, block.alias("_block")).distinct()
    every_sum = wanted.select(*by, "_block", F.explode(F.sequence(F.lit(0), F.lit(_sums(k) - 1))).alias("_i")).join(parts, [*by, "_block", "_i"], "full_outer")
    running = every_sum.withColumn("_c", F.sum(F.coalesce("_x", F.lit(0.0))).over(Window.partitionBy(*by, "_i").orderBy("_block")))
    sums = running.groupBy(*by, "_block").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_c"))), lambda s: s["_c"]).alias("sums")).where(F.col("sums")[0] >= 2 * k + 2)

    @F.udf("intercept double, coefficients array<double>")
    def solve(s):
        return solve_ridge(s, k, alpha)

    fits = sums.select(*by, "_block", solve("sums").alias("_f")).select(*by, "_block", "_f.*")
    joined = labelled.withColumn("_block", block).join(fits, [*by, "_block"])
    return joined.select("series", "b", "h", F.lit("refit_ridge").alias("member"), linear(joined, fits, by, x).alias("p"))


def _sums(k: int) -> int:
    return 3 + k + k * (k + 1) // 2 + k + 1


def boosted(train: DataFrame, test: DataFrame, x: list[str], y: str, weight: str | None = None, trees: int = 30, depth: int = 4, seed: int = 7) -> DataFrame:
    """test with prediction p by gradient-boosted trees on absolute loss; all horizons in one model if h is among x."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    vectors = VectorAssembler(inputCols=x, outputCol="_x", handleInvalid="skip")
    model = GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="p", lossType="absolute", maxIter=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)
    if weight:
        model = model.setWeightCol(weight)
    return model.fit(vectors.transform(train)).transform(vectors.transform(test)).drop("_x")


def smooth_horizons(predictions: DataFrame, width: int = 1) -> DataFrame:
    """Mean of p over neighbouring horizons of one origin."""
    w = Window.partitionBy("series", "b", "member").orderBy("h").rowsBetween(-width, width)
    return predictions.withColumn("p", F.avg("p").over(w))


def nonnegative_fit(sums: list[float], k: int) -> list[float]:
    """Non-negative least squares without intercept from the sums of gram, by trying supports (k is small)."""
    s = np.asarray(sums, float)
    xx = np.zeros((k, k))
    xx[np.triu_indices(k)] = s[3 + k : 3 + k + k * (k + 1) // 2]
    xx = xx + np.triu(xx, 1).T
    xy = s[3 + k + k * (k + 1) // 2 : 3 + k + k * (k + 1) // 2 + k]
    best, least = np.zeros(k), 0.0
    for mask in range(1, 1 << k):
        on = [i for i in range(k) if mask >> i & 1]
        a = xx[np.ix_(on, on)]
        b = np.linalg.lstsq(a, xy[on], rcond=None)[0]
        if (b >= -1e-12).all():
            loss = b @ a @ b - 2 * b @ xy[on]
            if loss < least - 1e-9:
                least, best = loss, np.zeros(k)
                best[on] = np.maximum(b, 0)
    return best.tolist()


def efficiency(sums: list[float], defaults: list[float], least: int = 64, reach: float = 20.0) -> list[float]:
    """Power by unit of each gas: the non-negative fit, each within a twentieth and twenty times its default; the defaults where rows are few."""
    if sums[0] < least:
        return list(defaults)
    return [min(max(b, d / reach), d * reach) for b, d in zip(nonnegative_fit(sums, len(defaults)), defaults)]
