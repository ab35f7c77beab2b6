"""Queries on folds, composed forecasts, pools, kept fits, audits of deliveries, files and streams, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.functions import time as t
from slotwise.operators import blend, contracts, features, grid, members, quality, validate
from slotwise.plans.catalogue import AHEAD, CUTOFF, FIRST, GRID, LAST, RANGE, SERIES, W, _ahead, at, observations, origins, panel, query, r, rounded, table
from slotwise.plans.forecasts import _ALL, _CAL, _EMAS, _HIST, EMA, member_table, with_averages
from slotwise.session import scratch_path, ship_package, written

# -- columns and rows --


@query(f"WITH {GRID}, w AS (SELECT b, max(raw) FILTER (series = 'click') AS click, max(raw) FILTER (series = 'view') AS view FROM grid GROUP BY b), x AS (SELECT *, last_value(click / nullif(view, 0) IGNORE NULLS) OVER (ORDER BY b ROWS UNBOUNDED PRECEDING) AS s FROM w) SELECT b, {r('greatest(view - click, 0)')} AS view_other, {r('least(greatest(coalesce(s, 0.45), 0), 1)')} AS click_share FROM x")
def shares_of_total(spark, sf_dir):
    wide = grid.to_wide(panel(spark, sf_dir), SERIES)
    return rounded(features.shares_of_total(wide, "click", "view", 0.45).select("b", F.when(F.col("view").isNotNull() & F.col("click").isNotNull(), F.col("view_other")).when(F.col("view").isNull() & F.col("click").isNull(), F.lit(0.0)).otherwise(F.col("view_other")).alias("view_other"), "click_share"))


@query(f"WITH {GRID} SELECT series, b, coalesce(lag(v, 1) OVER ({W}), 0) AS lag_1_kept, coalesce(lag(v, 4) OVER ({W}), 0) AS lag_4_kept FROM panel")
def suffixed_columns(spark, sf_dir):
    x = features.lags(panel(spark, sf_dir), [1, 4]).drop("raw", "v")
    return features.suffixed(x, ["lag_1", "lag_4"], "_kept")


@query(f"WITH {GRID}, x AS (SELECT series, b, v, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY series) AS n FROM panel WHERE {RANGE}) SELECT series, b, v, CASE WHEN i = 1 THEN 'first' WHEN i = n THEN 'last' ELSE 'middle' END AS corner FROM x WHERE i IN (1, n // 2 + 1, n)")
def corner_origins(spark, sf_dir):
    return grid.corner_origins(origins(panel(spark, sf_dir)), ["series"]).select("series", "b", "v", "corner")


@query("WITH c AS (SELECT column_name AS c, ordinal_position AS i FROM information_schema.columns WHERE table_name = 'lineitem'), p AS (SELECT c, row_number() OVER (ORDER BY CASE WHEN c = 'l_tax' THEN 0 WHEN contains(c, 'price') OR contains(c, 'date') THEN 1 ELSE 2 END, i) AS n FROM c) SELECT c AS \"column\", CAST(n AS INTEGER) AS place FROM p WHERE n <= 6")
def columns_by_priority(spark, sf_dir):
    chosen = contracts.by_priority(table(spark, sf_dir, "lineitem").columns, ["l_tax"], ("price", "date"), 6)
    return spark.createDataFrame([(c, i) for i, c in enumerate(chosen, 1)], "column string, place int")


@query(f"WITH {GRID}, w AS (SELECT b, max(raw) FILTER (series = 'error') AS e, max(raw) FILTER (series = 'signup') AS s FROM grid GROUP BY b) SELECT b, greatest(coalesce(e, s) - 300, 0) AS either FROM w")
def coalesced_columns(spark, sf_dir):
    wide = grid.coalesce_columns(grid.to_wide(panel(spark, sf_dir), SERIES), "error", "signup", "either")
    return grid.non_negative(wide.withColumn("either", F.col("either") - 300), "either", F.lit("flow")).select("b", "either")


@query(f"WITH {GRID}, {AHEAD((1, 8))} SELECT series, b, h, CASE WHEN target_ts <= TIMESTAMP '2024-01-28 23:45:00' THEN y END AS y FROM labelled")
def masked_labels(spark, sf_dir):
    x = _ahead(panel(spark, sf_dir), [1, 8])
    return validate.mask_after(x, at("2024-01-28 23:45:00")).select("series", "b", "h", "y")


_CORE = ["click", "click_lag_1", "view_diff_4"]


@query(f"WITH {GRID}, w AS (SELECT b, max(v) FILTER (series = 'click') AS click, max(v) FILTER (series = 'view') AS view FROM panel GROUP BY b) SELECT b, click, coalesce(lag(click) OVER (ORDER BY b), 0) AS click_lag_1, {r('coalesce(view - lag(view, 4) OVER (ORDER BY b), 0)')} AS view_diff_4 FROM w")
def core_signals(spark, sf_dir):
    """The ablation that keeps core signals whole, and of the others one kind of column."""
    x = features.differences(features.lags(panel(spark, sf_dir), [1]), [4]).select("b", "series", "v", "lag_1", "diff_4").where("series in ('click', 'view', 'error')")
    wide = x.groupBy("b").pivot("series", ["click", "view", "error"]).agg(F.first("v").alias("v"), F.first("lag_1").alias("lag_1"), F.first("diff_4").alias("diff_4"))
    wide = wide.withColumnsRenamed({c: c.removesuffix("_v") for c in wide.columns})
    kept = contracts.core_columns(wide.drop("click_diff_4").columns, ["click"], ("diff_4",), ("view",))
    return rounded(wide.select("b", *[c for c in kept if c in _CORE]))


# -- folds --

_CUTOFFS = ("2024-01-23 23:45:00", "2024-01-25 23:45:00", "2024-01-27 23:45:00")
_RIDGE = ["v"]


def fold_errors(spark: SparkSession, sf_dir: str, steps: tuple[int, ...] = (1, 8)) -> DataFrame:
    """Out-of-fold rows fold, series, b, h, member, p, y: members without a fit, and a ridge fitted at each cutoff, over the two days after it.

    All folds are one pass: a training row belongs to every fold whose cutoff its label precedes.
    """
    p = written(with_averages(panel(spark, sf_dir)), "panel")
    x = features.labels(p, list(steps))
    folds = F.broadcast(spark.createDataFrame(list(enumerate(_CUTOFFS)), "fold int, cut string").select("fold", F.col("cut").cast("timestamp_ntz").alias("cutoff")))  # a row a fold
    train = x.join(folds, F.col("target_ts") <= F.col("cutoff")).where("y is not null")
    fit = members.ridge(train, ["fold", "series", "h"], _RIDGE, "y")
    tested = x.join(folds, (F.col("b") > F.col("cutoff")) & (t.micros(F.col("b")) <= t.micros(F.col("cutoff")) + 2 * 86_400_000_000))
    ridge = tested.join(F.broadcast(fit), ["fold", "series", "h"])  # a row a fold, series and step
    ridge = ridge.withColumn("ridge", members.linear(ridge, fit, ["fold", "series", "h"], _RIDGE))
    day = p.select(F.col("series").alias("_s"), F.col("b").alias("_t"), F.col("raw").alias("_day"))
    wide = ridge.withColumn("_at", t.shift(F.col("target_ts"), -96)).join(day, (F.col("series") == F.col("_s")) & (F.col("_at") == F.col("_t")), "left")
    wide = wide.withColumns({"persistence": F.col("v"), "seasonal": F.coalesce("_day", "v")})
    return wide.unpivot(["fold", "series", "b", "h", "y"], ["persistence", "seasonal", "ema_16", "ridge"], "member", "p")


def _folds_sql(steps: str = "(1), (8)") -> str:
    cuts = ", ".join(f"({i}, TIMESTAMP '{c}')" for i, c in enumerate(_CUTOFFS))
    return f"""WITH {GRID}, {_EMAS}, hist AS (SELECT p.series, p.b, CAST(s.h AS INTEGER) AS h, p.v, p.b + s.h * INTERVAL 15 MINUTE AS target_ts, g.raw AS y FROM panel p CROSS JOIN (VALUES {steps}) s(h) LEFT JOIN panel g ON g.series = p.series AND g.b = p.b + s.h * INTERVAL 15 MINUTE),
cuts(fold, cutoff) AS (VALUES {cuts}), fit AS (SELECT fold, series, h, coalesce(regr_slope(y, v), 0) * count(*) / (count(*) + 100.0) AS k, avg(y) AS my, avg(v) AS mv FROM hist JOIN cuts ON target_ts <= cutoff WHERE y IS NOT NULL GROUP BY 1, 2, 3),
test AS (SELECT c.fold, x.* FROM hist x JOIN cuts c ON x.b > c.cutoff AND x.b <= c.cutoff + INTERVAL 2 DAY),
oof AS (SELECT fold, series, b, h, y, 'persistence' AS member, v AS p FROM test UNION ALL SELECT t.fold, t.series, t.b, t.h, t.y, 'seasonal', coalesce(d.raw, t.v) FROM test t LEFT JOIN panel d ON d.series = t.series AND d.b = t.target_ts - INTERVAL 1 DAY
UNION ALL SELECT t.fold, t.series, t.b, t.h, t.y, 'ema_16', e.e16 FROM test t JOIN ema e ON e.series = t.series AND e.b = t.b UNION ALL SELECT t.fold, t.series, t.b, t.h, t.y, 'ridge', my + k * (v - mv) FROM test t JOIN fit f ON f.fold = t.fold AND f.series = t.series AND f.h = t.h),
scored AS (SELECT *, CASE WHEN abs(y) > 1e-8 THEN abs(y - p) / abs(y) END AS ape FROM oof)"""


@query(f"{_folds_sql()} SELECT CAST(fold AS INTEGER) AS fold, series, h, member, {r('avg(ape)')} AS mape, count(ape) AS n_scored FROM scored GROUP BY 1, 2, 3, 4")
def fold_backtest(spark, sf_dir):
    e = validate.error_by(fold_errors(spark, sf_dir), ["fold", "series", "h", "member"], strict=False)
    return rounded(e.select("fold", "series", "h", "member", "mape", "n_scored"))


@query(f"{_folds_sql()} SELECT series, h, count(*) AS n_rows, {', '.join(f'''{r(f"avg(ape) FILTER (member = '{m}')")} AS {m}''' for m in ('persistence', 'seasonal', 'ema_16', 'ridge'))} FROM scored WHERE ape IS NOT NULL GROUP BY 1, 2")
def stacked_folds(spark, sf_dir):
    """Out-of-fold rows of all folds that can be scored, as a stacked fit reads them."""
    x = fold_errors(spark, sf_dir).withColumn("ape", validate.percentage_error(F.col("y"), F.col("p"), False)).where("ape is not null")
    wide = x.groupBy("series", "h").pivot("member", ["persistence", "seasonal", "ema_16", "ridge"]).agg(F.avg("ape"))
    return rounded(x.groupBy("series", "h").agg(F.count(F.lit(1)).alias("n_rows")).join(wide, ["series", "h"]))


@query(None)
def out_of_fold_blend(spark, sf_dir):
    """Convex weights per series and horizon from out-of-fold rows of all folds, none of which saw its own labels."""
    ship_package(spark)
    return blend.fit_blend(fold_errors(spark, sf_dir).drop("fold"), ["persistence", "seasonal", "ema_16", "ridge"], ["series", "h"])


@query(f"{_folds_sql()}, g AS (SELECT series, h, member, avg(ape) AS e FROM scored GROUP BY 1, 2, 3), s AS (SELECT series, member, avg(e) AS e FROM g GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY e, member) AS n, min(e) OVER (PARTITION BY series) AS best FROM s) SELECT series, member, CAST(n AS INTEGER) AS rank FROM k WHERE e <= 1.05 * best OR n <= 2")
def frozen_pool(spark, sf_dir):
    scores = validate.macro_error(fold_errors(spark, sf_dir), ["series", "member"], ["h"], strict=False)
    return blend.frozen_pool(scores.select("series", "member", F.col("macro_mape").alias("error")), ["series"])


@query(f"{_folds_sql('(1), (4), (8)')}, e AS (SELECT series, h, avg(ape) FILTER (member = 'ridge') AS l, avg(ape) FILTER (member = 'seasonal') AS s FROM scored WHERE fold < 2 AND h IN (1, 8) GROUP BY 1, 2), a AS (SELECT series, h, least(greatest((1 / l) / (1 / l + 1 / s), 0.15), 0.95) AS w FROM e), q AS (SELECT o.series, x.b, x.h, a1.w + (a8.w - a1.w) * (x.h - 1) / 7.0 AS w, o.p AS l, x.p AS s FROM oof o JOIN oof x ON x.fold = o.fold AND x.series = o.series AND x.b = o.b AND x.h = o.h AND x.member = 'seasonal' JOIN a a1 ON a1.series = o.series AND a1.h = 1 JOIN a a8 ON a8.series = o.series AND a8.h = 8 WHERE o.member = 'ridge' AND o.fold = 2) SELECT series, b, h, {r('w')} AS w, {r('w * l + (1 - w) * s')} AS p FROM q")
def anchor_horizon_blend(spark, sf_dir):
    """Weights from the first two folds at the anchors 1 and 8, applied to the last fold at 1, 4 and 8."""
    x = written(fold_errors(spark, sf_dir, (1, 4, 8)), "oof")
    scores = validate.error_by(x.where("fold < 2"), ["series", "h", "member"], strict=False).withColumnRenamed("mape", "error")
    return rounded(blend.anchor_blend(x.where("fold = 2").drop("fold", "y"), scores, "ridge", "seasonal", [1, 8]))


# -- a forecast as a whole: members, calibration, gate, blend, limits --

_TWO = _CAL.split("SELECT series, b, CAST(1 AS INTEGER)")[0]
_RECURSE = _TWO[_TWO.index("c AS ("):].rstrip()


def _calibrated(member: str, value: str, suffix: str) -> str:
    """The recursion of causal calibration for another member, under names of its own."""
    rows = f"e{suffix} AS (SELECT a.series, a.b, {value} AS p, o.y - o.{value.split('.')[-1]} AS err, row_number() OVER (PARTITION BY a.series ORDER BY a.b) AS n FROM two a LEFT JOIN two o ON o.series = a.series AND o.target_ts = a.b)"
    body = _RECURSE.replace("c AS (", f"c{suffix} AS (", 1).replace("FROM e WHERE", f"FROM e{suffix} e WHERE").replace("JOIN e ON", f"JOIN e{suffix} e ON").replace("FROM c JOIN", f"FROM c{suffix} c JOIN")
    return f"{rows}, {body}"


@query(f"WITH RECURSIVE {GRID}, {AHEAD((1,))}, {_EMAS}, two AS (SELECT l.*, e.e16 FROM labelled l JOIN ema e ON e.series = l.series AND e.b = l.b), {_calibrated('persistence', 'a.v', '1')}, {_calibrated('ema_16', 'a.e16', '2')}, st AS (SELECT series, b, v, avg(v) OVER ({W} ROWS 95 PRECEDING) AS m, stddev_samp(v) OVER ({W} ROWS 95 PRECEDING) AS s FROM panel), f AS (SELECT c1.series, c1.b, CASE WHEN c1.k >= 8 THEN c1.p + 0.5 * c1.m ELSE c1.p END AS a, CASE WHEN c2.k >= 8 THEN c2.p + 0.5 * c2.m ELSE c2.p END AS z, abs(st.v - st.m) > 2 * st.s AS far FROM c1 JOIN c2 ON c2.series = c1.series AND c2.b = c1.b JOIN st ON st.series = c1.series AND st.b = c1.b) SELECT series, b, {r('greatest(CASE WHEN coalesce(far, false) THEN z ELSE 0.6 * a + 0.4 * z END, 0)')} AS p FROM f")
def composed_forecast(spark, sf_dir):
    """One step ahead: two members, each calibrated by its own matured errors, blended; in extremes the calmer one alone; never below 0."""
    p = panel(spark, sf_dir)
    made = member_table(spark, sf_dir, (1,), ("persistence", "averages")).where("member in ('persistence', 'ema_16')").select("series", "b", "h", "member", "p")
    wide = blend.causal_calibration(made, p).groupBy("series", "b").pivot("member", ["persistence", "ema_16"]).agg(F.first("p"))
    w = features.previous(96)
    state = p.select("series", "b", "v", F.avg("v").over(w).alias("m"), F.stddev_samp("v").over(w).alias("s"))
    x = wide.join(state, ["series", "b"]).withColumn("mixed", 0.6 * F.col("persistence") + 0.4 * F.col("ema_16"))
    x = blend.extreme_gate(x, F.abs(F.col("v") - F.col("m")) > 2 * F.col("s"), "mixed", "ema_16", "p")
    return rounded(x.select("series", "b", F.greatest("p", F.lit(0.0)).alias("p")))


@query(f"WITH {GRID}, {_HIST}, {AHEAD((1, 8))}, x AS (SELECT series, h, y / v - 1 AS x, sum(v) AS w FROM hist WHERE target_ts <= TIMESTAMP '{CUTOFF}' AND y > 0 AND v > 0 GROUP BY 1, 2, 3), c AS (SELECT *, sum(w) OVER (PARTITION BY series, h ORDER BY x) AS cum, sum(w) OVER (PARTITION BY series, h) AS al FROM x), m AS (SELECT series, h, min(x) AS m FROM c WHERE cum >= 0.5 * al GROUP BY 1, 2) SELECT l.series, l.b, l.h, {r('v * (1 + 0.5 * coalesce(m, 0))')} AS p FROM labelled l LEFT JOIN m ON m.series = l.series AND m.h = l.h")
def drift_member(spark, sf_dir):
    p = written(panel(spark, sf_dir), "panel")
    return rounded(members.drift(_ahead(p, [1, 8]), features.labels(p, [1, 8]), at(CUTOFF)).select("series", "b", "h", "p"))


_CLOSED = f"WITH {GRID}, {_HIST}, fit AS (SELECT series, h, coalesce(regr_slope(y, v), 0) * count(*) / (count(*) + 100.0) AS k, avg(y) AS my, avg(v) AS mv FROM hist WHERE target_ts <= TIMESTAMP '{CUTOFF}' AND y IS NOT NULL GROUP BY 1, 2)"


@query(f"{_CLOSED} SELECT x.series, x.b, x.h, {r('greatest(my + k * (v - mv), 0)')} AS p FROM hist x JOIN fit f ON f.series = x.series AND f.h = x.h WHERE x.{RANGE}")
def reloaded_ridge(spark, sf_dir):
    """A ridge that is fitted, kept, read back and used for the origins."""
    x = written(features.labels(panel(spark, sf_dir), [1, 8]), "labelled")
    path = scratch_path(spark, "fit")
    train = validate.purge(x, at(CUTOFF)).where("y is not null")
    fit = members.warm_start(spark, path, train.select("series", "b", "h", "v", "y"), ["v"], {"alpha": 100.0}, lambda: members.ridge(train, ["series", "h"], ["v"], "y"))
    test = origins(x).join(F.broadcast(fit), ["series", "h"])  # a row a series and step
    return rounded(test.select("series", "b", "h", F.greatest(members.linear(test, fit, ["series", "h"], ["v"]), F.lit(0.0)).alias("p")))


@query(f"{_ALL} SELECT count(*) AS n, true AS agrees FROM (SELECT DISTINCT series, b, h FROM scored WHERE member = 'persistence')")
def parameter_replay(spark, sf_dir):
    """Blends come out again from members and weights that were written and read back."""
    made = written(member_table(spark, sf_dir, only=("persistence", "averages")), "members")
    w = spark.createDataFrame([("persistence", 0.5), ("ema_4", 0.3), ("ema_16", 0.2)], "member string, w double")
    recorded = written(blend.apply_weights(made, w.withColumn("_", F.lit(0)).drop("_"), []), "blends")
    return blend.replayed(recorded, made, written(w, "weights"), []).select("n", "agrees")


# -- deliveries --

_FENCE = lambda n, where: f"{n} AS (SELECT series, CASE WHEN q3 > q1 THEN q1 - 1.5 * (q3 - q1) ELSE q2 END AS lo, CASE WHEN q3 > q1 THEN q3 + 1.5 * (q3 - q1) ELSE q2 END AS hi, q2 AS mid FROM (SELECT series, quantile_cont(raw, 0.25) AS q1, quantile_cont(raw, 0.5) AS q2, quantile_cont(raw, 0.75) AS q3 FROM panel WHERE {where} GROUP BY 1))"


@query(f"WITH {GRID}, {_FENCE('f', f'''b <= TIMESTAMP '{CUTOFF}' ''')}, {_FENCE('g', f'''b <= TIMESTAMP '{CUTOFF}' AND b > TIMESTAMP '{CUTOFF}' - INTERVAL 7 DAY''')}, u AS (SELECT f.series, least(f.lo, g.lo) AS lo, greatest(f.hi, g.hi) AS hi, coalesce(g.mid, f.mid) AS mid, g.lo AS glo, g.hi AS ghi FROM f LEFT JOIN g ON g.series = f.series), x AS (SELECT p.series, p.b, p.raw, CASE WHEN raw IS NULL OR raw < lo OR raw > hi THEN 1 ELSE 0 END AS outlier, glo, ghi FROM panel p JOIN u ON u.series = p.series WHERE p.{RANGE}) SELECT series, count(*) AS n_rows, 0::BIGINT AS n_repeated, 0::BIGINT AS n_breaks, 0::BIGINT AS n_not_finite, 0::BIGINT AS n_outside, CAST(sum(outlier) AS BIGINT) AS n_repaired, count(*) FILTER (outlier = 1 AND raw BETWEEN glo AND ghi) AS n_normal_repaired, count(*) = 192 AND count(*) FILTER (outlier = 1 AND raw BETWEEN glo AND ghi) = 0 AS passed FROM x GROUP BY 1")
def delivered_audit(spark, sf_dir):
    p = written(panel(spark, sf_dir), "panel")
    history = p.where(F.col("b") <= at(CUTOFF))
    fences = [written(quality.tukey_fence(d, ["series"], "raw"), "fence") for d in (history, history.where(F.col("b") > t.shift(at(CUTOFF), -7 * 96)))]
    x = origins(p)
    delivered = quality.repair(x, *fences, ["series"], "raw").select("series", "b", F.col("repaired").alias("value"), "outlier")
    return quality.delivered_audit(delivered, x.select("series", "b", F.col("raw").alias("value")), *fences, 192)


# -- files --


@query(f"WITH {GRID} SELECT DISTINCT b FROM grid WHERE {RANGE}")
def origins_file(spark, sf_dir):
    """Origins written as a CSV file and read back from it."""
    from slotwise.sources import export, tables

    path = scratch_path(spark, "origins")
    slots = grid.rolling_origins(panel(spark, sf_dir), since=FIRST, until=LAST)
    export.write_folder(export.formatted(slots.select(F.col("b").alias("datetime"))), path)
    return tables.read_origins(spark, path)


@query("SELECT CAST(m AS INTEGER) AS month, CAST(s AS INTEGER) AS step, round(0.3 + 0.01 * m + 0.02 * s, 6) AS price FROM generate_series(1, 12) a(m) CROSS JOIN generate_series(0, 23) b(s)")
def tariff_scan(spark, sf_dir):
    """A tariff with a column for each month, written and read as its long form."""
    from slotwise.sources import tables

    path = scratch_path(spark, "tariff")
    steps = spark.range(24).select(F.col("id").cast("int").alias("step"), *[(0.3 + 0.01 * m + 0.02 * F.col("id")).alias(str(m)) for m in range(1, 13)])
    steps.write.csv(path, header=True)
    return rounded(tables.read_tariff(spark, path))


@query(f"{_ALL} SELECT series, b, h, member, {r('p')} AS p FROM scored WHERE member IN ('persistence', 'ema_16')")
def bank_roundtrip(spark, sf_dir):
    """Members' forecasts kept as gzip JSON and read back."""
    from slotwise.sources import export, tables

    path = scratch_path(spark, "bank")
    export.write_bank(member_table(spark, sf_dir, only=("persistence", "averages")).where("member <> 'ema_4'"), path)
    return rounded(tables.read_bank(spark, path))


# -- streams --


@query(f"WITH {GRID} SELECT series, b, v, {r(EMA(16))} AS ema, {r(f'lag(v, 4) OVER ({W})')} AS lag FROM panel")
def stream_features(spark, sf_dir):
    """Last value, average and lag as a stream over the grid in files by day, taken a file at a time."""
    from slotwise.streaming import online

    ship_package(spark)
    source, path, state = (scratch_path(spark, n) for n in ("slots", "features", "features-state"))
    days = written(panel(spark, sf_dir).select("series", F.col("b").cast("timestamp").alias("b"), "raw", F.to_date("b").alias("day")), "days")
    for k, day in enumerate(sorted(d["day"] for d in days.select("day").distinct().collect())):  # a file for each day, as they would arrive
        days.where(F.col("day") == F.lit(day)).drop("day").coalesce(1).write.mode("append").parquet(f"{source}/part={k:05d}")
    stream = spark.readStream.schema("series string, b timestamp, raw double").option("maxFilesPerTrigger", 7).option("recursiveFileLookup", True).parquet(source)
    running = online.feature_stream(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    out = spark.read.schema("series string, b timestamp, v double, ema double, lag double").parquet(path)
    return rounded(out.select("series", F.col("b").cast("timestamp_ntz").alias("b"), "v", "ema", F.nanvl("lag", F.lit(None).cast("double")).alias("lag")))
