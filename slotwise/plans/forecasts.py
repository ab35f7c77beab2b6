"""Queries on forecasts, blends, validation, dispatch and streams, and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.functions import time as t
from slotwise.operators import blend, contracts, dispatch, features, members, validate
from slotwise.plans.catalogue import AHEAD, BUCKET, CUTOFF, EMA, GRID, OBS, RANGE, SLOT, W, _ahead, at, observations, origins, panel, query, r, rounded, table
from slotwise.session import scratch_path, ship_package, written

STEPS = (1, 2, 4, 8)
X = ["v", "lag_1", "lag_4", "lag_96", "mean_8", "std_8"]


def with_averages(p: DataFrame) -> DataFrame:
    return features.ema(p, [4, 16])


# -- members --

_A = f"WITH {GRID}, {AHEAD(STEPS)}"
_RECENT = f"recent AS (SELECT series, b, median(v) OVER ({W} ROWS 7 PRECEDING) AS m8, avg(v) OVER ({W} ROWS 3 PRECEDING) AS m4, coalesce(v - lag(v) OVER ({W}), 0) AS d FROM panel)"
_PROFILE = f"lv AS (SELECT series, {SLOT('b')} AS slot, avg(raw) AS l FROM panel WHERE b > TIMESTAMP '{CUTOFF}' - INTERVAL 7 DAY AND b <= TIMESTAMP '{CUTOFF}' GROUP BY 1, 2), sl AS (SELECT n.series, CAST(s.slot AS INTEGER) AS slot, l FROM (SELECT DISTINCT series FROM panel) n CROSS JOIN generate_series(0, 95) s(slot) LEFT JOIN lv ON lv.series = n.series AND lv.slot = s.slot), profile AS (SELECT series, slot, coalesce(last_value(l IGNORE NULLS) OVER (PARTITION BY series ORDER BY slot ROWS UNBOUNDED PRECEDING), first_value(l IGNORE NULLS) OVER (PARTITION BY series ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM sl)"
_AR = f"dd AS (SELECT series, b, v - lag(v) OVER ({W}) AS d FROM panel), d2 AS (SELECT *, lag(d, 1) OVER ({W}) AS d1, lag(d, 2) OVER ({W}) AS dl2 FROM dd), ar AS (SELECT series, coalesce(corr(d, d1), 0) AS phi, least(greatest(coalesce(corr(d, dl2) / nullif(corr(d, d1), 0), 0), 0), 0.95) AS rho FROM d2 WHERE b <= TIMESTAMP '{CUTOFF}' GROUP BY 1)"
_DAY = "LEFT JOIN panel dy ON dy.series = a.series AND dy.b = a.target_ts - INTERVAL 1 DAY"
_WEEK = "LEFT JOIN panel wk ON wk.series = a.series AND wk.b = a.target_ts - INTERVAL 7 DAY"
_MEMBER = {
    "persistence": "SELECT a.series, a.b, a.h, 'persistence' AS member, a.v AS p FROM labelled a",
    "seasonal": f"SELECT a.series, a.b, a.h, 'seasonal' AS member, coalesce(dy.raw, a.v) AS p FROM labelled a {_DAY}",
    "seasonal_blend": f"SELECT a.series, a.b, a.h, 'seasonal_blend' AS member, 0.72 * coalesce(dy.raw, m8) + 0.18 * coalesce(wk.raw, dy.raw, m8) + 0.10 * m8 AS p FROM labelled a JOIN recent q ON q.series = a.series AND q.b = a.b {_DAY} {_WEEK}",
    "momentum": "SELECT a.series, a.b, a.h, 'momentum' AS member, a.v + phi * pow(rho, a.h - 1) * d AS p FROM labelled a JOIN recent q ON q.series = a.series AND q.b = a.b JOIN ar ON ar.series = a.series",
    "profile": f"SELECT a.series, a.b, a.h, 'profile' AS member, coalesce(level, a.v) AS p FROM labelled a LEFT JOIN profile f ON f.series = a.series AND f.slot = {SLOT('a.target_ts')}",
    "anchored_profile": f"SELECT a.series, a.b, a.h, 'anchored_profile' AS member, coalesce(f.level * m4 / nullif(n.level, 0), a.v) AS p FROM labelled a JOIN recent q ON q.series = a.series AND q.b = a.b LEFT JOIN profile f ON f.series = a.series AND f.slot = {SLOT('a.target_ts')} LEFT JOIN profile n ON n.series = a.series AND n.slot = {SLOT('a.b')}",
}
_MEMBER |= {f"ema_{s}": f"SELECT a.series, a.b, a.h, 'ema_{s}' AS member, e.e{s} AS p FROM labelled a JOIN ema e ON e.series = a.series AND e.b = a.b" for s in (4, 16)}
_EMAS = f"ema AS (SELECT series, b, {EMA(4)} AS e4, {EMA(16)} AS e16 FROM panel)"
_ALL = f"{_A}, {_RECENT}, {_PROFILE}, {_AR}, {_EMAS}, every AS ({' UNION ALL '.join(_MEMBER.values())}), scored AS (SELECT e.*, l.y, CASE WHEN abs(l.y) > 1e-8 THEN abs(l.y - e.p) / abs(l.y) END AS ape FROM every e JOIN labelled l ON l.series = e.series AND l.b = e.b AND l.h = e.h)"


def member_table(spark: SparkSession, sf_dir: str, steps: tuple[int, ...] = STEPS, only: tuple[str, ...] | None = None) -> DataFrame:
    """series, b, h, member, p, y of the members that need no fit."""
    p = written(with_averages(panel(spark, sf_dir)), "panel")  # events are read and summed once, not once a member
    levels = members.profile(p, t.shift(at(CUTOFF), -7 * 96), at(CUTOFF))
    every = members.simple_members(_ahead(p, list(steps)), p, levels, members.ar1(p, at(CUTOFF)), [4, 16])
    if only is not None:
        every = every.where(F.col("member").isin([m for k in only for m in (("ema_4", "ema_16") if k == "averages" else (k,))]))
    return every.select("series", "b", "h", "member", "p", "y")


def _one(name: str):
    def run(spark, sf_dir):
        return rounded(member_table(spark, sf_dir, only=(name,)).select("series", "b", "h", "member", "p"))

    run.__name__ = {"seasonal": "seasonal_lag", "seasonal_blend": "seasonal_fallback", "momentum": "momentum_ar1", "profile": "diurnal_forecast", "anchored_profile": "profile_anchored"}[name]
    return query(f"{_A}, {_RECENT}, {_PROFILE}, {_AR} SELECT series, b, h, member, {r('p')} AS p FROM ({_MEMBER[name]})")(run)


for _name in ("seasonal", "seasonal_blend", "momentum", "profile", "anchored_profile"):
    _one(_name)


@query(f"WITH {GRID}, {_PROFILE} SELECT series, slot, {r('level')} AS level FROM profile")
def diurnal_profile(spark, sf_dir):
    return rounded(members.profile(panel(spark, sf_dir), t.shift(at(CUTOFF), -7 * 96), at(CUTOFF)))


@query(f"{_A}, {_EMAS}, every AS ({_MEMBER['persistence']} UNION ALL {_MEMBER['ema_4']} UNION ALL {_MEMBER['ema_16']}), s AS (SELECT e.*, CASE WHEN abs(l.y) > 1e-8 THEN abs(l.y - p) / abs(l.y) END AS ape FROM every e JOIN labelled l ON l.series = e.series AND l.b = e.b AND l.h = e.h WHERE e.h = 8) SELECT series, member, {r('avg(ape)')} AS mape, count(ape) AS n_scored, count(*) - count(ape) AS n_unscored FROM s GROUP BY 1, 2")
def persistence_mape(spark, sf_dir):
    return rounded(validate.error_by(member_table(spark, sf_dir, (8,), ("persistence", "averages")), ["series", "member"]))


_NAMES = list(_MEMBER)


@query(f"{_ALL}, g AS (SELECT series, h, member, avg(ape) AS m FROM scored GROUP BY 1, 2, 3), s AS (SELECT series, member, avg(m) AS m FROM g GROUP BY 1, 2) SELECT series, {', '.join(f'''{r(f"max(m) FILTER (member = '{n}')")} AS {n}''' for n in _NAMES)} FROM s GROUP BY 1")
def member_leaderboard(spark, sf_dir):
    scores = validate.macro_error(member_table(spark, sf_dir), ["series", "member"], ["h"])
    return rounded(scores.groupBy("series").pivot("member", _NAMES).agg(F.first("macro_mape")))


@query(f"{_ALL}, f AS (SELECT series, member, greatest(0.01 * median(abs(y)), 1e-9) AS fl FROM scored GROUP BY 1, 2) SELECT s.series, s.member, {r('avg(abs(y - p) / greatest(abs(y), fl))')} AS safe_mape FROM scored s JOIN f ON f.series = s.series AND f.member = s.member GROUP BY 1, 2")
def safe_mape(spark, sf_dir):
    return rounded(validate.safe_error(member_table(spark, sf_dir), ["series", "member"]))


_LONG = (1, 8, 24, 48, 96)
_PERSIST = f"WITH {GRID}, {AHEAD(_LONG)}, s AS (SELECT series, b, h, CASE WHEN abs(y) > 1e-8 THEN abs(y - v) / abs(y) END AS ape FROM labelled)"


@query(f"{_PERSIST}, g AS (SELECT series, h, avg(ape) AS m FROM s GROUP BY 1, 2) SELECT series, CASE WHEN h <= 8 THEN 'short' WHEN h <= 48 THEN 'middle' ELSE 'long' END AS band, {r('avg(m)')} AS mape FROM g GROUP BY 1, 2 UNION ALL SELECT series, 'end', {r('m')} FROM g WHERE h = 96")
def horizon_band_summary(spark, sf_dir):
    return rounded(validate.band_summary(member_table(spark, sf_dir, _LONG, ("persistence",)), ["series"]))


@query(f"{_PERSIST}, o AS (SELECT series, b, avg(ape) AS m FROM s GROUP BY 1, 2) SELECT series, CAST(b AS DATE) AS day, {r('avg(m)')} AS mape FROM o GROUP BY 1, 2")
def daily_mape(spark, sf_dir):
    return rounded(validate.daily_error(member_table(spark, sf_dir, _LONG, ("persistence",)), ["series"]))


_HIST = f"hist AS (SELECT p.series, p.b, CAST(s.h AS INTEGER) AS h, p.v, p.b + s.h * INTERVAL 15 MINUTE AS target_ts, g.raw AS y FROM panel p CROSS JOIN (VALUES (1), (8)) s(h) LEFT JOIN panel g ON g.series = p.series AND g.b = p.b + s.h * INTERVAL 15 MINUTE)"


@query(f"WITH {GRID}, {_HIST}, x AS (SELECT series, h, y / v - 1 AS x, sum(v) AS w FROM hist WHERE target_ts <= TIMESTAMP '{CUTOFF}' AND y > 0 AND v > 0 GROUP BY 1, 2, 3), c AS (SELECT *, sum(w) OVER (PARTITION BY series, h ORDER BY x) AS cum, sum(w) OVER (PARTITION BY series, h) AS al FROM x) SELECT series, h, {r('min(x)')} AS median FROM c WHERE cum >= 0.5 * al GROUP BY 1, 2")
def weighted_median_drift(spark, sf_dir):
    x = features.labels(panel(spark, sf_dir), [1, 8])
    x = x.where((F.col("target_ts") <= at(CUTOFF)) & (F.col("y") > 0) & (F.col("v") > 0)).select("series", "h", (F.col("y") / F.col("v") - 1).alias("x"), F.col("v").alias("w"))
    return rounded(members.weighted_median(x, ["series", "h"], "x", "w"))


# -- fitted members: no SQL, tested against closed forms --


def _training(spark, sf_dir, steps=(1, 8)) -> DataFrame:
    p = written(features.lags(features.rolling(panel(spark, sf_dir), 8), [1, 4, 96], fill="current"), "training")
    return features.labels(p, list(steps))


def _fit_rows(x: DataFrame) -> DataFrame:
    return validate.purge(x, at(CUTOFF)).where("y is not null and y > 0")


@query(None)
def ridge_member(spark, sf_dir):
    x = _training(spark, sf_dir)
    fit = members.ridge(_fit_rows(x), ["series", "h"], X, "y")
    test = x.where(F.col("b") > at(CUTOFF)).join(F.broadcast(fit), ["series", "h"])
    return test.select("series", "b", "h", F.greatest(members.linear(test, fit, ["series", "h"], X), F.lit(0.0)).alias("p"), "y")


def _tested(x: DataFrame) -> DataFrame:
    return x.where(F.col("b") > at(CUTOFF))


@query(None)
def robust_ridge_member(spark, sf_dir):
    x = _training(spark, sf_dir, (8,))
    fit = members.robust_ridge(_fit_rows(x), ["series", "h"], X, "y")
    test = _tested(x).join(F.broadcast(fit), ["series", "h"])
    return test.select("series", "b", "h", F.greatest(members.linear(test, fit, ["series", "h"], X), F.lit(0.0)).alias("p"), "y")


@query(None)
def relative_ridge_member(spark, sf_dir):
    """Ridge on relative changes; the forecast is the origin's level times one and the change."""
    x = _training(spark, sf_dir)
    fit = members.relative_ridge(_fit_rows(x), ["series", "h"], X, "y", "v")
    test = _tested(x).join(F.broadcast(fit), ["series", "h"])
    level = F.greatest(F.col("v"), F.lit(1.0))
    return test.select("series", "b", "h", F.greatest(level * (1 + members.linear(test, fit, ["series", "h"], X)), F.lit(0.0)).alias("p"), "y")


@query(None)
def local_ridge_member(spark, sf_dir):
    """Four experts around quantiles of the recent level, four fifths of the forecast, and a global fit."""
    x = _training(spark, sf_dir, (8,))
    train = written(_fit_rows(x), "local-rows")
    centres, width = members.centres_of(train, "mean_8", 4)
    fits = members.local_ridge(train, ["series", "h"], X, "y", "mean_8", centres, width)
    made = members.local_forecast(_tested(x), fits, ["series", "h"], X, "mean_8", centres, width)
    return made.select("series", "b", "h", F.greatest("p", F.lit(0.0)).alias("p"), "y")


@query(None)
def windowed_ridge_member(spark, sf_dir):
    """The mean of ridges on the last 7, 21 and 60 days, newer rows weighing more."""
    x = _training(spark, sf_dir, (8,))
    train = features.recency_weights(_fit_rows(x), at(CUTOFF), 14.0, ["series", "h"])
    parts = None
    test = _tested(x)
    for days in (7, 21, 60):
        fit = members.ridge(train.where(F.col("b") > t.shift(at(CUTOFF), -96 * days)), ["series", "h"], X, "y", 100.0, F.col("weight"))
        own = test.join(F.broadcast(fit), ["series", "h"])
        own = own.select("series", "b", "h", "y", members.linear(own, fit, ["series", "h"], X).alias("p"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("series", "b", "h").agg(F.greatest(F.avg("p"), F.lit(0.0)).alias("p"), F.first("y").alias("y"))


@query(None)
def online_refit(spark, sf_dir):
    x = _training(spark, sf_dir, (8,))
    return members.periodic_refit(x, ["series", "h"], X, "y", 24)


@query(None)
def gbt_member(spark, sf_dir):
    x = _training(spark, sf_dir, (8,)).where("v > 0")
    x = x.withColumn("residual", F.col("y") - F.col("v"))
    done = members.boosted(_fit_rows(x).withColumn("w", 1 / F.col("y")), x.where((F.col("b") > at(CUTOFF)) & F.col("y").isNotNull()), X, "residual", "w", trees=5)
    return done.select("series", "b", "h", (F.col("v") + F.col("p")).alias("p"), "y")


@query(None)
def pooled_gbt_member(spark, sf_dir):
    x = _training(spark, sf_dir, (1, 4, 8)).where("v > 0").withColumn("residual", F.col("y") - F.col("v"))
    w = Window.partitionBy("h")
    train = _fit_rows(x).withColumn("w", 1 / F.col("y")).withColumn("w", F.col("w") / F.sum("w").over(w) * 1000)
    done = members.boosted(train, x.where((F.col("b") > at(CUTOFF)) & F.col("y").isNotNull()), [*X, "h", "h_sin", "h_cos"], "residual", "w", trees=5)
    return members.smooth_horizons(done.select("series", "b", "h", F.lit("pooled").alias("member"), (F.col("v") + F.col("p")).alias("p")))


_GRAM = [("n", "CAST(count(*) AS DOUBLE)"), ("sxx_v_v", "sum(v * v)"), ("sxx_v_l", "sum(v * l)"), ("sxx_l_l", "sum(l * l)"), ("sxy_v", "sum(v * y)"), ("sxy_l", "sum(l * y)")]


@query(f"WITH {GRID}, x AS (SELECT series, b, v, coalesce(lag(v, 1) OVER ({W}), 0) AS l, lead(raw, 1) OVER ({W}) AS y FROM panel) SELECT series, {', '.join(f'{r(e, 4)} AS {n}' for n, e in _GRAM)} FROM x WHERE y IS NOT NULL AND b < TIMESTAMP '{CUTOFF}' GROUP BY 1")
def efficiency_gram(spark, sf_dir):
    x = features.labels(features.lags(panel(spark, sf_dir), [1]), [1]).where((F.col("b") < at(CUTOFF)) & F.col("y").isNotNull())
    g = members.gram(x, ["series"], ["v", "lag_1"], "y")
    picks = {"n": 0, "sxx_v_v": 5, "sxx_v_l": 6, "sxx_l_l": 7, "sxy_v": 8, "sxy_l": 9}
    return rounded(g.select("series", *[F.col("sums")[i].alias(n) for n, i in picks.items()]), 4)


@query(None)
def nonnegative_efficiency(spark, sf_dir):
    ship_package(spark)
    x = features.labels(features.lags(panel(spark, sf_dir), [1]), [1]).where((F.col("b") < at(CUTOFF)) & F.col("y").isNotNull())
    solve = F.udf(lambda s: members.nonnegative_fit(s, 2), "array<double>")
    return members.gram(x, ["series"], ["v", "lag_1"], "y").select("series", solve("sums").alias("efficiency"))


# -- blends --


@query(None)
def convex_blend(spark, sf_dir):
    ship_package(spark)
    return blend.fit_blend(member_table(spark, sf_dir), _NAMES, ["series", "h"])


@query(None)
def affine_blend(spark, sf_dir):
    ship_package(spark)
    x = member_table(spark, sf_dir).withColumn("part", F.when(F.hour("b") < 12, "early").otherwise("late"))
    return blend.fit_blend(x, _NAMES, ["series", "h", "part"], "affine")


_WEIGHTS = [("persistence", 0.5), ("ema_4", 0.3), ("ema_16", 0.2), ("seasonal", 0.0)]


@query(f"{_ALL}, w(member, w) AS (VALUES {', '.join(f'({m!r}, {x})' for m, x in _WEIGHTS)}), c AS (SELECT series, b, h, sum(w * p) AS p FROM every JOIN w ON w.member = every.member GROUP BY 1, 2, 3), t AS (SELECT b, h, sum(p) AS total, least(sum(p) FILTER (series IN ('purchase', 'view')), 400) AS grp FROM c GROUP BY 1, 2) SELECT b, h, {r('total')} AS total, {r('greatest(least(grp, total), total - 900)')} AS grp FROM t")
def blend_apply(spark, sf_dir):
    weights = spark.createDataFrame(_WEIGHTS, "member string, w double").crossJoin(F.broadcast(spark.createDataFrame([(h,) for h in STEPS], "h int")))
    mixed = blend.apply_weights(member_table(spark, sf_dir), weights, ["h"])
    sums = mixed.groupBy("b", "h").agg(F.sum("p").alias("total"), F.least(F.sum(F.when(F.col("series").isin("purchase", "view"), F.col("p"))), F.lit(400.0)).alias("grp"))
    return rounded(blend.reconcile(sums, "grp", "total", 900.0))


_ANCHORS = [("a", 1, 0.7), ("a", 8, 0.4), ("a", 96, 0.1), ("b", 1, 0.3), ("b", 8, 0.6), ("b", 96, 0.9)]


@query(f"WITH k(member, anchor, w) AS (VALUES {', '.join(map(str, _ANCHORS))}), s AS (SELECT CAST(h AS INTEGER) AS h FROM generate_series(1, 96) g(h)), m AS (SELECT DISTINCT member FROM k), x AS (SELECT m.member, s.h, (SELECT max(anchor) FROM k WHERE anchor <= s.h) AS lo, (SELECT min(anchor) FROM k WHERE anchor >= s.h) AS hi FROM m CROSS JOIN s) SELECT x.member, x.h, {r('a.w + (c.w - a.w) * coalesce((ln(x.h) - ln(lo)) / nullif(ln(hi) - ln(lo), 0), 0)')} AS w FROM x JOIN k a ON a.member = x.member AND a.anchor = lo JOIN k c ON c.member = x.member AND c.anchor = hi")
def interp_weights_logh(spark, sf_dir):
    anchors = spark.createDataFrame(_ANCHORS, "member string, anchor int, w double")
    return rounded(blend.interpolate_weights(anchors, spark.range(1, 97).select(F.col("id").cast("int").alias("h"))))


@query("WITH keys AS (SELECT s.series, CAST(h AS INTEGER) AS h, m.member FROM (SELECT DISTINCT event_type AS series FROM events) s CROSS JOIN (VALUES (1), (4), (30)) x(h) CROSS JOIN (VALUES ('a'), ('b')) m(member)) SELECT series, h, member, CASE WHEN h = 1 AND member = 'a' THEN 0.8 WHEN h = 4 AND member = 'a' THEN 0.5 WHEN h = 4 THEN 0.25 ELSE 0.0 END::DOUBLE AS w FROM keys")
def weights_lookup(spark, sf_dir):
    names = observations(spark, sf_dir).select("series").distinct()
    keys = names.withColumn("h", F.explode(F.array(F.lit(1), F.lit(4), F.lit(30)))).withColumn("member", F.explode(F.array(F.lit("a"), F.lit("b"))))
    specific = names.select("series", F.lit(1).alias("h"), F.lit("a").alias("member"), F.lit(0.8).alias("w"))
    general = names.select("series", F.lit("3-8").alias("band"), F.lit("a").alias("member"), F.lit(0.5).alias("w")).unionByName(names.select("series", F.lit("3-8").alias("band"), F.lit("b").alias("member"), F.lit(0.25).alias("w")))
    return blend.weights_for(specific, general, keys)


@query(f"{_ALL}, g AS (SELECT series, avg(ape) FILTER (member = 'ema_4') AS l, avg(ape) FILTER (member = 'persistence') AS s FROM scored WHERE h = 8 GROUP BY 1) SELECT series, {r('least(greatest((1/l) / (1/l + 1/s), 0.15), 0.95)')} AS w FROM g")
def inverse_error_blend(spark, sf_dir):
    e = validate.error_by(member_table(spark, sf_dir, (8,), ("persistence", "averages")), ["series", "member"]).groupBy("series").pivot("member", ["ema_4", "persistence"]).agg(F.first("mape"))
    return rounded(e.select("series", blend.inverse_error_weight(F.col("ema_4"), F.col("persistence")).alias("w")))


@query(f"{_ALL}, g AS (SELECT series, avg(ape) FILTER (member = 'persistence') AS a, avg(ape) FILTER (member = 'ema_16') AS c FROM scored GROUP BY 1) SELECT series, {r('a')} AS base_error, {r('c')} AS challenger_error, c < 0.995 * a AS accepted FROM g")
def accept_challenger(spark, sf_dir):
    x = member_table(spark, sf_dir, only=("persistence", "averages")).withColumn("error", validate.percentage_error(F.col("y"), F.col("p"), False))
    return rounded(blend.accept_challenger(x, "series", "persistence", "ema_16"))


@query(f"WITH {GRID}, x AS (SELECT *, avg(v) OVER ({W} ROWS 95 PRECEDING) AS m, stddev_samp(v) OVER ({W} ROWS 95 PRECEDING) AS s FROM panel) SELECT series, b, {r('CASE WHEN coalesce(abs(v - m) > 2 * s, false) THEN m ELSE v END', 9)} AS gated FROM x WHERE {RANGE}")
def extreme_gate(spark, sf_dir):
    w = features.previous(96)
    x = panel(spark, sf_dir).withColumns({"m": F.avg("v").over(w), "s": F.stddev_samp("v").over(w)}).where(F.col("b").between(at("2024-01-28 00:00:00"), at("2024-01-29 23:45:00")))
    return rounded(blend.extreme_gate(x, F.abs(F.col("v") - F.col("m")) > 2 * F.col("s"), "v", "m", "gated").select("series", "b", "gated"), 9)


_CAL = f"""WITH RECURSIVE {GRID}, {AHEAD((1,))}, e AS (SELECT a.series, a.b, a.v AS p, o.y - o.v AS err, row_number() OVER (PARTITION BY a.series ORDER BY a.b) AS n FROM labelled a LEFT JOIN labelled o ON o.series = a.series AND o.target_ts = a.b),
c AS (SELECT series, n, b, p, err AS m, 1.0::DOUBLE AS w, CAST(err IS NOT NULL AS INTEGER) AS k FROM e WHERE n = 1
UNION ALL SELECT e.series, e.n, e.b, e.p, CASE WHEN e.err IS NULL THEN c.m WHEN c.m IS NULL THEN e.err ELSE (c.w * {1 - 2 / 17!r} * c.m + {2 / 17!r} * e.err) / (c.w * {1 - 2 / 17!r} + {2 / 17!r}) END, CASE WHEN e.err IS NULL AND c.m IS NOT NULL THEN c.w * {1 - 2 / 17!r} ELSE 1.0 END, c.k + CAST(e.err IS NOT NULL AS INTEGER) FROM c JOIN e ON e.series = c.series AND e.n = c.n + 1)
SELECT series, b, CAST(1 AS INTEGER) AS h, 'persistence' AS member, {r('CASE WHEN k >= 8 THEN p + 0.5 * m ELSE p END')} AS p FROM c"""


@query(_CAL)
def causal_calibration(spark, sf_dir):
    p = panel(spark, sf_dir)
    made = member_table(spark, sf_dir, (1,), ("persistence",)).select("series", "b", "h", "member", "p")
    return rounded(blend.causal_calibration(made, p))


# -- validation --


@query(f"WITH {GRID}, s AS (SELECT b, row_number() OVER (ORDER BY b) AS n, count(*) OVER () AS total FROM slots), f AS (SELECT CAST(k AS INTEGER) AS fold, total - (3 - k) * 192 AS n_train FROM (SELECT DISTINCT total FROM s) CROSS JOIN (VALUES (0), (1), (2)) g(k)) SELECT fold, max(b) FILTER (n <= n_train) AS train_end, min(b) FILTER (n > n_train) AS test_start, max(b) FILTER (n <= n_train + 192) AS test_end, n_train FROM f CROSS JOIN s WHERE n_train >= 512 GROUP BY fold, n_train")
def expanding_folds(spark, sf_dir):
    return validate.expanding_folds(panel(spark, sf_dir), 3, 192, 512)


_B = "epoch_us(b) // 21600000000"


@query(f"WITH {GRID}, x AS (SELECT {_B} AS block, epoch_us(b) - ({_B}) * 21600000000 AS o FROM slots), nr AS (SELECT block + 1 AS block FROM x WHERE o >= 14400000000 UNION ALL SELECT block - 1 FROM x WHERE o < 7200000000), k AS (SELECT block, count(*) AS c FROM nr GROUP BY 1) SELECT x.block, count(*) AS n_test, coalesce(max(c), 0) AS n_embargoed, (SELECT count(*) FROM x) - count(*) - coalesce(max(c), 0) AS n_train FROM x LEFT JOIN k ON k.block = x.block GROUP BY 1")
def purge_audit(spark, sf_dir):
    return validate.purged_blocks(panel(spark, sf_dir).select("b").distinct())


@query(f"WITH {GRID}, d AS (SELECT series, CAST(b AS DATE) AS day, sum(raw) AS s, count(raw) AS n FROM panel GROUP BY 1, 2) SELECT series, day, {r('(sum(s) OVER p - s) / nullif(sum(n) OVER p - n, 0)')} AS others_mean, n FROM d WINDOW p AS (PARTITION BY series)")
def leave_fold_out(spark, sf_dir):
    return rounded(validate.leave_one_out(panel(spark, sf_dir).withColumn("day", F.to_date("b")), "day", ["series"], "raw"))


@query(f"{_ALL}, g AS (SELECT series, h, member, avg(ape) AS m FROM scored GROUP BY 1, 2, 3), d AS (SELECT o.member, b.m - o.m AS g FROM g o JOIN g b ON b.series = o.series AND b.h = o.h AND b.member = 'persistence' WHERE o.member <> 'persistence') SELECT member, count(g) AS n, count(*) FILTER (g > 1e-9) AS n_better, {r('avg(g)')} AS gain_mean, {r('stddev_samp(g)')} AS gain_std, {r('min(g)')} AS gain_min, {r('quantile_cont(g, 0.1)')} AS gain_p10 FROM d GROUP BY 1")
def paired_window_sweep(spark, sf_dir):
    scores = validate.error_by(member_table(spark, sf_dir), ["series", "h", "member"], strict=False)
    return rounded(validate.paired_improvement(scores, "persistence", ["series", "h"]))


@query(f"{_ALL}, o AS (SELECT series, member, b, avg(ape) AS m FROM scored GROUP BY 1, 2, 3), d AS (SELECT series, member, CAST(b AS DATE) AS day, avg(m) AS m FROM o GROUP BY 1, 2, 3), g AS (SELECT series, day, max(m) FILTER (member = 'persistence') - max(m) FILTER (member = 'ema_16') AS g FROM d GROUP BY 1, 2) SELECT series, count(g) AS n_days, count(*) FILTER (g > 0) AS n_better, {r('avg(g)')} AS gain_mean, {r('min(g)')} AS gain_min, count(*) FILTER (g > 0) >= 2/3 * count(g) AND avg(g) > 0 AND min(g) > -0.005 AS passed FROM g GROUP BY 1")
def day_gate(spark, sf_dir):
    daily = validate.daily_error(member_table(spark, sf_dir, only=("persistence", "averages")), ["series", "member"])
    return rounded(validate.day_gate(daily, "persistence", "ema_16", ["series"]))


@query(f"{_ALL}, g AS (SELECT series, member, h, avg(ape) AS m FROM scored GROUP BY 1, 2, 3), s AS (SELECT series, member, avg(m) AS m FROM g GROUP BY 1, 2) SELECT series, arg_min(member, m) AS best_member, {r('min(m)')} AS mape, {r('50 + 50 * ((1 - min(m)) - 0.688) / 0.312')} AS points FROM s GROUP BY 1")
def best_member(spark, sf_dir):
    s = validate.macro_error(member_table(spark, sf_dir), ["series", "member"], ["h"])
    x = s.groupBy("series").agg(F.min_by("member", "macro_mape").alias("best_member"), F.min("macro_mape").alias("mape"))
    return rounded(x.withColumn("points", validate.score_points(F.col("mape"))))


@query(f"SELECT '{CUTOFF}' AS until, true AS same")
def prefix_replay(spark, sf_dir):
    """Whether features of the rows before the cutoff change when later rows are taken away."""
    rows = observations(spark, sf_dir)

    def decide(o: DataFrame) -> DataFrame:
        from slotwise.operators import grid

        x = grid.fill(grid.full_grid(grid.resample(o, "sum"), until=CUTOFF))  # the last slots may hold no event
        return features.rolling(features.lags(x, [1, 96]), 8).select("series", "b", "raw", "v", "lag_1", "lag_96", "mean_8")

    same = validate.replay(decide, rows, "ts", CUTOFF, "b")
    return spark.createDataFrame([(CUTOFF, same)], "until string, same boolean")


# -- tariffs and dispatch --


def _prices(spark: SparkSession) -> DataFrame:
    """24 steps a month, in a rule that SQL can follow."""
    return spark.range(12 * 24).select((F.expr("id div 24") + 1).cast("int").alias("month"), F.expr("id % 24").cast("int").alias("step")).withColumn("price", 0.3 + 0.01 * F.col("month") + 0.02 * F.col("step"))


_PRICE = "0.3 + 0.01 * month(b) + 0.02 * hour(b)"


@query(f"WITH {GRID} SELECT b, CAST(month(b) AS INTEGER) AS month, {SLOT('b')} AS slot, {r(_PRICE)} AS price FROM slots")
def tariff_lookup(spark, sf_dir):
    x = dispatch.with_price(panel(spark, sf_dir).select("b").distinct(), dispatch.price_table(_prices(spark)))
    return rounded(x.select("b", "month", "slot", "price"))


@query(f"WITH {GRID} SELECT series, {r(f'sum(v * ({_PRICE}))', 4)} AS revenue, {r(f'sum(v) * avg({_PRICE})', 4)} AS flat_revenue FROM panel GROUP BY 1")
def tariff_revenue(spark, sf_dir):
    x = dispatch.with_price(panel(spark, sf_dir), dispatch.price_table(_prices(spark)))
    return rounded(x.groupBy("series").agg(F.sum(F.col("v") * F.col("price")).alias("revenue"), (F.sum("v") * F.avg("price")).alias("flat_revenue")), 4)


@query(f"WITH {GRID} SELECT b, CASE WHEN hour(b) IN (8, 9, 10, 18, 19, 20) THEN 1.30 WHEN hour(b) < 7 OR hour(b) >= 23 THEN 0.38 ELSE 0.85 END::DOUBLE AS price FROM slots")
def time_of_use(spark, sf_dir):
    return panel(spark, sf_dir).select("b").distinct().withColumn("price", t.time_of_use_price(F.col("b")))


_SIGNUP = "lead(x) OVER (PARTITION BY series ORDER BY b DESC)"


@query(f"WITH {GRID}, p AS (SELECT series, b, CASE WHEN series = 'signup' THEN 0.01 * v ELSE v END AS x FROM panel WHERE b <= TIMESTAMP '{CUTOFF}'), s AS (SELECT b, (x - {_SIGNUP}) / 0.25 AS d FROM p WHERE series = 'signup'), a AS (SELECT p.series, x, CASE WHEN p.series = 'click' THEN x + d ELSE x END AS a, row_number() OVER (PARTITION BY p.series ORDER BY p.b DESC) AS n FROM p JOIN s ON s.b = p.b WHERE p.series <> 'signup'), g AS (SELECT series, median(a) FILTER (n <= 16) AS m, quantile_cont(x, 0.99) FILTER (n <= 1344) AS q FROM a GROUP BY 1) SELECT series, {r('m')} AS surplus, {r('greatest(m, q)')} AS cap FROM g")
def surplus_forecast(spark, sf_dir):
    """'signup' stands for the stock of the holder of 'click'."""
    x = panel(spark, sf_dir).withColumn("raw", F.when(F.col("series") == "signup", 0.01 * F.col("raw")).otherwise(F.col("raw")))
    return rounded(dispatch.surplus_forecast(x, at(CUTOFF), {"click": "signup"}))


def _steps(spark, sf_dir) -> DataFrame:
    """Each series' gas over the two days of origins: a plan for each series and day."""
    p = origins(panel(spark, sf_dir))
    plan = F.concat_ws(" ", "series", F.date_format("b", "yyyy-MM-dd"))
    return p.withColumns({"plan": plan, "step": t.slot_of_day(F.col("b")), "inflow": 20_000 + 40 * F.col("v"), "price": t.time_of_use_price(F.col("b"))})


@query(None)
def dispatch_plan(spark, sf_dir):
    ship_package(spark)
    return dispatch.plan(_steps(spark, sf_dir), dispatch.Plant())


@query(None)
def dispatch_audit(spark, sf_dir):
    """Violations, revenue, the gap to the bound, and what a plan made for a flat tariff earns at the real prices."""
    ship_package(spark)
    x, plant = written(_steps(spark, sf_dir), "steps"), dispatch.Plant()
    done = written(dispatch.plan(x, plant), "plans")
    flat = x.withColumn("price", F.avg("price").over(Window.partitionBy("plan")))
    flat = dispatch.plan(flat, plant).drop("price").join(x.select("plan", "step", "price"), ["plan", "step"])
    gap = done.groupBy("plan").agg(((F.first("bound") - F.first("value")) / F.abs(F.first("bound"))).alias("gap"))
    found = dispatch.mass_balance(done, plant).join(dispatch.revenue(done, plant), "plan").join(gap, "plan")
    return found.join(dispatch.revenue(flat, plant).withColumnRenamed("revenue", "flat_revenue"), "plan")


@query("SELECT DISTINCT e.event_type AS series, d.day, 0.0::DOUBLE AS balance_error, 0.0::DOUBLE AS band_error, 0.0::DOUBLE AS end_error, 0::BIGINT AS n_infeasible FROM events e CROSS JOIN (VALUES ('2024-01-28'), ('2024-01-29')) d(day)")
def dispatch_feasible(spark, sf_dir):
    """What an audit must find of every plan: no violation of balance, band, end stock or units."""
    found = dispatch.mass_balance(dispatch_plan(spark, sf_dir), dispatch.Plant())
    near = lambda c: F.when(F.col(c) > 1e-6, F.col(c)).otherwise(F.lit(0.0)).alias(c)
    return found.select(F.split("plan", " ")[0].alias("series"), F.split("plan", " ")[1].alias("day"), near("balance_error"), near("band_error"), near("end_error"), "n_infeasible")


# -- files and streams --


def read_wide(spark: SparkSession, path: str, minutes: int = 15) -> DataFrame:
    """series, b, h, p of a delivered wide file."""
    back = spark.read.csv(path, header=True)
    long = back.unpivot(["datetime"], [c for c in back.columns if c != "datetime"], "_k", "p")
    h = (F.regexp_extract("_k", r"(\d+)_pred$", 1).cast("int") / minutes).cast("int")
    return long.select(F.regexp_extract("_k", r"^(.*)_t\+", 1).alias("series"), F.col("datetime").cast("timestamp_ntz").alias("b"), h.alias("h"), F.col("p").cast("double").alias("p"))


@query(f"WITH {GRID}, {AHEAD((1, 8))} SELECT series, b, h, {r('v')} AS p FROM labelled")
def export_roundtrip(spark, sf_dir):
    """Wide predictions written as CSV that appears at once, and read back as long rows."""
    from slotwise.sources import export

    names = sorted(r["series"] for r in observations(spark, sf_dir).select("series").distinct().collect())  # a row a series
    made = export.wide_predictions(member_table(spark, sf_dir, (1, 8), ("persistence",)).select("series", "b", "h", "p"), names, [1, 8])
    path = scratch_path(spark, "export")
    export.write_folder(export.formatted(made), path)
    return read_wide(spark, path)


@query("SELECT * FROM (VALUES ('nation.parquet', 'added'), ('orders.parquet', 'changed'), ('region.parquet', 'missing')) v(name, status)")
def manifest_verify(spark, sf_dir):
    """A manifest of four files against files of which one is gone, one is new and one has other bytes than stated."""
    from slotwise.sources import export

    of = lambda *names: reduce(DataFrame.unionByName, [export.manifest(spark, f"{sf_dir}/{n}.parquet") for n in names])
    stated = of("region", "supplier", "part", "orders").withColumn("sha256", F.when(F.col("name") == "orders.parquet", F.reverse("sha256")).otherwise(F.col("sha256")))
    return export.verify_manifest(of("nation", "supplier", "part", "orders"), written(stated, "manifest"))


@query("SELECT 'sensor' AS series, count(value) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM events")
def csv_scan(spark, sf_dir):
    from slotwise.sources import tables

    path = scratch_path(spark, "csv")
    wide = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("DateTime"), F.col("value").alias("sensor"), F.col("event_type").alias("label"))
    wide.write.csv(path, header=True)
    return tables.observations(spark, path).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"WITH {OBS}, n AS (SELECT event_type AS series, {BUCKET} AS b, count(*) AS n FROM events GROUP BY 1, 2) SELECT obs.series, obs.b, n.n, raw FROM obs JOIN n ON n.series = obs.series AND n.b = obs.b WHERE obs.b + INTERVAL 45 MINUTE <= (SELECT max(b) FROM obs)")
def stream_slots(spark, sf_dir):
    """The right-closed resampling as a stream over the events' file, run to its end."""
    from slotwise.streaming import online

    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = source.select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), "value")
    path, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    running = online.slot_sums(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema("series string, b timestamp_ntz, n long, raw double").parquet(path)


@query(f"SELECT series, h, b, p FROM ({_CAL})")
def stream_calibration(spark, sf_dir):
    """Causal calibration as a stateful stream over forecasts, run to its end."""
    from slotwise.streaming import online

    ship_package(spark)
    made = member_table(spark, sf_dir, (1,), ("persistence",)).join(panel(spark, sf_dir).select("series", "b", "raw"), ["series", "b"])
    source, path, state = (scratch_path(spark, n) for n in ("forecasts", "calibrated", "calibrated-state"))
    made.select("series", "h", F.col("b").cast("timestamp").alias("b"), "raw", "p").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("series string, h int, b timestamp, raw double, p double").parquet(source)
    running = online.calibrated_stream(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema("series string, h int, b timestamp, p double").parquet(path).select("series", "h", F.col("b").cast("timestamp_ntz").alias("b"), F.round("p", 6).alias("p"))


# -- contracts --


@query(f"WITH {GRID} SELECT series, b, raw, CASE WHEN b <= TIMESTAMP '{CUTOFF}' THEN 'train' ELSE 'test' END AS part FROM grid")
def union_cut(spark, sf_dir):
    p = panel(spark, sf_dir).select("series", "b", "raw")
    return contracts.combine(p, p, ["series", "b"], at(CUTOFF))


@query(f"WITH {GRID}, x AS (SELECT series, b, v, row_number() OVER ({W}) AS n FROM panel) SELECT series, b, v FROM x WHERE n % 7 = 1")
def stride_sample(spark, sf_dir):
    return contracts.every_nth(panel(spark, sf_dir), ["series"], "b", 7).select("series", "b", "v")


@query(f"WITH {GRID}, x AS (SELECT series, b, v, row_number() OVER (PARTITION BY series ORDER BY b DESC) AS n FROM panel) SELECT series, b, v FROM x WHERE n <= 200")
def latest_rows(spark, sf_dir):
    return contracts.latest(panel(spark, sf_dir), ["series"], "b", 200).select("series", "b", "v")


@query(f"WITH {GRID}, {AHEAD(STEPS)} SELECT series, count(*) AS n_rows, 0::BIGINT AS n_repeated, count(*) FILTER (v IS NULL) AS n_missing, 0::BIGINT AS n_not_finite, count(*) FILTER (v < 0) AS n_negative, 0::BIGINT AS n_other_steps, count(DISTINCT b) AS n_origins, count(*) = 192 * 4 AND count(DISTINCT b) = 192 AS passed FROM labelled GROUP BY 1")
def contract_check(spark, sf_dir):
    return contracts.check_predictions(member_table(spark, sf_dir, only=("persistence",)), list(STEPS), 192)


@query(f"{_ALL}, g AS (SELECT series, h, avg(ape) AS m FROM scored WHERE member = 'persistence' GROUP BY 1, 2) SELECT series, h, {r('m')} AS own_mape, {r('round(m, 6)')} AS recorded_mape, true AS agrees FROM g")
def rescoring(spark, sf_dir):
    """Errors taken anew from forecasts as delivered, a CSV file with six decimals, against those recorded when they were made."""
    from slotwise.sources import export

    x = written(member_table(spark, sf_dir, only=("persistence",)), "made")
    names = sorted(r["series"] for r in x.select("series").distinct().collect())  # a row a series
    path = scratch_path(spark, "delivered")
    export.write_folder(export.formatted(export.wide_predictions(x.select("series", "b", "h", "p"), names, list(STEPS))), path)
    delivered = read_wide(spark, path).join(x.select("series", "b", "h", "y"), ["series", "b", "h"])
    return rounded(contracts.rescore(delivered, rounded(validate.error_by(x, ["series", "h"])), ["series", "h"]))


@query(f"{_ALL}, g AS (SELECT series, h, CAST(b AS DATE) AS cutoff, member, avg(ape) AS e FROM scored WHERE member IN ('persistence', 'ema_4', 'ema_16') GROUP BY 1, 2, 3, 4), o AS (SELECT *, (sum(e) OVER p - e) / nullif(count(e) OVER p - 1, 0) AS others FROM g WINDOW p AS (PARTITION BY series, h, member)), k AS (SELECT *, row_number() OVER (PARTITION BY series, h, cutoff ORDER BY others, member) AS n FROM o) SELECT series, h, cutoff, member, {r('e')} AS left_out_error FROM k WHERE n = 1")
def leave_cutoff_out(spark, sf_dir):
    x = member_table(spark, sf_dir, only=("persistence", "averages")).withColumn("cutoff", F.to_date("b"))
    e = validate.error_by(x, ["series", "h", "cutoff", "member"], strict=False)
    return rounded(contracts.shrink_select(e, ["series", "h"], "member", "mape"))


_WIDE = ", ".join(f"max(p) FILTER (member = '{n}') AS {n}" for n in _NAMES)
_MEAN = "(" + " + ".join(f"coalesce({n}, 0)" for n in _NAMES) + f") / {len(_NAMES)}"
_SPREAD = f"greatest({', '.join(_NAMES)}) - least({', '.join(_NAMES)})"


@query(f"{_ALL}, w AS (SELECT series, b, h, {_WIDE} FROM scored GROUP BY 1, 2, 3) SELECT series, b, h, {r(_MEAN)} AS member_mean, {r(_SPREAD)} AS member_spread, {SLOT('b')} AS slot FROM w")
def stacking_features(spark, sf_dir):
    x = contracts.stack_rows(member_table(spark, sf_dir), _NAMES)
    return rounded(x.select("series", "b", "h", "member_mean", "member_spread", "slot"))


@query(None)
def stacked_member(spark, sf_dir):
    """A booster over members' forecasts, fitted on the first origin day's matured labels, for the second day."""
    x = contracts.stack_rows(member_table(spark, sf_dir, (8,)), _NAMES).withColumn("residual", F.col("y") - F.col("member_mean"))
    train = x.where((F.col("b") <= at("2024-01-28 21:45:00")) & F.col("y").isNotNull())
    test = x.where((F.col("b") >= at("2024-01-29 00:00:00")) & F.col("y").isNotNull())
    done = members.boosted(train, test, [*_NAMES, "member_spread", "slot"], "residual", trees=5)
    return done.select("series", "b", "h", F.lit("stacked").alias("member"), (F.col("member_mean") + F.col("p")).alias("p"))


@query(f"{_ALL}, g AS (SELECT series, h, avg(ape) AS m FROM scored WHERE member = 'persistence' GROUP BY 1, 2) SELECT 50.0::DOUBLE AS form_points, {r('greatest(0, 50 * (1 - avg(m)))')} AS accuracy_points FROM g")
def rubric_score(spark, sf_dir):
    x = member_table(spark, sf_dir, only=("persistence",))
    mape = validate.macro_error(x, ["member"], ["series", "h"]).first()["macro_mape"]
    return rounded(contracts.rubric(contracts.check_predictions(x, list(STEPS), 192), F.lit(mape)))
