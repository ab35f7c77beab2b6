"""Queries over the driver's tables, each with the DuckDB SQL that says the same.

events stand for sensors: event_type is the series, value in cents is summed by right-closed 15-minute
slot. Origins are the last two days, the cutoff is the slot before them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import time as t
from slotwise.operators import blend, features, grid, members, quality, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SERIES = ["click", "error", "purchase", "signup", "view"]
CUTOFF, FIRST, LAST = "2024-01-27 23:45:00", "2024-01-28 00:00:00", "2024-01-29 23:45:00"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(time: str) -> Column:
    return F.lit(time).cast("timestamp_ntz")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "event_id", "ts", "value")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, b, raw, v on the full grid."""
    return grid.fill(grid.full_grid(grid.resample(observations(spark, sf_dir), "sum")))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema])


def origins(df: DataFrame) -> DataFrame:
    return df.where(F.col("b").between(at(FIRST), at(LAST)))


def r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0)"


BUCKET = "make_timestamp(((epoch_us(ts) + 899999999) // 900000000) * 900000000)"
OBS = f"obs AS (SELECT event_type AS series, {BUCKET} AS b, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS raw FROM events GROUP BY 1, 2)"
GRID = OBS + """, span AS (SELECT min(b) AS lo, max(b) AS hi FROM obs), slots AS (SELECT unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS b FROM span),
grid AS (SELECT n.series, s.b, o.raw FROM (SELECT DISTINCT series FROM obs) n CROSS JOIN slots s LEFT JOIN obs o ON o.series = n.series AND o.b = s.b),
panel AS (SELECT series, b, raw, coalesce(last_value(raw IGNORE NULLS) OVER (PARTITION BY series ORDER BY b ROWS UNBOUNDED PRECEDING), 0) AS v FROM grid)"""
W = "PARTITION BY series ORDER BY b"
RANGE = f"b BETWEEN TIMESTAMP '{FIRST}' AND TIMESTAMP '{LAST}'"
SLOT = lambda x: f"CAST(hour({x}) * 4 + minute({x}) // 15 AS INTEGER)"


def AHEAD(steps: tuple[int, ...]) -> str:  # noqa: N802
    """CTE ahead: origins for each horizon with label y and the target's time."""
    listed = ", ".join(f"({h})" for h in steps)
    return f"ahead AS (SELECT p.series, p.b, CAST(s.h AS INTEGER) AS h, p.v, p.b + s.h * INTERVAL 15 MINUTE AS target_ts FROM panel p CROSS JOIN (VALUES {listed}) s(h) WHERE p.{RANGE}), labelled AS (SELECT a.*, g.raw AS y FROM ahead a LEFT JOIN panel g ON g.series = a.series AND g.b = a.target_ts)"


EMA = lambda span: f"list_reduce(list(v) OVER ({W} ROWS UNBOUNDED PRECEDING), lambda y, x: {1 - 2 / (span + 1)!r} * y + {2 / (span + 1)!r} * x)"

# -- grids --


@query(f"SELECT series, {BUCKET} AS b, {r('avg(value)')} AS raw FROM (SELECT event_type AS series, ts, avg(value) AS value FROM events GROUP BY 1, 2) GROUP BY 1, 2")
def grid_resample_right(spark, sf_dir):
    return rounded(grid.resample(observations(spark, sf_dir), "mean"))


@query(f"SELECT series, b, value AS raw FROM (SELECT event_type AS series, {BUCKET} AS b, value, row_number() OVER (PARTITION BY event_type, {BUCKET} ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE value IS NOT NULL) WHERE n = 1")
def grid_resample_last(spark, sf_dir):
    return grid.resample(observations(spark, sf_dir), "last")


@query(f"WITH {GRID} SELECT series, b, raw, v FROM panel")
def grid_full_ffill(spark, sf_dir):
    return panel(spark, sf_dir).select("series", "b", "raw", "v")


@query(f"WITH {OBS}, x AS (SELECT *, (epoch_us(b) - epoch_us(lag(b) OVER ({W}))) / 900000000 AS s FROM obs) SELECT series, count(*) AS n_slots, min(b) AS first_slot, max(b) AS last_slot, count(*) FILTER (s <> 1) AS n_breaks, CAST(sum(greatest(coalesce(s, 1) - 1, 0)) AS BIGINT) AS n_missing, count(*) FILTER (raw IS NULL) AS n_null FROM x GROUP BY 1")
def grid_gap_report(spark, sf_dir):
    return grid.gap_report(grid.resample(observations(spark, sf_dir), "sum"))


@query(f"WITH {GRID} SELECT b, {', '.join(f'max(raw) FILTER (series = {s!r}) AS {s}' for s in SERIES)} FROM grid GROUP BY b")
def series_pivot_wide(spark, sf_dir):
    return grid.to_wide(panel(spark, sf_dir), SERIES)


@query(f"WITH {GRID} SELECT series, b, raw FROM grid WHERE raw IS NOT NULL")
def series_unpivot(spark, sf_dir):
    return grid.to_long(grid.to_wide(panel(spark, sf_dir), SERIES), SERIES).select("series", "b", "raw")


@query(f"WITH {GRID} SELECT series, CAST(b AS DATE) AS day, {r('avg(raw)')} AS mean FROM grid GROUP BY 1, 2 HAVING avg(raw) IS NOT NULL")
def daily_resample(spark, sf_dir):
    return rounded(grid.daily_mean(panel(spark, sf_dir)))


@query(f"WITH {GRID} SELECT count(*) AS n_rows, min(b) AS first_slot, max(b) AS last_slot, count(*) FILTER (raw IS NULL) AS missing_raw, count(*) FILTER (v IS NULL) AS missing_v FROM panel")
def data_profile(spark, sf_dir):
    return grid.profile_rows(panel(spark, sf_dir), ["raw", "v"])


@query(f"WITH {GRID}, a AS (SELECT b FROM grid WHERE series = 'click' AND raw IS NOT NULL), o AS (SELECT b FROM grid WHERE series = 'view' AND raw IS NOT NULL) SELECT b, 'both' AS kind FROM (SELECT b FROM a INTERSECT SELECT b FROM o) UNION ALL SELECT b, 'click_only' AS kind FROM (SELECT b FROM a EXCEPT SELECT b FROM o) UNION ALL SELECT b, 'view_only' AS kind FROM (SELECT b FROM o EXCEPT SELECT b FROM a)")
def semi_anti_origins(spark, sf_dir):
    p = panel(spark, sf_dir).where("raw is not null")
    a, o = p.where("series = 'click'").select("b"), p.where("series = 'view'").select("b")
    both = a.join(o, "b", "left_semi").select("b", F.lit("both").alias("kind"))
    return both.unionByName(a.join(o, "b", "left_anti").select("b", F.lit("click_only").alias("kind"))).unionByName(o.join(a, "b", "left_anti").select("b", F.lit("view_only").alias("kind")))


@query(f"WITH {GRID} SELECT DISTINCT b FROM grid WHERE {RANGE}")
def rolling_origins(spark, sf_dir):
    return grid.rolling_origins(panel(spark, sf_dir), since=FIRST, until=LAST)


# -- features --

_CALENDAR = {"hour_sin": "sin(2*pi()*(hour(b) + minute(b)/60.0)/24)", "hour_cos": "cos(2*pi()*(hour(b) + minute(b)/60.0)/24)", "dow_sin": "sin(2*pi()*((isodow(b) - 1)/7.0))", "dow_cos": "cos(2*pi()*((isodow(b) - 1)/7.0))", "month_sin": "sin(2*pi()*((month(b) - 1)/12.0))", "month_cos": "cos(2*pi()*((month(b) - 1)/12.0))"}
_CALENDAR |= {f"clock_{f}{k}": f"{f}(2*pi()*{k}*(hour(b)*60 + minute(b))/1440)" for k in (1, 2, 3) for f in ("sin", "cos")}


@query(f"WITH {GRID} SELECT b, {', '.join(f'{r(x)} AS {n}' for n, x in _CALENDAR.items())}, CAST(isodow(b) >= 6 AS DOUBLE) AS weekend, {SLOT('b')} AS slot FROM slots")
def calendar_features(spark, sf_dir):
    return rounded(features.calendar(panel(spark, sf_dir).select("b").distinct()))


@query(f"WITH {GRID}, x AS (SELECT b, CAST(h AS INTEGER) AS h, b + h * INTERVAL 15 MINUTE AS target_ts FROM slots CROSS JOIN (VALUES (1), (8), (96)) s(h)) SELECT b, h, target_ts, {r('h/96.0')} AS h_fraction, {r('sin(2*pi()*h/96)')} AS h_sin, {r('cos(2*pi()*h/96)')} AS h_cos, {SLOT('target_ts')} AS target_slot, {r('sin(2*pi()*(hour(target_ts)*60 + minute(target_ts))/1440)')} AS clock_sin1_target, {r('cos(2*pi()*(hour(target_ts)*60 + minute(target_ts))/1440)')} AS clock_cos1_target FROM x")
def target_calendar(spark, sf_dir):
    x = features.horizons(features.calendar(panel(spark, sf_dir).select("b").distinct()), [1, 8, 96])
    x = features.rotate_clock(x, "clock_sin1", "clock_cos1", F.col("h")).withColumn("target_slot", t.slot_of_day(F.col("target_ts")))
    return rounded(x.select("b", "h", "target_ts", "h_fraction", "h_sin", "h_cos", "target_slot", "clock_sin1_target", "clock_cos1_target"))


@query(f"WITH {GRID} SELECT series, b, {', '.join(f'coalesce(lag(v, {n}) OVER ({W}), 0) AS lag_{n}' for n in (1, 4, 96, 672))}, {', '.join(f'''{r(f'coalesce(v - lag(v, {n}) OVER ({W}), 0)')} AS diff_{n}''' for n in (1, 4, 96))} FROM panel")
def lag_features(spark, sf_dir):
    x = features.differences(features.lags(panel(spark, sf_dir), [1, 4, 96, 672]), [1, 4, 96])
    return rounded(x.drop("raw", "v"))


@query(f"WITH {GRID} SELECT series, b, {', '.join(f'''{r(f'avg(v) OVER ({W} ROWS {f})')} AS mean_{n}, {r(f'coalesce(stddev_samp(v) OVER ({W} ROWS {f}), 0)')} AS std_{n}''' for n, f in (('8', '7 PRECEDING'), ('8_past', 'BETWEEN 8 PRECEDING AND 1 PRECEDING')))} FROM panel")
def roll_mean_std(spark, sf_dir):
    x = features.rolling(features.rolling(panel(spark, sf_dir), 8), 8, current=False)
    return rounded(x.select("series", "b", "mean_8", "std_8", "mean_8_past", "std_8_past"))


@query(f"WITH {GRID} SELECT series, b, {r(f'max(v) OVER ({W} ROWS 15 PRECEDING) - min(v) OVER ({W} ROWS 15 PRECEDING)')} AS range_16 FROM panel")
def roll_range(spark, sf_dir):
    return rounded(features.rolling(panel(spark, sf_dir), 16).select("series", "b", "range_16"))


_PAST96 = f"OVER ({W} ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING)"


@query(f"WITH {GRID}, x AS (SELECT *, CASE WHEN count(v) {_PAST96} >= 32 THEN quantile_cont(v, 0.025) {_PAST96} END AS lo, CASE WHEN count(v) {_PAST96} >= 32 THEN quantile_cont(v, 0.975) {_PAST96} END AS hi FROM panel) SELECT series, b, {r('least(greatest(v, coalesce(lo, v)), coalesce(hi, v))')} AS clipped FROM x")
def roll_quantile_clip(spark, sf_dir):
    return rounded(features.rolling_clip(panel(spark, sf_dir), 96, 32, 0.025, 0.975).select("series", "b", "clipped"))


@query(f"WITH {GRID}, x AS (SELECT *, list(v) OVER ({W} ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING) AS past FROM panel), m AS (SELECT *, list_aggregate(past, 'median') AS mid FROM x), d AS (SELECT *, list_aggregate(list_transform(past, lambda z: abs(z - mid)), 'median') AS mad FROM m) SELECT series, b, {r('CASE WHEN abs(v - mid) > 3.0 * 1.4826 * mad AND mad > 0 THEN mid ELSE v END')} AS hampel FROM d")
def hampel_clean(spark, sf_dir):
    return rounded(features.hampel(panel(spark, sf_dir), 32, 3.0).select("series", "b", "hampel"))


@query(f"WITH {GRID} SELECT series, b, {', '.join(f'{r(EMA(s))} AS ema_{s}' for s in (4, 8, 16))} FROM panel")
def ema_multi(spark, sf_dir):
    return rounded(features.ema(panel(spark, sf_dir), [4, 8, 16]).drop("raw", "v"))


@query(f"WITH {GRID}, x AS (SELECT *, avg(v) OVER ({W} ROWS 95 PRECEDING) AS level, max(v) OVER ({W} ROWS 7 PRECEDING) AS peak FROM panel) SELECT series, b, {r('v / greatest(level, 1) - 1')} AS v_rel, {r('peak / greatest(level, 1) - 1')} AS peak_rel FROM x")
def relative_features(spark, sf_dir):
    x = panel(spark, sf_dir).withColumns({"level": F.avg("v").over(features.previous(96)), "peak": F.max("v").over(features.previous(8))})
    return rounded(features.relative(x, "level", ["v", "peak"]).select("series", "b", "v_rel", "peak_rel"))


@query(f"""WITH {GRID}, w AS (SELECT b, {', '.join(f"max(raw) FILTER (series = '{s}') AS {s}" for s in SERIES)} FROM grid GROUP BY b), x AS (SELECT *, coalesce(click, 0) + coalesce(view, 0) AS production, coalesce(purchase, 0) + coalesce(signup, 0) AS demand FROM w) SELECT b, {r('production')} AS production, {r('demand')} AS demand, {r('production - demand')} AS surplus, {r('demand / nullif(production, 0)')} AS demand_share, {r('error / 2000.0')} AS holder_ratio, {r('2000.0 - error')} AS margin_up, CAST(error IS NULL AS DOUBLE) AS holder_missing, {r('3.2 * coalesce(click, 0) + 17.0 * coalesce(view, 0)')} AS energy FROM x""")
def balance_features(spark, sf_dir):
    x = features.balance(grid.to_wide(panel(spark, sf_dir), SERIES), ["click", "view"], ["purchase", "signup"], "error", 2000.0)
    x = features.energy(x, {"click": 3.2, "view": 17.0})
    return rounded(x.select("b", "production", "demand", "surplus", "demand_share", "holder_ratio", "margin_up", "holder_missing", "energy"))


@query(f"WITH {GRID}, x AS (SELECT *, coalesce(v - lag(v, 4) OVER ({W}), 0) AS d, abs(v - lag(v, 4) OVER ({W})) AS ad, coalesce(stddev_samp(v) OVER ({W} ROWS 7 PRECEDING), 0) AS s FROM panel), c AS (SELECT series, greatest(coalesce(median(ad), 0), 0.005 * median(abs(v)), 1e-4) AS scale FROM x GROUP BY 1) SELECT x.series, b, {r('0.5 + 0.5 * tanh(d / (3 * scale))')} AS change_bounded, {r('ln(1 + s)')} AS deviation_log FROM x JOIN c ON x.series = c.series")
def bounded_encodings(spark, sf_dir):
    p = panel(spark, sf_dir)
    x = features.bounded(features.rolling(features.differences(p, [4]), 8), quality.change_scale(p))
    return rounded(x.select("series", "b", "change_bounded", "deviation_log"))


@query(f"WITH {GRID}, {AHEAD((1, 8))} SELECT series, b, h, target_ts, y FROM labelled")
def horizon_labels(spark, sf_dir):
    p = panel(spark, sf_dir)
    return _ahead(p, [1, 8], ["series", "b", "h", "target_ts", "y"])


def _ahead(p: DataFrame, steps: list[int], columns: list[str] | None = None) -> DataFrame:
    """Origins for each horizon with their labels."""
    truth = p.select(F.col("series").alias("_s"), F.col("b").alias("_b"), F.col("raw").alias("y"))
    x = features.horizons(origins(p), steps)
    x = x.join(truth, (F.col("series") == F.col("_s")) & (F.col("target_ts") == F.col("_b")), "left").drop("_s", "_b")
    return x.select(*columns) if columns else x


@query(f"WITH {GRID}, {AHEAD((8, 96))} SELECT a.series, a.b, a.h, CAST(k.k AS INTEGER) AS k, g.v AS anchor FROM ahead a CROSS JOIN (VALUES (-1), (0), (1)) k(k) LEFT JOIN panel g ON g.series = a.series AND g.b = a.b + least(a.h - 96 - k.k, 0) * INTERVAL 15 MINUTE")
def clamped_anchor_lags(spark, sf_dir):
    p = panel(spark, sf_dir)
    x = features.horizons(origins(p), [8, 96]).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])))
    return members.lookup(x, p, t.shift(F.col("b"), F.least(F.col("h") - 96 - F.col("k"), F.lit(0))), "anchor").select("series", "b", "h", "k", "anchor")


@query(f"WITH {GRID}, x AS (SELECT series, b, (epoch_us(TIMESTAMP '{CUTOFF}') - epoch_us(b)) / 86400e6 AS age FROM panel WHERE b <= TIMESTAMP '{CUTOFF}'), y AS (SELECT *, pow(2.0, -age / 7.0) AS w FROM x) SELECT series, b, {r('w / avg(w) OVER (PARTITION BY series)')} AS weight FROM y")
def recency_weights(spark, sf_dir):
    p = panel(spark, sf_dir).where(F.col("b") <= at(CUTOFF))
    return rounded(features.recency_weights(p, at(CUTOFF), 7.0, ["series"]).select("series", "b", "weight"))


# -- quality --


@query(f"WITH q AS (SELECT event_type AS series, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, quantile_cont(value, 0.999) AS c FROM events GROUP BY 1), d AS (SELECT series, 0.0::DOUBLE AS low, greatest(c, b + 6 * (b - a), 1.0) AS high FROM q) SELECT series, {r('low')} AS low, {r('high')} AS high, (SELECT count(*) FROM events e WHERE e.event_type = d.series AND NOT (e.value BETWEEN d.low AND d.high)) AS n_outside FROM d")
def sensor_bounds(spark, sf_dir):
    o = observations(spark, sf_dir)
    dim = quality.bounds(o, "series", "value")
    outside = quality.outside_to_null(o, dim, "series", "value").groupBy("series").agg(F.count_if(F.col("value").isNull()).alias("n_outside"))
    return rounded(dim.join(outside, "series"))


_FENCE = lambda n, where: f"{n} AS (SELECT l_returnflag, CASE WHEN q3 > q1 THEN q1 - 1.5 * (q3 - q1) ELSE q2 END AS lo, CASE WHEN q3 > q1 THEN q3 + 1.5 * (q3 - q1) ELSE q2 END AS hi, q2 AS mid FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem WHERE {where} GROUP BY 1))"


@query(f"WITH {_FENCE('a', '''l_shipdate < TIMESTAMP '1998-01-01' ''')}, {_FENCE('b', '''l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' ''')}, f AS (SELECT a.l_returnflag, least(a.lo, b.lo) AS lo, greatest(a.hi, b.hi) AS hi FROM a LEFT JOIN b ON a.l_returnflag = b.l_returnflag) SELECT l.l_returnflag, l.l_linestatus, CAST(sum(CAST(l_extendedprice < lo OR l_extendedprice > hi AS INTEGER)) AS BIGINT) AS n_outlier, {r('avg(least(greatest(l_extendedprice, lo), hi))', 4)} AS mean_repaired FROM lineitem l JOIN f ON l.l_returnflag = f.l_returnflag GROUP BY 1, 2")
def regime_fence_repair(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", "l_shipdate")
    before = x.where(F.col("l_shipdate") < at("1998-01-01 00:00:00"))
    fences = [quality.tukey_fence(d, ["l_returnflag"], "l_extendedprice") for d in (before, before.where(F.col("l_shipdate") >= at("1997-01-01 00:00:00")))]
    done = quality.repair(x, *fences, ["l_returnflag"], "l_extendedprice")
    return rounded(done.groupBy("l_returnflag", "l_linestatus").agg(F.sum("outlier").alias("n_outlier"), F.avg("repaired").alias("mean_repaired")), 4)


@query(f"WITH d AS (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2), x AS (SELECT *, count(m) OVER p AS n, sum(m) OVER p AS s, count(m) OVER a AS nn, sum(m) OVER a AS ss FROM d WINDOW p AS (PARTITION BY o_orderstatus ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY o_orderstatus)), y AS (SELECT *, greatest((s / n) / nullif((ss - s) / (nn - n), 0), ((ss - s) / (nn - n)) / nullif(s / n, 0)) AS ratio FROM x WHERE n >= 3 AND nn - n >= 3) SELECT o_orderstatus, CASE WHEN max(ratio) >= 1.1 THEN arg_max(day, ratio) END AS break_day, {r('max(ratio)')} AS ratio FROM y GROUP BY 1")
def structural_break(spark, sf_dir):
    daily = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("m"))
    return rounded(quality.structural_break(daily, "o_orderstatus", "day", "m", 1.1))


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("WITH " + "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v FROM lineitem" for c in _NUMERIC) + "), s AS (SELECT c, avg(v) AS m, stddev_samp(v) AS d, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY 1) SELECT l.c AS \"column\", count(*) AS n_rows, count(*) FILTER (v IS NULL) AS n_missing, count(*) FILTER (v < 0) AS n_negative, count(*) FILTER (v = 0) AS n_zero, coalesce(min(v) = max(v), true) AS is_constant, count(*) FILTER (abs((v - m) / nullif(d, 0)) > 3) AS n_z3, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_iqr FROM l JOIN s ON l.c = s.c GROUP BY 1")
def quality_audit(spark, sf_dir):
    return quality.audit(table(spark, sf_dir, "lineitem").select(*_NUMERIC), _NUMERIC)


@query("SELECT c AS \"column\", active FROM (SELECT min(l_quantity) <> max(l_quantity) AS l_quantity, min(l_tax) <> max(l_tax) AS l_tax, false AS fixed FROM lineitem) UNPIVOT (active FOR c IN (l_quantity, l_tax, fixed))")
def constant_columns(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", F.lit(2.0).alias("fixed"))
    live = set(quality.active_columns(x, x.columns))
    return spark.createDataFrame([(c, c in live) for c in x.columns], "column string, active boolean")


@query("SELECT 'o_copy' AS \"column\", 'o_totalprice' AS duplicate_of FROM (SELECT o_totalprice, o_totalprice AS o_copy FROM orders) HAVING count(*) FILTER (o_totalprice IS DISTINCT FROM o_copy) = 0")
def duplicate_columns(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_totalprice").alias("o_copy"), (F.col("o_totalprice") + 1).alias("o_other"))
    return quality.duplicate_columns(x, ["o_orderkey"], ["o_totalprice", "o_copy", "o_other"])


@query(f"WITH k AS (SELECT event_type, quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS q FROM events GROUP BY 1), x AS (SELECT event_id, value AS v, q, len(list_filter(q, lambda y: y <= value)) AS n FROM events JOIN k ON events.event_type = k.event_type) SELECT event_id, {r('CASE WHEN n = 0 THEN 0 WHEN n >= 5 THEN 1 ELSE (n - 1 + (v - q[n]) / nullif(q[n + 1] - q[n], 0)) / 4 END')} AS quantile FROM x")
def quantile_transform(spark, sf_dir):
    o = observations(spark, sf_dir)
    return rounded(quality.quantile_transform(o, quality.quantile_knots(o, "series", "value", 5), "series", "value").select("event_id", "quantile"))


@query(f"WITH {GRID}, x AS (SELECT raw, CASE WHEN raw BETWEEN 0 AND 400 THEN raw END AS cut FROM panel) SELECT 'raw' AS \"column\", count(*) FILTER (CASE WHEN raw IS NULL OR cut IS NULL THEN raw IS DISTINCT FROM cut ELSE abs(raw - cut) > 1e-6 END) AS n_changed FROM x")
def changed_cells(spark, sf_dir):
    p = panel(spark, sf_dir).select("series", "b", "raw")
    return quality.changed_cells(p, p.withColumn("raw", F.when(F.col("raw").between(0, 400), F.col("raw"))), ["series", "b"], ["raw"])


_HEADS = ["BF", "bfg_main", "blast_furnace_1", "coke_oven_2", "cog", "co_line", "ldg", "converter_3", "air_heater_7", "mixed", "error"]
_TAILS = ["", "_holder", "_into_gas_mixed", "_user_4", "_generator_use_gas", "_supply", "_temp"]


@query(f"WITH s AS (SELECT h || t AS series, lower(h || t) AS n FROM (SELECT unnest({_HEADS!r}) AS h) CROSS JOIN (SELECT unnest({_TAILS!r}) AS t) UNION SELECT DISTINCT event_type, event_type FROM events), g AS (SELECT *, CASE WHEN n LIKE 'air\\_heater\\_%' ESCAPE '\\' OR contains(n, 'blast') OR regexp_matches(n, '(^|_)bf(g|_)') THEN 'blast_furnace' WHEN contains(n, 'coke') OR regexp_matches(n, '(^|_)co(g|_)') THEN 'coke' WHEN contains(n, 'converter') OR regexp_matches(n, '(^|_)ldg($|_)') THEN 'converter' WHEN contains(n, 'mixed') THEN 'mixed' END AS gas FROM s) SELECT series, gas, CASE WHEN gas IS NULL THEN 'other' WHEN contains(n, 'generator') AND contains(n, 'gas') OR contains(n, 'generator_use') THEN 'generator' WHEN contains(n, 'holder') OR contains(n, 'gasometer') THEN 'holder' WHEN contains(n, 'mixed') AND contains(n, 'into') THEN 'mixed_in' WHEN contains(n, 'user') OR contains(n, 'heater') OR contains(n, 'consume') THEN 'user' WHEN regexp_matches(n, '(blast_furnace|coke_oven|converter)_[0-9]+$') OR contains(n, 'produce') OR contains(n, 'generation') OR contains(n, 'output') OR contains(n, 'supply') THEN 'production' ELSE 'other' END AS role FROM g")
def sensor_roles(spark, sf_dir):
    from slotwise.sources.tables import sensor_roles as roles

    names = spark.createDataFrame([(h + x,) for h in _HEADS for x in _TAILS], "series string").union(observations(spark, sf_dir).select("series")).distinct()
    return roles(names)


@query(None)
def content_hash(spark, sf_dir):
    return quality.content_hash(panel(spark, sf_dir))
