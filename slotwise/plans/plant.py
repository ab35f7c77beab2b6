"""Queries on a plant: gas balances, ratios, limits of values, contracts of delivered tables, workbooks, banks and plans for three gases."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.functions import time as t
from slotwise.operators import blend, contracts, dispatch, features, grid, members, quality
from slotwise.plans.catalogue import AHEAD, CUTOFF, GRID, RANGE, SERIES, SLOT, W, _ahead, at, observations, origins, panel, query, r, rounded, table
from slotwise.plans.forecasts import _ALL, _DAY, _RECENT, _WEEK, STEPS, member_table, read_wide
from slotwise.session import scratch_path, ship_package, written

# -- balances and ratios --

#: Which series stands for which of a gas's roles.
_GROUPS = {
    "blast_furnace": {"production": ["click"], "user": ["error"], "mixed_in": ["purchase"], "holder": ["signup"]},
    "coke": {"production": ["view"], "mixed_in": ["signup"]},
    "converter": {"production": ["purchase"], "user": ["signup"]},
}
_HEATING = {"blast_furnace": 3.2, "coke": 17.0, "converter": 7.5}  # fixed values: lower heating values
_C = {s: f"coalesce({s}, 0)" for s in SERIES}
_WIDE = f"w AS (SELECT b, {', '.join(f'max(raw) FILTER (series = {s!r}) AS {s}' for s in SERIES)} FROM grid GROUP BY b)"
_MIXED = {"blast_furnace": _C["purchase"], "coke": _C["signup"], "converter": "0.0"}
_FLOW = f"nullif({_C['purchase']} + {_C['signup']}, 0)"
_SHARES = ", ".join(f"least(greatest(coalesce(last_value(({m}) / {_FLOW} IGNORE NULLS) OVER (ORDER BY b ROWS UNBOUNDED PRECEDING), 1.0 / 3), 0), 1) AS {g}_mixed_share" for g, m in _MIXED.items())
_SUPPLY = {"blast_furnace": _C["click"], "coke": _C["view"], "converter": _C["purchase"]}
_USERS = {"blast_furnace": _C["error"], "coke": "0.0", "converter": _C["signup"]}
_DEMAND = {g: f"({u} + {_C['view']} * {g}_mixed_share)" for g, u in _USERS.items()}
_ENERGY = {k: " + ".join(f"{x[g]} * {_HEATING[g]}" for g in _GROUPS) for k, x in (("supply", _SUPPLY), ("demand", _DEMAND))}
_BALANCE = ["blast_furnace_available", "coke_mixed_share", "converter_priority_demand", "available_total", "energy_supply", "energy_demand", "stock_ratio", "stock_margin_low", "stock_margin_high", "stock_change_1", "stock_change_4"]


@query(
    f"WITH {GRID}, {_WIDE}, x AS (SELECT *, {_SHARES} FROM w) SELECT b, {r(_SUPPLY['blast_furnace'] + ' - ' + _DEMAND['blast_furnace'])} AS blast_furnace_available, {r('coke_mixed_share')} AS coke_mixed_share, {r(_DEMAND['converter'])} AS converter_priority_demand, "
    f"{r(' + '.join(_SUPPLY.values()) + ' - (' + ' + '.join(_DEMAND.values()) + ')')} AS available_total, {r(_ENERGY['supply'], 4)} AS energy_supply, {r(_ENERGY['demand'], 4)} AS energy_demand, {r('least(greatest(' + _C['signup'] + ' / 2000.0, 0), 2)')} AS stock_ratio, {r(_C['signup'] + ' - 300.0')} AS stock_margin_low, "
    f"{r('1800.0 - ' + _C['signup'])} AS stock_margin_high, {r('coalesce(' + _C['signup'] + ' - lag(' + _C['signup'] + ') OVER (ORDER BY b), 0)')} AS stock_change_1, {r('coalesce(' + _C['signup'] + ' - lag(' + _C['signup'] + ', 4) OVER (ORDER BY b), 0)')} AS stock_change_4 FROM x"
)
def gas_balance(spark, sf_dir):
    done = features.gas_balance(grid.to_wide(panel(spark, sf_dir), SERIES), _GROUPS, ["view"], 2000.0, _HEATING).select("b", *_BALANCE)
    return rounded(done.withColumns({c: F.round(c, 4) for c in ("energy_supply", "energy_demand")}))


_POWER = "CASE WHEN view IS NOT NULL THEN greatest(view, 1) END"


@query(f"WITH {GRID}, {_WIDE} SELECT b, {r(f'click / ({_POWER})')} AS click_per_power, {r(f'error / ({_POWER})')} AS error_per_power, {r(f'purchase / ({_POWER})')} AS group_power_ratio FROM w")
def power_ratios(spark, sf_dir):
    wide = grid.to_wide(panel(spark, sf_dir), SERIES)
    return rounded(features.power_ratios(wide, ["click", "error"], "view", "purchase").select("b", "click_per_power", "error_per_power", "group_power_ratio"))


_CLOCKS = [(f, k) for k in (1, 2) for f in ("sin", "cos")]


@query(f"WITH {GRID} SELECT b, {', '.join(r(f'0.5 * (1 + {f}(2 * pi() * {k} * (hour(b) * 60 + minute(b)) / 1440))') + f' AS clock_{f}{k}' for f, k in _CLOCKS)} FROM slots")
def unit_clock(spark, sf_dir):
    x = features.calendar(panel(spark, sf_dir).select("b").distinct())
    return rounded(features.unit_clock(x, [f"clock_{f}{k}" for f, k in _CLOCKS]).select("b", *[f"clock_{f}{k}" for f, k in _CLOCKS]))


@query(
    f"WITH {GRID}, a AS (SELECT b, max(raw) FILTER (series = 'click') AS click, max(raw) FILTER (series = 'view') AS view FROM obs WHERE series IN ('click', 'view') GROUP BY 1), o AS (SELECT b, max(raw) FILTER (series = 'view') * 2 AS view, max(raw) FILTER (series = 'error') AS error FROM obs WHERE series IN ('error', 'view') AND hour(b) < 12 GROUP BY 1), "
    "s AS (SELECT b, raw AS signup FROM obs WHERE series = 'signup') SELECT coalesce(a.b, o.b, s.b) AS b, click, coalesce(a.view, o.view) AS view, error, signup FROM a FULL JOIN o ON a.b = o.b FULL JOIN s ON s.b = coalesce(a.b, o.b)"
)
def joined_sources(spark, sf_dir):
    """Three wide sources, two of which have a column 'view'."""
    slots = written(grid.resample(observations(spark, sf_dir), "sum"), "slots")
    of = lambda *names: slots.where(F.col("series").isin(*names)).groupBy("b").pivot("series", list(names)).agg(F.max("raw"))
    return grid.join_sources([of("click", "view"), of("error", "view").where(F.hour("b") < 12).withColumn("view", F.col("view") * 2), of("signup")])


# -- values --


@query("SELECT event_type AS series, 0.0::DOUBLE AS low, CASE event_type WHEN 'click' THEN 200.0 WHEN 'view' THEN 440.0 ELSE round(greatest(quantile_cont(value, 0.999), quantile_cont(value, 0.75) + 6 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 1), 6) END::DOUBLE AS high FROM events WHERE value IS NOT NULL GROUP BY 1")
def capped_bounds(spark, sf_dir):
    return rounded(quality.bounds(observations(spark, sf_dir), "series", "value", {"click": 200.0, "view": 440.0}))


_QUARTILES = "f AS (SELECT event_type AS series, CASE WHEN q[3] > q[1] THEN q[1] - 1.5 * (q[3] - q[1]) ELSE q[2] END AS lo, CASE WHEN q[3] > q[1] THEN q[3] + 1.5 * (q[3] - q[1]) ELSE q[2] END AS hi FROM (SELECT event_type, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events GROUP BY 1) UNION ALL SELECT 'constant', 3.1, 3.1)"
_IN = "CASE WHEN nextafter(hi::FLOAT, '-inf'::FLOAT) > nextafter(lo::FLOAT, 'inf'::FLOAT) THEN nextafter({0}::FLOAT, '{1}inf'::FLOAT) ELSE hi::FLOAT END::DOUBLE"


@query(f"WITH {_QUARTILES} SELECT series, {_IN.format('lo', '')} AS fence_low, {_IN.format('hi', '-')} AS fence_high FROM f")
def single_precision_fences(spark, sf_dir):
    fences = quality.tukey_fence(observations(spark, sf_dir), ["series"], "value").select("series", "fence_low", "fence_high")
    constant = spark.createDataFrame([("constant", 3.1, 3.1)], fences.schema)
    return quality.inward(fences.unionByName(constant))


@query(f"WITH {GRID}, x AS (SELECT series, b, v, raw AS y, lag(raw, 96) OVER ({W}) AS base FROM panel) SELECT series, count(*) AS n_rows, count(*) FILTER (y > 0 AND y <= 500 AND base IS NOT NULL) AS n_valid FROM x GROUP BY 1")
def valid_labels(spark, sf_dir):
    x = panel(spark, sf_dir).withColumn("base", F.lag("raw", 96).over(grid.by_time()))
    return x.groupBy("series").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(quality.valid(F.col("raw"), F.col("base"), 500.0)).alias("n_valid"))


@query(
    f"WITH {GRID}, d AS (SELECT series, CAST(b AS DATE) AS day, avg(raw) AS m FROM panel GROUP BY 1, 2 HAVING avg(raw) IS NOT NULL), x AS (SELECT *, count(m) OVER p AS n, sum(m) OVER p AS s, count(m) OVER a AS nn, sum(m) OVER a AS ss FROM d WINDOW p AS (PARTITION BY series ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY series)), "
    "y AS (SELECT *, greatest((s / n) / nullif((ss - s) / (nn - n), 0), ((ss - s) / (nn - n)) / nullif(s / n, 0)) AS ratio FROM x WHERE n >= 3 AND nn - n >= 3), k AS (SELECT series, CASE WHEN max(ratio) >= 1.02 THEN arg_max(day, ratio) END AS break_day FROM y GROUP BY 1), "
    "z AS (SELECT p.series, count(*) AS n_rows, min(b) AS first_slot, avg(v) AS m FROM panel p JOIN k ON k.series = p.series WHERE b >= CAST(break_day AS TIMESTAMP) GROUP BY 1) SELECT series, n_rows, first_slot, (round(m, 6) + 0) AS mean FROM z WHERE n_rows >= 288"
)
def regime_window(spark, sf_dir):
    """Rows since the last change of level."""
    p = written(panel(spark, sf_dir), "panel")
    daily = grid.daily_mean(p)
    breaks = quality.structural_break(daily, "series", "day", "mean", least_ratio=1.02)
    return rounded(quality.regime_window(p, breaks, "series", "b").groupBy("series").agg(F.count(F.lit(1)).alias("n_rows"), F.min("b").alias("first_slot"), F.avg("v").alias("mean")))


_KNOTS = "[" + ", ".join(f"{i}/511.0" for i in range(512)) + "]"


@query(
    f"WITH {GRID}, k AS (SELECT series, quantile_cont(v, {_KNOTS}) AS q FROM panel WHERE b > (SELECT max(b) FROM panel) - INTERVAL 14 DAY GROUP BY 1), x AS (SELECT p.series, b, v, q, len(list_filter(q, lambda y: y < v)) AS below, len(list_filter(q, lambda y: y <= v)) AS upto FROM panel p JOIN k ON k.series = p.series WHERE {RANGE}) "
    "SELECT series, b, (round(CASE WHEN v <= q[1] THEN 0 WHEN v >= q[512] THEN 1 WHEN upto > below THEN (below + upto - 1) / 2 / 511 ELSE (below - 1 + (v - q[below]) / (q[below + 1] - q[below])) / 511 END, 4) + 0) AS quantile FROM x"
)
def recent_quantiles(spark, sf_dir):
    """512 knots of the last 14 days."""
    p = written(panel(spark, sf_dir), "panel")
    last = p.agg(F.max("b").alias("_last"))
    recent = p.join(F.broadcast(last)).where(F.col("b") > t.shift(F.col("_last"), -14 * t.SLOTS_PER_DAY))  # one row on the right
    done = quality.quantile_position(origins(p), quality.quantile_knots(recent, "series", "v", 512), "series", "v")
    return rounded(done.select("series", "b", "quantile"), 4)


# -- members and blends --


@query(f"WITH {GRID}, {AHEAD(STEPS)}, {_RECENT} SELECT a.series, a.b, a.h, 'seasonal_future' AS member, {r('greatest(0, 0.75 * coalesce(dy.raw, m8) + 0.15 * coalesce(wk.raw, dy.raw, m8) + 0.10 * m8)')} AS p FROM labelled a JOIN recent q ON q.series = a.series AND q.b = a.b {_DAY} {_WEEK}")
def seasonal_future(spark, sf_dir):
    p = written(panel(spark, sf_dir), "panel")
    return rounded(members.seasonal_future(_ahead(p, list(STEPS)), p).select("series", "b", "h", "member", "p"))


@query(None)
def band_blend(spark, sf_dir):
    """Convex weights of each series and band of horizons."""
    ship_package(spark)
    x = member_table(spark, sf_dir, only=("persistence", "averages", "seasonal")).withColumn("band", F.when(F.col("h") <= 2, "near").otherwise("far"))
    return blend.fit_blend(x, ["persistence", "ema_4", "ema_16", "seasonal"], ["series", "band"])


@query(None)
def day_part_blend(spark, sf_dir):
    """Affine weights of each series, horizon and half of the day."""
    ship_package(spark)
    x = member_table(spark, sf_dir, (1, 8), ("persistence", "averages")).withColumn("part", t.day_block(F.col("b"), 2))
    return blend.fit_blend(x, ["persistence", "ema_4", "ema_16"], ["series", "h", "part"], "affine")


_DEFAULTS = (0.03, 0.9)


@query(
    f"WITH {GRID}, x AS (SELECT series, b, v, coalesce(lag(v, 1) OVER ({W}), 0) AS l, lead(raw, 1) OVER ({W}) AS y FROM panel), g AS (SELECT series, count(*) AS n, sum(v * v) AS vv, sum(v * l) AS vl, sum(l * l) AS ll, sum(v * y) AS vy, sum(l * y) AS ly FROM x WHERE y IS NOT NULL AND b < TIMESTAMP '{CUTOFF}' GROUP BY 1), "
    "s AS (SELECT *, (vy * ll - ly * vl) / (vv * ll - vl * vl) AS b1, (ly * vv - vy * vl) / (vv * ll - vl * vl) AS b2 FROM g), c AS (SELECT *, CASE WHEN b1 >= 0 AND b2 >= 0 THEN b1 WHEN vy * vy / vv >= ly * ly / ll THEN greatest(vy / vv, 0) ELSE 0 END AS e1, CASE WHEN b1 >= 0 AND b2 >= 0 THEN b2 WHEN vy * vy / vv >= ly * ly / ll THEN 0 ELSE greatest(ly / ll, 0) END AS e2 FROM s) "
    f"SELECT series, {r(f'CASE WHEN n < 64 THEN {_DEFAULTS[0]} ELSE least(greatest(e1, {_DEFAULTS[0]} / 20), {_DEFAULTS[0]} * 20) END')} AS now, {r(f'CASE WHEN n < 64 THEN {_DEFAULTS[1]} ELSE least(greatest(e2, {_DEFAULTS[1]} / 20), {_DEFAULTS[1]} * 20) END')} AS before FROM c"
)
def plant_efficiency(spark, sf_dir):
    ship_package(spark)
    x = features.labels(features.lags(panel(spark, sf_dir), [1]), [1]).where((F.col("b") < at(CUTOFF)) & F.col("y").isNotNull())
    fit = F.udf(lambda sums: members.efficiency(sums, list(_DEFAULTS)), "array<double>")  # a row a series
    done = members.gram(x, ["series"], ["v", "lag_1"], "y").withColumn("_e", fit("sums"))
    return rounded(done.select("series", F.col("_e")[0].alias("now"), F.col("_e")[1].alias("before")))


# -- delivered tables --


@query(f"WITH {GRID}, {AHEAD(STEPS)} SELECT 'long' AS kind, series, b, h, {r('v')} AS p FROM labelled UNION ALL SELECT 'short' AS kind, series, b, h, {r('v')} AS p FROM labelled WHERE h <= 2")
def short_and_long(spark, sf_dir):
    """The two wide results written as CSV and read back as long rows."""
    from slotwise.sources import export

    made = written(member_table(spark, sf_dir, only=("persistence",)), "predictions")
    back = []
    for kind, df in zip(("short", "long"), export.split_results(made, SERIES, [h for h in STEPS if h <= 2], list(STEPS))):
        path = scratch_path(spark, kind)
        export.write_folder(export.formatted(df), path)
        back.append(read_wide(spark, path).withColumn("kind", F.lit(kind)))
    return rounded(back[0].unionByName(back[1]).select("kind", "series", "b", "h", "p"))


_DELIVERED = f"WITH {GRID}, {_WIDE}, f AS (SELECT series, quantile_cont(raw, 0.25) AS q1, quantile_cont(raw, 0.5) AS q2, quantile_cont(raw, 0.75) AS q3 FROM panel WHERE b <= TIMESTAMP '{CUTOFF}' GROUP BY 1), k AS (SELECT series, CASE WHEN q3 > q1 THEN q1 - 1.5 * (q3 - q1) ELSE q2 END AS lo, CASE WHEN q3 > q1 THEN q3 + 1.5 * (q3 - q1) ELSE q2 END AS hi FROM f)"


def _delivered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A table as it would be delivered, with its faults left in, and the fences it is held against."""
    p = written(panel(spark, sf_dir), "panel")
    x = origins(grid.to_wide(p, SERIES))
    made = {f"feat_{s}_{k}": F.coalesce(F.col(s), F.lit(0.0)) * k for s in SERIES for k in range(4)} | {f"feat_{s}_outlier": F.lit(0.0) for s in SERIES}
    return x.withColumns(made | {"plain": F.lit(1.0)}), quality.tukey_fence(p.where(F.col("b") <= at(CUTOFF)), ["series"], "raw")


@query(
    f"{_DELIVERED}, o AS (SELECT p.series, p.raw, lo, hi FROM grid p JOIN k ON k.series = p.series WHERE {RANGE}), c AS (SELECT (SELECT count(*) FROM o WHERE raw IS NULL) AS missing, (SELECT count(*) FROM o WHERE raw < lo OR raw > hi) AS outside) "
    "SELECT * FROM (SELECT 'unique times' AS \"check\", 5.0::DOUBLE AS points, 0::BIGINT AS n_faults FROM c UNION ALL SELECT 'origins', 5.0, 0 FROM c UNION ALL SELECT 'finite values', CASE WHEN missing = 0 THEN 10.0 ELSE 0.0 END, missing FROM c UNION ALL SELECT 'feature names', 0.0, 1 FROM c "
    "UNION ALL SELECT 'raw columns', 15.0, 0 FROM c UNION ALL SELECT 'outliers', CASE WHEN outside = 0 THEN 10.0 ELSE 0.0 END, outside FROM c)"
)
def delivery_points(spark, sf_dir):
    """Points of a delivered table that has a column without a prefix and the gaps and outliers of the data."""
    made, fences = _delivered(spark, sf_dir)
    return contracts.delivery_points(made, SERIES, at(FIRST_SLOT), at(LAST_SLOT), fences)


FIRST_SLOT, LAST_SLOT = "2024-01-28 00:00:00", "2024-01-29 23:45:00"


@query(f"WITH {GRID}, {AHEAD((1, 2))}, n AS (SELECT count(*) FILTER (raw IS NULL) AS missing FROM grid WHERE {RANGE}), o AS (SELECT count(DISTINCT b) AS n FROM grid WHERE {RANGE}) SELECT 'input' AS name, o.n AS n_rows, 0::BIGINT AS n_repeated, missing AS n_not_finite, 1::BIGINT AS n_misnamed, false AS passed FROM n, o UNION ALL SELECT 'short', o.n, 0, 0, 0, true FROM o UNION ALL SELECT 'twice', 2 * o.n, o.n, 0, 0, false FROM o")
def frame_contracts(spark, sf_dir):
    """Contracts of an input with a column that lacks its prefix, of short results, and of results delivered twice."""
    from slotwise.sources import export

    made, _ = _delivered(spark, sf_dir)
    short = export.wide_predictions(member_table(spark, sf_dir, (1, 2), ("persistence",)), SERIES, [1, 2])
    found = contracts.check_frame(made.withColumnRenamed("b", "datetime"), "input", SERIES, "feat_")
    return found.unionByName(contracts.check_frame(short, "short")).unionByName(contracts.check_frame(short.unionByName(short), "twice"))


# -- files --


def _cell(at: str, value: object) -> str:
    return f'<c r="{at}" t="inlineStr"><is><t>{value}</t></is></c>' if isinstance(value, str) else f'<c r="{at}"><v>{value!r}</v></c>'


def workbook_bytes(sheets: dict[str, list[list[object]]]) -> bytes:
    """A small workbook, as spreadsheet programs write it."""
    names = [chr(65 + i) for i in range(26)]
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{k}">' + "".join(_cell(f"{names[j]}{k}", x) for j, x in enumerate(row) if x is not None) + "</row>" for k, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


@query("SELECT CAST(m AS INTEGER) AS month, CAST(s AS INTEGER) AS slot, round(0.1 * m + 0.01 * (s // 4), 6) AS price FROM generate_series(1, 6) a(m) CROSS JOIN generate_series(0, 95) b(s) UNION ALL SELECT 7, CAST(s AS INTEGER), round(0.7 + 0.01 * (s // 2), 6) FROM generate_series(0, 95) b(s)")
def tariff_workbook(spark, sf_dir):
    """Two sheets: a column a month with 24 prices, and rows of month and price with 48."""
    from slotwise.sources import tables

    first = [["时段", *[f"{m}月" for m in range(1, 7)]], *[[f"{s}:00", *[0.1 * m + 0.01 * s for m in range(1, 7)]] for s in range(24)]]
    second = [["月份", "电价(元)"], *[["7月", 0.7 + 0.01 * s] for s in range(48)]]
    path = scratch_path(spark, "price") + ".xlsx"
    _put(spark, path, workbook_bytes({"a": first, "b": second}))
    return rounded(dispatch.price_table(tables.read_tariff(spark, path)).select("month", "slot", "price"))


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    stream = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to)
    stream.write(bytearray(data))
    stream.close()


@query(f"{_ALL} SELECT series, b, h, member, {r('p')} AS p FROM scored WHERE member IN ('persistence', 'ema_4', 'ema_16') AND h IN (1, 8)")
def bank_document(spark, sf_dir):
    """Members' forecasts as one gzip JSON document and read back."""
    from slotwise.sources import export, tables

    path = scratch_path(spark, "bank")
    export.write_bank_document(written(member_table(spark, sf_dir, (1, 8), ("persistence", "averages")), "bank"), path)
    return rounded(tables.read_bank_document(spark, path))


# -- plans for three gases --


def _three_gases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dispatch.Plant]:
    plant = dispatch.Plant(start_cost=30.0, ramp_cost=0.25, flare_cost=0.20, others=(("coke", 180.0), ("converter", 450.0)))
    p = origins(panel(spark, sf_dir))
    plan = F.concat_ws(" ", "series", F.date_format("b", "yyyy-MM-dd"))
    x = p.withColumns({"plan": plan, "step": t.slot_of_day(F.col("b")), "inflow": 20_000 + 40 * F.col("v"), "price": t.time_of_use_price(F.col("b")), "cap": F.lit(70_000.0)})
    return x.withColumns({"coke_inflow": 1_500 + 5 * F.col("v"), "coke_cap": F.lit(4_000.0), "converter_inflow": 2_000 + 5 * F.col("v"), "converter_cap": F.lit(3_000.0)}), plant


@query("SELECT DISTINCT e.event_type AS series, d.day, 0.0::DOUBLE AS balance_error, 0.0::DOUBLE AS band_error, 0.0::DOUBLE AS end_error, 0::BIGINT AS n_infeasible, true AS near_bound FROM events e CROSS JOIN (VALUES ('2024-01-28'), ('2024-01-29')) d(day)")
def three_gas_plan(spark, sf_dir):
    """What an audit must find of every plan for a stored gas and two others: no violation, and a value within a hundredth of the bound."""
    ship_package(spark)
    x, plant = _three_gases(spark, sf_dir)
    done = written(dispatch.plan(x, plant), "plans")
    gap = done.groupBy("plan").agg((F.first("bound") - F.first("value") <= 0.01 * F.abs(F.first("bound"))).alias("near_bound"))
    near = lambda c: F.when(F.col(c) > 1e-4, F.col(c)).otherwise(F.lit(0.0)).alias(c)
    found = dispatch.mass_balance(done, plant).join(gap, "plan")
    return found.select(F.split("plan", " ")[0].alias("series"), F.split("plan", " ")[1].alias("day"), near("balance_error"), near("band_error"), near("end_error"), "n_infeasible", "near_bound")
