import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotwise.operators import contracts, dispatch, features, grid, members, quality
from slotwise.plans import catalogue, plant
from slotwise.sources import export, tables, workbook

START = dt.datetime(2024, 1, 1)


def slots(n):
    return [START + dt.timedelta(minutes=15 * i) for i in range(n)]


def test_relaxed_burn_is_the_optimum():
    rng = np.random.default_rng(1)
    one = dispatch.Plant(capacity=100.0, low=0.1, high=0.5)
    for _ in range(60):
        inflow, price, cap = (rng.integers(a, b, 4).astype(float) for a, b in ((0, 30), (1, 9), (5, 40)))
        stock = int(rng.integers(10, 51))
        value = {s: 0.0 if s >= stock else -np.inf for s in range(10, 51)}
        for i in range(3, -1, -1):
            value = {s: max((price[i] * b + value[int(min(s + inflow[i] - b, 50))] for b in range(int(cap[i]) + 1) if s + inflow[i] - b >= 10), default=-np.inf) for s in range(10, 51)}
        assert (dispatch.relaxed_burn(inflow, price, float(stock), one, cap) * price).sum() == pytest.approx(value[stock])


def test_plan_with_unstored_gases_and_ramps(spark):
    one = dispatch.Plant(others=(("coke", 180.0),), ramp_share=0.3, start_cost=30.0, ramp_cost=0.25, flare_cost=0.2)
    rows = [("d", i, b, 20_000.0, 1.0 + i % 4, 60_000.0, 1_500.0, 1_000.0) for i, b in enumerate(slots(24))]
    steps = spark.createDataFrame(rows, "plan string, step int, b timestamp_ntz, inflow double, price double, cap double, coke_inflow double, coke_cap double")
    done = dispatch.plan(steps, one).toPandas()
    assert (done.coke_burned <= 1_000.0 + 1e-6).all() and (done.burned <= 60_000.0 + 1e-6).all() and done.value[0] <= done.bound[0]
    assert done.power_small.diff().abs().max() <= 0.3 * 200 + 1e-6
    found = dispatch.mass_balance(spark.createDataFrame(done), one).first()
    assert max(found.balance_error, found.band_error, found.end_error) < 1e-4 and found.n_infeasible == 0
    broken = done.assign(power_small=5.0, burned=done.burned + 70_000.0)
    found = dispatch.mass_balance(spark.createDataFrame(broken), one).first()
    assert found.balance_error > 1 and found.band_error > 1 and found.n_infeasible > 0


@pytest.mark.parametrize("volume", [20.0, 2_100.0, 21_000.0])
def test_plan_is_near_its_bound_however_much_gas_comes(volume):
    """Beyond what the limits allow gas must be flared: the bound knows, and the plan burns all that is allowed."""
    one = dispatch.Plant(start_cost=30.0, ramp_cost=0.25, flare_cost=0.2, others=(("coke", 180.0), ("converter", 450.0)))
    price = np.repeat([0.38, 1.3, 0.85, 1.3], 6)
    v = volume * (1 + np.arange(24) % 5 / 5)
    others = np.array([[1_500 + 5 * v, 2_000 + 5 * v], [np.full(24, 4_000.0), np.full(24, 3_000.0)]]).transpose(0, 2, 1)
    inflow = 20_000 + 40 * v
    got = dispatch.solve(inflow, price, 100_000.0, one, cap=np.full(24, 70_000.0), others=others)
    assert -1e-6 <= got["bound"] - got["value"] <= 0.01 * abs(got["bound"])
    moved = sum(0.25 * np.abs(np.diff(got[c])).sum() for c in ("power_small", "power_large"))
    flared = got["flare"].sum() + (others[0].T - got["others"].T).sum()
    assert got["value"] <= (price * got["power"] * 250).sum() - 0.2 * flared - moved + 1e-6


def test_deficit_is_an_error(spark):
    rows = [(s, b, v) for i, b in enumerate(slots(20)) for s, v in (("gas", 5.0), ("holder", 1000.0 - 10 * i))]
    x = spark.createDataFrame(rows, "series string, b timestamp_ntz, raw double")
    until = F.lit(slots(20)[-1]).cast("timestamp_ntz")
    with pytest.raises(Exception, match="no supply"):
        dispatch.surplus_forecast(x, until, {"gas": "holder"}).collect()
    row = dispatch.surplus_forecast(x.where("series = 'gas'"), until).first()
    assert (row.surplus, row.cap) == (5.0, 5.0)


def test_workbooks(spark, tmp_path):
    months = [["step", "1月", "2月", "note"], *[[float(s), 1.0 + s, 2.0 + s, "x"] for s in reversed(range(24))]]
    rows = [["Month", "Price"], *[[3.0, float(s)] for s in range(96)], [None, "end"]]
    (tmp_path / "price.xlsx").write_bytes(plant.workbook_bytes({"a": months, "empty": [["only a header"]], "b": rows}))
    got = tables.read_tariff(spark, (tmp_path / "price.xlsx").as_uri()).toPandas()
    assert got.groupby("month").size().to_dict() == {1: 24, 2: 24, 3: 96}
    assert got.sort_values(["month", "step"]).price.tolist()[:3] == [1.0, 2.0, 3.0]
    (tmp_path / "price.csv").write_bytes("月份,电价\n".encode("gb18030") + b"".join(b"5,%d\n" % s for s in range(48)))
    assert tables.read_tariff(spark, (tmp_path / "price.csv").as_uri()).count() == 48
    (tmp_path / "odd.csv").write_text("month,price\n" + "6,1\n" * 25)
    with pytest.raises(ValueError, match="25 prices"):
        tables.read_tariff(spark, (tmp_path / "odd.csv").as_uri())
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no monthly"):
        tables.read_tariff(spark, (tmp_path / "none.csv").as_uri())
    with pytest.raises(ValueError, match="refused"):
        workbook._xml(b"<!DOCTYPE x><x/>")


def test_names_of_time_columns():
    assert tables.time_column(["g1", "Date.Time", "time"]) == "Date.Time"
    assert tables.time_column(["record_time", "datetime"]) == "record_time"
    assert tables.time_column(["a", "b"]) == "a"


def test_gas_shares_are_carried_and_missing_counts_as_zero(spark):
    rows = [(b, s, m, k, u) for b, s, m, k, u in zip(slots(4), (10.0, None, 30.0, 40.0), (0.0, 1.0, 0.0, None), (0.0, 3.0, 0.0, 0.0), (8.0, 8.0, 8.0, 8.0))]
    wide = spark.createDataFrame(rows, "b timestamp_ntz, s double, m double, k double, u double")
    groups = {"a": {"production": ["s"], "mixed_in": ["m"]}, "c": {"mixed_in": ["k"], "holder": ["s"]}}
    got = features.gas_balance(wide, groups, ["u"], 20.0, {"a": 1.0, "c": 2.0}).orderBy("b").toPandas()
    assert got.a_mixed_share.tolist() == [0.5, 0.25, 0.25, 0.25]
    assert got.a_available.tolist() == [6.0, -2.0, 28.0, 38.0]
    assert got.stock_ratio.tolist() == [0.5, 0.0, 1.5, 2.0] and got.stock_change_1.tolist() == [0.0, -10.0, 30.0, 10.0]


def test_sources_join_once_and_first_wins(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5.0)], "b int, x double, y double")
    c = spark.createDataFrame([(2, 7.0), (1, 8.0), (3, 9.0)], "b int, y double")
    got = {r.b: (r.x, r.y) for r in grid.join_sources([a, c]).collect()}
    assert got == {1: (1.0, 8.0), 2: (2.0, 5.0), 3: (None, 9.0)}


def test_quantile_positions(spark):
    df = spark.createDataFrame([("s", v) for v in (0.0, 1.0, 1.0, 1.0, 2.0, 9.0, None)], "series string, v double")
    got = quality.quantile_position(df, quality.quantile_knots(df, "series", "v", 6), "series", "v").toPandas()
    assert got["quantile"].tolist()[:6] == pytest.approx([0.0, 0.4, 0.4, 0.4, 0.8, 1.0]) and pd.isna(got["quantile"][6])
    flat = spark.createDataFrame([("s", 3.0)] * 4, "series string, v double")
    assert {r["quantile"] for r in quality.quantile_position(flat, quality.quantile_knots(flat, "series", "v", 4), "series", "v").collect()} == {0.0}


def test_validity_and_short_regimes(spark):
    x = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (11.0, 1.0), (float("nan"), 1.0), (None, 1.0), (1.0, None)], "y double, base double")
    assert x.where(quality.valid(F.col("y"), F.col("base"), 10.0)).count() == 1
    rows = [(s, b, 1.0) for s, n in (("a", 400), ("z", 300)) for b in slots(n)]
    df = spark.createDataFrame(rows, "series string, b timestamp_ntz, v double")
    breaks = spark.createDataFrame([("a", dt.date(2024, 1, 2)), ("z", dt.date(2024, 1, 2))], "series string, break_day date")
    assert {r.series: r["count"] for r in quality.regime_window(df, breaks, "series", "b").groupBy("series").count().collect()} == {"a": 304}


def test_efficiency_is_bounded():
    x = np.random.default_rng(2).random((100, 2))
    y = x @ [2.0, 50.0]
    sums = [100.0, y.sum(), (y * y).sum(), *x.sum(0), (x[:, 0] ** 2).sum(), (x[:, 0] * x[:, 1]).sum(), (x[:, 1] ** 2).sum(), *(x.T @ y)]
    assert members.efficiency(sums, [1.0, 1.0]) == pytest.approx([2.0, 20.0])
    assert members.efficiency([10.0, *sums[1:]], [1.0, 1.0]) == [1.0, 1.0]


def test_contracts_of_delivered_tables(spark):
    good = spark.createDataFrame([(b, 1.0, *[0.0] * 21) for b in slots(4)], "b timestamp_ntz, g double, " + ", ".join(f"feat_{i} double" for i in range(20)) + ", feat_g_outlier double")
    fences = spark.createDataFrame([("g", 0.0, 2.0)], "series string, fence_low double, fence_high double")
    ends = [F.lit(b).cast("timestamp_ntz") for b in (slots(4)[0], slots(4)[-1])]
    points = contracts.delivery_points(good, ["g"], *ends, fences)
    assert points.agg(F.sum("points")).first()[0] == 50.0
    bad = good.unionByName(good.limit(1)).withColumn("g", F.lit(5.0)).drop("feat_g_outlier")
    found = {r.check: r.n_faults for r in contracts.delivery_points(bad, ["g", "h"], *ends, fences).collect()}
    assert found == {"unique times": 1, "origins": 0, "finite values": 0, "feature names": 1, "raw columns": 1, "outliers": 7}
    assert contracts.check_frame(good.limit(0), "empty", time="b").first().passed is False
    with pytest.raises(ValueError):
        contracts.check_frame(good, "input")


def test_bank_document_keeps_gaps(spark, tmp_path):
    rows = [("g", b, h, m, None if (i, h) == (1, 2) else float(i * h)) for i, b in enumerate(slots(3)) for h in (1, 2) for m in ("a", "b")]
    bank = spark.createDataFrame(rows, "series string, b timestamp_ntz, h int, member string, p double")
    export.write_bank_document(bank, (tmp_path / "bank").as_uri())
    back = tables.read_bank_document(spark, (tmp_path / "bank").as_uri())
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_blends_by_band_and_part_of_the_day(spark):
    sf = "/root/testdata/sf0.001"
    bands = catalogue.QUERIES["band_blend"](spark, sf).toPandas()
    assert set(bands.band) == {"near", "far"} and np.allclose(bands.groupby(["series", "band"]).w.sum(), 1.0)
    parts = catalogue.QUERIES["day_part_blend"](spark, sf)
    assert {r.part for r in parts.select("part").distinct().collect()} == {0, 1}
