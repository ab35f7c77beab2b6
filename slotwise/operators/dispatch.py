"""Planning power from surplus gas: forecast of the surplus, unit commitment, checks and revenue."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import time as t


@dataclass(frozen=True)
class Plant:
    """Units of either size, fed by a gas with a holder and, where there are any, by gases that can't be stored."""

    small_units: int = 4
    small_range: tuple[float, float] = (30.0, 50.0)  # MW of one unit
    large_units: int = 2
    large_range: tuple[float, float] = (72.0, 120.0)
    gas_per_mwh: float = 1000.0  # of the stored gas
    capacity: float = 200_000.0
    low: float = 0.15
    high: float = 0.90
    start_cost: float = 500.0
    ramp_cost: float = 2.0
    flare_cost: float = 0.05
    hours: float = 0.25
    ramp_share: float = 1.5  # most change of a kind's power between steps, as a share of all its units' power
    others: tuple[tuple[str, float], ...] = ()  # names of gases that can't be stored, and their volume a MWh


def surplus_forecast(grid: DataFrame, origin: Column, holder: dict[str, str] | None = None, last: int = 16, history_days: int = 14) -> DataFrame:
    """Per series the supply to expect, the median of the last values, and the most that may be burned: the 99th percentile of the last days' use
    or that supply, if it is more.

    holder names for a series the one that tells its stock, whose change by hour counts as supply. A missing value is the one before it. A
    deficit, or a series without a value, is an error.
    """
    past = grid.where(F.col("b") <= origin)
    order = Window.partitionBy("series").orderBy("b")
    held = past.withColumn("_x", F.last("raw", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    available = F.col("_x")
    if holder:
        stock = held.where(F.col("series").isin(list(holder.values()))).withColumn("_d", (F.col("_x") - F.lag("_x").over(order)) / 0.25)
        names = F.create_map(*[F.lit(v) for pair in holder.items() for v in (pair[1], pair[0])])
        held = held.join(stock.select(names[F.col("series")].alias("series"), "b", "_d"), ["series", "b"], "left")
        available = F.when(F.col("series").isin(list(holder)), F.col("_x") + F.col("_d")).otherwise(F.col("_x"))
        held = held.where(~F.col("series").isin(list(holder.values())))
    ranked = held.withColumn("_a", available).withColumn("_r", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("b"))))
    found = ranked.where(F.col("_r") <= history_days * t.SLOTS_PER_DAY).groupBy("series").agg(F.median(F.when(F.col("_r") <= last, F.col("_a"))).alias("surplus"), F.percentile("_x", F.lit(0.99)).alias("_q"))
    ok = F.coalesce(F.col("surplus") >= 0, F.lit(False))
    found = found.withColumn("surplus", F.when(ok, F.col("surplus")).otherwise(F.raise_error(F.concat(F.col("series"), F.lit(": no supply that could be relied on"))).cast("double")))
    return found.select("series", "surplus", F.greatest("surplus", "_q").alias("cap"))


def price_table(prices: DataFrame) -> DataFrame:
    """month, slot, price from rows of 24, 48 or 96 steps a month: steps are held, never interpolated."""
    size = prices.groupBy("month").agg(F.count(F.lit(1)).alias("_n"))
    x = prices.join(F.broadcast(size), "month").where(F.when(F.col("_n").isin(24, 48, 96), F.lit(True)).otherwise(F.raise_error(F.lit("a month needs 24, 48 or 96 prices")).cast("boolean")))
    width = (F.lit(96) / F.col("_n")).cast("int")
    return x.select("month", F.explode(F.sequence(F.col("step") * width, F.col("step") * width + width - 1)).alias("slot"), "price")


def with_price(df: DataFrame, tariff: DataFrame, at: str = "b") -> DataFrame:
    """df with the price of its month and slot; a month without prices fails."""
    x = df.withColumns({"month": F.month(at), "slot": t.slot_of_day(F.col(at))}).join(F.broadcast(tariff), ["month", "slot"], "left")
    return x.withColumn("price", F.when(F.col("price").isNull(), F.raise_error(F.lit("no price for a month")).cast("double")).otherwise(F.col("price")))


def check_stock(df: DataFrame, stock: str, plant: Plant) -> DataFrame:
    ok = F.col(stock).between(plant.low * plant.capacity, plant.high * plant.capacity)
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("initial stock is outside the safe band")).cast("boolean")))


def power_levels(units: int, one: tuple[float, float], steps: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Powers of one kind of unit, a few in the range of each number of running ones, and the fewest units that give each."""
    found = {0.0: 0}
    for n in range(units, 0, -1):
        found |= {float(x): n for x in np.round(np.linspace(n * one[0], n * one[1], steps if one[1] > one[0] else 1), 6)}
    powers = np.array(sorted(found))
    return powers, np.array([found[x] for x in powers])


def burn_unstored(power: np.ndarray, others: np.ndarray, plant: Plant) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Volumes of each gas that can't be stored (supply and most use by step: others, 2 x gases) burned for each power, what of them is
    flared, and the power left for the stored gas. Gases of more volume a MWh go first, so that least is flared."""
    left, used = power.astype(float).copy(), np.zeros((others.shape[1], len(power)))
    for g in sorted(range(others.shape[1]), key=lambda g: -plant.others[g][1]):
        per = plant.others[g][1] * plant.hours
        used[g] = np.minimum(left * per, others[:, g].min())
        left = np.maximum(left - used[g] / per, 0.0)
    return used, np.maximum(others[0][:, None] - used, 0.0).sum(axis=0), np.where(left < 1e-9, 0.0, left)


def relaxed_burn(inflow: np.ndarray, price: np.ndarray, stock: float, plant: Plant, cap: np.ndarray) -> np.ndarray:
    """Stored gas burned by step, at most cap, that earns most where any power can be run and flaring is free; the holder's band and the end stock hold.

    What can be burned is what flows through the holder, so taking as much as possible at the best price, then at the next, is the optimum.
    """
    n, low, high = len(inflow), plant.low * plant.capacity, plant.high * plant.capacity
    burned = np.zeros(n)
    for i in np.argsort(-price, kind="stable"):
        level, held, lost = stock, np.zeros(n), np.zeros(n)
        for k in range(n):
            level += inflow[k] - burned[k]
            lost[k] = max(level - high, 0.0)
            level -= lost[k]
            held[k] = level
        room = held[n - 1] - max(stock, low)
        for k in range(n - 2, i - 1, -1):
            room = min(held[k] - low, lost[k + 1] + room)
        burned[i] = min(max(room + lost[i], 0.0), cap[i])
    return burned


def least_flare(inflow: np.ndarray, stock: float, plant: Plant, cap: np.ndarray, others: np.ndarray, most_power: float) -> float:
    """Volume that every plan flares: each gas is burned up to its own limits as if it had all power, so the stock is never higher than need be."""
    low, high, flared, level = plant.low * plant.capacity, plant.high * plant.capacity, 0.0, stock
    for x, most in zip(inflow, np.minimum(cap, most_power * plant.gas_per_mwh * plant.hours)):
        level += x - min(max(level + x - low, 0.0), most)
        flared += max(level - high, 0.0)
        level = min(level, high)
    for g, (_, per) in enumerate(plant.others):
        flared += np.maximum(others[0][:, g] - np.minimum(others[1][:, g], most_power * per * plant.hours), 0.0).sum()
    return float(flared)


def solve(inflow: np.ndarray, price: np.ndarray, stock: float, plant: Plant, cells: int = 241, cap: np.ndarray | None = None, others: np.ndarray | None = None) -> dict[str, np.ndarray | float]:
    """A feasible plan of greatest value on a grid of stocks, and an upper bound on any plan's value.

    Dynamic program over (stock cell, powers of both kinds of unit). Stock rounds down to a cell, so a plan found is feasible for the exact
    stock. cap: most of the stored gas that may be burned by step; others: supply and cap of each gas that can't be stored (2 x steps x
    gases), burned before the stored one. Where these limits allow less than all power, each number of running units can also give just
    that. The bound relaxes commitment, ramps and starts, and takes off only what no plan can avoid to flare (see relaxed_burn,
    least_flare). The value is what the plan itself earns, not its cells.
    """
    (small, n_small), (large, n_large) = power_levels(plant.small_units, plant.small_range), power_levels(plant.large_units, plant.large_range)
    pair = np.array([(i, j) for i in range(len(small)) for j in range(len(large))])
    n, on_a, on_b = len(inflow), n_small[pair[:, 0]], n_large[pair[:, 1]]
    a, b = np.tile(small[pair[:, 0]], (n, 1)), np.tile(large[pair[:, 1]], (n, 1))  # powers by step
    most_power = small.max() + large.max()
    cap = np.full(n, np.inf) if cap is None else cap
    others = np.zeros((2, n, len(plant.others))) if others is None else others
    free = np.array([sum(others[:, i, g].min() / (per * plant.hours) for g, (_, per) in enumerate(plant.others)) for i in range(n)])
    allowed = free + cap / (plant.gas_per_mwh * plant.hours)
    if (allowed < most_power).any():
        run_a, run_b = (x.ravel() for x in np.meshgrid(np.arange(plant.small_units + 1), np.arange(plant.large_units + 1)))
        (least_a, top_a), (least_b, top_b) = ((run * one[0], run * one[1]) for run, one in ((run_a, plant.small_range), (run_b, plant.large_range)))
        total = np.clip(allowed[:, None], least_a + least_b, top_a + top_b)
        part = np.clip(total - least_a, least_b, top_b)
        a, b = np.hstack([a, total - part]), np.hstack([b, part])
        on_a, on_b = np.append(on_a, run_a), np.append(on_b, run_b)
    levels = a + b
    m = levels.shape[1]
    grid = np.linspace(plant.low * plant.capacity, plant.high * plant.capacity, cells)
    width = grid[1] - grid[0]
    rise = lambda x: np.maximum(x[None, :] - x[:, None], 0)
    start = plant.start_cost * (rise(on_a) + rise(on_b))
    most_a, most_b = (plant.ramp_share * k * r[1] + 1e-9 for k, r in ((plant.small_units, plant.small_range), (plant.large_units, plant.large_range)))

    def change(i: int) -> np.ndarray:
        """Cost of going from each power of the step before to each of step i."""
        move_a, move_b = np.abs(a[i - 1][:, None] - a[i][None, :]), np.abs(b[i - 1][:, None] - b[i][None, :])
        return np.where((move_a <= most_a) & (move_b <= most_b), plant.ramp_cost * (move_a + move_b) + start, np.inf)

    steps = [burn_unstored(levels[i], others[:, i], plant) for i in range(n)]
    burn = np.array([left * plant.gas_per_mwh * plant.hours for _, _, left in steps])
    value = np.full((n + 1, cells, m), -np.inf)  # best value from step i on, last powers before it
    choice = np.zeros((n, cells, m), np.int16)
    start_cell = int(np.floor((stock - grid[0]) / width + 1e-9))
    value[n, start_cell:, :] = 0.0  # end stock at least the initial one
    cell_of = lambda s: np.floor((np.minimum(s, grid[-1]) - grid[0]) / width + 1e-9).astype(int)
    for i in range(n - 1, -1, -1):
        after = grid[:, None] + inflow[i] - burn[i][None, :]
        flared = np.maximum(after - grid[-1], 0) + steps[i][1][None, :]
        to = cell_of(after)
        ok = (to >= 0) & (burn[i] <= cap[i] + 1e-6)[None, :]
        gain = price[i] * levels[i][None, :] * plant.hours * 1000 - plant.flare_cost * flared
        future = np.where(ok, gain + value[i + 1, np.maximum(to, 0), np.arange(m)[None, :]], -np.inf)  # cells x powers
        if i:
            moving = change(i)
            for last in range(m):  # one column of the table at a time: memory stays cells x powers
                total = future - moving[last][None, :]
                choice[i, :, last] = total.argmax(axis=1)
                value[i, :, last] = total.max(axis=1)
        else:  # the first step has no ramp or start cost
            choice[i] = future.argmax(axis=1)[:, None]
            value[i] = future.max(axis=1)[:, None]
    if not np.isfinite(value[0, start_cell, 0]):
        raise ValueError("no feasible plan")
    at, stocks, flare = np.zeros(n, int), np.zeros(n), np.zeros(n)
    cell, level, exact = start_cell, 0, stock
    for i in range(n):
        level = int(choice[i, cell, level])
        exact = exact + inflow[i] - burn[i][level]
        flare[i] = max(0.0, exact - grid[-1])
        exact -= flare[i]
        at[i], stocks[i] = level, exact
        cell = int(cell_of(np.array([grid[cell] + inflow[i] - burn[i][level]]))[0])
    k = np.arange(n)
    used = np.array([steps[i][0][:, at[i]] for i in range(n)]).reshape(n, -1)
    lost = flare + np.array([steps[i][1][at[i]] for i in range(n)])
    moved = sum(change(i)[at[i - 1], at[i]] for i in range(1, n))
    earned = float((price * levels[k, at] * plant.hours * 1000 - plant.flare_cost * lost).sum() - moved)
    stored = relaxed_burn(inflow, price, stock, plant, np.minimum(np.maximum(most_power - free, 0.0) * plant.gas_per_mwh * plant.hours, cap))
    unavoidable = plant.flare_cost * least_flare(inflow, stock, plant, cap, others, most_power)
    bound = float((price * (np.minimum(free, most_power) * plant.hours + stored / plant.gas_per_mwh) * 1000).sum()) - unavoidable
    return {"power": levels[k, at], "power_small": a[k, at], "power_large": b[k, at], "stock": stocks, "flare": flare, "burned": burn[k, at], "others": used, "value": earned, "bound": bound}


def plan(steps: DataFrame, plant: Plant, stock_share: float = 0.5) -> DataFrame:
    """steps(plan, step, b, inflow, price) to rows with powers, stock, flare, value and bound; one plan is one day and one task's work.

    Volumes are those of a step. Columns read where they are there: cap, the most of the stored gas; and for each other gas of the plant
    <gas>_inflow and <gas>_cap, which give a column <gas>_burned.
    """
    names = [g for g, _ in plant.others]
    given = ["cap", *[f"{g}_{k}" for g in names for k in ("inflow", "cap")]]
    given = [c for c in given if c in steps.columns]
    out = ["power", "power_small", "power_large", "burned", "stock", "flare"]
    kept = ["plan", "step", "b", "inflow", "price", *given]
    schema = "plan string, step int, b timestamp_ntz, " + ", ".join(f"`{c}` double" for c in [*kept[3:], *out, *[f"{g}_burned" for g in names], "value", "bound"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        column = lambda c, default: pdf[c].to_numpy(float) if c in pdf else np.full(len(pdf), default)
        others = np.array([[column(f"{g}_inflow", 0.0) for g in names], [column(f"{g}_cap", np.inf) for g in names]]).reshape(2, len(names), len(pdf)).transpose(0, 2, 1)
        found = solve(column("inflow", 0.0), column("price", 0.0), stock_share * plant.capacity, plant, cap=column("cap", np.inf), others=others)
        made = {c: found[c] for c in out} | {f"{g}_burned": found["others"][:, i] for i, g in enumerate(names)}
        return pdf.assign(**made, value=found["value"], bound=found["bound"])[[*kept, *made, "value", "bound"]]

    return steps.select(*kept).groupBy("plan").applyInPandas(run, schema)


def mass_balance(planned: DataFrame, plant: Plant, stock_share: float = 0.5) -> DataFrame:
    """Largest violations of a plan, told from its columns alone: balance of the holder and of power, its band, the end stock, gas burned
    beyond what there is, and steps whose powers or changes of power no units can give."""
    w = Window.partitionBy("plan").orderBy("step")
    before = F.coalesce(F.lag("stock").over(w), F.lit(stock_share * plant.capacity))
    off = F.abs(before + F.col("inflow") - F.col("burned") - F.col("flare") - F.col("stock"))
    made = sum((F.col(f"{g}_burned") / (per * plant.hours) for g, per in plant.others), F.col("burned") / (plant.gas_per_mwh * plant.hours))
    over = [F.col("burned") - F.col("cap")] if "cap" in planned.columns else []
    over += [F.col(f"{g}_burned") - F.least(*[f"{g}_{k}" for k in ("inflow", "cap") if f"{g}_{k}" in planned.columns], F.lit(float("inf"))) for g, _ in plant.others]
    allowed, moved = F.lit(True), F.lit(True)
    for c, units, one in (("power_small", plant.small_units, plant.small_range), ("power_large", plant.large_units, plant.large_range)):
        allowed = allowed & F.greatest(*[F.col(c).between(k * one[0] - 1e-6, k * one[1] + 1e-6) for k in range(units + 1)], F.lit(False))
        moved = moved & (F.coalesce(F.abs(F.col(c) - F.lag(c).over(w)), F.lit(0.0)) <= plant.ramp_share * units * one[1] + 1e-6)
    band = F.greatest(plant.low * plant.capacity - F.col("stock"), F.col("stock") - plant.high * plant.capacity, F.lit(0.0), *over)
    off = F.greatest(off, F.abs(made - F.col("power")), F.abs(F.col("power_small") + F.col("power_large") - F.col("power")))
    x = planned.withColumns({"_off": off, "_band": band, "_bad": (~(allowed & moved)).cast("int")})
    return x.groupBy("plan").agg(F.max("_off").alias("balance_error"), F.max("_band").alias("band_error"), F.greatest(F.lit(stock_share * plant.capacity) - F.max_by("stock", "step"), F.lit(0.0)).alias("end_error"), F.sum("_bad").alias("n_infeasible"))


def revenue(planned: DataFrame, plant: Plant, price: str = "price") -> DataFrame:
    return planned.groupBy("plan").agg(F.sum(F.col("power") * plant.hours * 1000 * F.col(price)).alias("revenue"))
