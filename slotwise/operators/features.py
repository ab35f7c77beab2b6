"""Causal features over one window per series, so that all of them share a sort."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.functions import time as t
from slotwise.operators.grid import by_time


def previous(n: int, current: bool = True):
    return by_time().rowsBetween(-(n - 1), 0) if current else by_time().rowsBetween(-n, -1)


def lags(df: DataFrame, steps: list[int], value: str = "v", fill: str | None = "zero") -> DataFrame:
    """lag_n; past the start: zero, the current value, or NULL."""
    other = {"zero": F.lit(0.0), "current": F.col(value), None: F.lit(None).cast("double")}[fill]
    return df.withColumns({f"lag_{n}": F.coalesce(F.lag(value, n).over(by_time()), other) for n in steps})


def differences(df: DataFrame, steps: list[int], value: str = "v") -> DataFrame:
    return df.withColumns({f"diff_{n}": F.coalesce(F.col(value) - F.lag(value, n).over(by_time()), F.lit(0.0)) for n in steps})


def rolling(df: DataFrame, n: int, value: str = "v", current: bool = True) -> DataFrame:
    """Mean, sample deviation (0 for one row) and range of the last n rows, with or without the current one."""
    w = previous(n, current)
    tail = "" if current else "_past"
    return df.withColumns({f"mean_{n}{tail}": F.avg(value).over(w), f"std_{n}{tail}": F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)), f"range_{n}{tail}": F.max(value).over(w) - F.min(value).over(w)})


def rolling_clip(df: DataFrame, n: int, least: int, low: float, high: float, value: str = "v", out: str = "clipped") -> DataFrame:
    """value clipped to quantiles of the n rows before it, where there are at least `least`."""
    w = previous(n, False)
    enough = F.count(value).over(w) >= least
    lo = F.when(enough, F.percentile(value, F.lit(low)).over(w))
    hi = F.when(enough, F.percentile(value, F.lit(high)).over(w))
    return df.withColumns({"_lo": lo, "_hi": hi}).withColumn(out, F.least(F.greatest(F.col(value), F.coalesce("_lo", F.col(value))), F.coalesce("_hi", F.col(value)))).drop("_lo", "_hi")


def hampel(df: DataFrame, n: int = 96, width: float = 8.0, value: str = "v", out: str = "hampel") -> DataFrame:
    """value, or the median of the n rows before it where it is further than width * 1.4826 * MAD from that."""
    w = previous(n, False)
    df = df.withColumn("_past", F.sort_array(F.collect_list(value).over(w)))

    def middle(a: Column) -> Column:
        k = F.size(a)
        half = F.floor(k / 2).cast("int")
        return F.when(k > 0, F.when(k % 2 == 1, F.get(a, half)).otherwise((F.get(a, half - 1) + F.get(a, half)) / 2))

    df = df.withColumn("_median", middle(F.col("_past")))
    df = df.withColumn("_mad", middle(F.sort_array(F.transform("_past", lambda x: F.abs(x - F.col("_median"))))))
    far = F.abs(F.col(value) - F.col("_median")) > width * 1.4826 * F.col("_mad")
    return df.withColumn(out, F.when(far & (F.col("_mad") > 0), F.col("_median")).otherwise(F.col(value))).drop("_past", "_median", "_mad")


def ema(df: DataFrame, spans: list[int], value: str = "v") -> DataFrame:
    """Columns ema_<span>: exponential averages y = (1 - a) y + a x from the series' first row, a = 2 / (span + 1), all in one pass a series."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"ema_{s}", T.DoubleType()) for s in spans]])

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        return pdf.assign(**{f"ema_{s}": pdf[value].ewm(span=s, adjust=False, ignore_na=True).mean() for s in spans})[schema.names]

    return df.groupBy("series").applyInPandas(average, schema)


class GapAverage:
    """Exponential average of values with gaps (NaN): the old weight decays across gaps; NaN before the first value."""

    def __init__(self, span: float, mean: float = math.nan, weight: float = 1.0, n: int = 0):
        self.a, self.mean, self.weight, self.n = 2.0 / (span + 1), mean, weight, n

    def add(self, x: float) -> float:
        if math.isnan(x):
            if self.n:
                self.weight *= 1 - self.a
        elif not self.n:
            self.mean, self.n = x, 1
        else:
            old = self.weight * (1 - self.a)
            self.mean, self.weight, self.n = (old * self.mean + self.a * x) / (old + self.a), 1.0, self.n + 1
        return self.mean


def calendar(df: DataFrame, at: str = "b", prefix: str = "") -> DataFrame:
    columns: dict[str, Column] = {}
    for period in ("hour", "dow", "month"):
        columns |= t.sin_cos(F.col(at), period)
    columns |= t.clock_harmonics(F.col(at)) | {"weekend": (F.weekday(F.col(at)) >= 5).cast("double"), "slot": t.slot_of_day(F.col(at))}
    return df.withColumns({f"{prefix}{k}": c for k, c in columns.items()})


def horizons(df: DataFrame, steps: list[int]) -> DataFrame:
    """Each row once for each horizon, with its target time and horizon features."""
    h = F.col("h")
    out = df.withColumn("h", F.explode(F.array(*[F.lit(s) for s in steps])))
    return out.withColumns({"target_ts": t.shift(F.col("b"), h), "h_fraction": h / 96.0, "h_sin": F.sin(2 * F.pi() * h / 96), "h_cos": F.cos(2 * F.pi() * h / 96)})


def rotate_clock(df: DataFrame, sin: str, cos: str, steps: Column) -> DataFrame:
    """The clock pair of the target time by addition of angles."""
    angle = 2 * F.pi() * steps / t.SLOTS_PER_DAY
    return df.withColumns({f"{sin}_target": F.col(sin) * F.cos(angle) + F.col(cos) * F.sin(angle), f"{cos}_target": F.col(cos) * F.cos(angle) - F.col(sin) * F.sin(angle)})


def relative(df: DataFrame, level: str, columns: list[str]) -> DataFrame:
    base = F.greatest(F.col(level), F.lit(1.0))
    return df.withColumns({f"{c}_rel": F.col(c) / base - 1 for c in columns})


def bounded(df: DataFrame, scale: DataFrame, value: str = "v", change: str = "diff_4", deviation: str = "std_8") -> DataFrame:
    """Change as .5 + .5 tanh(x / 3 scale), deviation as log1p; scale(series, scale) is a small dimension."""
    joined = df.join(F.broadcast(scale), "series", "left") if scale is not None else df
    return joined.withColumns({"change_bounded": 0.5 + 0.5 * F.tanh(F.col(change) / (3 * F.col("scale"))), "deviation_log": F.log1p(F.col(deviation))})


def balance(wide: DataFrame, production: list[str], users: list[str], holder: str, capacity: float) -> DataFrame:
    """Totals by role, surplus, and a holder's ratio, margins and change."""
    total = lambda names: sum((F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in names), F.lit(0.0))
    level = F.col(f"`{holder}`")
    out = wide.withColumns({"production": total(production), "demand": total(users)})
    out = out.withColumn("surplus", F.col("production") - F.col("demand"))
    share = F.col("demand") / F.nullif(F.col("production"), F.lit(0.0))
    return out.withColumns({"demand_share": share, "holder_ratio": level / capacity, "margin_up": capacity - level, "margin_down": level, "holder_missing": level.isNull().cast("double")})


def gas_balance(wide: DataFrame, groups: dict[str, dict[str, list[str]]], mixed_users: list[str], capacity: float, heating: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Per gas its supply, the demand of users that come first with their part of the mixed gas, what is left, its share of the mixed gas
    and its stock; totals, energies by lower heating value, and the stock's ratio, margins and changes.

    groups names each gas's columns by role (production, user, mixed_in, holder); a missing value counts as zero in a sum. A gas's share is
    carried on over slots without mixed flow, and is an equal part before any. by: columns that part the rows of one slot (plants, say).
    """
    c = lambda name: F.col(f"`{name}`")
    total = lambda names: sum((F.coalesce(c(n), F.lit(0.0)) for n in names), F.lit(0.0))
    order = Window.partitionBy(*by).orderBy("b")  # one row a slot
    mixed = {g: total(roles.get("mixed_in", [])) for g, roles in groups.items()}
    flow = sum(mixed.values(), F.lit(0.0))
    carried = {g: F.last(m / F.nullif(flow, F.lit(0.0)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for g, m in mixed.items()}
    out = wide.withColumns({f"{g}_mixed_share": F.least(F.greatest(F.coalesce(s, F.lit(1.0 / len(groups))), F.lit(0.0)), F.lit(1.0)) for g, s in carried.items()})
    demand = {g: total(roles.get("user", [])) + total(mixed_users) * c(f"{g}_mixed_share") for g, roles in groups.items()}
    out = out.withColumns({f"{g}_{k}": v for g, roles in groups.items() for k, v in (("supply", total(roles.get("production", []))), ("priority_demand", demand[g]), ("stock", total(roles.get("holder", []))))})
    every = lambda kind, by_heat=False: sum((c(f"{g}_{kind}") * (heating[g] if by_heat else 1.0) for g in groups), F.lit(0.0))
    out = out.withColumns({f"{g}_available": c(f"{g}_supply") - c(f"{g}_priority_demand") for g in groups})
    out = out.withColumns({"supply_total": every("supply"), "priority_demand_total": every("priority_demand"), "energy_supply": every("supply", True), "energy_demand": every("priority_demand", True), "stock_total": every("stock")})
    s = F.col("stock_total")
    change = lambda n: F.coalesce(s - F.lag(s, n).over(order), F.lit(0.0))
    return out.withColumns(
        {
            "available_total": F.col("supply_total") - F.col("priority_demand_total"),
            "energy_available": F.col("energy_supply") - F.col("energy_demand"),
            "stock_ratio": F.least(F.greatest(s / capacity, F.lit(0.0)), F.lit(2.0)),
            "stock_margin_low": s - 0.15 * capacity,
            "stock_margin_high": 0.90 * capacity - s,
            "stock_change_1": change(1),
            "stock_change_4": change(4),
        }
    )


def power_ratios(wide: DataFrame, gases: list[str], total: str, part: str) -> DataFrame:
    """Gas burned by unit of power, and a group's share of the power; powers below 1 count as 1, a missing one gives NULL."""
    power = F.when(F.col(f"`{total}`").isNotNull(), F.greatest(F.col(f"`{total}`"), F.lit(1.0)))
    return wide.withColumns({f"{g}_per_power": F.col(f"`{g}`") / power for g in gases} | {"group_power_ratio": F.col(f"`{part}`") / power})


def unit_clock(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sines and cosines moved to [0, 1]."""
    return df.withColumns({c: (F.col(c) + 1) * 0.5 for c in columns})


def energy(wide: DataFrame, heating: dict[str, float], out: str = "energy") -> DataFrame:
    """Sum of volumes by lower heating value."""
    return wide.withColumn(out, sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) * x for c, x in heating.items()), F.lit(0.0)))


def labels(df: DataFrame, steps: list[int], value: str = "raw") -> DataFrame:
    """Rows of df for each horizon with label y: the value exactly that many steps ahead, NULL where none was observed."""
    ahead = horizons(df, steps)
    truth = df.select(F.col("series").alias("_s"), F.col("b").alias("_b"), F.col(value).alias("y"))
    return ahead.join(truth, (F.col("series") == F.col("_s")) & (F.col("target_ts") == F.col("_b")), "left").drop("_s", "_b")


def recency_weights(df: DataFrame, cutoff: Column, half_life_days: float, partition: list[str]) -> DataFrame:
    """2 ** (-age / half life), scaled to mean 1."""
    age = (t.micros(cutoff) - t.micros(F.col("b"))) / 86_400e6
    raw = F.pow(F.lit(2.0), -age / half_life_days)
    return df.withColumn("_w", raw).withColumn("weight", F.col("_w") / F.avg("_w").over(Window.partitionBy(*partition))).drop("_w")


def shares_of_total(wide: DataFrame, part: str, total: str, default: float) -> DataFrame:
    """What others make of the total, and the part's share of it: carried on where it can't be told, `default` before that, within [0, 1]."""
    ratio = F.col(f"`{part}`") / F.nullif(F.col(f"`{total}`"), F.lit(0.0))
    share = F.coalesce(F.last(ratio, ignorenulls=True).over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)), F.lit(default))  # one row a slot
    return wide.withColumns({f"{total}_other": F.greatest(F.col(f"`{total}`") - F.col(f"`{part}`"), F.lit(0.0)), f"{part}_share": F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))})


def suffixed(df: DataFrame, columns: list[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in columns})
