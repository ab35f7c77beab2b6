"""Streaming forms: right-closed slots, and calibration of forecasts by errors as they mature."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions import time as t
from slotwise.operators.features import GapAverage


def slot_sums(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    """series, b, n, raw per right-closed slot of a stream of series, ts (timestamp), value; late rows beyond the watermark are left out."""
    edge = F.timestamp_micros(F.unix_micros("ts") + F.pmod(-F.unix_micros("ts"), F.lit(t.STEP_US)))
    marked = events.withColumn("_edge", edge).withWatermark("_edge", late)
    # the window that begins at the right edge stands for the slot that ends there
    sums = marked.groupBy("series", F.window("_edge", "15 minutes").alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("raw"))
    return sums.select("series", F.col("_w.start").cast("timestamp_ntz").alias("b"), "n", "raw")


def calibrate_rows(rows: pd.DataFrame, state: dict, h: int, span: int, gain: float, warm_up: int) -> tuple[pd.DataFrame, dict]:
    """Rows (b in microseconds, raw, p) of one key in order: corrected forecasts and the state after them.

    state: mean and weight of the error average, how many errors it holds, forecasts that wait for their target, and
    the last row's time. A row no later than that came too late: its forecast passes as it is and changes nothing.
    """
    last = state.get("last")
    average, waiting = GapAverage(span, state["mean"], state["weight"], state["n"]), dict(state["waiting"])
    out = []
    for at, raw, p in rows.sort_values("b")[["b", "raw", "p"]].itertuples(index=False):
        if last is not None and at <= last:
            out.append((at, p))
            continue
        last, made = at, waiting.pop(at, None)
        average.add(math.nan if made is None or raw is None else raw - made)
        out.append((at, p + gain * average.mean if average.n >= warm_up else p))
        waiting[at + h * t.STEP_US] = p
        waiting = {k: v for k, v in waiting.items() if k > at}
    return pd.DataFrame(out, columns=["b", "p"]), {"mean": average.mean, "weight": average.weight, "n": average.n, "waiting": waiting, "last": last}


def calibrated_stream(forecasts: DataFrame, span: int = 16, gain: float = 0.5, warm_up: int = 8) -> DataFrame:
    """Stream of series, h, b (timestamp), raw (value observed at b), p (forecast made at b) with p corrected by matured errors."""
    out = "series string, h int, b timestamp, p double"
    keep = "mean double, weight double, n long, at array<long>, made array<double>, last long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        at = pd.to_datetime(rows["b"], utc=True)
        rows = rows.assign(b=at.astype("datetime64[us, UTC]").astype("int64"))
        mean, weight, n, ats, made, last = state.get if state.exists else (0.0, 1.0, 0, [], [], None)
        done, new = calibrate_rows(rows, {"mean": mean, "weight": weight, "n": n, "waiting": dict(zip(ats, made, strict=True)), "last": last}, int(key[1]), span, gain, warm_up)
        state.update((float(new["mean"]), float(new["weight"]), int(new["n"]), list(map(int, new["waiting"])), list(map(float, new["waiting"].values())), int(new["last"])))
        yield pd.DataFrame({"series": key[0], "h": int(key[1]), "b": pd.to_datetime(done["b"], unit="us"), "p": done["p"]})

    return forecasts.groupBy("series", "h").applyInPandasWithState(step, out, keep, "append", "NoTimeout")


def feature_rows(rows: pd.DataFrame, state: tuple | None, span: int, lag: int) -> tuple[pd.DataFrame, tuple]:
    """Rows (b in microseconds, raw) of one series in order, with the value carried forward (0 before the first), its exponential
    average and its lag; and the state after them: last time, value, average and the last `lag` values. Late rows are left out."""
    last, v, mean, past = state if state is not None else (None, 0.0, None, ())
    past = list(past)
    out = []
    for at, raw in rows.sort_values("b")[["b", "raw"]].itertuples(index=False):
        if last is not None and at <= last:
            continue
        last = at
        v = v if raw is None or math.isnan(raw) else raw
        mean = v if mean is None else mean + 2.0 / (span + 1) * (v - mean)
        out.append((at, v, mean, past[0] if len(past) == lag else math.nan))
        past = [*past, v][-lag:]
    return pd.DataFrame(out, columns=["b", "v", "ema", "lag"]), (last, v, mean, tuple(past))


def feature_stream(slots: DataFrame, span: int = 16, lag: int = 4) -> DataFrame:
    """Stream of series, b (timestamp), raw with v, ema and lag, whose state is carried from batch to batch."""
    out = "series string, b timestamp, v double, ema double, lag double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        rows = rows.assign(b=pd.to_datetime(rows["b"], utc=True).astype("datetime64[us, UTC]").astype("int64"))
        done, new = feature_rows(rows, state.get if state.exists else None, span, lag)
        if new[0] is not None:
            state.update((int(new[0]), float(new[1]), None if new[2] is None else float(new[2]), list(map(float, new[3]))))
        yield pd.DataFrame({"series": key[0], "b": pd.to_datetime(done["b"], unit="us"), "v": done["v"], "ema": done["ema"], "lag": done["lag"]})

    return slots.groupBy("series").applyInPandasWithState(step, out, "last long, v double, mean double, past array<double>", "append", "NoTimeout")


def require_observed(batch: DataFrame, step_us: int = t.STEP_US) -> DataFrame:
    """For foreachBatch: fails where a series lacks a slot between its first and last of the batch."""
    span = batch.groupBy("series").agg(F.count_distinct("b").alias("n"), ((F.unix_micros(F.max("b").cast("timestamp")) - F.unix_micros(F.min("b").cast("timestamp"))) / step_us + 1).alias("need"))
    bad = span.where("n <> need").limit(1).collect()
    if bad:
        raise ValueError(f"series {bad[0]['series']} lacks observations")
    return batch
