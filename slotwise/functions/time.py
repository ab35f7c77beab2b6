"""Time expressions on timestamp_ntz; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP_US = 900_000_000
SLOTS_PER_DAY = 96


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def right_bucket(ts: Column, step_us: int = STEP_US) -> Column:
    """Right edge of the bucket (edge - step, edge] that holds ts."""
    return from_micros(micros(ts) + F.pmod(-micros(ts), F.lit(step_us)))


def left_bucket(ts: Column, step_us: int = STEP_US) -> Column:
    return from_micros(micros(ts) - F.pmod(micros(ts), F.lit(step_us)))


def block(ts: Column, length_us: int) -> Column:
    """Number of the block of this length since 1970 that ts lies in, left-closed."""
    return ((micros(ts) - F.pmod(micros(ts), F.lit(length_us))) / length_us).cast("long")


def shift(ts: Column, steps: Column | int, step_us: int = STEP_US) -> Column:
    steps = F.lit(steps) if isinstance(steps, int) else steps
    return from_micros(micros(ts) + steps.cast("long") * step_us)


def slot_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 4 + F.floor(F.minute(ts) / 15)).cast("int")


def day_block(ts: Column, blocks: int) -> Column:
    """Which of that many equal parts of the day a time is in."""
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / (1440 // blocks)).cast("int")


def sin_cos(ts: Column, period: str) -> dict[str, Column]:
    """Calendar pairs; Monday is 0."""
    part = {
        "hour": (F.hour(ts) + F.minute(ts) / 60.0) / 24.0,
        "dow": F.weekday(ts) / 7.0,
        "month": (F.month(ts) - 1) / 12.0,
    }[period]
    return {f"{period}_sin": F.sin(2 * F.pi() * part), f"{period}_cos": F.cos(2 * F.pi() * part)}


def clock_harmonics(ts: Column, count: int = 3) -> dict[str, Column]:
    minute = (F.hour(ts) * 60 + F.minute(ts)).cast("double")
    out = {}
    for k in range(1, count + 1):
        angle = 2 * F.pi() * k * minute / 1440
        out[f"clock_sin{k}"], out[f"clock_cos{k}"] = F.sin(angle), F.cos(angle)
    return out


def time_of_use_price(ts: Column) -> Column:
    """Fallback tariff by hour band: peak from 8 to 11 and from 18 to 21, valley from 23 to 7, flat between; a band's end is not in it."""
    h = F.hour(ts)
    peak = h.between(8, 10) | h.between(18, 20)
    valley = (h < 7) | (h >= 23)
    return F.when(peak, F.lit(1.30)).when(valley, F.lit(0.38)).otherwise(F.lit(0.85))
