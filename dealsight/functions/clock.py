"""Explicit as-of time, whole-day arithmetic and signal decay."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# fixed values: decay rule
RECENT_DAYS = 7
RECENT_BOOST = 1.5
DECAY_FLOOR = 0.1
DEFAULT_HALF_LIFE = 30.0


def at(ts: str | Column) -> Column:
    """A zone-free timestamp literal."""
    return ts if isinstance(ts, Column) else F.lit(ts).cast("timestamp_ntz")


def micros_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def whole_days(earlier: Column, later: Column) -> Column:
    """Elapsed whole days, floored (a negative span floors away from zero)."""
    return F.floor(micros_between(earlier, later) / F.lit(86_400_000_000)).cast("bigint")


def decay_weight(days: Column, half_life: Column | float = DEFAULT_HALF_LIFE) -> Column:
    hl = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    faded = F.exp(F.lit(-math.log(2)) / hl * days)
    return F.when(days < RECENT_DAYS, F.lit(RECENT_BOOST)).otherwise(F.greatest(faded, F.lit(DECAY_FLOOR)))


def sql_decay(days: str, half_life: str | float = DEFAULT_HALF_LIFE) -> str:
    return f"CASE WHEN {days} < 7 THEN 1.5e0 ELSE greatest(exp(-ln(2e0)/{half_life}*({days})), 0.1e0) END"
