"""Freshness and effective confidence of facts; the time of the question is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours after which a fact of a horizon class is stale, before salience.
HORIZON_HOURS = {"short": 24, "medium": 35 * 24, "long": 365 * 24}
STALE_FACTOR = 0.5


def salience(accesses: Column) -> Column:
    """1 to 4: how much longer an often used fact stays fresh."""
    return F.least(F.greatest(1 + 0.25 * F.log(1 + accesses), F.lit(1.0)), F.lit(4.0))


def freshness(horizon: Column, anchor: Column, now: Column, accesses: Column) -> Column:
    """'fresh', 'stale' or 'unknown': no horizon is fresh, no anchor or one in the future unknown."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(anchor.cast("timestamp"))) / 3.6e9
    hours = F.lit(None).cast("double")
    for name, limit in HORIZON_HOURS.items():
        hours = F.when(horizon == name, F.lit(float(limit))).otherwise(hours)
    state = F.when(horizon.isNull() | (horizon == "none"), "fresh").when(anchor.isNull() | (age < 0), "unknown")
    return state.when(age > hours * salience(accesses), "stale").otherwise("fresh")


def effective(confidence: Column, state: Column) -> Column:
    return F.when(state == "stale", confidence * STALE_FACTOR).otherwise(confidence)
