"""Arithmetic helpers that return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 2) -> Column:
    """Half-up rounding on doubles; the same value in every engine, unlike ``round``."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / F.lit(float(scale))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def mastery_score(score: Column, attempts: Column, spent: Column, expected: Column) -> Column:
    """0.6 score + 0.2 / attempts + 0.2 speed; attempts and time count as 1 at least."""
    tries = F.greatest(attempts, F.lit(1)).cast("double")
    time = F.greatest(spent, F.lit(1)).cast("double")
    return round_half_up(0.6 * score + 0.2 / tries + 0.2 * F.least(F.lit(1.0), expected / time))
