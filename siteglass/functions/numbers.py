"""Rounding rules shared by every score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_half_up(value: Column) -> Column:
    """Round halves towards positive infinity, as scores are rounded (50.5 -> 51, -0.5 -> 0)."""
    return F.floor(value + F.lit(0.5)).cast("int")


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part / whole * scale, 0 where the whole is 0 or missing."""
    return F.when(whole > 0, part / whole * F.lit(float(scale))).otherwise(F.lit(0.0))


def points(condition: Column, value: float) -> Column:
    """``value`` where the condition holds, else 0 (null counts as no)."""
    return F.when(condition, F.lit(float(value))).otherwise(F.lit(0.0))
