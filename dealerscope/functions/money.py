"""Amounts stay decimal through every sum; only averages and ratios become doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOTAL = "decimal(38,2)"


def total(amount: Column | str) -> Column:
    return F.sum(amount).cast(TOTAL)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient, null when the denominator is zero."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` rounded half-up to two places, null when ``whole`` is zero.

    The numerator is narrowed so that the quotient keeps fifteen decimals before the
    rounding; a 38-digit numerator would leave six and round twice.
    """
    hundredfold = (part * F.lit(100)).cast("decimal(22,2)")
    return F.round(hundredfold / F.nullif(whole, F.lit(0).cast("decimal(12,2)")), 2).cast("decimal(24,2)")
