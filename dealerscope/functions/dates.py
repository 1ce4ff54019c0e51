"""Calendar expressions. No clock is read here: every as-of date is passed in."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(value: dt.date | str) -> Column:
    return F.lit(str(value)).cast("date")


def month_start(day: Column | str) -> Column:
    return F.trunc(day, "month")


def week_start(day: Column | str) -> Column:
    """The Monday on or before ``day``."""
    return F.trunc(day, "week")


def days_to_peak(day: Column, peak_month: Column) -> Column:
    """Signed days from ``day`` to the nearest 1st of ``peak_month``; a tie takes the earlier one."""
    before, same, after = (
        F.datediff(F.make_date(F.year(day) + F.lit(shift), peak_month, F.lit(1)), day) for shift in (-1, 0, 1)
    )
    return (
        F.when((F.abs(before) <= F.abs(same)) & (F.abs(before) <= F.abs(after)), before)
        .when(F.abs(same) <= F.abs(after), same)
        .otherwise(after)
    )


# Signed days to the peak, inclusive, of the two windows around it.
SEASON_WINDOWS = {"pre_peak": (0, 45), "post_peak": (-15, -1)}


def season_window(days_until_peak: Column) -> Column:
    """Which part of the season a day falls in, given its signed days to the peak."""
    named = (F.when(days_until_peak.between(lo, hi), name) for name, (lo, hi) in SEASON_WINDOWS.items())
    return F.coalesce(*named, F.lit("baseline"))
