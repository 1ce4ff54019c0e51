"""Row filters that panels share."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerscope.functions.dates import as_date


def in_regions(dealers: DataFrame, regions: Iterable[str] | None) -> DataFrame:
    """Dealers of the given regions; None keeps all of them, an empty list none."""
    return dealers if regions is None else dealers.filter(F.col("region").isin(list(regions)))


def in_date_range(rows: DataFrame, lo: dt.date | str | None, hi: dt.date | str | None) -> DataFrame:
    """Orders dated from ``lo`` to ``hi``, both inclusive; None leaves an end open."""
    if lo is not None:
        rows = rows.filter(F.col("order_date") >= as_date(lo))
    if hi is not None:
        rows = rows.filter(F.col("order_date") <= as_date(hi))
    return rows


def region_date_filter(
    dealers: DataFrame,
    regions: Iterable[str] | None = None,
    lo: dt.date | str | None = None,
    hi: dt.date | str | None = None,
) -> Callable[[DataFrame], DataFrame]:
    """The global panel filter, for ``rows.transform(...)``; dealers are tested for existence."""
    keys = in_regions(dealers, regions).select("dealer_id")
    return lambda rows: in_date_range(rows, lo, hi).join(keys, "dealer_id", "left_semi")


def search(df: DataFrame, column: str, term: str) -> DataFrame:
    """Rows whose ``column`` contains the pattern, in any case; a null never matches.

    ``term`` is a regular expression; the empty term keeps every non-null row.
    """
    return df.filter(F.coalesce(F.col(column).rlike("(?i)" + term), F.lit(False)))
