"""The texts and row sets of the scheduled reports.

A text is built in parts of a fixed number of ids each, so that one part never collects
more than that many lines; the parts in order are the whole text.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerscope.functions.dates import as_date
from dealerscope.plans.views import monthly_sales_summary


def weekly_summary_recent(orders: DataFrame, dealers: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Monthly summary rows whose month starts on or after last week's Monday.

    A month start is compared with a week start, so most weeks the result is empty. The
    rows sought are those of whole months from a first one on, which is asked of the order
    date itself, so that older files are not read.
    """
    day = dt.date.fromisoformat(str(as_of)) - dt.timedelta(days=7)
    monday = day - dt.timedelta(days=day.weekday())
    first = monday if monday.day == 1 else (monday.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    return monthly_sales_summary(orders.filter(F.col("order_date") >= as_date(first)), dealers)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; amounts and counts are written as quoted exact text."""
    fields = [F.col(c).cast("string").alias(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*fields)).alias("json"))


def message_parts(df: DataFrame, key: str, line: Column, ids_per_part: int = 1000) -> DataFrame:
    """Join the lines of ``df`` (one per integer ``key``) into texts, in key order."""
    lines = df.select(F.floor(F.col(key) / ids_per_part).alias("part"), F.col(key).alias("key"), line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("part").agg(F.count(F.lit(1)).alias("line_count"), text.alias("message"))


def low_stock_message(status: DataFrame, ids_per_part: int = 1000) -> DataFrame:
    """``product: quantity`` per product below its reorder level."""
    line = F.concat_ws(": ", F.col("product_name"), F.col("quantity_available").cast("string"))
    return message_parts(status.filter("is_below_reorder"), "product_id", line, ids_per_part)


def overdue_dealers(aging: DataFrame) -> DataFrame:
    """Dealers with something outstanding for more than 60 days."""
    return aging.filter((F.col("outstanding_61_90") > 0) | (F.col("outstanding_90_plus") > 0))


def overdue_line() -> Column:
    return F.concat(
        F.col("dealer_name"),
        F.lit(": 61-90="),
        F.col("outstanding_61_90").cast("string"),
        F.lit(", 90+="),
        F.col("outstanding_90_plus").cast("string"),
    )


def overdue_reminders(aging: DataFrame) -> DataFrame:
    """One reminder line per such dealer."""
    return overdue_dealers(aging).select("dealer_id", overdue_line().alias("reminder"))


def overdue_message(aging: DataFrame, ids_per_part: int = 1000) -> DataFrame:
    """The reminder lines as texts."""
    return message_parts(overdue_dealers(aging), "dealer_id", overdue_line(), ids_per_part)
