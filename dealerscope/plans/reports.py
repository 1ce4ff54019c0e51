"""The result sets behind the panels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerscope.functions.dates import as_date, month_start
from dealerscope.functions.money import TOTAL, ratio, total
from dealerscope.operators.filters import in_date_range, in_regions, region_date_filter, search
from dealerscope.operators.joins import rollup_through
from dealerscope.operators.rollups import dealer_totals
from dealerscope.plans.views import (
    AGE_BUCKETS,
    aging_from_balance,
    dealer_aging_report,
    dealer_scorecard,
    scorecard_from_balance,
)

Day = dt.date | str | None
Regions = Iterable[str] | None


def region_list(dealers: DataFrame) -> DataFrame:
    return dealers.select("region").distinct().orderBy("region")


def dealer_type_list(dealers: DataFrame) -> DataFrame:
    return dealers.select("dealer_type").distinct().orderBy("dealer_type")


def crop_list(revenue: DataFrame) -> DataFrame:
    """Crops with sales, from :func:`product_revenue`."""
    return revenue.select("target_crop").distinct().orderBy("target_crop")


def order_date_bounds(orders: DataFrame) -> DataFrame:
    return orders.agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))


def _filtered_dealer_totals(
    orders: DataFrame, dealers: DataFrame, regions: Regions, lo: Day, hi: Day, *columns: str
) -> DataFrame:
    """Dealer sums within the dates, for the dealers of the regions, with dealer columns."""
    chosen = in_regions(dealers, regions).select("dealer_id", *columns)
    return dealer_totals(in_date_range(orders, lo, hi)).join(chosen, "dealer_id")


def kpi_summary(
    orders: DataFrame, dealers: DataFrame, regions: Regions = None, lo: Day = None, hi: Day = None
) -> DataFrame:
    """One row: revenue, orders, active dealers, average order value; zeros if nothing matches."""
    per_dealer = _filtered_dealer_totals(orders, dealers, regions, lo, hi)
    sums = per_dealer.agg(
        F.coalesce(total("revenue"), F.lit(0).cast(TOTAL)).alias("revenue"),
        F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"),
        F.count(F.lit(1)).alias("dealers"),
    )
    aov = F.coalesce(ratio(F.col("revenue"), F.col("orders")), F.lit(0.0))
    return sums.withColumn("aov", aov)


def kpi_texts(kpis: DataFrame, currency: str = "\u20b9") -> DataFrame:
    """The four figures as they are shown: ``metric``, ``text``, with grouped thousands."""
    # The names of the figures.
    texts = {
        "Total revenue": F.concat(F.lit(currency), F.format_number("revenue", 0)),
        "Total orders": F.format_number("orders", 0),
        "Active dealers": F.col("dealers").cast("string"),
        "Average order value": F.concat(F.lit(currency), F.format_number("aov", 0)),
    }
    rows = [F.struct(F.lit(name).alias("metric"), text.alias("text")) for name, text in texts.items()]
    return kpis.select(F.inline(F.array(*rows)))


def monthly_revenue(
    orders: DataFrame, dealers: DataFrame, regions: Regions = None, lo: Day = None, hi: Day = None
) -> DataFrame:
    return rollup_through(
        in_date_range(orders, lo, hi),
        key="dealer_id",
        fact_columns={"month_start": month_start("order_date")},
        dimension=in_regions(dealers, regions).select("dealer_id"),
        by=["month_start"],
        amounts={"revenue": "total_amount"},
        counts={},
    ).orderBy("month_start")


def extreme(df: DataFrame, value: str, key: str, n: int, smallest: bool = False) -> DataFrame:
    """The n rows with the largest (or smallest) value; the key settles ties."""
    order: Column = F.asc_nulls_last(value) if smallest else F.desc_nulls_last(value)
    return df.orderBy(order, key).limit(n)


def top_regions(
    orders: DataFrame, dealers: DataFrame, regions: Regions = None, lo: Day = None, hi: Day = None, n: int = 5
) -> DataFrame:
    per_region = (
        _filtered_dealer_totals(orders, dealers, regions, lo, hi, "region")
        .groupBy("region")
        .agg(total("revenue").alias("revenue"))
    )
    return extreme(per_region, "revenue", "region", n)


def top_dealers(
    orders: DataFrame, dealers: DataFrame, regions: Regions = None, lo: Day = None, hi: Day = None, n: int = 5
) -> DataFrame:
    """Dealers by revenue; namesakes stay apart because the sum is per dealer id."""
    per_dealer = _filtered_dealer_totals(orders, dealers, regions, lo, hi, "dealer_name")
    return extreme(per_dealer, "revenue", "dealer_id", n).select("dealer_id", "dealer_name", "revenue")


def of_dealers(dealers: DataFrame, orders: DataFrame, payments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The orders of some dealers and the payments of these orders, cut before anything is summed."""
    kept = orders.join(dealers.select("dealer_id"), "dealer_id", "left_semi")
    return kept, payments.join(kept.select("order_id"), "order_id", "left_semi")


def dealer_performance(
    dealers: DataFrame,
    orders: DataFrame,
    payments: DataFrame,
    regions: Regions = None,
    types: Iterable[str] | None = None,
) -> DataFrame:
    """Scorecard with dealer type for the chosen regions and types, best revenue first."""
    chosen = _in_types(in_regions(dealers, regions), types)
    score = dealer_scorecard(chosen, *of_dealers(chosen, orders, payments), carry=["dealer_type"])
    return score.orderBy(F.desc_nulls_last("total_revenue"), "dealer_id")


def _in_types(dealers: DataFrame, types: Iterable[str] | None) -> DataFrame:
    return dealers if types is None else dealers.filter(F.col("dealer_type").isin(list(types)))


def performance_from_balance(
    dealers: DataFrame, balance: DataFrame, regions: Regions = None, types: Iterable[str] | None = None
) -> DataFrame:
    """:func:`dealer_performance` from a stored order balance, cut to the dealers before it is summed."""
    chosen = _in_types(in_regions(dealers, regions), types)
    kept = balance.join(chosen.select("dealer_id"), "dealer_id", "left_semi")
    score = scorecard_from_balance(chosen, kept, carry=["dealer_type"])
    return score.orderBy(F.desc_nulls_last("total_revenue"), "dealer_id")


def product_revenue(
    lines: DataFrame,
    dealers: DataFrame,
    products: DataFrame,
    regions: Regions = None,
    lo: Day = None,
    hi: Day = None,
) -> DataFrame:
    """Revenue of every product with sales in the chosen regions and dates."""
    per_product = (
        lines.transform(region_date_filter(dealers, regions, lo, hi))
        .groupBy("product_id")
        .agg(total("total_amount").alias("revenue"))
    )
    return per_product.join(products.select("product_id", "product_name", "target_crop"), "product_id")


def top_products(revenue: DataFrame, n: int = 10) -> DataFrame:
    return extreme(revenue, "revenue", "product_id", n)


def bottom_products(revenue: DataFrame, n: int = 10) -> DataFrame:
    return extreme(revenue, "revenue", "product_id", n, smallest=True)


def crop_demand_curve(
    lines: DataFrame,
    dealers: DataFrame,
    products: DataFrame,
    crop: str,
    regions: Regions = None,
    lo: Day = None,
    hi: Day = None,
) -> DataFrame:
    """Monthly quantity sold of one crop's products."""
    of_crop = products.filter(F.col("target_crop") == crop).select("product_id")
    return (
        lines.transform(region_date_filter(dealers, regions, lo, hi))
        .join(of_crop, "product_id", "left_semi")
        .groupBy(month_start("order_date").alias("month_start"))
        .agg(F.sum("quantity").alias("quantity"))
        .orderBy("month_start")
    )


def crop_peak_month(calendar: DataFrame, crop: str | None = None) -> DataFrame:
    """Peak month per crop; the earliest one where regions disagree."""
    rows = calendar if crop is None else calendar.filter(F.col("crop") == crop)
    return rows.groupBy("crop").agg(F.min("peak_demand_month").alias("peak_demand_month"))


def stock_overview(status: DataFrame) -> DataFrame:
    """Inventory status, low stock first, then soonest expiry."""
    return status.orderBy(F.desc("is_below_reorder"), F.asc("days_to_expiry"), "product_id")


def low_stock(status: DataFrame) -> DataFrame:
    return status.filter("is_below_reorder").orderBy("days_to_expiry", "product_id")


def near_expiry(inventory: DataFrame, products: DataFrame, as_of: dt.date | str, days: int = 60) -> DataFrame:
    """Batches that expire from ``as_of`` to ``days`` later, soonest first.

    The range is put on the date column itself, so it can prune files and row groups.
    """
    first = as_date(as_of)
    expiring = inventory.filter(F.col("expiry_date").between(first, F.date_add(first, days)))
    return (
        expiring.select("product_id", "batch_no", "expiry_date", "quantity_available")
        .join(products.select("product_id", "product_name"), "product_id")
        .withColumn("days_to_expiry", F.datediff("expiry_date", first))
        .select("product_id", "product_name", "batch_no", "expiry_date", "quantity_available", "days_to_expiry")
        .orderBy("expiry_date", "product_id", "batch_no")
    )


def aging_totals(aging: DataFrame) -> DataFrame:
    """One row per age bucket: its name and the outstanding of all dealers."""
    return aging.agg(*(total(b).alias(b) for b in AGE_BUCKETS)).unpivot(
        [], list(AGE_BUCKETS), "bucket", "outstanding"
    )


def aging_search(
    dealers: DataFrame, orders: DataFrame, payments: DataFrame, as_of: dt.date | str, term: str
) -> DataFrame:
    """The aging report of the dealers whose name matches."""
    chosen = search(dealers, "dealer_name", term)
    return dealer_aging_report(chosen, *of_dealers(chosen, orders, payments), as_of)


def aging_search_from_balance(dealers: DataFrame, balance: DataFrame, as_of: dt.date | str, term: str) -> DataFrame:
    """:func:`aging_search` from a stored order balance."""
    chosen = search(dealers, "dealer_name", term)
    kept = balance.join(chosen.select("dealer_id"), "dealer_id", "left_semi")
    return aging_from_balance(chosen, kept, as_of)


def forecast_overview(results: DataFrame, products: DataFrame) -> DataFrame:
    """Stored forecast rows with the product name, by week."""
    return results.join(products.select("product_id", "product_name"), "product_id").orderBy(
        "forecast_week", "product_id"
    )


def forecast_series(overview: DataFrame) -> DataFrame:
    """Actual and predicted quantity in long form: one row per product, week and measure."""
    return overview.select("product_id", "product_name", "forecast_week", "actual_qty", "predicted_qty").unpivot(
        ["product_id", "product_name", "forecast_week"], ["actual_qty", "predicted_qty"], "measure", "quantity"
    )


def segment_overview(segments: DataFrame, dealers: DataFrame) -> DataFrame:
    """Stored dealer segments with the dealer name."""
    return segments.join(dealers.select("dealer_id", "dealer_name"), "dealer_id")
