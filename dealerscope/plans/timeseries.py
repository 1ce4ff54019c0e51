"""Weekly demand per product: series, gaps, season, holdout and lag features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealerscope.functions.dates import days_to_peak, season_window, week_start
from dealerscope.functions.money import total
from dealerscope.operators.joins import rollup_through
from dealerscope.plans.reports import crop_peak_month

LAGS = 4
HOLDOUT_WEEKS = 8


def top_skus(product_revenue: DataFrame, n: int = 12) -> DataFrame:
    """The n products with most revenue; unsold ones come last and ties go to the lower id."""
    return product_revenue.orderBy(F.desc_nulls_last("total_revenue"), "product_id").limit(n).select("product_id")


def product_peaks(products: DataFrame, calendar: DataFrame) -> DataFrame:
    """Peak month per product. The calendar is cut to one row per crop before the join,
    because it lists a crop once per region."""
    peaks = crop_peak_month(calendar).withColumnRenamed("peak_demand_month", "peak_month")
    return (
        products.select("product_id", F.col("target_crop").alias("crop"))
        .join(peaks, "crop")
        .select("product_id", "crop", "peak_month")
    )


def weekly_demand(
    lines: DataFrame, products: DataFrame, calendar: DataFrame, skus: DataFrame | None = None
) -> DataFrame:
    """Quantity per product and Monday-anchored week, with the product's peak month."""
    chosen = lines if skus is None else lines.join(skus, "product_id", "left_semi")
    weekly = chosen.groupBy("product_id", week_start("order_date").alias("ds")).agg(
        F.sum("quantity").cast("double").alias("y")
    )
    peaks = product_peaks(products, calendar).select("product_id", "peak_month")
    return weekly.join(peaks, "product_id")


def _by_week():
    return Window.partitionBy("product_id").orderBy("ds")


def typed_weekly(weekly: DataFrame) -> DataFrame:
    """The series columns as numbers, whatever type they arrive in.

    An unreadable product id is an error, an unreadable quantity counts as zero, an
    unreadable month is left empty.
    """
    return weekly.select(
        F.col("product_id").cast("bigint").alias("product_id"),
        "ds",
        F.coalesce(F.col("y").try_cast("double"), F.lit(0.0)).alias("y"),
        F.col("peak_month").try_cast("int").alias("peak_month"),
    )


def fill_weeks(weekly: DataFrame) -> DataFrame:
    """Every week from a product's first to its last; weeks without an order have y = 0.

    Days are anchored to their Monday first. Each row then emits itself and the empty
    weeks up to the next one, so nothing is joined back.
    """
    anchored = typed_weekly(weekly).groupBy("product_id", week_start("ds").alias("ds")).agg(
        F.sum("y").alias("y"), F.min("peak_month").alias("peak_month")
    )
    week = F.expr("INTERVAL 7 DAYS")
    following = F.coalesce(F.lead("ds").over(_by_week()), F.date_add("ds", 7))
    weeks = F.sequence("ds", F.date_sub("following", 7), week)
    return (
        anchored.withColumn("following", following)
        .select("product_id", "peak_month", "y", F.col("ds").alias("observed"), F.explode(weeks).alias("ds"))
        .select(
            "product_id",
            "ds",
            F.when(F.col("ds") == F.col("observed"), F.col("y")).otherwise(F.lit(0.0)).alias("y"),
            "peak_month",
        )
    )


def with_days_to_peak(weekly: DataFrame) -> DataFrame:
    return weekly.withColumn(
        "days_to_peak_demand", days_to_peak(F.col("ds"), F.col("peak_month")).cast("double")
    )


def mark_holdout(weekly: DataFrame, n: int = HOLDOUT_WEEKS) -> DataFrame:
    """Flag the last n weeks of each product: those with no row n places later."""
    return weekly.withColumn("is_holdout", F.lead("ds", n).over(_by_week()).isNull())


def demand_series(
    lines: DataFrame, products: DataFrame, calendar: DataFrame, skus: DataFrame | None = None
) -> DataFrame:
    """The gap-filled weekly series with season distance and holdout flag.

    All windows share one partitioning by product; a product has at most one row per week
    of the calendar, however many orders it has.
    """
    filled = fill_weeks(weekly_demand(lines, products, calendar, skus))
    return mark_holdout(with_days_to_peak(filled))


def demand_features(series: DataFrame) -> DataFrame:
    """Add lag_1..lag_4, the mean of the four previous weeks (null until there are four)
    and the month."""
    previous = _by_week().rowsBetween(-LAGS, -1)
    features = series.withColumns({f"lag_{i}": F.lag("y", i).over(_by_week()) for i in range(1, LAGS + 1)})
    four_known = F.count("y").over(previous) == LAGS
    return features.withColumns(
        {"rolling_4": F.when(four_known, F.avg("y").over(previous)), "month": F.month("ds").cast("double")}
    )


def sales_by_season_window(lines: DataFrame, products: DataFrame, calendar: DataFrame) -> DataFrame:
    """Lines, quantity and revenue per crop before the peak, just after it and otherwise.

    Summed per crop and day first, so the season is worked out for few rows.
    """
    daily = rollup_through(
        lines,
        key="product_id",
        fact_columns={"order_date": F.col("order_date")},
        dimension=product_peaks(products, calendar),
        by=["crop", "peak_month", "order_date"],
        amounts={"total_revenue": "total_amount"},
        counts={"line_count": F.lit(1), "total_quantity": F.col("quantity")},
    )
    window = season_window(days_to_peak(F.col("order_date"), F.col("peak_month")))
    return daily.groupBy("crop", window.alias("season_window")).agg(
        F.sum("line_count").alias("line_count"),
        F.sum("total_quantity").alias("total_quantity"),
        total("total_revenue").alias("total_revenue"),
    )
