"""The six reporting views and their registration for SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerscope.functions.dates import as_date, month_start
from dealerscope.functions.money import percent, ratio, total
from dealerscope.operators.joins import rollup_through
from dealerscope.operators.ranking import rank_descending
from dealerscope.operators.rollups import dealer_totals, product_totals, with_outstanding
from dealerscope.sources.roles import Roles


def monthly_sales_summary(orders: DataFrame, dealers: DataFrame) -> DataFrame:
    """Revenue, number of orders and mean order value per month and region."""
    sums = rollup_through(
        orders,
        key="dealer_id",
        fact_columns={"month": month_start("order_date")},
        dimension=dealers.select("dealer_id", "region"),
        by=["month", "region"],
        amounts={"total_revenue": "total_amount"},
        counts={"total_orders": F.lit(1)},
    )
    return sums.withColumn("avg_order_value", ratio(F.col("total_revenue"), F.col("total_orders")))


def dealer_scorecard(
    dealers: DataFrame, orders: DataFrame, payments: DataFrame, carry: Sequence[str] = ()
) -> DataFrame:
    """Revenue, orders, exposure and credit use per dealer.

    A dealer without orders is kept, with count 0 and null sums. ``carry`` names further
    dealer columns to pass through.
    """
    per_dealer = with_outstanding(orders, payments).groupBy("dealer_id").agg(
        total("total_amount").alias("total_revenue"),
        F.count("order_id").alias("order_count"),
        total("outstanding").alias("current_outstanding"),
    )
    return _scorecard(dealers, per_dealer, carry)


def scorecard_from_balance(dealers: DataFrame, balance: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """:func:`dealer_scorecard` from a stored order balance."""
    per_dealer = balance.groupBy("dealer_id").agg(
        total("revenue").alias("total_revenue"),
        F.sum("orders").alias("order_count"),
        total("outstanding").alias("current_outstanding"),
    )
    return _scorecard(dealers, per_dealer, carry)


def _scorecard(dealers: DataFrame, per_dealer: DataFrame, carry: Sequence[str]) -> DataFrame:
    return dealers.join(per_dealer, "dealer_id", "left").select(
        "dealer_id",
        "dealer_name",
        "region",
        "total_revenue",
        F.coalesce("order_count", F.lit(0)).alias("order_count"),
        "credit_limit",
        "current_outstanding",
        percent(F.col("current_outstanding"), F.col("credit_limit")).alias("credit_utilization_pct"),
        *carry,
    )


# The age buckets in days, inclusive; None leaves the end open.
AGE_BUCKETS = {
    "outstanding_0_30": (0, 30),
    "outstanding_31_60": (31, 60),
    "outstanding_61_90": (61, 90),
    "outstanding_90_plus": (91, None),
}


def dealer_aging_report(
    dealers: DataFrame, orders: DataFrame, payments: DataFrame, as_of: dt.date | str
) -> DataFrame:
    """Outstanding per dealer with orders, by age of the order at ``as_of``.

    Orders dated after ``as_of`` fall in no bucket.
    """
    return aging_from_balance(dealers, with_outstanding(orders, payments), as_of)


def aging_from_balance(dealers: DataFrame, balance: DataFrame, as_of: dt.date | str) -> DataFrame:
    """:func:`dealer_aging_report` from rows of dealer, order date and outstanding, such as a stored balance."""
    age = F.datediff(as_date(as_of), F.col("order_date"))
    nothing = F.lit(0).cast("decimal(38,2)")

    def bucket(lo, hi):
        inside = age >= lo if hi is None else age.between(lo, hi)
        return total(F.when(inside, F.col("outstanding").cast("decimal(38,2)")).otherwise(nothing))

    per_dealer = balance.groupBy("dealer_id").agg(*(bucket(lo, hi).alias(name) for name, (lo, hi) in AGE_BUCKETS.items()))
    return dealers.select("dealer_id", "dealer_name").join(per_dealer, "dealer_id")


def product_sales(products: DataFrame, lines: DataFrame) -> DataFrame:
    """Revenue and quantity per product; products without sales are kept with null sums."""
    return products.select("product_id", "product_name", "target_crop").join(
        product_totals(lines), "product_id", "left"
    )


def product_crop_performance(products: DataFrame, lines: DataFrame) -> DataFrame:
    """:func:`product_sales` ranked by revenue within the crop, unsold products first."""
    return rank_descending(
        product_sales(products, lines),
        ["target_crop"],
        "total_revenue",
        "rank_within_crop_category",
    )


def inventory_status(products: DataFrame, inventory: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Stock, reorder flag and days to the first expiry per product with stock rows."""
    stock = inventory.groupBy("product_id").agg(
        total("quantity_available").alias("quantity_available"),
        F.max("reorder_level").alias("reorder_level"),
        F.min("expiry_date").alias("first_expiry"),
    )
    return products.select("product_id", "product_name").join(stock, "product_id").select(
        "product_id",
        "product_name",
        "quantity_available",
        "reorder_level",
        (F.col("quantity_available") < F.col("reorder_level")).alias("is_below_reorder"),
        F.datediff("first_expiry", as_date(as_of)).alias("days_to_expiry"),
    )


def regional_performance(dealers: DataFrame, orders: DataFrame) -> DataFrame:
    """Revenue, dealers with orders and revenue per such dealer, by region.

    Orders are summed per dealer first, so counting dealers needs no distinct.
    """
    return (
        dealer_totals(orders)
        .join(dealers.select("dealer_id", "region"), "dealer_id")
        .groupBy("region")
        .agg(total("revenue").alias("total_revenue"), F.count(F.lit(1)).alias("dealer_count"))
        .withColumn("avg_revenue_per_dealer", ratio(F.col("total_revenue"), F.col("dealer_count")))
    )


# The names that ad-hoc SQL can use, besides the stored results.
VIEW_NAMES = (
    "dealers",
    "products",
    "sales_orders",
    "payments",
    "crop_calendar",
    "inventory",
    "monthly_sales_summary",
    "dealer_scorecard",
    "dealer_aging_report",
    "product_crop_performance",
    "inventory_status",
    "regional_performance",
)


def register_views(
    spark: SparkSession,
    roles: Roles,
    as_of: dt.date | str,
    results: Mapping[str, DataFrame] | None = None,
    names: Iterable[str] | None = None,
) -> list[str]:
    """Make base tables, views and any stored results available to SQL by name.

    ``names`` restricts the registration. Some views count a dimension when they are
    composed, to choose how to join it.
    """
    r = roles
    surface: dict[str, Callable[[], DataFrame]] = {
        "dealers": lambda: r.dealers,
        "products": lambda: r.products,
        "sales_orders": lambda: r.orders,
        "payments": lambda: r.payments,
        "inventory": lambda: r.inventory,
        "crop_calendar": lambda: r.calendar,
        "monthly_sales_summary": lambda: monthly_sales_summary(r.orders, r.dealers),
        "dealer_scorecard": lambda: scorecard_from_balance(r.dealers, r.balance),
        "dealer_aging_report": lambda: aging_from_balance(r.dealers, r.balance, as_of),
        "product_crop_performance": lambda: product_crop_performance(r.products, r.product_lines),
        "inventory_status": lambda: inventory_status(r.products, r.inventory, as_of),
        "regional_performance": lambda: regional_performance(r.dealers, r.orders),
    }
    for name, frame in (results or {}).items():
        surface[name] = lambda frame=frame: frame
    chosen = list(surface) if names is None else [n for n in surface if n in set(names)]
    for name in chosen:
        surface[name]().createOrReplaceTempView(name)
    return chosen
