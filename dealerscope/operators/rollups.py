"""First-level sums over the facts.

Each of these is a plain ``groupBy`` on a fact key, so Spark sums within every input
split before it shuffles: a key that holds a third of all rows arrives as one partial
row per split. The dimensions are joined afterwards, to one row per key.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerscope.functions.money import total


def receipts_by_order(payments: DataFrame) -> DataFrame:
    """Receipts per order, summed as whole cents.

    This is the widest shuffle of the receivables reports, and a long takes half the room
    of a decimal sum in it. It holds 9 million receipts of the largest amount on one order,
    and Spark's ANSI mode raises an error beyond that. Sums over many orders stay decimal.
    """
    cents = F.sum((F.col("amount_received") * 100).cast("bigint"))
    received = (cents.cast("decimal(19,0)") * F.lit(Decimal("0.01"))).cast("decimal(20,2)")
    return payments.groupBy("order_id").agg(received.alias("received"))


def with_outstanding(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders plus ``outstanding`` = total less receipts (none received counts as zero)."""
    received = F.coalesce(F.col("received"), F.lit(0).cast("decimal(20,2)"))
    return (
        orders.select("order_id", "order_date", "dealer_id", "total_amount")
        .join(receipts_by_order(payments), "order_id", "left")
        .withColumn("outstanding", (F.col("total_amount") - received).cast("decimal(20,2)"))
    )


def contradicts_receipts(status: Column, due: Column, received: Column) -> Column:
    """Paid orders must have received exactly their total; part-paid and overdue ones less."""
    return ((status == "Paid") & (received != due)) | (status.isin("Partial", "Overdue") & (received >= due))


def order_balance(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """(dealer_id, order_date, orders, revenue, outstanding, contradictions), one row per dealer and order date.

    Meant to be stored at load, when orders and receipts are joined once; every receivables
    report is a sum of it. The sums add up over dealers and dates. What is outstanding does not
    add up over reporting dates: its age is taken from ``order_date`` for each of them.
    ``contradictions`` counts the orders whose status contradicts their receipts.
    """
    received = F.coalesce(F.col("received"), F.lit(0).cast("decimal(20,2)"))
    wrong = contradicts_receipts(F.col("payment_status"), F.col("total_amount"), received)
    joined = orders.select("order_id", "order_date", "dealer_id", "total_amount", "payment_status").join(
        receipts_by_order(payments), "order_id", "left"
    )
    return joined.groupBy("dealer_id", "order_date").agg(
        F.count("order_id").alias("orders"),
        total("total_amount").alias("revenue"),
        total((F.col("total_amount") - received).cast("decimal(20,2)")).alias("outstanding"),
        F.count_if(F.coalesce(wrong, F.lit(False))).alias("contradictions"),
    )


def dealer_totals(orders: DataFrame) -> DataFrame:
    """Revenue and number of orders per dealer."""
    return orders.groupBy("dealer_id").agg(
        total("total_amount").alias("revenue"), F.count(F.lit(1)).alias("orders")
    )


def product_totals(lines: DataFrame) -> DataFrame:
    """Revenue and quantity per product."""
    return lines.groupBy("product_id").agg(
        total("total_amount").alias("total_revenue"), F.sum("quantity").alias("total_quantity_sold")
    )
