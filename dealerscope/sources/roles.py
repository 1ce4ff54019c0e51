"""Where the plans get their tables from.

The plans speak of dealers, products, orders, order lines, payments, stock and a crop
calendar. Two sources can play these roles: the nine loaded tables, whose orders carry
one product each, and the TPC-H-like star, whose orders and lines are separate tables.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerscope.operators.rollups import order_balance
from dealerscope.sources.schemas import STAR_DDL


class Roles(Protocol):
    dealers: DataFrame
    products: DataFrame
    suppliers: DataFrame
    orders: DataFrame  # order grain: order_id, order_date, dealer_id, total_amount, payment_status
    product_lines: DataFrame  # product grain without the order header: order_id, product_id, quantity, total_amount
    lines: DataFrame  # product grain with order_date and dealer_id
    payments: DataFrame
    inventory: DataFrame
    calendar: DataFrame
    balance: DataFrame  # per dealer and order date, see order_balance; stored where the source was loaded

    def lines_of(self, products: DataFrame) -> DataFrame:
        """Order lines of a few products: order_id, order_date, product_id, quantity."""

    def lines_with(self, dealers: DataFrame) -> DataFrame:
        """Order lines joined to their dealers, with the columns of both."""


@dataclass(frozen=True)
class TableRoles:
    dealers: DataFrame
    products: DataFrame
    suppliers: DataFrame
    orders: DataFrame
    product_lines: DataFrame
    lines: DataFrame
    payments: DataFrame
    inventory: DataFrame
    calendar: DataFrame
    balance: DataFrame

    def lines_of(self, products: DataFrame) -> DataFrame:
        chosen = self.lines.join(products.select("product_id"), "product_id", "left_semi")
        return chosen.select("order_id", "order_date", "product_id", "quantity")

    def lines_with(self, dealers: DataFrame) -> DataFrame:
        return self.lines.join(dealers, "dealer_id")


def roles_from_tables(tables: Mapping[str, DataFrame]) -> Roles:
    """Roles of the nine loaded tables; header and line are the same row there."""
    orders = tables["sales_orders"]
    balance = tables["order_balance"] if "order_balance" in tables else order_balance(orders, tables["payments"])
    return TableRoles(
        dealers=tables["dealers"],
        products=tables["products"],
        suppliers=tables["suppliers"],
        orders=orders,
        product_lines=orders,
        lines=orders,
        payments=tables["payments"],
        inventory=tables["inventory"],
        calendar=tables["crop_calendar"],
        balance=balance,
    )


def _net() -> Column:
    """Line amount after discount; the factors are decimals before they are multiplied."""
    gross = F.col("l_extendedprice").cast("decimal(12,2)")
    kept = F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    return F.round(gross * kept, 2).cast("decimal(12,2)")


class StarRoles:
    """Roles of the TPC-H-like tables; the column mapping is in FIXTURES.md part B.

    A role is composed when it is first asked for, so a query pays for its own roles only.
    """

    def __init__(self, spark: SparkSession, folder: str, ending: str = ".parquet"):
        self._spark, self._folder, self._ending = spark, folder.rstrip("/"), ending

    def table(self, name: str) -> DataFrame:
        return self._spark.read.schema(STAR_DDL[name]).parquet(f"{self._folder}/{name}{self._ending}")

    @cached_property
    def _geography(self) -> DataFrame:
        return (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", "n_name", "r_name")
        )

    @cached_property
    def dealers(self) -> DataFrame:
        located = self.table("customer").join(self._geography, F.col("c_nationkey") == F.col("n_nationkey"))
        return located.select(
            F.col("c_custkey").alias("dealer_id"),
            F.col("c_name").alias("dealer_name"),
            F.col("c_mktsegment").alias("dealer_type"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("district"),
            F.col("c_acctbal").cast("decimal(12,2)").alias("credit_limit"),
        )

    @cached_property
    def suppliers(self) -> DataFrame:
        located = self.table("supplier").join(self._geography, F.col("s_nationkey") == F.col("n_nationkey"))
        return located.select(
            F.col("s_suppkey").alias("supplier_id"),
            F.col("s_name").alias("supplier_name"),
            F.col("r_name").alias("region"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("target_crop"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("dealer_price"),
            F.col("p_size").alias("shelf_life_months"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.col("o_custkey").alias("dealer_id"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"),
            F.when(status == "F", "Paid").when(status == "P", "Partial").when(status == "O", "Overdue")
            .alias("payment_status"),
        )

    @cached_property
    def product_lines(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            _net().alias("total_amount"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        return self.product_lines.join(self.orders.select("order_id", "order_date", "dealer_id"), "order_id")

    def lines_of(self, products: DataFrame) -> DataFrame:
        """The lines are filtered before they meet the order headers; if few are left,
        adaptive execution broadcasts them and the headers need no shuffle."""
        chosen = self.product_lines.select("order_id", "product_id", "quantity").join(
            products.select("product_id"), "product_id", "left_semi"
        )
        dates = self.orders.select("order_id", "order_date")
        return dates.join(chosen, "order_id")

    def lines_with(self, dealers: DataFrame) -> DataFrame:
        headers = self.orders.select("order_id", "order_date", "dealer_id").join(dealers, "dealer_id")
        return self.product_lines.join(headers, "order_id")

    @cached_property
    def payments(self) -> DataFrame:
        return self.table("lineitem").filter(F.col("l_linestatus") == "F").select(
            F.col("l_orderkey").alias("order_id"),
            _net().alias("amount_received"),
            F.col("l_shipdate").cast("date").alias("payment_date"),
        )

    @cached_property
    def balance(self) -> DataFrame:
        return order_balance(self.orders, self.payments)

    @cached_property
    def inventory(self) -> DataFrame:
        return self.table("lineitem").filter(F.col("l_linestatus") == "O").select(
            F.col("l_partkey").alias("product_id"),
            F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("batch_no"),
            F.col("l_shipdate").cast("date").alias("expiry_date"),
            F.col("l_quantity").cast("decimal(12,2)").alias("quantity_available"),
            (F.col("l_quantity").cast("int") * 8).cast("decimal(12,2)").alias("reorder_level"),
        )

    @cached_property
    def calendar(self) -> DataFrame:
        """One row per crop and region: each crop gets the keys of the region table, as one list."""
        crops = self.table("part").select(F.col("p_brand").alias("crop")).distinct()
        keys = self.table("region").agg(F.collect_set("r_regionkey")).scalar()
        return (
            crops.withColumn("region_key", F.explode(keys))
            .join(self.table("region"), F.col("region_key") == F.col("r_regionkey"))
            .select(
                "crop",
                F.col("r_name").alias("region"),
                (F.regexp_extract("crop", "([0-9]+)$", 1).cast("int") % 12 + 1).alias("peak_demand_month"),
            )
        )


def roles_from_star(spark: SparkSession, folder: str, ending: str = ".parquet") -> Roles:
    """Roles of the star's Parquet tables ``{folder}/{name}{ending}``; loaded ones have no ending."""
    return StarRoles(spark, folder, ending)
