"""The star loaded once: facts in buckets of the order, and the order balance."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerscope.operators.rollups import order_balance
from dealerscope.sources.durable import fresh_path, materialise
from dealerscope.sources.roles import Roles

# An order is hot if it has over 1 / HOT of all lines; so there are at most HOT such orders.
HOT = 1000


def write_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Writes ``df`` as a table of ``buckets`` files, each sorted by ``key``, and returns a scan of it.

    Tables of one key and one number of buckets are joined on the key without an exchange.
    The table lies in the shared scratch folder and is known to this application's catalog only.
    """
    spark = df.sparkSession
    name = f"dealerscope_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key).sortWithinPartitions(key)
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", fresh_path(spark)).saveAsTable(name)
    return spark.table(name)


class StoredRoles:
    """Roles whose facts are written once, at first use, and read by all reports after that.

    Order headers and lines lie in buckets of ``order_id``. A bucketed join cannot split a key,
    so the lines of hot orders are kept apart and meet their headers, at most HOT rows, by broadcast.
    All other roles are those of the source.
    """

    def __init__(self, source: Roles, spark: SparkSession, buckets: int | None = None):
        self._source = source
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.dealers, self.products, self.suppliers = source.dealers, source.products, source.suppliers
        self.payments, self.inventory, self.calendar = source.payments, source.inventory, source.calendar

    @cached_property
    def orders(self) -> DataFrame:
        return write_buckets(self._source.orders, "order_id", self._buckets)

    @cached_property
    def _hot_orders(self) -> DataFrame:
        lines = self._source.product_lines
        most = lines.count() // HOT
        counts = lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("many"))
        return materialise(counts.filter((F.col("many") > most) & F.col("order_id").isNotNull()).select("order_id"))

    @cached_property
    def _usual_lines(self) -> DataFrame:
        usual = self._source.product_lines.join(F.broadcast(self._hot_orders), "order_id", "left_anti")
        return write_buckets(usual, "order_id", self._buckets)

    @cached_property
    def _hot_lines(self) -> DataFrame:
        return materialise(self._source.product_lines.join(F.broadcast(self._hot_orders), "order_id", "left_semi"))

    @cached_property
    def product_lines(self) -> DataFrame:
        return self._usual_lines.unionByName(self._hot_lines)

    def _with_headers(self, lines: DataFrame, hot: DataFrame, *columns: str, dealers: DataFrame | None = None) -> DataFrame:
        headers = self.orders.select("order_id", *columns)
        of_hot = materialise(headers.join(F.broadcast(self._hot_orders), "order_id", "left_semi"))
        if dealers is not None:
            headers, of_hot = (part.join(dealers, "dealer_id") for part in (headers, of_hot))
        return lines.join(headers, "order_id").unionByName(hot.join(F.broadcast(of_hot), "order_id"))

    @cached_property
    def lines(self) -> DataFrame:
        return self._with_headers(self._usual_lines, self._hot_lines, "order_date", "dealer_id")

    def lines_with(self, dealers: DataFrame) -> DataFrame:
        """The headers meet their dealers before the lines: only headers are dealt anew, to the buckets."""
        return self._with_headers(self._usual_lines, self._hot_lines, "order_date", "dealer_id", dealers=dealers)

    def lines_of(self, products: DataFrame) -> DataFrame:
        chosen = products.select("product_id")
        columns = ["order_id", "product_id", "quantity"]
        usual, hot = (part.select(*columns).join(chosen, "product_id", "left_semi") for part in (self._usual_lines, self._hot_lines))
        return self._with_headers(usual, hot, "order_date").select("order_id", "order_date", "product_id", "quantity")

    @cached_property
    def balance(self) -> DataFrame:
        return materialise(order_balance(self.orders, self.payments))
