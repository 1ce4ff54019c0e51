from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from dealerscope.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]",
        app="tests",
        spark__sql__shuffle__partitions="4",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("scratch")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    yield session
    session.stop()


def day(text: str | None):
    return None if text is None else dt.date.fromisoformat(text)


def money(value) -> Decimal | None:
    return None if value is None else Decimal(str(value)).quantize(Decimal("0.01"))


class Make:
    """Small role tables from tuples."""

    def __init__(self, spark):
        self.spark = spark

    def dealers(self, *rows):
        """(id, name, region, credit limit, type)"""
        data = [(i, n, r, money(c), t) for i, n, r, c, t in rows]
        return self.spark.createDataFrame(
            data, "dealer_id INT, dealer_name STRING, region STRING, credit_limit DECIMAL(12,2), dealer_type STRING"
        )

    def orders(self, *rows):
        """(id, date, dealer, total, status)"""
        data = [(i, day(d), k, money(t), s) for i, d, k, t, s in rows]
        return self.spark.createDataFrame(
            data, "order_id INT, order_date DATE, dealer_id INT, total_amount DECIMAL(12,2), payment_status STRING"
        )

    def payments(self, *rows):
        """(order, amount)"""
        data = [(o, money(a)) for o, a in rows]
        return self.spark.createDataFrame(data, "order_id INT, amount_received DECIMAL(12,2)")

    def products(self, *rows):
        """(id, name, crop)"""
        return self.spark.createDataFrame(list(rows), "product_id INT, product_name STRING, target_crop STRING")

    def lines(self, *rows):
        """(order, date, dealer, product, quantity, total)"""
        data = [(o, day(d), k, p, q, money(t)) for o, d, k, p, q, t in rows]
        return self.spark.createDataFrame(
            data,
            "order_id INT, order_date DATE, dealer_id INT, product_id INT, quantity INT, total_amount DECIMAL(12,2)",
        )

    def inventory(self, *rows):
        """(product, batch, expiry, available, reorder)"""
        data = [(p, b, day(e), money(q), money(r)) for p, b, e, q, r in rows]
        return self.spark.createDataFrame(
            data,
            "product_id INT, batch_no STRING, expiry_date DATE, quantity_available DECIMAL(12,2), "
            "reorder_level DECIMAL(12,2)",
        )

    def calendar(self, *rows):
        """(crop, region, peak month)"""
        return self.spark.createDataFrame(list(rows), "crop STRING, region STRING, peak_demand_month INT")

    def weekly(self, *rows):
        """(product, day, y, peak month)"""
        data = [(p, day(d), float(y), m) for p, d, y, m in rows]
        return self.spark.createDataFrame(data, "product_id INT, ds DATE, y DOUBLE, peak_month INT")


@pytest.fixture(scope="session")
def make(spark):
    return Make(spark)
