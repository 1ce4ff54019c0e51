"""The stored cube: how often its rows are shuffled, and its cells on odd rows."""

import re
from types import SimpleNamespace

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dealerscope.plans import cube
from dealerscope.sources.stored import StoredRoles


@pytest.fixture
def large_everywhere(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _odd(make):
    """Hot order, hot product and hot day; repeated dealers, products and orders; null and unknown keys."""
    source = SimpleNamespace(suppliers=None, payments=None, inventory=None, calendar=None)
    source.dealers = make.dealers(
        (1, "a", "North", 1, "Retailer"), (2, "b", "South", 1, "Distributor"), (2, "b", "South", 1, "Distributor"), (3, "c", None, 1, None)
    )
    source.products = make.products((1, "x", "Rice"), (2, "y", "Wheat"), (2, "y", "Wheat"), (3, "z", None))
    orders = [(i, "2024-01-01" if i % 2 else f"2024-02-{1 + i % 9:02d}", 1 + i % 4, i, "Paid") for i in range(1, 40)]
    source.orders = make.orders(*orders, (5, "2024-03-01", 1, 7, "Paid"), (41, None, 2, 7, "Paid"), (42, "2024-01-01", None, 7, "Paid"))
    lines = [(7 if i % 3 == 0 else 1 + i % 44, None, None, 1 + i % 4 if i % 2 else 1, i % 5, i) for i in range(3000)]
    source.product_lines = make.lines(*lines, (None, None, None, 1, 1, 1), (3, None, None, None, 1, 1), (3, None, None, 2, None, None)).drop(
        "order_date", "dealer_id"
    )
    return source


def test_cells_of_odd_rows(spark, make):
    """Every grain is the plain sum over lines, or orders, joined to dealers and products."""
    source = _odd(make)
    stored = StoredRoles(source, spark, buckets=3)
    cells = cube.store_cube(stored)
    located = source.orders.select("order_id", "order_date", "dealer_id", F.col("total_amount").alias("due")).join(source.dealers, "dealer_id")
    lines = source.product_lines.join(located, "order_id").join(source.products.withColumnRenamed("target_crop", "crop"), "product_id")
    for grain, keys in cube.GRAINS.items():
        by = [*cube.SHARED, *keys]
        if grain in ("region", "dealer"):
            plain = located.groupBy(*by).agg(F.sum("due").cast("decimal(38,2)").alias("revenue"), F.count(F.lit(1)).alias("orders"))
        else:
            plain = lines.groupBy(*by).agg(F.sum("total_amount").cast("decimal(38,2)").alias("revenue"), F.sum("quantity").alias("quantity"))
        ours = cells.filter(F.col("grain") == grain).select(plain.columns)
        assert plain.count() > 3
        assert plain.exceptAll(ours).isEmpty() and ours.exceptAll(plain).isEmpty()


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


def test_lines_are_dealt_for_the_products_and_for_the_cells_only(spark, large_everywhere, monkeypatch):
    written = []
    roles = entry._loaded(spark, SMALL)
    assert roles.lines.columns  # the facts are stored
    write = type(roles.orders.write).parquet

    def parquet(writer, path, *args, **kwargs):
        written.append(writer._df)
        return write(writer, path, *args, **kwargs)

    monkeypatch.setattr(type(roles.orders.write), "parquet", parquet)
    cube.store_cube(roles)
    exchanges = [e for df in written if any("product_id" in e for e in _exchanges(df)) for e in _exchanges(df)]
    of_lines = [e for e in exchanges if "product_id" in e or "crop" in e]
    assert sorted(of_lines) == ["order_date, region, dealer_type, crop", "product_id", "product_id"]  # lines once, products once
