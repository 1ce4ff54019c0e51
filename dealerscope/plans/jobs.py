"""End-to-end jobs over a folder of tables: load, forecast, segment, ask."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from dealerscope.operators import quality
from dealerscope.operators.rollups import order_balance
from dealerscope.plans import adhoc
from dealerscope.plans.forecast import ForecastRun, run_forecast
from dealerscope.plans.segments import Segmentation, segment_dealers
from dealerscope.plans.timeseries import top_skus
from dealerscope.plans.views import product_sales
from dealerscope.sources.roles import Roles, roles_from_tables
from dealerscope.sources.schemas import INPUT_DDL, RESULT_DDL
from dealerscope.sources.tables import load_tables, read_table, write_replace, write_result


BALANCE = "order_balance"


def load(spark: SparkSession, csv_folder: str, folder: str) -> DataFrame:
    """Refresh all tables from CSV, store the order balance, check everything, return the row counts.

    Orders and receipts are joined once, for the balance. The tables stay in place if a check
    fails, so that they can be inspected.
    """
    loaded = load_tables(spark, csv_folder, folder, quality.row_rules)
    write_replace(order_balance(loaded.tables["sales_orders"], loaded.tables["payments"]), os.path.join(folder, BALANCE), ["order_date", "dealer_id"])
    quality.require_clean(quality.suite_after_load(loaded, read_table(spark, BALANCE, folder)))
    return spark.createDataFrame(list(loaded.counts.items()), "table_name STRING, row_count BIGINT")


def open_roles(spark: SparkSession, folder: str) -> Roles:
    return roles_from_tables({name: read_table(spark, name, folder) for name in (*INPUT_DDL, BALANCE)})


def forecast(
    spark: SparkSession, folder: str, top_n: int = 12, params: Mapping[str, object] | None = None
) -> ForecastRun:
    """Forecast the best-selling products and replace the stored results."""
    r = open_roles(spark, folder)
    skus = top_skus(product_sales(r.products, r.product_lines), top_n)
    run = run_forecast(r.lines_of(skus), r.products, r.calendar, params=params)
    write_result(run.results, RESULT_DDL["demand_forecast_results"], os.path.join(folder, "demand_forecast_results"))
    return run


def segment(spark: SparkSession, folder: str, restarts: int = 20) -> Segmentation:
    """Segment the dealers and replace the stored results."""
    r = open_roles(spark, folder)
    run = segment_dealers(r.dealers, r.orders, restarts=restarts)
    write_result(run.segments, RESULT_DDL["dealer_segments"], os.path.join(folder, "dealer_segments"))
    return run


def stored_results(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The result tables that have been written so far."""
    found = {}
    for name in RESULT_DDL:
        try:
            found[name] = read_table(spark, name, folder)
        except AnalysisException:  # not written yet
            continue
    return found


def ask(spark: SparkSession, folder: str, as_of: dt.date | str, statement: str, parameters: Mapping[str, object] | None = None) -> DataFrame:
    """A bounded SELECT over tables, views and stored results."""
    roles, results = open_roles(spark, folder), stored_results(spark, folder)
    return adhoc.ask(spark, roles, as_of, statement, results, parameters)
