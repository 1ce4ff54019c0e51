"""

The library returns dates and exact decimals. Here they are put out as ISO text and
doubles, in both engines, because the two client libraries hand dates and decimals to
Python as different types.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType

sys.path.insert(0, str(Path(__file__).resolve().parent))  # when loaded by path from elsewhere

from dealerscope.functions.dates import as_date, month_start  # noqa: E402
from dealerscope.functions.money import total  # noqa: E402
from dealerscope.operators import quality  # noqa: E402
from dealerscope.plans import adhoc, alerts, backtest, cube, forecast, reports, segments, timeseries, views  # noqa: E402
from dealerscope.sources.durable import fresh_path, materialise  # noqa: E402
from dealerscope.sources.roles import Roles, roles_from_star  # noqa: E402
from dealerscope.sources.stored import StoredRoles  # noqa: E402
from dealerscope.sources.schemas import RESULT_DDL, STAR  # noqa: E402
from dealerscope.sources.tables import (  # noqa: E402
    Loaded,
    load_tables,
    read_table,
    refresh_status,
    row_counts,
    write_result,
)

try:  # the training-data operators, or a library that they need, may be left out of an installation
    import dealerscope.llm.queries as llm_queries
except ModuleNotFoundError:
    llm_queries = None

AS_OF = "2001-08-01"  # the latest order date of the test tables
REGIONS = ["ASIA", "EUROPE", "AMERICA"]
LO, HI = "1997-01-01", "2000-12-31"
DEALER_TYPES = ["BUILDING", "MACHINERY"]

# The domains of the test tables, and how many rows their tables may have.
STATUSES = ["Paid", "Partial", "Overdue"]
ALL_DEALER_TYPES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ROW_BOUNDS = {"dealers": (100, 20_000), "products": (100, 50_000), "orders": (4_000, 6_000), "calendar": (125, 125)}

# The CSV files on the way to reloaded tables.
CSV_FILES = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
ROWS_PER_CSV = 1_000_000

CROP = "Brand#12"
TERM = "00[1-3]7"
ADHOC = (
    "SELECT r.region, r.dealer_count, s.dealers_over_limit FROM regional_performance r JOIN "
    "(SELECT region, count(*) AS dealers_over_limit FROM dealer_scorecard "
    "WHERE credit_utilization_pct > 100 GROUP BY region) s ON r.region = s.region ORDER BY r.region;"
)

ADHOC_BOUND = (
    "SELECT product_id, product_name, total_quantity_sold, rank_within_crop_category FROM product_crop_performance "
    "WHERE target_crop = :crop AND total_quantity_sold >= :floor ORDER BY total_quantity_sold DESC, product_id"
)

Query = Callable[[SparkSession, str], DataFrame]


def _portable(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, DecimalType):
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return df.select(columns)


def _query(plan: Callable[[Roles], DataFrame]) -> Query:
    return lambda spark, folder: _portable(plan(roles_from_star(spark, folder)))


def _aging(r: Roles) -> DataFrame:
    return views.aging_from_balance(r.dealers, r.balance, AS_OF)


def _stock(r: Roles) -> DataFrame:
    return views.inventory_status(r.products, r.inventory, AS_OF)


def _monthly(r: Roles) -> DataFrame:
    return views.monthly_sales_summary(r.orders, r.dealers)


GLOBAL = (REGIONS, LO, HI)  # the choice of regions and dates above all sales panels


def _top_skus(r: Roles) -> DataFrame:
    return timeseries.top_skus(views.product_sales(r.products, r.product_lines))


def _series(r: Roles) -> DataFrame:
    return timeseries.demand_series(r.lines_of(_top_skus(r)), r.products, r.calendar)


def _null_keys(r: Roles) -> DataFrame:
    return quality.union_checks(
        [
            quality.row_checks(r.orders, {"orders": quality.is_missing(["order_id", "dealer_id"])}),
            quality.row_checks(r.product_lines, {"lines": quality.is_missing(["order_id", "product_id"])}),
            quality.row_checks(r.payments, {"payments": quality.is_missing(["order_id"])}),
        ]
    )


def _orphans(r: Roles) -> DataFrame:
    return quality.union_checks(
        [
            quality.orphans(r.orders, {"dealer_id": r.dealers}, "orders to dealers"),
            quality.orphans(r.product_lines, {"product_id": r.products}, "lines to products"),
            quality.orphans(r.payments, {"order_id": r.orders}, "payments to orders"),
        ]
    )


def _negatives(r: Roles) -> DataFrame:
    return quality.union_checks(
        [
            quality.row_checks(r.orders, {"orders": quality.is_negative(["total_amount"])}),
            quality.row_checks(r.product_lines, {"lines": quality.is_negative(["quantity", "total_amount"])}),
            quality.row_checks(r.payments, {"payments": quality.is_negative(["amount_received"])}),
            quality.row_checks(r.inventory, {"inventory": quality.is_negative(["quantity_available", "reorder_level"])}),
            quality.row_checks(r.dealers, {"dealers": quality.is_negative(["credit_limit"])}),
        ]
    )


def _domain(r: Roles) -> DataFrame:
    return quality.union_checks(
        [
            quality.row_checks(
                r.orders, {"payment status": quality.outside_domain("payment_status", STATUSES)}
            ),
            quality.row_checks(r.dealers, {"dealer type": quality.outside_domain("dealer_type", ALL_DEALER_TYPES)}),
            quality.row_checks(r.calendar, {"peak month": quality.outside_range("peak_demand_month", 1, 12)}),
        ]
    )


def _row_bounds(r: Roles) -> DataFrame:
    tables = {"dealers": r.dealers, "products": r.products, "orders": r.orders, "calendar": r.calendar}
    return quality.union_checks(
        [quality.count_between(tables[name], lo, hi, f"{name}: rows") for name, (lo, hi) in ROW_BOUNDS.items()]
    )


def _duplicate_keys(r: Roles) -> DataFrame:
    return quality.union_checks(
        [
            quality.duplicate_keys(r.dealers, ["dealer_id"], "dealers"),
            quality.duplicate_keys(r.products, ["product_id"], "products"),
            quality.duplicate_keys(r.orders, ["order_id"], "orders"),
            quality.duplicate_keys(r.inventory, ["batch_no"], "inventory batches"),
            quality.duplicate_keys(r.calendar, ["crop", "region"], "calendar"),
        ]
    )


def _presence(r: Roles) -> DataFrame:
    return quality.union_checks(
        [quality.low_stock_present(_stock(r)), quality.old_overdue_present(r.orders, as_date(AS_OF))]
    )


def _row_counts(r: Roles) -> DataFrame:
    return row_counts(
        {
            "dealers": r.dealers,
            "products": r.products,
            "suppliers": r.suppliers,
            "sales_orders": r.orders,
            "order_lines": r.product_lines,
            "payments": r.payments,
            "inventory": r.inventory,
            "crop_calendar": r.calendar,
        }
    )


_stored: dict[tuple[str, str, str], object] = {}


def _loaded(spark: SparkSession, folder: str) -> StoredRoles:
    """The star of a folder with its stored facts and balance, each written once per Spark application."""
    key = ("facts", spark.sparkContext.applicationId, folder)
    if key not in _stored:
        _stored[key] = StoredRoles(roles_from_star(spark, folder), spark)
    return _stored[key]


def _reloaded(spark: SparkSession, folder: str) -> tuple[Loaded, Roles]:
    """All star tables written as CSV, loaded from there with their declared types and checked on the way.

    The files are compressed, so each is read by one task and holds a bounded number of rows.
    """
    key = ("reload", spark.sparkContext.applicationId, folder)
    if key not in _stored:
        csvs, out = fresh_path(spark), fresh_path(spark)
        for name, ddl in STAR.ddl.items():
            rows = spark.read.schema(ddl).parquet(f"{folder}/{name}.parquet")
            rows.write.options(**CSV_FILES, header=True, maxRecordsPerFile=ROWS_PER_CSV).csv(f"{csvs}/{name}.csv")
        loaded = load_tables(spark, csvs, out, lambda table, columns: quality.row_rules(table, columns, STAR), STAR)
        _stored[key] = loaded, roles_from_star(spark, out, ending="")
    return _stored[key]


def _reload(spark: SparkSession, folder: str) -> DataFrame:
    """The receipts by month of the loaded tables."""
    payments = _reloaded(spark, folder)[1].payments
    by_month = payments.groupBy(month_start("payment_date").alias("month")).agg(
        F.count(F.lit(1)).alias("receipts"), total("amount_received").alias("amount")
    )
    return _portable(by_month)


def _reload_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = _reloaded(spark, folder)[0].counts
    return spark.createDataFrame(list(counts.items()), "table_name STRING, row_count BIGINT")


def _reload_suite(spark: SparkSession, folder: str) -> DataFrame:
    return quality.suite_after_load(_reloaded(spark, folder)[0], source=STAR)


def _stored_query(plan: Callable[[StoredRoles], DataFrame]) -> Query:
    return lambda spark, folder: _portable(plan(_loaded(spark, folder)))


def _cube_query(plan: Callable[[DataFrame, Roles], DataFrame]) -> Query:
    """A panel of the sales cube of a folder, which is written once per Spark application."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        key = ("cube", spark.sparkContext.applicationId, folder)
        if key not in _stored:
            _stored[key] = cube.store_cube(_loaded(spark, folder))
        return _portable(plan(_stored[key], _loaded(spark, folder)))

    return run


def _adhoc(statement: str, **parameters: object) -> Query:
    return lambda spark, folder: _portable(
        adhoc.ask(spark, _loaded(spark, folder), AS_OF, statement, parameters=parameters)
    )


def _result_table(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    """Rows written as the declared result table, as a job would, and that table."""
    folder = fresh_path(spark)
    write_result(rows, RESULT_DDL[name], f"{folder}/{name}")
    return read_table(spark, name, folder)


def _stored_run(kind: str, spark: SparkSession, folder: str):
    """The forecast, backtest or segmentation of a folder, made once per Spark application.

    Its result table is written when it is made, and the panels that show it read that.
    """
    key = (kind, spark.sparkContext.applicationId, folder)
    if key not in _stored:
        r = _loaded(spark, folder)
        if kind == "forecast":  # the lines of a few products, read once: storing all lines would cost more
            source = roles_from_star(spark, folder)
            run = forecast.run_forecast(source.lines_of(_top_skus(source)), source.products, source.calendar)
            run = replace(run, results=_result_table(spark, "demand_forecast_results", run.results))
        elif kind == "backtest":
            run = backtest.run_backtest(_series_of(spark, folder))
            run = replace(run, results=_result_table(spark, "backtest_results", run.results))
        elif kind == "bands":
            run = segments.label_dealers(segments.quantile_bands(segments.rfm(r.dealers, r.orders)))
            run = replace(run, segments=_result_table(spark, "dealer_segments", run.segments))
        else:
            run = segments.segment_dealers(r.dealers, r.orders)
            run = replace(run, segments=_result_table(spark, "dealer_segments", run.segments))
        _stored[key] = run
    return _stored[key]


def _series_of(spark: SparkSession, folder: str) -> DataFrame:
    """The weekly series of the best sellers, written once per Spark application."""
    key = ("series", spark.sparkContext.applicationId, folder)
    if key not in _stored:
        _stored[key] = materialise(_series(_loaded(spark, folder)))
    return _stored[key]


def _run_query(kind: str, plan) -> Query:
    return lambda spark, folder: _portable(plan(_stored_run(kind, spark, folder), _loaded(spark, folder)))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Means of doubles to six places: their last bits hang on the order of the sum."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _forecast_query(plan) -> Query:
    return lambda spark, folder: _portable(
        plan(_stored_run("forecast", spark, folder), roles_from_star(spark, folder))
    )


def _segment_query(plan) -> Query:
    return lambda spark, folder: _portable(
        plan(_stored_run("segments", spark, folder), roles_from_star(spark, folder))
    )


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the dealer scorecard on the smallest tables."""
    return queries()["dealer_scorecard"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return core_queries() | (llm_queries.queries() if llm_queries else {})


def oracle_sql() -> dict[str, str]:
    return core_sql() | (llm_queries.oracle_sql() if llm_queries else {})


def core_queries() -> dict[str, Query]:
    return {
        # reporting views
        "monthly_sales_summary": _query(_monthly),
        "dealer_scorecard": _stored_query(lambda r: views.scorecard_from_balance(r.dealers, r.balance)),
        "dealer_aging_report": _stored_query(_aging),
        "product_crop_performance": _query(lambda r: views.product_crop_performance(r.products, r.product_lines)),
        "inventory_status": _query(_stock),
        "regional_performance": _query(lambda r: views.regional_performance(r.dealers, r.orders)),
        # load and quality
        "load_row_counts": _query(_row_counts),
        "reload_from_csv": _reload,
        "reload_row_counts": _reload_counts,
        "reload_suite": _reload_suite,
        "refresh_status": _query(lambda r: refresh_status(r.orders)),
        "dq_null_keys": _query(_null_keys),
        "dq_orphans": _query(_orphans),
        "dq_negatives": _query(_negatives),
        "dq_payment_reconciliation": _stored_query(
            lambda r: quality.balance_reconciliation(r.balance, "status contradicts receipts")
        ),
        "dq_domain": _query(_domain),
        "dq_row_bounds": _query(_row_bounds),
        "dq_duplicate_keys": _query(_duplicate_keys),
        "dq_presence": _query(_presence),
        # panels
        "region_list": _query(lambda r: reports.region_list(r.dealers)),
        "dealer_type_list": _query(lambda r: reports.dealer_type_list(r.dealers)),
        "crop_list": _cube_query(lambda c, r: cube.crop_list(c, *GLOBAL)),
        "order_date_bounds": _query(lambda r: reports.order_date_bounds(r.orders)),
        "kpi_summary": _cube_query(lambda c, r: cube.kpi_summary(c, *GLOBAL)),
        "kpi_texts": _cube_query(lambda c, r: reports.kpi_texts(cube.kpi_summary(c, *GLOBAL))),
        "monthly_revenue": _cube_query(lambda c, r: cube.monthly_revenue(c, *GLOBAL)),
        "top_regions": _cube_query(lambda c, r: cube.top_regions(c, *GLOBAL)),
        "top_dealers": _cube_query(lambda c, r: cube.top_dealers(c, r.dealers, *GLOBAL)),
        "dealer_performance": _stored_query(
            lambda r: reports.performance_from_balance(r.dealers, r.balance, REGIONS, DEALER_TYPES)
        ),
        "top_products": _cube_query(
            lambda c, r: reports.top_products(cube.product_revenue(c, r.products, *GLOBAL))
        ),
        "bottom_products": _cube_query(
            lambda c, r: reports.bottom_products(cube.product_revenue(c, r.products, *GLOBAL))
        ),
        "crop_demand_curve": _cube_query(lambda c, r: cube.crop_demand_curve(c, CROP, *GLOBAL)),
        "crop_peak_month": _query(lambda r: reports.crop_peak_month(r.calendar)),
        "stock_overview": _query(lambda r: reports.stock_overview(_stock(r))),
        "low_stock": _query(lambda r: reports.low_stock(_stock(r))),
        "near_expiry": _query(lambda r: reports.near_expiry(r.inventory, r.products, AS_OF)),
        "aging_totals": _stored_query(lambda r: reports.aging_totals(_aging(r))),
        "aging_search": _stored_query(lambda r: reports.aging_search_from_balance(r.dealers, r.balance, AS_OF, TERM)),
        # scheduled reports
        "weekly_summary_recent": _query(lambda r: alerts.weekly_summary_recent(r.orders, r.dealers, AS_OF)),
        "weekly_summary_json": _query(
            lambda r: alerts.as_json(
                alerts.weekly_summary_recent(r.orders, r.dealers, AS_OF).select(
                    "month", "region", "total_revenue", "total_orders"
                )
            )
        ),
        "weekly_regional_json": _query(
            lambda r: alerts.as_json(
                views.regional_performance(r.dealers, r.orders).select("region", "total_revenue", "dealer_count")
            )
        ),
        "low_stock_message": _query(lambda r: alerts.low_stock_message(_stock(r))),
        "overdue_reminders": _stored_query(lambda r: alerts.overdue_reminders(_aging(r))),
        "overdue_message": _stored_query(lambda r: alerts.overdue_message(_aging(r))),
        # demand series
        "top_skus": _query(_top_skus),
        "weekly_demand": _stored_query(
            lambda r: timeseries.weekly_demand(r.lines_of(_top_skus(r)), r.products, r.calendar)
        ),
        "weekly_demand_filled": _stored_query(_series),
        "demand_features": _stored_query(lambda r: timeseries.demand_features(_series(r))),
        "sales_by_season_window": _stored_query(
            lambda r: timeseries.sales_by_season_window(r.lines, r.products, r.calendar)
        ),
        # dealer segments
        "dealer_rfm": _query(lambda r: segments.rfm(r.dealers, r.orders)),
        "rfm_standardised": _query(lambda r: segments.standardise(segments.rfm(r.dealers, r.orders))),
        "dealer_segments": _segment_query(lambda run, r: run.segments),
        "segment_diagnostics": _segment_query(lambda run, r: run.diagnostics),
        "segment_centres": _segment_query(lambda run, r: run.centres),
        "segment_profile": _segment_query(lambda run, r: segments.segment_profile(run.segments)),
        "segment_overview": _segment_query(lambda run, r: reports.segment_overview(run.segments, r.dealers)),
        # forecasts
        "demand_forecast": _forecast_query(lambda run, r: run.results),
        "forecast_model_summary": _forecast_query(lambda run, r: forecast.model_summary(run.scores)),
        "forecast_scores": _forecast_query(lambda run, r: run.scores),
        "forecast_overview": _forecast_query(lambda run, r: reports.forecast_overview(run.results, r.products)),
        "forecast_series": _forecast_query(
            lambda run, r: reports.forecast_series(reports.forecast_overview(run.results, r.products))
        ),
        "dq_result_sanity": lambda spark, folder: _portable(
            quality.union_checks(
                [
                    forecast.forecast_checks(_stored_run("forecast", spark, folder).results),
                    segments.segment_checks(
                        _stored_run("segments", spark, folder).segments, roles_from_star(spark, folder).orders
                    ),
                ]
            )
        ),
        # plain forecasts over several origins, and segments by exact quantiles
        "backtest_forecasts": _run_query("backtest", lambda run, r: run.forecasts),
        "backtest_scores": _run_query("backtest", lambda run, r: run.scores),
        "backtest_results": _run_query("backtest", lambda run, r: run.results),
        "backtest_league": _run_query("backtest", lambda run, r: _rounded(backtest.league(run), "mean_mape")),
        "backtest_overview": _run_query("backtest", lambda run, r: reports.forecast_overview(run.results, r.products)),
        "backtest_series": _run_query(
            "backtest",
            lambda run, r: reports.forecast_series(reports.forecast_overview(run.results.filter("fold = 0"), r.products)),
        ),
        "linear_forecast": lambda spark, folder: _portable(backtest.forecast_linear(_series_of(spark, folder))),
        "band_segments": _run_query("bands", lambda run, r: run.segments),
        "band_centres": _run_query("bands", lambda run, r: _rounded(run.centres, *segments.MEASURES)),
        "band_profile": _run_query(
            "bands",
            lambda run, r: _rounded(segments.segment_profile(run.segments), *(f"mean_{m}" for m in segments.MEASURES)),
        ),
        "band_overview": _run_query("bands", lambda run, r: reports.segment_overview(run.segments, r.dealers)),
        "dq_plain_results": lambda spark, folder: quality.union_checks(
            [
                forecast.forecast_checks(_stored_run("backtest", spark, folder).results.filter("fold = 0")),
                segments.segment_checks(_stored_run("bands", spark, folder).segments, _loaded(spark, folder).orders),
            ]
        ),
        # bounded SQL
        "adhoc_bounded": _adhoc(ADHOC),
        "adhoc_parameters": _adhoc(ADHOC_BOUND, crop=CROP, floor=100),
    }


# Tables of the roles as DuckDB sees them, one WITH item each.
_ROLE_SQL = {
    "dealers": (
        "SELECT c_custkey AS dealer_id, c_name AS dealer_name, c_mktsegment AS dealer_type, r_name AS region, "
        "CAST(c_acctbal AS DECIMAL(12,2)) AS credit_limit FROM customer JOIN nation ON c_nationkey = n_nationkey "
        "JOIN region ON n_regionkey = r_regionkey"
    ),
    "products": (
        "SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS target_crop FROM part"
    ),
    "sales_orders": (
        "SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, o_custkey AS dealer_id, "
        "CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount, CASE o_orderstatus WHEN 'F' THEN 'Paid' "
        "WHEN 'P' THEN 'Partial' WHEN 'O' THEN 'Overdue' END AS payment_status FROM orders"
    ),
    "order_lines": (
        "SELECT l_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, o_custkey AS dealer_id, "
        "l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity, CAST(round(CAST(l_extendedprice AS "
        "DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(12,2)) "
        "AS total_amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    ),
    "payments": (
        "SELECT l_orderkey AS order_id, CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS "
        "DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(12,2)) AS amount_received "
        "FROM lineitem WHERE l_linestatus = 'F'"
    ),
    "inventory": (
        "SELECT l_partkey AS product_id, l_orderkey || '-' || l_linenumber AS batch_no, CAST(l_shipdate AS DATE) "
        "AS expiry_date, CAST(l_quantity AS DECIMAL(12,2)) AS quantity_available, "
        "CAST(l_quantity * 8 AS DECIMAL(12,2)) AS reorder_level FROM lineitem WHERE l_linestatus = 'O'"
    ),
    "crop_calendar": (
        "SELECT crop, r_name AS region, CAST(regexp_extract(crop, '[0-9]+$') AS INTEGER) % 12 + 1 "
        "AS peak_demand_month FROM (SELECT DISTINCT p_brand AS crop FROM part) CROSS JOIN region"
    ),
}

# The views in SQL, built from shared steps.
_VIEW_SQL = {
    "dealer_orders": (
        "SELECT order_id, dealer_id, dealer_name, region, order_date, total_amount, "
        "CAST(date_trunc('month', order_date) AS DATE) AS month FROM sales_orders JOIN dealers USING (dealer_id)"
    ),
    "receipts": "SELECT order_id, sum(amount_received) AS received FROM payments GROUP BY order_id",
    "open_orders": (
        "SELECT order_id, dealer_id, total_amount, payment_status, total_amount - coalesce(received, 0) AS "
        f"outstanding, date_diff('day', order_date, DATE '{AS_OF}') AS age "
        "FROM sales_orders LEFT JOIN receipts USING (order_id)"
    ),
    "monthly": (
        "SELECT month, region, sum(total_amount) AS total_revenue, count(*) AS total_orders, "
        "CAST(sum(total_amount) AS DOUBLE) / count(*) AS avg_order_value FROM dealer_orders GROUP BY month, region"
    ),
    "dealer_sums": (
        "SELECT dealer_id, sum(total_amount) AS total_revenue, count(*) AS orders, sum(outstanding) AS "
        "current_outstanding, CAST(sum(outstanding) * 100 AS HUGEINT) AS owed FROM open_orders GROUP BY dealer_id"
    ),
    # Rounds 100 * owed / allowed half away from zero with whole numbers only.
    "scorecard": (
        "SELECT dealer_id, dealer_name, region, dealer_type, total_revenue, coalesce(orders, 0) AS order_count, "
        "credit_limit, current_outstanding, CASE WHEN allowed <> 0 THEN sign(owed) * sign(allowed) * ((20000 * "
        "abs(owed) + abs(allowed)) // (2 * abs(allowed))) / 100.0 END AS credit_utilization_pct FROM "
        "(SELECT *, CAST(credit_limit * 100 AS HUGEINT) AS allowed FROM dealers) LEFT JOIN dealer_sums "
        "USING (dealer_id)"
    ),
    "aged": (
        "SELECT dealer_id, sum(outstanding) FILTER (age >= 0 AND age <= 30) AS b0, sum(outstanding) FILTER "
        "(age > 30 AND age <= 60) AS b31, sum(outstanding) FILTER (age > 60 AND age <= 90) AS b61, "
        "sum(outstanding) FILTER (age > 90) AS b91 FROM open_orders GROUP BY dealer_id"
    ),
    "aging": (
        "SELECT dealer_id, dealer_name, coalesce(b0, 0) AS outstanding_0_30, coalesce(b31, 0) AS outstanding_31_60, "
        "coalesce(b61, 0) AS outstanding_61_90, coalesce(b91, 0) AS outstanding_90_plus "
        "FROM aged JOIN dealers USING (dealer_id)"
    ),
    "stock_sums": (
        "SELECT product_id, sum(quantity_available) AS quantity_available, max(reorder_level) AS reorder_level, "
        "min(expiry_date) AS first_expiry FROM inventory GROUP BY product_id"
    ),
    "stock": (
        "SELECT product_id, product_name, quantity_available, reorder_level, quantity_available < reorder_level AS "
        f"is_below_reorder, CAST(date_diff('day', DATE '{AS_OF}', first_expiry) AS INTEGER) AS days_to_expiry "
        "FROM stock_sums JOIN products USING (product_id)"
    ),
    "line_sums": (
        "SELECT product_id, sum(total_amount) AS total_revenue, sum(quantity) AS total_quantity_sold "
        "FROM order_lines GROUP BY product_id"
    ),
    "product_sales": (
        "SELECT product_id, product_name, target_crop, total_revenue, total_quantity_sold FROM products "
        "LEFT JOIN line_sums USING (product_id)"
    ),
    "regional": (
        "SELECT region, sum(total_amount) AS total_revenue, count(DISTINCT dealer_id) AS dealer_count "
        "FROM dealer_orders GROUP BY region"
    ),
    "chosen_orders": (
        "SELECT * FROM dealer_orders WHERE region IN ('ASIA', 'EUROPE', 'AMERICA') "
        f"AND order_date >= DATE '{LO}' AND order_date <= DATE '{HI}'"
    ),
    "chosen_lines": "SELECT * FROM order_lines SEMI JOIN chosen_orders USING (order_id)",
    "chosen_products": (
        "SELECT product_id, product_name, target_crop, revenue FROM products JOIN (SELECT product_id, "
        "sum(total_amount) AS revenue FROM chosen_lines GROUP BY product_id) USING (product_id)"
    ),
    "top_skus": (
        "SELECT product_id FROM product_sales ORDER BY total_revenue DESC NULLS LAST, product_id LIMIT 12"
    ),
    "peaks": "SELECT crop, min(peak_demand_month) AS peak_month FROM crop_calendar GROUP BY crop",
    "weekly": (
        "SELECT product_id, ds, CAST(sum(quantity) AS DOUBLE) AS y, any_value(peak_month) AS peak_month FROM "
        "(SELECT product_id, quantity, CAST(date_trunc('week', order_date) AS DATE) AS ds FROM order_lines "
        "SEMI JOIN top_skus USING (product_id)) JOIN products USING (product_id) JOIN peaks ON crop = target_crop "
        "GROUP BY product_id, ds"
    ),
    "weeks": (
        "SELECT product_id, peak_month, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 7 DAY)) AS DATE) "
        "AS ds FROM weekly GROUP BY product_id, peak_month"
    ),
    "series": (
        "SELECT w.product_id, w.ds, coalesce(x.y, 0.0) AS y, w.peak_month, CAST({nearest} AS DOUBLE) AS "
        "days_to_peak_demand, row_number() OVER (PARTITION BY w.product_id ORDER BY w.ds DESC) <= 8 AS is_holdout "
        "FROM weeks w LEFT JOIN weekly x ON x.product_id = w.product_id AND x.ds = w.ds"
    ),
    "dated_orders": (
        "SELECT dealer_id, total_amount, order_date, max(order_date) OVER () AS latest, "
        "order_date >= max(order_date) OVER () - INTERVAL 12 MONTH AS recent FROM sales_orders"
    ),
    "rfm": (
        "SELECT dealer_id, CAST(date_diff('day', max(order_date), any_value(latest)) AS INTEGER) AS recency, "
        "count(*) FILTER (recent) AS frequency, sum(if(recent, total_amount, 0)) AS monetary "
        "FROM dated_orders SEMI JOIN dealers USING (dealer_id) GROUP BY dealer_id"
    ),
    "features": (
        "SELECT *, lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, lag(y, 3) OVER w AS lag_3, lag(y, 4) OVER w AS "
        "lag_4 FROM series WINDOW w AS (PARTITION BY product_id ORDER BY ds)"
    ),
    # every week for each of six folds, eight weeks apart; the last known week has before = 1
    "folds": (
        "SELECT product_id, ds, y, CAST(fold AS INTEGER) AS fold, place - (fold + 1) * 8 AS before FROM (SELECT product_id, "
        "ds, y, row_number() OVER (PARTITION BY product_id ORDER BY ds DESC) AS place FROM series), "
        "(SELECT unnest(range(6)) AS fold) WHERE place - (fold + 1) * 8 > -8"
    ),
    "fold_known": (
        "SELECT product_id, fold, max(y) FILTER (before = 1) AS last, avg(y) AS mean FROM folds WHERE before BETWEEN 1 AND 4 "
        "GROUP BY product_id, fold HAVING count(*) = 4"
    ),
    "plain": (
        "SELECT product_id, fold, ds, y, greatest(last, 0) AS last, greatest(mean, 0) AS mean FROM folds JOIN fold_known "
        "USING (product_id, fold) WHERE before <= 0"
    ),
    "plain_scores": (
        "SELECT *, CASE WHEN last_mape <= mean_mape THEN 'last_week' ELSE 'mean_of_four' END AS model_used FROM (SELECT "
        "product_id, fold, "
        + ", ".join(
            f"round(avg(abs(y - {m}) / greatest(y, 1)) * 100, 9) AS {m}_mape, round(sqrt(avg((y - {m}) * (y - {m}))), 9) "
            f"AS {m}_rmse"
            for m in ("mean", "last")
        )
        + " FROM plain GROUP BY product_id, fold)"
    ),
    "plain_results": (
        "SELECT product_id, fold, model_used, CAST(CASE model_used WHEN 'last_week' THEN last_mape ELSE mean_mape END AS "
        "DECIMAL(10,4)) AS mape, CAST(CASE model_used WHEN 'last_week' THEN last_rmse ELSE mean_rmse END AS DECIMAL(12,4)) "
        "AS rmse, CAST(last_mape AS DECIMAL(10,4)) AS last_mape, CAST(mean_mape AS DECIMAL(10,4)) AS mean_mape, ds AS "
        "forecast_week, CAST(CASE model_used WHEN 'last_week' THEN last ELSE mean END AS DECIMAL(12,2)) AS predicted_qty, "
        "CAST(y AS DECIMAL(12,2)) AS actual_qty FROM plain JOIN plain_scores USING (product_id, fold)"
    ),
    "linear_start": (
        "SELECT product_id, "
        + ", ".join(f"coalesce(arg_min_null(lag_{i}, ds), 0) AS lag_{i}" for i in range(1, 5))
        + " FROM features WHERE is_holdout GROUP BY product_id"
    ),
    "linear_steps": (
        "SELECT product_id, 0 AS step, lag_1, lag_2, lag_3, lag_4 FROM linear_start UNION ALL SELECT product_id, step + 1, "
        "greatest(0, 0.75::DOUBLE * lag_1 + 0.5::DOUBLE * lag_2 - 0.25::DOUBLE * lag_3 - 0.125::DOUBLE * lag_4 - 3), lag_1, "
        "lag_2, lag_3 FROM linear_steps WHERE step < 8"
    ),
    # the exact quarter of each measure, then the sum of the three in five bands
    "quarters": (
        "SELECT *, "
        + ", ".join(
            f"3 - ((rank() OVER (ORDER BY {order} DESC) - 1) * 4) // count(*) OVER () AS q_{m}"
            for m, order in (("recency", "-recency"), ("frequency", "frequency"), ("monetary", "monetary"))
        )
        + " FROM rfm"
    ),
    "banded": (
        "SELECT dealer_id, recency, CAST(frequency AS INTEGER) AS frequency, CAST(monetary AS DECIMAL(14,2)) AS monetary, "
        "CAST(((q_recency + q_frequency + q_monetary) * 5) // 10 AS INTEGER) AS cluster_id FROM quarters"
    ),
    "band_means": (
        "SELECT cluster_id, avg(recency) AS recency, avg(frequency) AS frequency, avg(CAST(monetary AS DOUBLE)) AS monetary "
        "FROM banded GROUP BY cluster_id"
    ),
    "band_shares": (
        "SELECT *, "
        + ", ".join(
            f"(rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0) / count(*) OVER () AS s_{m}"
            for m in ("recency", "frequency", "monetary")
        )
        + " FROM band_means"
    ),
    "band_labels": (
        "SELECT cluster_id, recency, frequency, monetary, CASE WHEN s_recency < 0.4 AND s_frequency > 0.6 AND s_monetary > "
        "0.6 THEN 'Champions' WHEN s_recency > 0.65 AND s_frequency < 0.5 THEN 'At Risk' WHEN s_frequency > 0.6 THEN "
        "'Loyal' WHEN s_recency < 0.5 THEN 'Potential' ELSE 'Needs Attention' END AS segment_label FROM band_shares"
    ),
    "band_dealers": "SELECT * FROM banded JOIN (SELECT cluster_id, segment_label FROM band_labels) USING (cluster_id)",
}


def _nearest_sql(day: str, month: str) -> str:
    """Signed days to the nearest first of the month: least distance, then earlier year."""
    anchors = ", ".join(
        f"make_date(CAST(year({day}) AS INTEGER) + ({k}), CAST({month} AS INTEGER), 1) - {day}" for k in (-1, 0, 1)
    )
    return f"list_sort([struct_pack(a := abs(x), x := x) FOR x IN [{anchors}]])[1].x"


_VIEW_SQL["series"] = _VIEW_SQL["series"].format(nearest=_nearest_sql("w.ds", "w.peak_month"))

_NEEDS = {
    "dealer_orders": ["sales_orders", "dealers"],
    "receipts": ["payments"],
    "open_orders": ["sales_orders", "receipts"],
    "monthly": ["dealer_orders"],
    "dealer_sums": ["open_orders"],
    "scorecard": ["dealers", "dealer_sums"],
    "aged": ["open_orders"],
    "aging": ["aged", "dealers"],
    "stock_sums": ["inventory"],
    "stock": ["products", "stock_sums"],
    "line_sums": ["order_lines"],
    "product_sales": ["products", "line_sums"],
    "regional": ["dealer_orders"],
    "chosen_orders": ["dealer_orders"],
    "chosen_lines": ["order_lines", "chosen_orders"],
    "chosen_products": ["chosen_lines", "products"],
    "top_skus": ["product_sales"],
    "peaks": ["crop_calendar"],
    "weekly": ["order_lines", "products", "peaks", "top_skus"],
    "weeks": ["weekly"],
    "series": ["weeks", "weekly"],
    "dated_orders": ["sales_orders"],
    "rfm": ["dealers", "dated_orders"],
    "features": ["series"],
    "folds": ["series"],
    "fold_known": ["folds"],
    "plain": ["folds", "fold_known"],
    "plain_scores": ["plain"],
    "plain_results": ["plain", "plain_scores"],
    "linear_start": ["features"],
    "linear_steps": ["linear_start"],
    "quarters": ["rfm"],
    "banded": ["quarters"],
    "band_means": ["banded"],
    "band_shares": ["band_means"],
    "band_labels": ["band_shares"],
    "band_dealers": ["banded", "band_labels"],
}


def _with(names: list[str], select: str) -> str:
    """``select`` preceded by the WITH items it needs, in order of need."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    items = ", ".join(f"{n} AS ({_ROLE_SQL.get(n) or _VIEW_SQL[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if 'linear_steps' in order else ''}{items} {select}"


def _money(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)


def _suite_sql() -> str:
    """Every rule of the star tables as a count of failing rows."""

    def count(name: str, table: str, wrong: str) -> str:
        return f"SELECT '{name}' AS check_name, count(*) AS failures FROM {table} WHERE {wrong}"

    checks = []
    for table, ddl in STAR.ddl.items():
        columns = [c.split()[0] for c in ddl.split(", ")]
        checks.append(count(f"{table}: missing required value", table, " OR ".join(f"{c} IS NULL" for c in columns)))
        if table in STAR.strict:
            checks.append(count(f"{table}: missing relationship key", table, " OR ".join(f"{c} IS NULL" for c in STAR.foreign_keys[table])))
        if table in STAR.amounts:
            checks.append(count(f"{table}: negative amount", table, " OR ".join(f"{c} < 0" for c in STAR.amounts[table])))
    for (table, column), allowed in STAR.domains.items():
        checks.append(count(f"{table}.{column}: unknown value", table, f"{column} NOT IN {allowed!r}"))
    for (table, column), (lo, hi) in STAR.ranges.items():
        checks.append(count(f"{table}.{column}: out of range", table, f"{column} NOT BETWEEN {lo} AND {hi}"))
    for table, keys in STAR.primary_keys.items():
        repeated = f"(SELECT 1 FROM {table} GROUP BY {', '.join(keys)} HAVING count(*) > 1)"
        checks.append(count(f"{table}: duplicate key", repeated, "true"))
    for table, references in STAR.foreign_keys.items():
        missing = [f"NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{STAR.primary_keys[parent][0]} = {table}.{key})" for key, parent in references.items()]
        checks.append(count(f"{table}: orphan foreign key", table, " OR ".join(missing)))
    return " UNION ALL ".join(checks)


def core_sql() -> dict[str, str]:
    aging_columns = _money("outstanding_0_30", "outstanding_31_60", "outstanding_61_90", "outstanding_90_plus")
    score_columns = (
        "dealer_id, dealer_name, region, order_count, credit_utilization_pct, "
        + _money("total_revenue", "credit_limit", "current_outstanding")
    )
    stock_columns = "product_id, product_name, is_below_reorder, days_to_expiry, " + _money(
        "quantity_available", "reorder_level"
    )
    monthly_columns = "CAST(month AS VARCHAR) AS month, region, total_orders, avg_order_value, " + _money(
        "total_revenue"
    )
    recent = f"month >= date_trunc('week', DATE '{AS_OF}' - INTERVAL 7 DAY)"
    overdue = "outstanding_61_90 > 0 OR outstanding_90_plus > 0"
    overdue_line = (
        "dealer_name || ': 61-90=' || CAST(CAST(outstanding_61_90 AS DECIMAL(38,2)) AS VARCHAR) || ', 90+=' || "
        "CAST(CAST(outstanding_90_plus AS DECIMAL(38,2)) AS VARCHAR)"
    )
    season = _nearest_sql("order_date", "peak_month")
    result_columns = "product_id, fold, model_used, CAST(forecast_week AS VARCHAR) AS forecast_week, " + _money(
        "mape", "rmse", "last_mape", "mean_mape", "predicted_qty", "actual_qty"
    )
    return {
        "monthly_sales_summary": _with(["monthly"], f"SELECT {monthly_columns} FROM monthly"),
        "dealer_scorecard": _with(["scorecard"], f"SELECT {score_columns} FROM scorecard"),
        "dealer_aging_report": _with(["aging"], f"SELECT dealer_id, dealer_name, {aging_columns} FROM aging"),
        "product_crop_performance": _with(
            ["product_sales"],
            "SELECT product_id, product_name, target_crop, CAST(total_revenue AS DOUBLE) AS total_revenue, "
            "CAST(total_quantity_sold AS BIGINT) AS total_quantity_sold, rank() OVER (PARTITION BY target_crop "
            "ORDER BY total_revenue DESC NULLS FIRST) AS rank_within_crop_category FROM product_sales",
        ),
        "inventory_status": _with(["stock"], f"SELECT {stock_columns} FROM stock"),
        "regional_performance": _with(
            ["regional"],
            "SELECT region, dealer_count, CAST(total_revenue AS DOUBLE) AS total_revenue, CAST(total_revenue AS "
            "DOUBLE) / dealer_count AS avg_revenue_per_dealer FROM regional",
        ),
        "load_row_counts": (
            "SELECT 'dealers' AS table_name, count(*) AS row_count FROM customer "
            "UNION ALL SELECT 'products', count(*) FROM part UNION ALL SELECT 'suppliers', count(*) FROM supplier "
            "UNION ALL SELECT 'sales_orders', count(*) FROM orders "
            "UNION ALL SELECT 'order_lines', count(*) FROM lineitem "
            "UNION ALL SELECT 'payments', count(*) FROM lineitem WHERE l_linestatus = 'F' "
            "UNION ALL SELECT 'inventory', count(*) FROM lineitem WHERE l_linestatus = 'O' "
            "UNION ALL SELECT 'crop_calendar', count(DISTINCT p_brand) * (SELECT count(*) FROM region) FROM part"
        ),
        "reload_from_csv": (
            "SELECT strftime(l_shipdate, '%Y-%m-01') AS month, count(*) AS receipts, CAST(sum(CAST(round(CAST("
            "l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))), 2) AS "
            "DECIMAL(12,2))) AS DOUBLE) AS amount FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1"
        ),
        "reload_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in STAR.ddl),
        "reload_suite": _suite_sql(),
        "refresh_status": (
            "SELECT 'ETL completed; standard views require no refresh' AS status, count(*) AS order_count FROM orders"
        ),
        "dq_null_keys": (
            "SELECT 'orders' AS check_name, count(*) AS failures FROM orders WHERE o_orderkey IS NULL OR o_custkey "
            "IS NULL UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey IS NULL OR l_partkey IS NULL "
            "UNION ALL SELECT 'payments', count(*) FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey IS NULL"
        ),
        "dq_orphans": _with(
            ["dealers"],
            "SELECT 'orders to dealers' AS check_name, count(*) AS failures FROM orders LEFT JOIN dealers ON "
            "o_custkey = dealer_id WHERE dealer_id IS NULL UNION ALL SELECT 'lines to products', count(*) FROM "
            "lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE p_partkey IS NULL UNION ALL SELECT "
            "'payments to orders', count(*) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey "
            "WHERE l_linestatus = 'F' AND o_orderkey IS NULL",
        ),
        "dq_negatives": _with(
            ["sales_orders", "order_lines", "payments", "inventory", "dealers"],
            "SELECT 'orders' AS check_name, count(*) AS failures FROM sales_orders WHERE total_amount < 0 UNION ALL "
            "SELECT 'lines', count(*) FROM order_lines WHERE quantity < 0 OR total_amount < 0 UNION ALL "
            "SELECT 'payments', count(*) FROM payments WHERE amount_received < 0 UNION ALL "
            "SELECT 'inventory', count(*) FROM inventory WHERE quantity_available < 0 OR reorder_level < 0 UNION ALL "
            "SELECT 'dealers', count(*) FROM dealers WHERE credit_limit < 0",
        ),
        "dq_payment_reconciliation": _with(
            ["open_orders"],
            "SELECT 'status contradicts receipts' AS check_name, count(*) FILTER (CASE payment_status WHEN 'Paid' "
            "THEN outstanding <> 0 ELSE outstanding <= 0 END) AS failures FROM open_orders",
        ),
        "dq_domain": _with(
            ["sales_orders", "dealers", "crop_calendar"],
            "SELECT 'payment status' AS check_name, count(*) AS failures FROM sales_orders WHERE payment_status NOT "
            "IN ('Paid', 'Partial', 'Overdue') UNION ALL SELECT 'dealer type', count(*) FROM dealers WHERE dealer_type NOT IN "
            "('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') UNION ALL SELECT 'peak month', count(*) FROM crop_calendar WHERE "
            "peak_demand_month NOT BETWEEN 1 AND 12",
        ),
        "dq_row_bounds": _with(
            ["dealers", "products", "sales_orders", "crop_calendar"],
            " UNION ALL ".join(
                f"SELECT '{name}: rows' AS check_name, CAST(CASE WHEN count(*) BETWEEN {lo} AND {hi} THEN 0 ELSE 1 END "
                f"AS BIGINT) AS failures FROM {table}"
                for (name, (lo, hi)), table in zip(
                    ROW_BOUNDS.items(), ("dealers", "products", "sales_orders", "crop_calendar")
                )
            ),
        ),
        "dq_duplicate_keys": _with(
            ["dealers", "products", "sales_orders", "inventory", "crop_calendar"],
            "SELECT 'dealers' AS check_name, count(*) AS failures FROM (SELECT 1 FROM dealers GROUP BY dealer_id "
            "HAVING count(*) > 1) UNION ALL SELECT 'products', count(*) FROM (SELECT 1 FROM products GROUP BY "
            "product_id HAVING count(*) > 1) UNION ALL SELECT 'orders', count(*) FROM (SELECT 1 FROM sales_orders "
            "GROUP BY order_id HAVING count(*) > 1) UNION ALL SELECT 'inventory batches', count(*) FROM (SELECT 1 "
            "FROM inventory GROUP BY batch_no HAVING count(*) > 1) UNION ALL SELECT 'calendar', count(*) FROM "
            "(SELECT 1 FROM crop_calendar GROUP BY crop, region HAVING count(*) > 1)",
        ),
        "dq_presence": _with(
            ["stock", "sales_orders"],
            "SELECT 'some product is below its reorder level' AS check_name, EXISTS (SELECT 1 FROM stock WHERE "
            "is_below_reorder) AS present UNION ALL SELECT 'some overdue order is older than 90 days', EXISTS "
            f"(SELECT 1 FROM sales_orders WHERE payment_status = 'Overdue' AND order_date < DATE '{AS_OF}' - 90)",
        ),
        "region_list": _with(["dealers"], "SELECT DISTINCT region FROM dealers ORDER BY region"),
        "dealer_type_list": "SELECT DISTINCT c_mktsegment AS dealer_type FROM customer ORDER BY 1",
        "crop_list": _with(
            ["chosen_products"], "SELECT DISTINCT target_crop FROM chosen_products ORDER BY target_crop"
        ),
        "order_date_bounds": _with(
            ["sales_orders"],
            "SELECT CAST(min(order_date) AS VARCHAR) AS lo, CAST(max(order_date) AS VARCHAR) AS hi FROM sales_orders",
        ),
        "kpi_summary": _with(
            ["chosen_orders"],
            "SELECT CAST(coalesce(sum(total_amount), 0) AS DOUBLE) AS revenue, count(*) AS orders, count(DISTINCT "
            "dealer_id) AS dealers, coalesce(CAST(sum(total_amount) AS DOUBLE) / count(*), 0) AS aov "
            "FROM chosen_orders",
        ),
        "kpi_texts": _with(
            ["chosen_orders"],
            "SELECT 'Total revenue' AS metric, '\u20b9' || format('{:,}', CAST(round_even(sum(total_amount), 0) AS "
            "BIGINT)) AS text FROM chosen_orders UNION ALL SELECT 'Total orders', format('{:,}', count(*)) FROM "
            "chosen_orders UNION ALL SELECT 'Active dealers', CAST(count(DISTINCT dealer_id) AS VARCHAR) FROM "
            "chosen_orders UNION ALL SELECT 'Average order value', '\u20b9' || format('{:,}', CAST(round_even("
            "CAST(sum(total_amount) AS DOUBLE) / count(*), 0) AS BIGINT)) FROM chosen_orders",
        ),
        "monthly_revenue": _with(
            ["chosen_orders"],
            "SELECT CAST(month AS VARCHAR) AS month_start, CAST(sum(total_amount) AS DOUBLE) AS revenue "
            "FROM chosen_orders GROUP BY month ORDER BY month",
        ),
        "top_regions": _with(
            ["chosen_orders"],
            "SELECT region, CAST(sum(total_amount) AS DOUBLE) AS revenue FROM chosen_orders GROUP BY region "
            "ORDER BY sum(total_amount) DESC, region LIMIT 5",
        ),
        "top_dealers": _with(
            ["chosen_orders"],
            "SELECT dealer_id, dealer_name, CAST(sum(total_amount) AS DOUBLE) AS revenue FROM chosen_orders GROUP BY "
            "dealer_id, dealer_name ORDER BY sum(total_amount) DESC, dealer_id LIMIT 5",
        ),
        "dealer_performance": _with(
            ["scorecard"],
            f"SELECT {score_columns}, dealer_type FROM scorecard WHERE region IN ('ASIA', 'EUROPE', 'AMERICA') AND "
            "dealer_type IN ('BUILDING', 'MACHINERY') ORDER BY total_revenue DESC",
        ),
        "top_products": _with(
            ["chosen_products"],
            "SELECT product_id, product_name, target_crop, CAST(revenue AS DOUBLE) AS revenue FROM (SELECT * FROM "
            "chosen_products ORDER BY revenue DESC, product_id LIMIT 10)",
        ),
        "bottom_products": _with(
            ["chosen_products"],
            "SELECT product_id, product_name, target_crop, CAST(revenue AS DOUBLE) AS revenue FROM (SELECT * FROM "
            "chosen_products ORDER BY revenue, product_id LIMIT 10)",
        ),
        "crop_demand_curve": _with(
            ["chosen_lines", "products"],
            "SELECT strftime(order_date, '%Y-%m-01') AS month_start, CAST(sum(quantity) AS BIGINT) AS quantity "
            f"FROM chosen_lines JOIN products USING (product_id) WHERE target_crop = '{CROP}' "
            "GROUP BY month_start ORDER BY month_start",
        ),
        "crop_peak_month": _with(["peaks"], "SELECT crop, peak_month AS peak_demand_month FROM peaks"),
        "stock_overview": _with(
            ["stock"], f"SELECT {stock_columns} FROM stock ORDER BY is_below_reorder DESC, days_to_expiry"
        ),
        "low_stock": _with(["stock"], f"SELECT {stock_columns} FROM stock WHERE is_below_reorder"),
        "near_expiry": _with(
            ["inventory", "products"],
            "SELECT product_id, product_name, batch_no, CAST(expiry_date AS VARCHAR) AS expiry_date, "
            "CAST(quantity_available AS DOUBLE) AS quantity_available, "
            f"CAST(date_diff('day', DATE '{AS_OF}', expiry_date) AS INTEGER) AS days_to_expiry FROM inventory "
            f"JOIN products USING (product_id) WHERE expiry_date >= DATE '{AS_OF}' AND "
            f"expiry_date <= DATE '{AS_OF}' + 60",
        ),
        "aging_totals": _with(
            ["aging"],
            "SELECT 'outstanding_0_30' AS bucket, CAST(sum(outstanding_0_30) AS DOUBLE) AS outstanding FROM aging "
            "UNION ALL SELECT 'outstanding_31_60', CAST(sum(outstanding_31_60) AS DOUBLE) FROM aging "
            "UNION ALL SELECT 'outstanding_61_90', CAST(sum(outstanding_61_90) AS DOUBLE) FROM aging "
            "UNION ALL SELECT 'outstanding_90_plus', CAST(sum(outstanding_90_plus) AS DOUBLE) FROM aging",
        ),
        "aging_search": _with(
            ["aging"],
            f"SELECT dealer_id, dealer_name, {aging_columns} FROM aging WHERE regexp_matches(dealer_name, '{TERM}', "
            "'i')",
        ),
        "weekly_summary_recent": _with(["monthly"], f"SELECT {monthly_columns} FROM monthly WHERE {recent}"),
        "weekly_summary_json": _with(
            ["monthly"],
            "SELECT '{\"month\":\"' || month || '\",\"region\":\"' || region || '\",\"total_revenue\":\"' || "
            "CAST(total_revenue AS DECIMAL(38,2)) || '\",\"total_orders\":\"' || total_orders || '\"}' AS json "
            f"FROM monthly WHERE {recent}",
        ),
        "weekly_regional_json": _with(
            ["regional"],
            "SELECT '{\"region\":\"' || region || '\",\"total_revenue\":\"' || CAST(total_revenue AS DECIMAL(38,2)) "
            "|| '\",\"dealer_count\":\"' || dealer_count || '\"}' AS json FROM regional",
        ),
        "low_stock_message": _with(
            ["stock"],
            "SELECT product_id // 1000 AS part, count(*) AS line_count, string_agg(product_name || ': ' || "
            "CAST(CAST(quantity_available AS DECIMAL(38,2)) AS VARCHAR), chr(10) ORDER BY product_id) AS message "
            "FROM stock WHERE is_below_reorder GROUP BY 1",
        ),
        "overdue_reminders": _with(["aging"], f"SELECT dealer_id, {overdue_line} AS reminder FROM aging WHERE {overdue}"),
        "overdue_message": _with(
            ["aging"],
            f"SELECT dealer_id // 1000 AS part, count(*) AS line_count, string_agg({overdue_line}, chr(10) ORDER BY "
            f"dealer_id) AS message FROM aging WHERE {overdue} GROUP BY 1",
        ),
        "top_skus": _with(["top_skus"], "SELECT product_id FROM top_skus"),
        "weekly_demand": _with(["weekly"], "SELECT product_id, CAST(ds AS VARCHAR) AS ds, y, peak_month FROM weekly"),
        "weekly_demand_filled": _with(
            ["series"],
            "SELECT product_id, CAST(ds AS VARCHAR) AS ds, y, peak_month, days_to_peak_demand, is_holdout FROM series",
        ),
        "demand_features": _with(
            ["series"],
            "SELECT product_id, CAST(ds AS VARCHAR) AS ds, y, peak_month, days_to_peak_demand, is_holdout, "
            "lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, lag(y, 3) OVER w AS lag_3, lag(y, 4) OVER w AS "
            "lag_4, (lag(y, 1) OVER w + lag(y, 2) OVER w + lag(y, 3) OVER w + lag(y, 4) OVER w) / 4 AS rolling_4, "
            "CAST(month(ds) AS DOUBLE) AS month FROM series WINDOW w AS (PARTITION BY product_id ORDER BY ds)",
        ),
        "sales_by_season_window": _with(
            ["order_lines", "products", "peaks"],
            "SELECT crop, CASE WHEN until BETWEEN 0 AND 45 THEN 'pre_peak' WHEN until BETWEEN -15 AND -1 THEN "
            "'post_peak' ELSE 'baseline' END AS season_window, count(*) AS line_count, CAST(sum(quantity) AS BIGINT) "
            f"AS total_quantity, CAST(sum(total_amount) AS DOUBLE) AS total_revenue FROM (SELECT *, {season} AS until "
            "FROM order_lines JOIN products USING (product_id) JOIN peaks ON crop = target_crop) GROUP BY 1, 2",
        ),
        "dealer_rfm": _with(
            ["rfm"], "SELECT dealer_id, recency, frequency, CAST(monetary AS DOUBLE) AS monetary FROM rfm"
        ),
        "rfm_standardised": _with(
            ["rfm"],
            "SELECT dealer_id, recency, frequency, CAST(monetary AS DOUBLE) AS monetary, "
            + ", ".join(
                f"round(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 6) AS z_{c}"
                for c in ("recency", "frequency", "monetary")
            )
            + " FROM rfm",
        ),
        "backtest_forecasts": _with(
            ["plain"],
            "SELECT product_id, fold, CAST(ds AS VARCHAR) AS ds, y, last AS yhat, 'last_week' AS model FROM plain UNION ALL "
            "SELECT product_id, fold, CAST(ds AS VARCHAR), y, mean, 'mean_of_four' FROM plain",
        ),
        "backtest_scores": _with(["plain_scores"], "SELECT * FROM plain_scores"),
        "backtest_results": _with(["plain_results"], f"SELECT {result_columns} FROM plain_results"),
        "backtest_league": _with(
            ["plain_scores"],
            "SELECT 'last_week' AS model, count(*) FILTER (model_used = 'last_week') AS wins, round(avg(last_mape), 6) AS "
            "mean_mape FROM plain_scores UNION ALL SELECT 'mean_of_four', count(*) FILTER (model_used = 'mean_of_four'), "
            "round(avg(mean_mape), 6) FROM plain_scores",
        ),
        "backtest_overview": _with(
            ["plain_results", "products"],
            f"SELECT {result_columns}, product_name FROM plain_results JOIN products USING (product_id)",
        ),
        "backtest_series": _with(
            ["plain_results", "products"],
            " UNION ALL ".join(
                f"SELECT product_id, product_name, CAST(forecast_week AS VARCHAR) AS forecast_week, '{c}' AS measure, "
                f"CAST({c} AS DOUBLE) AS quantity FROM plain_results JOIN products USING (product_id) WHERE fold = 0"
                for c in ("actual_qty", "predicted_qty")
            ),
        ),
        "linear_forecast": _with(
            ["features", "linear_steps"],
            "SELECT product_id, CAST(ds AS VARCHAR) AS ds, y, s.lag_1 AS yhat FROM (SELECT product_id, ds, y, row_number() OVER "
            "(PARTITION BY product_id ORDER BY ds) AS step FROM features WHERE is_holdout) JOIN linear_steps s "
            "USING (product_id, step)",
        ),
        "band_segments": _with(
            ["band_dealers"],
            "SELECT CAST(dealer_id AS INTEGER) AS dealer_id, recency, frequency, CAST(monetary AS DOUBLE) AS monetary, "
            "cluster_id, segment_label FROM band_dealers",
        ),
        "band_centres": _with(
            ["band_labels"],
            "SELECT cluster_id, round(recency, 6) AS recency, round(frequency, 6) AS frequency, round(monetary, 6) AS "
            "monetary, segment_label FROM band_labels",
        ),
        "band_profile": _with(
            ["band_dealers"],
            "SELECT segment_label, count(*) AS dealers, round(avg(recency), 6) AS mean_recency, round(avg(frequency), 6) AS "
            "mean_frequency, round(avg(CAST(monetary AS DOUBLE)), 6) AS mean_monetary FROM band_dealers GROUP BY segment_label",
        ),
        "band_overview": _with(
            ["band_dealers", "dealers"],
            "SELECT CAST(dealer_id AS INTEGER) AS dealer_id, recency, frequency, CAST(monetary AS DOUBLE) AS monetary, "
            "cluster_id, segment_label, dealer_name FROM band_dealers JOIN dealers USING (dealer_id)",
        ),
        "dq_plain_results": _with(
            ["plain_results", "band_dealers", "sales_orders"],
            "SELECT 'forecast: negative quantity' AS check_name, count(*) FILTER (predicted_qty IS NULL OR predicted_qty < 0) "
            "AS failures FROM plain_results WHERE fold = 0 UNION ALL SELECT 'forecast: MAPE not finite', count(*) FILTER "
            "(mape IS NULL) FROM plain_results WHERE fold = 0 UNION ALL SELECT 'forecast: duplicate week', count(*) FROM "
            "(SELECT 1 FROM plain_results WHERE fold = 0 GROUP BY product_id, forecast_week HAVING count(*) > 1) UNION ALL "
            "SELECT 'segments: no label', count(*) FILTER (coalesce(segment_label, '') = '') FROM band_dealers UNION ALL "
            "SELECT 'segments: duplicate dealer', count(*) FROM (SELECT 1 FROM band_dealers GROUP BY dealer_id HAVING "
            "count(*) > 1) UNION ALL SELECT 'segments: dealer left out', count(*) FROM (SELECT DISTINCT dealer_id FROM "
            "sales_orders) o ANTI JOIN band_dealers USING (dealer_id) UNION ALL SELECT 'segments: number of clusters', "
            "CAST(CASE WHEN count(DISTINCT cluster_id) BETWEEN 3 AND 5 THEN 0 ELSE 1 END AS BIGINT) FROM band_dealers",
        ),
        "adhoc_parameters": _with(
            ["product_sales"],
            "SELECT product_id, product_name, CAST(total_quantity_sold AS BIGINT) AS total_quantity_sold, "
            "rank_within_crop_category FROM (SELECT *, rank() OVER (PARTITION BY target_crop ORDER BY total_revenue "
            "DESC NULLS FIRST) AS rank_within_crop_category FROM product_sales) WHERE target_crop = "
            f"'{CROP}' AND total_quantity_sold >= 100 ORDER BY total_quantity_sold DESC, product_id LIMIT 200",
        ),
        "adhoc_bounded": _with(
            ["regional", "scorecard"],
            "SELECT r.region, r.dealer_count, s.dealers_over_limit FROM regional r JOIN (SELECT region, count(*) AS "
            "dealers_over_limit FROM scorecard WHERE credit_utilization_pct > 100 GROUP BY region) s ON "
            "r.region = s.region ORDER BY r.region LIMIT 200",
        ),
    }
