"""What the physical plans look like, and that hot keys do not land in one task."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dealerscope.operators import quality
from dealerscope.operators.filters import region_date_filter
from dealerscope.plans import alerts, cube, reports, views
from dealerscope.sources.roles import roles_from_star
from dealerscope.sources.stored import StoredRoles

FITTED = ("segment", "forecast", "dealer_segments", "demand_forecast", "dq_result_sanity")
PLAIN = ("backtest", "linear", "band", "dq_plain")  # their results are stored when they are first asked for
# These read facts that the first of them has stored.
OF_BALANCE = (
    "dealer_scorecard", "dealer_aging_report", "dq_payment_reconciliation", "dealer_performance", "aging_totals",
    "aging_search", "overdue_reminders", "overdue_message",
)
OF_BUCKETS = ("weekly_demand", "weekly_demand_filled", "demand_features", "sales_by_season_window")
OF_CUBE = (
    "kpi_summary", "kpi_texts", "monthly_revenue", "top_regions", "top_dealers", "crop_list", "top_products",
    "bottom_products", "crop_demand_curve",
)
STORED = (*OF_BALANCE, *OF_BUCKETS, *OF_CUBE, "adhoc")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def roles(spark):
    return roles_from_star(spark, SMALL)


@pytest.fixture
def large_everywhere(spark):
    """As on big tables: nothing is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", [n for n in entry.core_queries() if not n.startswith(FITTED)])
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "InPandas" not in plan


def test_filters_and_columns_reach_the_scan(roles):
    plan = plan_of(reports.kpi_summary(roles.orders, roles.dealers, ["ASIA"], "1997-01-01", "1997-12-31"))
    scan = next(line for line in plan.splitlines() if "orders.parquet" in line)
    assert re.search(r"FileScan parquet \[o_custkey#\d+L?,o_totalprice#\d+,o_orderdate#\d+\]", scan)
    assert "GreaterThanOrEqual(o_orderdate" in scan and "LessThan(o_orderdate" in scan


def test_weekly_summary_reads_only_recent_dates(roles):
    plan = plan_of(alerts.weekly_summary_recent(roles.orders, roles.dealers, "2001-08-01"))
    assert "GreaterThanOrEqual(o_orderdate,2001-08-01" in plan


def test_large_dimension_meets_sums_not_rows(large_everywhere, roles):
    plan = plan_of(views.monthly_sales_summary(roles.orders, roles.dealers))
    before_join = plan[plan.index("SortMergeJoin") : plan.index("orders.parquet")]
    assert "partial_sum" in before_join


def test_line_totals_do_not_read_the_order_headers(roles):
    plan = plan_of(views.product_sales(roles.products, roles.product_lines))
    assert "orders.parquet" not in plan and plan.count("lineitem.parquet") == 1


def _shuffled_after(plan, key, partial):
    """Whether some exchange on ``key`` takes its rows from a partial aggregate."""
    lines = plan.splitlines()
    return any(
        f"Exchange hashpartitioning({key}#" in line and partial in below for line, below in zip(lines, lines[1:])
    )


def _skewed_orders(spark, n=60_000):
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500)
    return spark.range(n).select(
        F.col("id").alias("order_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("order_date"),
        hot.cast("int").alias("dealer_id"),
        F.lit(1).cast("decimal(12,2)").alias("total_amount"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )


def _dealers(spark):
    return spark.range(500).select(
        F.col("id").cast("int").alias("dealer_id"),
        F.concat(F.lit("region "), (F.col("id") % 4).cast("string")).alias("region"),
        F.concat(F.lit("dealer "), F.col("id")).alias("dealer_name"),
        F.lit(10).cast("decimal(12,2)").alias("credit_limit"),
    )


def test_hot_dealer_is_split_by_the_adaptive_join(spark, large_everywhere, tmp_path):
    path = str(tmp_path / "orders")
    _skewed_orders(spark).write.parquet(path)
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "12",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = spark.read.parquet(path).transform(region_date_filter(_dealers(spark), ["region 0", "region 1"]))
        result = rows.groupBy("order_date").agg(F.count("payload").alias("n"))
        total = sum(r.n for r in result.collect())
        plan = plan_of(result)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert "skew=true" in plan
    expected = sum(1 for i in range(60_000) if (0 if i % 3 == 0 else i % 500) % 4 in (0, 1))
    assert total == expected


def test_hot_dealer_arrives_as_partial_sums(spark, large_everywhere):
    """A third of the rows has one key; what is shuffled is a few rows per input split."""
    orders = _skewed_orders(spark).drop("payload")
    result = views.regional_performance(_dealers(spark), orders)
    rows = {r.region: r for r in result.collect()}
    assert sum(r.total_revenue for r in rows.values()) == 60_000
    plan = plan_of(result)
    assert _shuffled_after(plan, "dealer_id", "partial_sum")


def test_orphan_check_joins_keys_not_rows(spark, large_everywhere):
    plan = plan_of(quality.orphans(_skewed_orders(spark).drop("payload"), {"dealer_id": _dealers(spark)}, "x"))
    assert _shuffled_after(plan, "dealer_id", "partial_count")
    assert plan.count("Range (0, 60000") == 1


@pytest.mark.parametrize("name", [n for n in entry.core_queries() if not n.startswith((*FITTED, *PLAIN, *STORED, "reload_"))])
def test_composing_a_plain_query_starts_no_job(spark, name):
    tracker = spark.sparkContext.statusTracker()
    group = f"compose {name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        entry.core_queries()[name](spark, SMALL)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(tracker.getJobIdsForGroup(group)) == []


def test_dealer_choice_reaches_the_facts(spark, large_everywhere, roles):
    plan = plan_of(reports.dealer_performance(roles.dealers, roles.orders, roles.payments, ["ASIA"], ["BUILDING"]))
    sums = [plan[m.start() :] for m in re.finditer("partial_sum", plan)]
    assert sums and all("LeftSemi" in below for below in sums)


def test_calendar_follows_the_region_table(spark, tmp_path):
    regions = spark.createDataFrame([(k, f"R{k}") for k in (0, 7, 10, 11, 12, 40)], "r_regionkey INT, r_name STRING")
    regions.write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([("Brand#11",), ("Brand#25",)], "p_brand STRING").write.parquet(f"{tmp_path}/part.parquet")
    rows = roles_from_star(spark, str(tmp_path)).calendar.collect()
    assert {(r.crop, r.region) for r in rows} == {(b, f"R{k}") for b in ("Brand#11", "Brand#25") for k in (0, 7, 10, 11, 12, 40)}


@pytest.mark.parametrize("name", OF_BALANCE)
def test_receivables_read_the_stored_balance_only(spark, name):
    """Orders and receipts are joined once, when the balance is stored; no report reads a fact again."""
    plan = plan_of(entry.queries()[name](spark, SMALL))
    assert "lineitem" not in plan and "orders.parquet" not in plan and "order_id" not in plan
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "order_date" in line or "outstanding#" in line and "FileScan" in line]
    assert "FileScan parquet" in plan and len(scans) <= 1


def test_the_balance_is_written_once(spark):
    first = entry._loaded(spark, SMALL).balance
    for name in OF_BALANCE:
        entry.queries()[name](spark, SMALL)
    assert entry._loaded(spark, SMALL).balance is first


@pytest.fixture
def only_a_few_rows_are_small(spark):
    """The dozen best sellers may be broadcast, no table may."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1024")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", OF_BUCKETS)
def test_lines_meet_their_headers_without_an_exchange(spark, only_a_few_rows_are_small, name):
    plan = plan_of(entry.queries()[name](spark, SMALL))
    assert "SelectedBucketsCount" in plan
    assert not re.search(r"Exchange hashpartitioning\(order_id", plan)


def test_a_hot_order_meets_its_header_by_broadcast(spark, roles):
    """A third of the lines lies in one order: they are in no bucket, and the rows are those of the plain join."""
    lines = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 4000).alias("order_id"),
        (F.col("id") % 11).alias("product_id"), F.lit(1).alias("quantity"), F.lit(2).cast("decimal(12,2)").alias("total_amount"),
    )
    orders = spark.range(3500).select(
        F.col("id").alias("order_id"), F.lit("2024-01-01").cast("date").alias("order_date"), (F.col("id") % 5).alias("dealer_id"),
        F.lit(3).cast("decimal(12,2)").alias("total_amount"), F.lit("Paid").alias("payment_status"),
    )

    class Plain:
        dealers = products = suppliers = payments = inventory = calendar = None

    source = Plain()
    source.orders, source.product_lines = orders, lines
    stored = StoredRoles(source, spark, buckets=5)
    assert [r.order_id for r in stored._hot_orders.collect()] == [7]
    assert stored._usual_lines.filter("order_id = 7").count() == 0
    assert stored.product_lines.exceptAll(lines).isEmpty() and lines.exceptAll(stored.product_lines).isEmpty()
    plain = lines.join(orders.select("order_id", "order_date", "dealer_id"), "order_id").select(stored.lines.columns)
    assert plain.exceptAll(stored.lines).isEmpty() and stored.lines.exceptAll(plain).isEmpty()
    few = spark.createDataFrame([(3,)], "product_id LONG")
    assert stored.lines_of(few).count() == plain.filter("product_id = 3").count()


@pytest.mark.parametrize("name", OF_CUBE)
def test_sales_panels_read_their_cells_only(spark, name):
    plan = plan_of(entry.queries()[name](spark, SMALL))
    assert "lineitem" not in plan and "orders.parquet" not in plan and "order_id" not in plan
    cells = [line for line in plan.splitlines() if "FileScan parquet" in line and "grain" in line]
    assert len(cells) == 1
    assert re.search(r"PartitionFilters: \[[^]]*grain#\d+ = ", cells[0])
    assert "GreaterThanOrEqual(or" in cells[0]  # the plan text is cut


def test_cube_panels_equal_the_panels_of_the_facts(spark, roles):
    cells = cube.store_cube(roles)
    for choice in ((None, None, None), (["ASIA"], "1996-01-01", None), (["EUROPE", "AFRICA"], None, "1999-06-30"), (["NOWHERE"], None, None)):
        plain = reports.product_revenue(roles.lines, roles.dealers, roles.products, *choice)
        pairs = [
            (cube.kpi_summary(cells, *choice), reports.kpi_summary(roles.orders, roles.dealers, *choice)),
            (cube.monthly_revenue(cells, *choice), reports.monthly_revenue(roles.orders, roles.dealers, *choice)),
            (cube.top_regions(cells, *choice), reports.top_regions(roles.orders, roles.dealers, *choice)),
            (cube.top_dealers(cells, roles.dealers, *choice), reports.top_dealers(roles.orders, roles.dealers, *choice)),
            (cube.product_revenue(cells, roles.products, *choice).orderBy("product_id"), plain.orderBy("product_id")),
            (cube.crop_list(cells, *choice), reports.crop_list(plain)),
            (cube.crop_demand_curve(cells, "Brand#12", *choice), reports.crop_demand_curve(roles.lines, roles.dealers, roles.products, "Brand#12", *choice)),
        ]
        for ours, theirs in pairs:
            assert ours.collect() == theirs.select(ours.columns).collect()
    types = ["BUILDING", "MACHINERY"]
    some = roles.dealers.filter(F.col("dealer_type").isin(types))
    assert cube.kpi_summary(cells, ["ASIA"], types=types).collect() == reports.kpi_summary(roles.orders, some, ["ASIA"]).collect()
