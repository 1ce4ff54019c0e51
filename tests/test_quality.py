from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from dealerscope.functions.dates import as_date
from dealerscope.operators import quality as q


def failures(df):
    return {r.check_name: r.failures for r in df.collect()}


def test_row_checks_count_each_rule_in_one_scan(spark):
    df = spark.createDataFrame([(1, -1, "x"), (None, 2, None), (3, None, "z")], "a INT, b INT, c STRING")
    checks = q.row_checks(
        df,
        {
            "keys: a.b missing": q.is_missing(["a"]),
            "negative": q.is_negative(["b"]),
            "domain": q.outside_domain("c", ["x", "y"]),
            "range": q.outside_range("a", 1, 2),
        },
    )
    assert failures(checks) == {"keys: a.b missing": 1, "negative": 1, "domain": 1, "range": 1}


def test_row_checks_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "a INT")
    assert failures(q.row_checks(empty, {"missing": q.is_missing(["a"])})) == {"missing": 0}


def test_orphans_count_rows_not_keys_and_include_nulls(spark):
    child = spark.createDataFrame(
        [(1, 10), (1, 99), (2, 10), (7, 99), (7, 10), (None, 10)], "dealer_id INT, product_id INT"
    )
    dealers = spark.createDataFrame([(1,), (2,), (2,)], "dealer_id INT")
    products = spark.createDataFrame([(10,)], "product_id INT")
    both = q.orphans(child, {"dealer_id": dealers, "product_id": products}, "both")
    assert failures(both) == {"both": 4}
    assert failures(q.orphans(child, {"product_id": products}, "p")) == {"p": 2}
    assert failures(q.orphans(child.limit(0), {"product_id": products}, "p")) == {"p": 0}


@pytest.mark.parametrize(
    ("status", "total", "received", "bad"),
    [
        ("Paid", 100, [60, 40], 0), ("Paid", 100, [99.99], 1), ("Paid", 100, [100.01], 1), ("Paid", 0, [], 0),
        ("Partial", 100, [99.99], 0), ("Partial", 100, [100], 1), ("Overdue", 100, [], 0), ("Overdue", 100, [101], 1),
        ("Overdue", 0, [], 1),
    ],
)
def test_reconciliation(make, status, total, received, bad):
    orders = make.orders((1, "2024-01-01", 1, total, status))
    payments = make.payments(*((1, r) for r in received), (2, 5))
    assert failures(q.reconciliation(orders, payments, "r")) == {"r": bad}


def test_duplicate_keys_single_and_composite(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("b", 1)], "k STRING, n INT")
    assert failures(q.duplicate_keys(df, ["k"], "k")) == {"k": 2}
    assert failures(q.duplicate_keys(df, ["k", "n"], "kn")) == {"kn": 1}


def test_count_bounds(spark):
    df = spark.range(70)
    assert failures(q.count_between(df, 70, 70, "n")) == {"n": 0}
    assert failures(q.count_between(df, 71, 80, "n")) == {"n": 1}


def test_presence(make, spark):
    status = spark.createDataFrame([(1, False), (2, None)], "product_id INT, is_below_reorder BOOLEAN")
    assert q.low_stock_present(status).first().present is False
    orders = make.orders((1, "2024-01-01", 1, 1, "Overdue"), (2, "2023-01-01", 1, 1, "Paid"))
    assert q.old_overdue_present(orders, as_date("2024-03-31")).first().present is False  # 90 days exactly
    assert q.old_overdue_present(orders, as_date("2024-04-01")).first().present is True


def test_require_clean(spark):
    results = spark.createDataFrame([("a", 0), ("b", 3)], "check_name STRING, failures BIGINT")
    with pytest.raises(q.QualityError, match=r"b \(3 rows\)"):
        q.require_clean(results)
    q.require_clean(results.filter("failures = 0"))


def test_money_type_of_receipts(make):
    from dealerscope.operators.rollups import receipts_by_order

    assert receipts_by_order(make.payments((1, 1.1), (1, 2.2))).first().received == D("3.30")


def test_orphans_are_joined_to_each_parent_once(spark):
    """A combination of keys is dealt for its count and for each parent, not twice for each."""
    child = spark.range(200).selectExpr("id % 7 AS a", "id % 5 AS b", "id % 3 AS c")
    parents = {k: spark.range(n).select(F.col("id").alias(k)) for k, n in (("a", 6), ("b", 5), ("c", 2))}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        checked = q.orphans(child, parents, "x")
        plan = checked._jdf.queryExecution().executedPlan().toString()
        assert failures(checked) == {"x": sum(i % 7 == 6 or i % 3 == 2 for i in range(200))}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 3
    assert plan.count("Exchange hashpartitioning") == 1 + 2 * 3  # the counts; rows and keys of each parent
