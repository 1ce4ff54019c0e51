import datetime as dt

import pytest
from conftest import day
from pyspark.sql import functions as F

from dealerscope.functions.dates import days_to_peak, season_window
from dealerscope.plans import timeseries as ts


def test_top_skus_skip_unsold_and_break_ties_by_id(spark):
    df = spark.createDataFrame([(3, 5.0), (1, None), (2, 5.0), (4, 9.0)], "product_id INT, total_revenue DOUBLE")
    assert [r.product_id for r in ts.top_skus(df, 3).collect()] == [4, 2, 3]
    assert [r.product_id for r in ts.top_skus(df, 4).collect()] == [4, 2, 3, 1]


def test_weekly_demand_does_not_multiply_by_calendar_regions(make):
    calendar = make.calendar(("Rice", "North", 7), ("Rice", "South", 6), ("Rice", "West", 8))
    products = make.products((1, "a", "Rice"), (2, "b", "Rice"))
    lines = make.lines(
        (1, "2024-01-01", 1, 1, 5, 1), (2, "2024-01-07", 1, 1, 7, 1), (3, "2024-01-08", 1, 1, 2, 1),
        (4, "2024-01-08", 1, 2, 9, 1),
    )
    skus = make.spark.createDataFrame([(1,)], "product_id INT")
    rows = ts.weekly_demand(lines, products, calendar, skus).collect()
    assert sorted((r.product_id, str(r.ds), r.y, r.peak_month) for r in rows) == [
        (1, "2024-01-01", 12.0, 6), (1, "2024-01-08", 2.0, 6),
    ]
    assert ts.weekly_demand(lines, products, calendar).count() == 3


def test_numbers_given_as_text(spark):
    rows = [("7", day("2024-01-01"), "2.5", "6"), ("7", day("2024-01-08"), "n/a", "x"), ("7", day("2024-01-15"), None, "")]
    df = spark.createDataFrame(rows, "product_id STRING, ds DATE, y STRING, peak_month STRING")
    typed = ts.typed_weekly(df).orderBy("ds").collect()
    assert [(r.product_id, r.y, r.peak_month) for r in typed] == [(7, 2.5, 6), (7, 0.0, None), (7, 0.0, None)]
    bad = spark.createDataFrame([("seven", day("2024-01-01"), "1", "6")], df.schema)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ts.typed_weekly(bad).collect()


def test_gap_of_three_weeks_is_filled_with_zeros(make):
    rows = ts.fill_weeks(make.weekly((1, "2024-01-01", 4, 6), (1, "2024-01-29", 5, 6), (2, "2024-01-08", 1, 3))).collect()
    assert sorted((r.product_id, str(r.ds), r.y, r.peak_month) for r in rows) == [
        (1, "2024-01-01", 4.0, 6), (1, "2024-01-08", 0.0, 6), (1, "2024-01-15", 0.0, 6), (1, "2024-01-22", 0.0, 6),
        (1, "2024-01-29", 5.0, 6), (2, "2024-01-08", 1.0, 3),
    ]


def test_sundays_are_anchored_to_their_monday(make):
    start = day("2024-06-09")  # a Sunday
    weeks = [(p, str(start + dt.timedelta(weeks=i)), 5 * i + p, 10) for p in (4, 9, 11) for i in range(13)]
    rows = ts.mark_holdout(ts.with_days_to_peak(ts.fill_weeks(make.weekly(*weeks)))).collect()
    assert len(rows) == 39 and all(r.ds.weekday() == 0 and r.y >= r.product_id for r in rows)
    for product in (4, 9, 11):
        held = sorted(r.ds for r in rows if r.product_id == product and r.is_holdout)
        assert held == sorted(r.ds for r in rows if r.product_id == product)[-8:]


@pytest.mark.parametrize(("weeks", "held"), [(5, 5), (8, 8), (9, 8)])
def test_holdout_is_the_last_eight_weeks(make, weeks, held):
    series = make.weekly(*((1, str(day("2024-01-01") + dt.timedelta(weeks=i)), 1, 6) for i in range(weeks)))
    assert ts.mark_holdout(series).filter("is_holdout").count() == held


def _nearest(date, month):
    anchors = [dt.date(date.year + k, month, 1) for k in (-1, 0, 1)]
    return min(((a - date).days for a in anchors), key=abs)


def test_days_to_peak_against_brute_force(spark):
    days = [day("2023-12-20") + dt.timedelta(days=3 * i) for i in range(260)]
    rows = [(d, m) for d in days for m in range(1, 13)]
    df = spark.createDataFrame(rows, "d DATE, m INT").withColumn("x", days_to_peak(F.col("d"), F.col("m")))
    assert all(r.x == _nearest(r.d, r.m) for r in df.collect())


def test_days_to_peak_tie_takes_the_earlier_peak(spark):
    # 1 July 2023 and 1 July 2024 are 366 days apart: 31 December 2023 is 183 from either
    df = spark.createDataFrame([(day("2023-12-31"), 7), (day("2024-12-30"), 1)], "d DATE, m INT")
    values = [r.x for r in df.withColumn("x", days_to_peak(F.col("d"), F.col("m"))).collect()]
    assert values == [-183, 2]


def test_season_windows(spark):
    df = spark.createDataFrame([(d,) for d in (-16, -15, -1, 0, 45, 46, None)], "d INT")
    assert [r.w for r in df.select(season_window(F.col("d")).alias("w")).collect()] == [
        "baseline", "post_peak", "post_peak", "pre_peak", "pre_peak", "baseline", "baseline",
    ]


def test_features_are_null_until_four_weeks_are_known(make):
    series = ts.mark_holdout(ts.with_days_to_peak(make.weekly(
        *((1, str(day("2024-01-01") + dt.timedelta(weeks=i)), i, 6) for i in range(6)),
        (2, "2024-01-01", 100, 6),
    )))
    rows = ts.demand_features(series).filter("product_id = 1").orderBy("ds").collect()
    assert [r.rolling_4 for r in rows] == [None, None, None, None, 1.5, 2.5]
    assert [r.lag_1 for r in rows] == [None, 0, 1, 2, 3, 4]
    assert [r.lag_4 for r in rows] == [None, None, None, None, 0, 1]
    assert {r.month for r in rows} == {1.0, 2.0}
    other = ts.demand_features(series).filter("product_id = 2").first()
    assert other.lag_1 is None and other.rolling_4 is None


def test_filled_weeks_span_first_to_last(make):
    weekly = make.weekly(*((p, str(day("2022-01-03") + dt.timedelta(weeks=p * i)), 1, 6) for p in (1, 2, 5) for i in range(9)))
    counts = {r.product_id: r["count"] for r in ts.fill_weeks(weekly).groupBy("product_id").count().collect()}
    assert counts == {1: 9, 2: 17, 5: 41}


def test_sales_by_season_window(make):
    calendar = make.calendar(("Rice", "North", 7), ("Wheat", "North", 1))
    products = make.products((1, "a", "Rice"), (2, "b", "Wheat"))
    lines = make.lines(
        (1, "2024-06-20", 1, 1, 5, 10), (2, "2024-06-21", 1, 1, 1, 10), (3, "2024-07-03", 1, 1, 2, 7),
        (4, "2024-03-01", 1, 2, 3, 9),
    )
    rows = ts.sales_by_season_window(lines, products, calendar).collect()
    assert sorted((r.crop, r.season_window, r.line_count, r.total_quantity, float(r.total_revenue)) for r in rows) == [
        ("Rice", "post_peak", 1, 2, 7.0), ("Rice", "pre_peak", 2, 6, 20.0), ("Wheat", "baseline", 1, 3, 9.0),
    ]
