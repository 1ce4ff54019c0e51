from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from dealerscope.operators.filters import region_date_filter
from dealerscope.plans import alerts, reports, views

DEALERS = [
    (1, "Asha Agro", "North", 1000, "Retailer"),
    (2, "Binod (Seeds)", "South", 100, "Distributor"),
    (3, "Asha Agro", "North", 500, "Distributor"),
    (4, None, "North", 500, "Retailer"),
]
ORDERS = [
    (1, "2024-01-10", 1, 100, "Paid"),
    (2, "2024-02-10", 2, 300, "Paid"),
    (3, "2024-02-20", 3, 80, "Paid"),
    (4, "2024-03-10", 1, 40, "Paid"),
]


def test_region_list_and_bounds(make):
    assert [r.region for r in reports.region_list(make.dealers(*DEALERS)).collect()] == ["North", "South"]
    bounds = reports.order_date_bounds(make.orders(*ORDERS)).first()
    assert (str(bounds.lo), str(bounds.hi)) == ("2024-01-10", "2024-03-10")


@pytest.mark.parametrize(
    ("regions", "lo", "hi", "expected"),
    [
        (None, None, None, [1, 2, 3, 4]),
        (["North"], "2024-01-10", "2024-02-20", [1, 3]),
        (["North", "South"], "2024-02-10", "2024-02-10", [2]),
        ([], None, None, []),
        (["O'Brien"], None, None, []),
    ],
)
def test_global_filter(make, regions, lo, hi, expected):
    rows = make.orders(*ORDERS).transform(region_date_filter(make.dealers(*DEALERS), regions, lo, hi))
    assert sorted(r.order_id for r in rows.collect()) == expected


def test_kpis(make):
    orders, dealers = make.orders(*ORDERS), make.dealers(*DEALERS)
    row = reports.kpi_summary(orders, dealers, ["North"]).first()
    assert (row.revenue, row.orders, row.dealers, row.aov) == (D("220.00"), 3, 2, 220 / 3)
    empty = reports.kpi_summary(orders, dealers, []).first()
    assert (empty.revenue, empty.orders, empty.dealers, empty.aov) == (0, 0, 0, 0.0)


def test_monthly_revenue_and_top_lists(make):
    orders, dealers = make.orders(*ORDERS), make.dealers(*DEALERS)
    monthly = reports.monthly_revenue(orders, dealers, ["North"]).collect()
    assert [(str(r.month_start), r.revenue) for r in monthly] == [
        ("2024-01-01", D("100.00")), ("2024-02-01", D("80.00")), ("2024-03-01", D("40.00")),
    ]
    assert [r.region for r in reports.top_regions(orders, dealers, n=1).collect()] == ["South"]
    top = reports.top_dealers(orders, dealers).collect()
    assert [(r.dealer_id, r.revenue) for r in top] == [(2, D("300.00")), (1, D("140.00")), (3, D("80.00"))]


def test_dealer_performance_filters_regions_and_types(make):
    rows = reports.dealer_performance(
        make.dealers(*DEALERS), make.orders(*ORDERS), make.payments(), ["North"], ["Retailer"]
    ).collect()
    assert [(r.dealer_id, r.dealer_type) for r in rows] == [(1, "Retailer"), (4, "Retailer")]


def test_products_top_bottom_and_curve(make):
    products = make.products(*((i, "same name", "Rice" if i % 2 else "Wheat") for i in range(1, 16)))
    lines = make.lines(*((i, f"2024-0{1 + i % 2}-05", 1, i, i, 10 * (i // 2)) for i in range(1, 14)))
    dealers = make.dealers(*DEALERS)
    revenue = reports.product_revenue(lines, dealers, products)
    assert [r.product_id for r in reports.top_products(revenue, 3).collect()] == [12, 13, 10]
    assert [r.product_id for r in reports.bottom_products(revenue, 3).collect()] == [1, 2, 3]
    curve = reports.crop_demand_curve(lines, dealers, products, "Rice", ["North"]).collect()
    assert [(str(r.month_start), r.quantity) for r in curve] == [("2024-02-01", 1 + 3 + 5 + 7 + 9 + 11 + 13)]


def test_crop_peak_is_the_earliest_of_the_regions(make):
    calendar = make.calendar(("Rice", "North", 7), ("Rice", "South", 6), ("Wheat", "North", 10))
    assert sorted((r.crop, r.peak_demand_month) for r in reports.crop_peak_month(calendar).collect()) == [
        ("Rice", 6), ("Wheat", 10),
    ]
    assert reports.crop_peak_month(calendar, "Wheat").count() == 1


def test_stock_panels(make):
    products = make.products((1, "a", "R"), (2, "b", "R"), (3, "c", "R"))
    inventory = make.inventory(
        (1, "x", "2024-06-29", 10, 5), (1, "y", "2024-06-30", 10, 5), (2, "z", "2024-08-29", 1, 5),
        (3, "w", "2024-08-30", 1, 5),
    )
    status = views.inventory_status(products, inventory, "2024-06-30")
    assert [r.product_id for r in reports.stock_overview(status).collect()] == [2, 3, 1]
    assert [r.product_id for r in reports.low_stock(status).collect()] == [2, 3]
    near = reports.near_expiry(inventory, products, "2024-06-30").collect()
    assert [(r.batch_no, r.days_to_expiry) for r in near] == [("y", 0), ("z", 60)]


def _aging(make):
    return make.spark.createDataFrame(
        [(1, "Asha Agro", D("1.00"), D("0.00"), D("0.00"), D("2.00")),
         (2, "BINOD (Seeds)", D("1.50"), D("1.00"), D("3.00"), D("-1.00")),
         (1500, None, D("0.00"), D("9.00"), D("0.00"), D("0.00"))],
        "dealer_id INT, dealer_name STRING, outstanding_0_30 DECIMAL(38,2), outstanding_31_60 DECIMAL(38,2), "
        "outstanding_61_90 DECIMAL(38,2), outstanding_90_plus DECIMAL(38,2)",
    )


def test_aging_totals_long_form(make):
    rows = {r.bucket: r.outstanding for r in reports.aging_totals(_aging(make)).collect()}
    assert rows == {
        "outstanding_0_30": D("2.50"), "outstanding_31_60": D("10.00"),
        "outstanding_61_90": D("3.00"), "outstanding_90_plus": D("1.00"),
    }


@pytest.mark.parametrize(
    ("term", "ids"), [("", [1, 2]), ("asha", [1]), ("binod", [2]), (r"\(seeds\)", [2]), ("^agro", []), ("a.ha", [1])]
)
def test_aging_search(make, term, ids):
    dealers = make.dealers((1, "Asha Agro", "North", 10, "Retailer"), (2, "Binod (Seeds)", "North", 10, "Retailer"), (3, None, "North", 1, "Retailer"))
    orders = make.orders(*((i, "2024-01-05", i, 5, "Overdue") for i in (1, 2, 3)))
    found = reports.aging_search(dealers, orders, make.payments((1, 2), (2, 1)), "2024-01-20", term).collect()
    assert {r.dealer_id: r.outstanding_0_30 for r in found} == {i: D("3.00") if i == 1 else D("4.00") for i in ids}


def test_overdue_reminders_and_message(make):
    aging = _aging(make)
    lines = {r.dealer_id: r.reminder for r in alerts.overdue_reminders(aging).collect()}
    assert lines == {1: "Asha Agro: 61-90=0.00, 90+=2.00", 2: "BINOD (Seeds): 61-90=3.00, 90+=-1.00"}
    parts = alerts.overdue_message(aging).collect()
    assert [(p.part, p.line_count, p.message) for p in parts] == [(0, 2, lines[1] + "\n" + lines[2])]


def test_low_stock_message_parts_hold_every_line_in_key_order(make):
    status = make.spark.createDataFrame(
        [(i, f"p{i}", D("1.50"), i % 3 != 0) for i in (5, 12, 7, 3, 25, 8, 10)],
        "product_id INT, product_name STRING, quantity_available DECIMAL(38,2), is_below_reorder BOOLEAN",
    )
    parts = alerts.low_stock_message(status, ids_per_part=10).orderBy("part").collect()
    assert [p.message for p in parts] == ["p5: 1.50\np7: 1.50\np8: 1.50", "p10: 1.50", "p25: 1.50"]


@pytest.mark.parametrize(
    ("as_of", "months"),
    [
        ("2024-04-10", ["2024-04-01", "2024-05-01"]),  # last week's Monday is 1 April itself
        ("2024-04-17", ["2024-05-01"]),
        ("2024-05-07", ["2024-05-01"]),  # Monday 29 April
        ("2024-05-14", []),  # Monday 6 May
        ("2024-01-03", ["2024-01-01", "2024-04-01", "2024-05-01"]),  # Monday 25 December
    ],
)
def test_weekly_summary_months(make, as_of, months):
    orders = make.orders(
        (1, "2023-12-31", 1, 1, "Paid"), (2, "2024-01-01", 1, 1, "Paid"), (3, "2024-04-30", 1, 1, "Paid"),
        (4, "2024-05-01", 1, 1, "Paid"),
    )
    dealers = make.dealers(*DEALERS)
    rows = alerts.weekly_summary_recent(orders, dealers, as_of).collect()
    assert sorted(str(r.month) for r in rows) == months
    # the same as filtering the whole summary by its month
    monday = F.trunc(F.date_sub(F.lit(as_of).cast("date"), 7), "week")
    whole = views.monthly_sales_summary(orders, dealers).filter(F.col("month") >= monday)
    assert sorted(whole.collect()) == sorted(rows)


def test_rows_as_json(make):
    df = views.regional_performance(make.dealers(*DEALERS), make.orders((1, "2024-01-01", 2, 12.5, "Paid")))
    assert alerts.as_json(df).first().json == (
        '{"region":"South","total_revenue":"12.50","dealer_count":"1","avg_revenue_per_dealer":"12.5"}'
    )


def test_kpi_texts(make):
    kpis = reports.kpi_summary(make.orders((1, "2024-01-10", 1, "1234567.50", "Paid")), make.dealers(*DEALERS))
    assert {r.metric: r.text for r in reports.kpi_texts(kpis).collect()} == {
        "Total revenue": "₹1,234,568", "Total orders": "1", "Active dealers": "1", "Average order value": "₹1,234,568",
    }
