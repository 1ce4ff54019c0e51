from decimal import Decimal as D


from dealerscope.plans import views

DEALERS = [
    (1, "Asha", "North", 1000, "Retailer"),
    (2, "Binod", "North", 0, "Distributor"),
    (3, "Chitra", "South", 500, "Retailer"),
    (4, "Asha", "South", None, "Retailer"),
]


def by(df, key):
    return {row[key]: row for row in df.collect()}


def test_monthly_summary_by_region(make):
    orders = make.orders(
        (1, "2024-01-31", 1, 100, "Paid"),
        (2, "2024-01-01", 2, 50.01, "Paid"),
        (3, "2024-02-01", 1, 10, "Paid"),
        (4, "2024-02-01", 99, 10, "Paid"),
    )
    rows = views.monthly_sales_summary(orders, make.dealers(*DEALERS)).collect()
    found = {(str(r.month), r.region): (r.total_revenue, r.total_orders, r.avg_order_value) for r in rows}
    assert found == {
        ("2024-01-01", "North"): (D("150.01"), 2, 75.005),
        ("2024-02-01", "North"): (D("10.00"), 1, 10.0),
    }


def test_scorecard_keeps_dealers_without_orders_and_guards_zero_limit(make):
    orders = make.orders((1, "2024-01-05", 1, 100, "Partial"), (2, "2024-01-06", 1, 50, "Overdue"), (3, "2024-01-06", 2, 70, "Paid"))
    payments = make.payments((1, 30), (1, 20.55), (3, 70), (77, 5))
    score = by(views.dealer_scorecard(make.dealers(*DEALERS), orders, payments), "dealer_id")
    assert score[1].total_revenue == D("150.00") and score[1].order_count == 2
    assert score[1].current_outstanding == D("99.45")
    assert score[1].credit_utilization_pct == D("9.95")  # 9.945 rounds half up
    assert score[2].current_outstanding == D("0.00") and score[2].credit_utilization_pct is None
    assert score[3].order_count == 0
    assert score[3].total_revenue is None and score[3].current_outstanding is None
    assert score[4].credit_utilization_pct is None


def test_utilisation_rounds_once(make):
    orders = make.orders((1, "2024-01-05", 1, "100.01", "Overdue"))
    score = views.dealer_scorecard(make.dealers((1, "A", "N", "3000000.61", "Retailer")), orders, make.payments())
    # 100 * 100.01 / 3000000.61 = 0.00333366...
    assert score.first().credit_utilization_pct == D("0.00")


def test_aging_bucket_boundaries(make):
    as_of = "2024-06-30"
    days = {0: "2024-06-30", 30: "2024-05-31", 31: "2024-05-30", 60: "2024-05-01", 61: "2024-04-30",
            90: "2024-04-01", 91: "2024-03-31", -1: "2024-07-01"}
    orders = make.orders(*((i, d, 1, 2**i, "Overdue") for i, d in enumerate(days.values())))
    row = views.dealer_aging_report(make.dealers(*DEALERS), orders, make.payments(), as_of).collect()
    assert len(row) == 1  # dealers without orders are left out
    assert row[0].outstanding_0_30 == 1 + 2
    assert row[0].outstanding_31_60 == 4 + 8
    assert row[0].outstanding_61_90 == 16 + 32
    assert row[0].outstanding_90_plus == 64


def test_aging_counts_what_is_left_after_receipts(make):
    orders = make.orders((1, "2024-06-01", 1, 100, "Paid"), (2, "2024-06-01", 1, 100, "Partial"), (3, "2024-06-01", 1, 10, "Paid"))
    payments = make.payments((1, 100), (2, 40), (3, 12))
    row = views.dealer_aging_report(make.dealers(*DEALERS), orders, payments, "2024-06-02").first()
    assert row.outstanding_0_30 == D("58.00")


def test_buckets_add_up_to_the_scorecard(make):
    orders = make.orders(*((i, f"2024-0{1 + i % 6}-11", 1 + i % 3, 10 + i, "Partial") for i in range(50)))
    payments = make.payments(*((i, 3.5) for i in range(0, 50, 2)))
    dealers = make.dealers(*DEALERS)
    score = by(views.dealer_scorecard(dealers, orders, payments), "dealer_id")
    for row in views.dealer_aging_report(dealers, orders, payments, "2024-12-31").collect():
        assert sum(row[b] for b in views.AGE_BUCKETS) == score[row.dealer_id].current_outstanding


PRODUCTS = [(1, "a", "Rice"), (2, "b", "Rice"), (3, "c", "Rice"), (4, "d", "Rice"), (5, "e", "Wheat")]


def test_unsold_products_rank_first_and_ties_share_a_rank(make):
    lines = make.lines((1, "2024-01-01", 1, 1, 2, 50), (2, "2024-01-01", 1, 2, 1, 50), (3, "2024-01-01", 1, 3, 1, 20))
    ranks = by(views.product_crop_performance(make.products(*PRODUCTS), lines), "product_id")
    assert {k: r.rank_within_crop_category for k, r in ranks.items()} == {4: 1, 1: 2, 2: 2, 3: 4, 5: 1}
    assert ranks[4].total_revenue is None and ranks[4].total_quantity_sold is None


def test_inventory_status(make):
    inventory = make.inventory(
        (1, "a", "2024-07-01", 10, 25), (1, "b", "2024-06-01", 14, 20),
        (2, "c", "2024-07-01", 25, 25), (3, "d", "2024-06-29", 26, 25),
    )
    status = by(views.inventory_status(make.products(*PRODUCTS), inventory, "2024-06-30"), "product_id")
    assert set(status) == {1, 2, 3}
    assert status[1].is_below_reorder and status[1].quantity_available == D("24.00")
    assert not status[2].is_below_reorder and not status[3].is_below_reorder
    assert [status[i].days_to_expiry for i in (1, 2, 3)] == [-29, 1, -1]


def test_regional_performance_counts_dealers_once(make):
    orders = make.orders((1, "2024-01-01", 1, 100, "Paid"), (2, "2024-01-02", 1, 100, "Paid"), (3, "2024-01-02", 2, 50, "Paid"))
    rows = by(views.regional_performance(make.dealers(*DEALERS), orders), "region")
    assert set(rows) == {"North"}
    assert rows["North"].dealer_count == 2 and rows["North"].avg_revenue_per_dealer == 125.0


def test_regional_revenue_adds_up_to_the_monthly_summary(make):
    orders = make.orders(*((i, f"2024-0{1 + i % 6}-11", 1 + i % 4, 10.1 * i, "Paid") for i in range(80)))
    dealers = make.dealers(*DEALERS)
    regional = sum(r.total_revenue for r in views.regional_performance(dealers, orders).collect())
    monthly = sum(r.total_revenue for r in views.monthly_sales_summary(orders, dealers).collect())
    assert regional == monthly


