from decimal import Decimal as D

import pytest

from dealerscope.plans import segments as sg

DEALERS = [(i, f"d{i}", "North", 100, "Retailer") for i in range(1, 5)]


def test_rfm_uses_the_last_order_date_and_a_clamped_year(make):
    orders = make.orders(
        (1, "2024-02-29", 1, 10, "Paid"),
        (2, "2023-02-28", 1, 5, "Paid"),  # exactly twelve months before, clamped
        (3, "2023-02-27", 2, 7, "Paid"),  # one day too old
        (4, "2023-12-31", 3, 2.5, "Paid"),
        (5, "2024-01-31", 77, 1, "Paid"),  # not a dealer
    )
    rows = {r.dealer_id: r for r in sg.rfm(make.dealers(*DEALERS), orders).collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[1].recency, rows[1].frequency, rows[1].monetary) == (0, 2, D("15.00"))
    assert (rows[2].recency, rows[2].frequency, rows[2].monetary) == (367, 0, D("0.00"))
    assert (rows[3].recency, rows[3].frequency, rows[3].monetary) == (60, 1, D("2.50"))


def test_standardise_uses_population_deviation_and_survives_constants(spark):
    table = spark.createDataFrame(
        [(1, 2, 5, D("1.00")), (2, 4, 5, D("2.00")), (3, 6, 5, D("3.00"))],
        "dealer_id INT, recency INT, frequency BIGINT, monetary DECIMAL(38,2)",
    )
    rows = {r.dealer_id: r for r in sg.standardise(table).collect()}
    assert [rows[i].z_recency for i in (1, 2, 3)] == [-1.224745, 0.0, 1.224745]
    assert [rows[i].z_frequency for i in (1, 2, 3)] == [0.0, 0.0, 0.0]
    assert rows[3].z_monetary == 1.224745


def _labels(spark, *rows):
    df = spark.createDataFrame(list(rows), "cluster_id INT, recency DOUBLE, frequency DOUBLE, monetary DOUBLE")
    return {r.cluster_id: r.segment_label for r in sg.label_clusters(df).collect()}


def test_each_label_is_reachable(spark):
    assert _labels(spark, (0, 1.0, 9.0, 9.0), (1, 9.0, 1.0, 1.0), (2, 5.0, 5.0, 5.0)) == {
        0: "Champions", 1: "At Risk", 2: "Loyal",
    }
    assert _labels(
        spark, (0, 1.0, 2.0, 5.0), (1, 2.0, 1.0, 4.0), (2, 3.0, 3.0, 3.0), (3, 4.0, 5.0, 2.0), (4, 5.0, 4.0, 1.0)
    ) == {0: "Potential", 1: "Potential", 2: "Needs Attention", 3: "Loyal", 4: "Loyal"}


def test_tied_centres_share_mean_ranks(spark):
    # recency shares 2/3 for all, frequency 2/3: At Risk needs frequency < .5, so Loyal
    assert set(_labels(spark, (0, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 1.0)).values()) == {"Loyal"}


@pytest.mark.parametrize(
    ("diagnostics", "expected"),
    [([(3, 9.0, 0.5), (4, 7.0, 0.6), (5, 5.0, 0.6)], 4), ([(3, 9.0, 0.7), (4, 7.0, 0.6), (5, 5.0, 0.6)], 3)],
)
def test_best_k(diagnostics, expected):
    assert sg.best_k(diagnostics) == expected


def test_segmentation_recovers_separate_groups(make):
    orders, dealers, n = [], [], 0
    for dealer in range(1, 25):
        dealers.append((dealer, f"d{dealer}", "North", 100, "Retailer"))
        group = dealer % 3
        for i in range((1, 8, 25)[group]):
            n += 1
            date = ("2023-02-01", "2023-11-15", "2024-01-31")[group] if i == 0 else "2023-10-01"
            orders.append((n, date, dealer, (10, 100, 1000)[group] + dealer, "Paid"))
    orders_df, dealers_df = make.orders(*orders), make.dealers(*dealers)
    run = sg.segment_dealers(dealers_df, orders_df, restarts=3)
    rows = run.segments.collect()
    assert len(rows) == 24
    assert [r.k for r in run.diagnostics.orderBy("k").collect()] == [3, 4, 5]
    inertia = [r.inertia for r in run.diagnostics.orderBy("k").collect()]
    assert inertia == sorted(inertia, reverse=True)
    by_group = {g: {r.cluster_id for r in rows if r.dealer_id % 3 == g} for g in range(3)}
    assert all(len(ids) >= 1 for ids in by_group.values())
    assert not (by_group[0] & by_group[1]) and not (by_group[1] & by_group[2])
    best = next(r for r in rows if r.dealer_id % 3 == 2)
    assert best.segment_label in ("Champions", "Loyal", "Potential")
    profile = sg.segment_profile(run.segments).collect()
    assert sum(r.dealers for r in profile) == 24
    assert all(r.failures == 0 for r in sg.segment_checks(run.segments, orders_df).collect())


def test_segment_checks_report_problems(make, spark):
    table = spark.createDataFrame(
        [(1, 0, "Loyal"), (1, 0, "Loyal"), (2, 1, "")], "dealer_id INT, cluster_id INT, segment_label STRING"
    )
    orders = make.orders((1, "2024-01-01", 1, 1, "Paid"), (2, "2024-01-01", 9, 1, "Paid"))
    failures = {r.check_name: r.failures for r in sg.segment_checks(table, orders).collect()}
    assert failures == {
        "segments: no label": 1, "segments: duplicate dealer": 1, "segments: dealer left out": 1,
        "segments: number of clusters": 1,
    }
