"""The views on random tables with all the awkward cases, against the same views in SQL."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest

import __spark_entry__ as entry
from dealerscope.plans import segments, timeseries, views

duckdb = pytest.importorskip("duckdb")
DEALERS = "dealer_id INT, dealer_name STRING, region STRING, dealer_type STRING, credit_limit DECIMAL(12,2)"
ORDERS = "order_id INT, order_date DATE, dealer_id INT, total_amount DECIMAL(12,2), payment_status STRING"
LINES = "order_id INT, order_date DATE, dealer_id INT, product_id INT, quantity INT, total_amount DECIMAL(12,2)"
STOCK = "product_id INT, batch_no STRING, expiry_date DATE, quantity_available DECIMAL(12,2), reorder_level DECIMAL(12,2)"


def _tables(seed):
    rng = random.Random(seed)
    last = dt.date.fromisoformat(entry.AS_OF)

    def cents(hi):
        return D(rng.randint(0, hi)) / 100

    def date(span):
        return last - dt.timedelta(days=rng.randint(-20, span))

    def hot(n):
        return 1 if rng.random() < 0.35 else rng.randint(1, n)

    dealers = [
        (i, rng.choice(["Rao", "Patil", "Joshi"]), rng.choice(["N", "S", "E"]), "Retailer",
         rng.choice([D("0.00"), D("-50.25"), cents(10**6), cents(10**4)]))
        for i in range(1, 31)
    ]
    products = [(i, rng.choice(["a", "b"]), rng.choice(["Crop1", "Crop7", "Crop12"])) for i in range(1, 41)]
    orders, lines = [], []
    for i in range(1, 301):
        dealer = None if rng.random() < 0.03 else hot(33)  # some unknown dealers, 30 may lack orders
        day, total = date(rng.choice([40, 100, 900])), cents(rng.choice([0, 500, 10**6]))
        orders.append((i, day, dealer, total, rng.choice(["Paid", "Partial", "Overdue"])))
        lines.append((i, day, dealer, hot(36), rng.randint(0, 9), rng.choice([total, D("5.00")])))
    payments = [(rng.randint(1, 320), cents(10**5)) for _ in range(400)]
    stock = [(hot(36), f"b{i}", date(90), cents(2000), cents(6000)) for i in range(80)]
    calendar = [(f"Crop{c}", r, 1 + (c + k) % 12) for c in (1, 7, 12) for k, r in enumerate(("N", "S"))]
    return {
        "dealers": (DEALERS, dealers),
        "products": ("product_id INT, product_name STRING, target_crop STRING", products),
        "sales_orders": (ORDERS, orders),
        "order_lines": (LINES, lines),
        "payments": ("order_id INT, amount_received DECIMAL(12,2)", payments),
        "inventory": (STOCK, stock),
        "crop_calendar": ("crop STRING, region STRING, peak_demand_month INT", calendar),
    }


def _plain(value):
    return round(float(value), 9) if isinstance(value, float | D) else value


@pytest.mark.parametrize("seed", range(3))
def test_views_on_random_tables(spark, seed):
    connection, t = duckdb.connect(), {}
    for name, (ddl, rows) in _tables(seed).items():
        t[name] = spark.createDataFrame(rows, ddl)
        connection.execute(f"CREATE TABLE {name} ({ddl.replace('STRING', 'VARCHAR')})")
        connection.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    dealers, orders, payments, lines = t["dealers"], t["sales_orders"], t["payments"], t["order_lines"]
    series = timeseries.demand_series(
        lines, t["products"], t["crop_calendar"],
        timeseries.top_skus(views.product_sales(t["products"], lines)),
    )
    rank = "rank() OVER (PARTITION BY target_crop ORDER BY total_revenue DESC NULLS FIRST)"
    expected = {
        "SELECT * FROM monthly": views.monthly_sales_summary(orders, dealers),
        "SELECT * FROM scorecard": views.dealer_scorecard(dealers, orders, payments, ["dealer_type"]),
        "SELECT * FROM aging": views.dealer_aging_report(dealers, orders, payments, entry.AS_OF),
        f"SELECT *, {rank} AS rank_within_crop_category FROM product_sales": views.product_crop_performance(
            t["products"], lines
        ),
        "SELECT * FROM stock": views.inventory_status(t["products"], t["inventory"], entry.AS_OF),
        "SELECT * FROM regional": views.regional_performance(dealers, orders).drop("avg_revenue_per_dealer"),
        "SELECT * FROM series": series,
        "SELECT * FROM rfm": segments.rfm(dealers, orders),
    }
    for sql, df in expected.items():
        name = sql.split()[-1]
        needed = {n: s for n, s in entry._VIEW_SQL.items()}
        order = []

        def add(view):
            for below in entry._NEEDS.get(view, []):
                add(below)
            if view in needed and view not in order:
                order.append(view)

        add(name)
        relation = connection.sql("WITH " + ", ".join(f"{n} AS ({needed[n]})" for n in order) + " " + sql)
        columns = sorted(df.columns)
        assert columns == sorted(relation.columns), name
        theirs = [dict(zip(relation.columns, row)) for row in relation.fetchall()]
        assert sorted(repr([_plain(r[c]) for c in columns]) for r in theirs) == sorted(
            repr([_plain(r[c]) for c in columns]) for r in df.collect()
        ), name
