"""Reports on a small shop with gaps, repeats and several lines per order."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from tillroll import fixed_values as fixed
from tillroll import plans

ORDERS = (
    "order_id string, customer_id string, order_date timestamp_ntz, total_amount decimal(18,2), "
    "payment_method string, shipping_method string, shipping_cost decimal(18,2), "
    "shipped_date timestamp_ntz, product_id string"
)
ITEMS = "order_id string, product_id string, quantity bigint, unit_price decimal(18,2)"
PRODUCTS = (
    "product_id string, product_name string, product_category string, cost_price decimal(18,2)"
)
CUSTOMERS = (
    "customer_id string, customer_age int, customer_gender string, customer_city string, "
    "customer_state string"
)


def day(text):
    return None if text is None else dt.datetime.fromisoformat(text)


def money(value):
    return None if value is None else Decimal(str(value))


def orders_of(spark, *rows):
    """(order, customer, date, amount[, payment, method, cost, shipped, product]) rows."""
    full = []
    for row in rows:
        order, customer, date, amount, *rest = row
        pay, method, cost, shipped, product = (*rest, *[None] * (5 - len(rest)))
        full.append(
            (order, customer, day(date), money(amount), pay, method, money(cost), day(shipped),
             product)
        )
    return spark.createDataFrame(full, ORDERS)


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_overview_and_quality(spark):
    orders = orders_of(
        spark,
        ("O1", "C1", "2024-01-05", 10, None, None, None, None, "P1"),
        ("O2", "C1", None, -1, None, None, None, None, "P2"),
        (None, None, "2024-03-01", None),
    )
    assert tuples(plans.dataset_overview(orders)) == [
        (3, 1, 2, day("2024-01-05"), day("2024-03-01"), Decimal("9.00"))
    ]
    assert tuples(plans.data_quality(orders)) == [("orders", 1, 1, 1, 1, 1)]
    assert tuples(plans.data_quality(orders.limit(0))) == [("orders", *[None] * 5)]


def test_revenue_bands_are_open_above_and_take_nulls_last(spark):
    amounts = [49.99, 50, 99.99, 100, 199.99, 200, None]
    orders = orders_of(spark, *[(f"O{a}", "C", "2024-01-01", a) for a in amounts])
    assert [r[:2] for r in tuples(plans.revenue_distribution(orders))] == [
        ("Low (0-50)", 1),
        ("Medium (50-100)", 2),
        ("High (100-200)", 2),
        ("Premium (200+)", 2),
    ]


def test_day_of_week(spark):
    orders = orders_of(
        spark, ("O1", "C", "2024-01-07", 1), ("O2", "C", "2024-01-08T23:59:00", 2), ("O3", "C", None, 5)
    )
    assert [r[:4] for r in tuples(plans.day_of_week_sales(orders))] == [
        (0, "Sunday", 1, Decimal("1.00")),
        (1, "Monday", 1, Decimal("2.00")),
        (None, None, 1, Decimal("5.00")),
    ]


def test_quarters_skip_gaps_unless_filled(spark):
    orders = orders_of(
        spark, ("O1", "C", "2023-11-05", 200), ("O2", "C", "2024-05-05", 150)
    )
    assert tuples(plans.quarterly_growth(orders)) == [
        (2023, 4, Decimal("200.00"), None, None),
        (2024, 2, Decimal("150.00"), Decimal("200.00"), Decimal("-25.00")),
    ]
    assert tuples(plans.quarterly_growth(orders, fill_gaps=True)) == [
        (2023, 4, Decimal("200.00"), None, None),
        (2024, 1, Decimal("0.00"), Decimal("200.00"), Decimal("-100.00")),
        (2024, 2, Decimal("150.00"), Decimal("0.00"), None),
    ]


def test_growth_from_nothing(spark):
    orders = orders_of(spark, ("O1", "C", "2024-01-05", 0), ("O2", "C", "2024-05-05", 150))
    with pytest.raises(ArithmeticException):
        plans.quarterly_growth(orders).collect()
    with pytest.raises(ArithmeticException):
        plans.revenue_moving_avg(orders).collect()
    assert tuples(plans.quarterly_growth(orders, on_zero_div="null"))[1][-1] is None
    assert tuples(plans.revenue_moving_avg(orders, on_zero_div="null"))[1][-1] is None


def test_moving_average_frames(spark):
    orders = orders_of(
        spark, *[(f"O{m}", "C", f"2024-{m:02d}-15", m * 10) for m in (1, 2, 3, 4, 5, 6, 8)]
    )
    got = tuples(plans.revenue_moving_avg(orders))
    assert [r[2] for r in got] == [money(v) for v in ("10.00", "15.00", "20.00", "30.00", "40.00", "50.00", "63.33")]
    assert [r[3] for r in got][-2:] == [Decimal("35.00"), Decimal("46.67")]
    assert got[1][4] == Decimal("100.00")
    undated = orders.union(orders_of(spark, ("X", "C", None, 9)))
    with_unknown = tuples(plans.revenue_moving_avg(undated, fill_gaps=True))
    filled = tuples(plans.revenue_moving_avg(orders, fill_gaps=True))
    assert [r[:2] for r in with_unknown] == [r[:2] for r in filled] + [(None, Decimal("9.00"))]
    assert [r[1] for r in filled][-2:] == [Decimal("0.00"), Decimal("80.00")]
    assert [r[4] for r in filled][-2:] == [Decimal("-100.00"), None]


def test_top_customers_break_ties_by_key_and_put_unknown_first(spark):
    orders = orders_of(
        spark,
        ("O1", "B", "2024-01-01", 10),
        ("O2", "A", "2024-01-01", 4),
        ("O3", "A", "2024-01-03T12:00:00", 6),
        ("O4", "N", "2024-01-03", None),
        ("O5", "Z", "2024-01-03", 1),
    )
    got = tuples(plans.top_customers(orders, n=3))
    assert [r[0] for r in got] == ["N", "A", "B"]
    assert got[1] == (
        "A", 2, Decimal("10.00"), Decimal("5.00"), day("2024-01-01"), day("2024-01-03T12:00:00"), 2,
    )


def test_lifetime_value(spark):
    orders = orders_of(
        spark,
        *[(f"O{n}", "A", "2018-07-24" if n else "2024-01-13", 300_000) for n in range(7)],
        ("S", "B", "2024-01-01", 5),
        ("T1", "C", None, 5),
        ("T2", "C", None, 7),
        ("U1", "D", "2024-01-01", None),
        ("U2", "D", "2024-01-01", None),
    )
    got = {r.customer_id: r for r in plans.customer_clv(orders).collect()}
    assert set(got) == {"A", "C", "D"}
    assert got["A"].customer_lifespan_days == 2000
    assert got["A"].annual_order_frequency == Decimal("1.28")
    assert got["A"].estimated_annual_clv == Decimal("383250.00")
    # No dates: no rate, and the value is what was spent.
    assert (got["C"].annual_order_frequency, got["C"].estimated_annual_clv) == (0, Decimal("12.00"))
    assert got["D"].estimated_annual_clv is None


def test_lifetime_value_is_divided_once(spark):
    # 300000 * 7 / 1999 * 365 keeps its cents.
    orders = orders_of(
        spark, *[(f"O{n}", "A", "2018-07-25" if n else "2024-01-13", 300_000) for n in range(7)]
    )
    assert plans.customer_clv(orders).first().estimated_annual_clv == Decimal("383441.72")


def test_rfm_rules(spark, monkeypatch):
    cells = [(r, f, m) for r in range(1, 6) for f in range(1, 6) for m in range(1, 6)]
    scored = spark.createDataFrame(
        [(str(c), 1, 1, Decimal(1), *c) for c in cells],
        "customer_id string, recency_days bigint, frequency bigint, monetary_value decimal(28,2), "
        "recency_score int, frequency_score int, monetary_score int",
    )
    monkeypatch.setattr("tillroll.plans.customers.rfm_scores", lambda *a, **k: scored)
    got = {r.customer_segment: r.customer_count for r in plans.rfm_segments(None).collect()}

    def segment(r, f, m):
        if r >= 4 and f >= 4 and m >= 4:
            return "Champions"
        if r >= 3 and f >= 3 and m >= 3:
            return "Loyal Customers"
        if r >= 3 and m >= 3:
            return "Potential Loyalists"
        if r >= 4 and f <= 2:
            return "New Customers"
        if r <= 2 and m >= 3:
            return "At Risk" if f >= 3 else "Cannot Lose Them"
        return "Hibernating" if r <= 2 and f <= 2 else "Others"

    expected = {}
    for cell in cells:
        label = segment(*cell)
        expected[label] = expected.get(label, 0) + 1
    assert got == expected and len(got) == 8


def test_rfm_scores_with_gaps(spark):
    orders = orders_of(
        spark,
        ("O1", "A", "2024-01-01", 10),
        ("O2", "B", None, None),
        ("O3", "C", "2024-01-31", 30),
        ("O4", "C", "2024-01-20", 30),
        ("O5", "D", "2024-01-11", 40),
        ("O6", "E", "2024-01-21", 50),
    )
    got = plans.rfm_scores(orders, "2024-02-10")
    rows = {r.customer_id: tuple(r)[1:] for r in got.collect()}
    # Unknown recency counts as longest ago, unknown value as highest.
    assert rows["B"] == (None, 1, None, 1, 2, 5)
    assert rows["A"] == (40, 1, Decimal("10.00"), 2, 1, 1)
    assert rows["C"] == (10, 2, Decimal("60.00"), 5, 5, 4)


def test_clv_is_rounded_once(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=n) for n in (*range(7), 2000)]
    amounts = [Decimal("90.49"), *[Decimal("1.00")] * 6, None]
    rows = [(f"O{i}", "A", str(d), a) for i, (d, a) in enumerate(zip(days, amounts))]
    row = plans.customer_clv(orders_of(spark, *rows)).first()
    exact = Decimal("96.49") * 8 * 365 / (7 * 2001)
    assert row.estimated_annual_clv == round(exact, 2) == Decimal("20.11")


def test_profit_is_rounded_once(spark):
    lines = spark.range(20_001).select(
        F.col("id").cast("string").alias("order_id"),
        F.lit("P").alias("product_id"),
        F.lit(1).cast("bigint").alias("quantity"),
        F.when(F.col("id") == 0, F.lit("1.06")).otherwise(F.lit("1.00")).cast("decimal(18,2)").alias("unit_price"),
    )
    products = spark.createDataFrame(
        [("P", "n", "c", Decimal("0.97"))],
        "product_id string, product_name string, product_category string, cost_price decimal(18,2)",
    )
    row = plans.product_profit(lines, products).first()
    assert row.total_profit == Decimal("600.09")


def test_filled_growth_keeps_the_stated_division(spark):
    orders = orders_of(
        spark, ("A", "A", "2024-01-01", 1), ("B", "A", "2024-07-01", 1), ("C", "A", "2024-10-01", 1)
    )
    assert plans.quarterly_growth(orders, fill_gaps=True).count() == 4
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        plans.quarterly_growth(orders, on_zero_div="raise", fill_gaps=True).collect()


def test_churn_limits(spark):
    gaps = {"A": 30, "B": 31, "C": 90, "D": 91, "E": 180, "F": 181}
    rows = [
        (f"O{c}", c, str(dt.date(2024, 12, 31) - dt.timedelta(days=g)), 1) for c, g in gaps.items()
    ]
    rows += [(f"G{n}", "G", "2024-12-31", n) for n in range(3)]
    rows += [(f"H{n}", "H", "2024-12-31", 1) for n in range(10)]
    rows += [(f"I{n}", "I", "2024-12-31", 1) for n in range(11)]
    rows += [("J1", "J", None, 1), ("J2", "J", None, 1)]
    got = {(r[0], r[1]): r for r in tuples(plans.churn_risk(orders_of(spark, *rows), "2024-12-31"))}
    assert {k: v[2] for k, v in got.items()} == {
        ("Active", "One-time"): 1,
        ("Active", "Occasional"): 2,
        ("Active", "Regular"): 1,
        ("Active", "Frequent"): 1,
        ("Low Risk", "One-time"): 2,
        ("Medium Risk", "One-time"): 2,
        ("High Risk", "One-time"): 1,
    }
    assert got["Low Risk", "One-time"][5] == 61  # 60.5 rounds up
    assert got["Active", "Occasional"][3:5] == (Decimal("2.50"), Decimal("1.00"))


def test_cohorts(spark):
    orders = orders_of(
        spark,
        ("O1", "A", "2023-01-20", 1),
        ("O2", "A", "2023-02-03", 1),
        ("O3", "A", "2024-02-03", 1),
        ("O4", "B", "2023-01-31", 1),
        ("O5", "B", "2024-01-31", 1),
        ("O6", "B", None, 1),
        ("O7", "C", None, 1),
        ("O8", None, "2023-01-31", 1),
    )
    january = day("2023-01-01")
    assert tuples(plans.cohort_retention(orders)) == [
        (january, 2, 0, 2, Decimal("100.00")),
        (january, 2, 1, 1, Decimal("50.00")),
        (january, 2, None, 1, Decimal("50.00")),
    ]
    assert [r[2:4] for r in tuples(plans.cohort_retention(orders, wrap_months=False))] == [
        (0, 2), (1, 1), (12, 1), (13, 1), (None, 1),
    ]


@pytest.fixture(scope="module")
def shop(spark):
    orders = orders_of(
        spark,
        ("O1", "A", "2024-01-05", 100, "Card", "Air", "5.00", "2024-01-07"),
        ("O2", "A", "2024-07-05", 50, "Card", "Sea", None, None),
        ("O3", "B", "2024-12-24", 30, "Cash", "Air", "6.00", "2024-12-23"),
        ("O4", "X", "2024-12-25", 7, None, "Air", "7.00", "2024-12-25T18:00:00"),
    )
    items = spark.createDataFrame(
        [
            ("O1", "P1", 2, money("10.00")),
            ("O1", "P2", 1, money("80.00")),
            ("O2", "P1", 5, money("10.00")),
            ("O3", "P3", 3, money("10.00")),
            ("O3", "P1", 4, money("12.00")),
            ("O9", "P1", 100, money("1.00")),  # order unknown
            ("O3", "P9", 100, money("1.00")),  # product unknown
            ("O4", "P2", 1, money("70.00")),
        ],
        ITEMS,
    )
    products = spark.createDataFrame(
        [
            ("P1", "Cup", "Kitchen", money("5.00")),
            ("P2", "Lamp", "Home", money("50.00")),
            ("P3", "Cup", "Home", money("8.00")),
        ],
        PRODUCTS,
    )
    customers = spark.createDataFrame(
        [
            ("A", 24, "Male", "Reno", "NV"),
            ("B", 25, "Female", "Reno", "CA"),
            ("X", None, "Other", "Reno", None),
        ],
        CUSTOMERS,
    )
    return orders, items, products, customers


def test_top_products(shop):
    orders, items, products, _ = shop
    got = {r[0]: r[1:] for r in tuples(plans.top_products(orders, items, products))}
    # The order total counts for each line.
    assert got["P1"] == ("Cup", "Kitchen", 11, 3, Decimal("180.00"), Decimal("10.67"), Decimal("16.36"))
    by_line = plans.top_products(orders, items, products, revenue="line")
    assert {r[0]: r[5] for r in tuples(by_line)} == {
        "P1": Decimal("118.00"), "P2": Decimal("150.00"), "P3": Decimal("30.00"),
    }
    assert [r[0] for r in tuples(plans.top_products(orders, items, products, n=1))] == ["P1"]
    with pytest.raises(ValueError):
        plans.top_products(orders, items, products, revenue="net")


def test_repeated_product_rows_count_repeatedly(shop):
    orders, items, products, _ = shop
    doubled = products.union(products)
    got = {r[0]: r[4] for r in tuples(plans.top_products(orders, items, doubled))}
    assert got["P1"] == 6


def test_categories_and_seasons(shop):
    orders, items, products, _ = shop
    assert tuples(plans.category_performance(orders, items, products)) == [
        ("Kitchen", 1, 11, Decimal("180.00"), Decimal("10.67"), 3, 2, Decimal("90.00")),
        ("Home", 2, 5, Decimal("137.00"), Decimal("53.33"), 3, 3, Decimal("45.67")),
    ]
    assert tuples(plans.seasonal_performance(orders, items, products)) == [
        ("Home", "Winter", 5, Decimal("137.00"), 3),
        ("Kitchen", "Winter", 6, Decimal("130.00"), 2),
        ("Kitchen", "Summer", 5, Decimal("50.00"), 1),
    ]


def test_market_basket(shop):
    orders, items, products, _ = shop
    got = tuples(plans.market_basket(orders, items, products, min_pairs=1))
    assert got == [("Cup", "Lamp", 1, 3, 2, Decimal("33.33"), Decimal("50.00"))]
    by_product = plans.market_basket(orders, items, products, min_pairs=1, key="product_id")
    assert {tuple(r)[:3] for r in by_product.select("product_a", "product_b", "product_a_name").collect()} == {
        ("P1", "P2", "Cup"), ("P1", "P3", "Cup"),
    }
    assert plans.market_basket(orders, items, products).count() == 0
    with pytest.raises(ValueError):
        plans.market_basket(orders, items, products, key="colour")


def test_a_name_in_two_categories_counts_twice(spark, shop):
    orders, items, products, _ = shop
    more = items.union(spark.createDataFrame([("O3", "P2", 1, money("1.00"))], ITEMS))
    got = tuples(plans.market_basket(orders, more, products, min_pairs=1))
    # O1 once, O3 once per category of "Cup"; confidence passes 100 %.
    assert got == [("Cup", "Lamp", 3, 3, 3, Decimal("100.00"), Decimal("100.00"))]


def test_product_profit(shop):
    _, items, products, _ = shop
    got = tuples(plans.product_profit(items, products, min_units=1))
    assert [r[0] for r in got] == ["P1", "P2", "P3"]
    # Prices 10, 10, 12, 1 on 111 units at cost 5.
    assert got[0][4:] == (
        Decimal("8.25"), Decimal("3.25"), Decimal("65.00"), 111, Decimal("360.75"),
    )
    assert [r[0] for r in tuples(plans.product_profit(items, products))] == ["P1"]


def test_profit_without_cost(spark, shop):
    orders, items, products, _ = shop
    free = products.withColumn("cost_price", F.lit(0).cast("decimal(18,2)"))
    with pytest.raises(ArithmeticException):
        plans.product_profit(items, free).collect()
    with pytest.raises(ArithmeticException):
        plans.monthly_profit(orders, items, free).collect()
    assert plans.product_profit(items, free, on_zero_div="null").first().profit_margin_percentage is None
    assert plans.monthly_profit(orders, items, free, on_zero_div="null").first().avg_profit_margin is None


def test_monthly_profit(shop):
    orders, items, products, _ = shop
    got = tuples(plans.monthly_profit(orders, items, products))
    # January: 2 cups at 10 (cost 5) and a lamp at 80 (cost 50): margins 100 and 60.
    assert got[0] == (
        day("2024-01-01"), Decimal("100.00"), Decimal("60.00"), Decimal("40.00"), Decimal("80.00"),
    )


def test_places(spark, shop):
    orders, _, _, customers = shop
    assert tuples(plans.sales_by_city(orders, customers, min_orders=2)) == [
        ("Reno", "NV", 1, 2, Decimal("150.00"), Decimal("75.00"), Decimal("150.00"))
    ]
    assert plans.sales_by_city(orders, customers).count() == 0
    assert tuples(plans.regional_performance(orders, customers)) == [
        ("Other", 2, 3, Decimal("157.00"), Decimal("52.33"), Decimal("52.33")),
        ("West", 1, 1, Decimal("30.00"), Decimal("30.00"), Decimal("30.00")),
    ]


def test_repeated_customer_rows(shop):
    orders, _, _, customers = shop
    doubled = customers.union(customers)
    got = {r[0]: r[1:4] for r in tuples(plans.regional_performance(orders, doubled))}
    assert got["West"] == (1, 2, Decimal("60.00"))


def test_ages(shop):
    orders, _, _, customers = shop
    assert tuples(plans.age_groups(orders, customers)) == [
        ("18-24", 1, 2, Decimal("150.00"), Decimal("75.00"), 2),
        ("25-34", 1, 1, Decimal("30.00"), Decimal("30.00"), 1),
    ]


def test_orders_per_customer_is_whole_unless_exact(spark, shop):
    orders, _, _, customers = shop
    same_age = customers.withColumn("customer_age", F.lit(30))
    more = orders.union(orders_of(spark, ("O5", "A", "2024-01-05", 1)))
    assert plans.age_groups(more, same_age).first().avg_orders_per_customer == 1
    exact = plans.age_groups(more, same_age, exact_ratio=True).first()
    assert exact.avg_orders_per_customer == Decimal("1.67")
    assert plans.kpi_summary(more).first().avg_orders_per_customer == 1
    exact = plans.kpi_summary(more, exact_ratio=True).first()
    assert exact.avg_orders_per_customer == Decimal("1.67")


def test_genders(shop):
    orders, items, products, customers = shop
    assert tuples(plans.gender_patterns(orders, customers, items, products)) == [
        ("Male", 1, 3, Decimal("250.00"), Decimal("83.33"), "Home, Kitchen"),
        ("Female", 1, 2, Decimal("60.00"), Decimal("30.00"), "Home, Kitchen"),
    ]


def test_payments(shop):
    orders = shop[0]
    got = {r[0]: r[1:] for r in tuples(plans.payment_methods(orders))}
    assert got["Card"] == (2, Decimal("150.00"), Decimal("75.00"), 1, Decimal("50.00"))
    assert got[None][-1] == Decimal("25.00")


def test_shipping(shop):
    got = tuples(plans.shipping(shop[0]))
    # 2 days, -1 day and 18 hours (0 days); the unshipped order is left out.
    assert got == [("Air", 3, Decimal("137.00"), Decimal("45.67"), Decimal("6.00"), Decimal("0.3"))]


def test_kpis(shop):
    got = plans.kpi_summary(shop[0]).first()
    assert got.business_days == 355
    assert got.daily_avg_revenue == Decimal("0.53")
    one_day = shop[0].limit(1)
    with pytest.raises(ArithmeticException):
        plans.kpi_summary(one_day).collect()
    assert plans.kpi_summary(one_day, on_zero_div="null").first().daily_avg_revenue is None
    assert plans.kpi_summary(one_day.limit(0), on_zero_div="null").first().total_orders == 0


def test_band_labels_cover_every_report_value():
    assert fixed.REVENUE_BANDS[-1][1] is None and fixed.AGE_BANDS[-1][1] is None
