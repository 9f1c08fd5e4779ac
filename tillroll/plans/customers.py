"""Customer value, segments, churn and retention."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll import fixed_values as fixed
from tillroll.functions import (
    as_of_date,
    asc,
    cents_per,
    desc,
    mean,
    month_start,
    months_between_starts,
    percent,
    ratio,
    whole_days,
)
from tillroll.operators.tiles import TileOrder, with_tiles
from tillroll.sources.scratch import scratch_path, written_and_observed


def _per_customer(orders):
    return orders.groupBy("customer_id").agg(
        F.count("*").alias("total_orders"),
        F.sum("total_amount").alias("total_spent"),
        F.count("total_amount").alias("amounts"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    )


def top_customers(orders, n=fixed.TOP_CUSTOMERS):
    return (
        _per_customer(orders)
        .orderBy(desc("total_spent"), asc("customer_id"))
        .limit(n)
        .select(
            "customer_id",
            "total_orders",
            "total_spent",
            F.round(mean(F.col("total_spent"), F.col("amounts")), 2).alias("avg_order_value"),
            "first_order_date",
            "last_order_date",
            whole_days(F.col("last_order_date"), F.col("first_order_date")).alias(
                "customer_lifespan_days"
            ),
        )
    )


def rfm_scores(orders, as_of=None):
    """Recency, frequency and monetary value per customer, each scored 1 to 5.

    The customer totals are stored once, and counted while they are: the scoring
    reads them several times.
    """
    customers, counted = written_and_observed(
        _per_customer(orders).select(
            "customer_id",
            whole_days(as_of_date(as_of), F.col("last_order_date")).alias("recency_days"),
            F.col("total_orders").alias("frequency"),
            F.col("total_spent").alias("monetary_value"),
        ),
        scratch_path(orders.sparkSession, "rfm"),
        {"rows": F.count("*")},
    )
    return with_tiles(
        customers,
        {
            "recency_score": TileOrder("recency_days", descending=True),
            "frequency_score": TileOrder("frequency"),
            "monetary_score": TileOrder("monetary_value"),
        },
        "customer_id",
        fixed.RFM_TILES,
        counted["rows"],
    )


def rfm_segments(orders, as_of=None):
    scores = ("recency_score", "frequency_score", "monetary_score")
    rules = []
    for label, *limits in fixed.RFM_SEGMENTS:
        matches = F.lit(True)
        for score, (low, high) in zip(scores, limits):
            matches = matches & F.col(score).between(low, high)
        rules.append(F.when(matches, label))
    return (
        rfm_scores(orders, as_of)
        .groupBy(F.coalesce(*rules, F.lit(fixed.RFM_OTHER)).alias("customer_segment"))
        .agg(
            F.count("*").alias("customer_count"),
            *[
                F.round(mean(F.sum(c), F.count(c)), 2).alias(f"avg_{c}")
                for c in ("monetary_value", "frequency", "recency_days")
            ],
        )
        .orderBy(desc("avg_monetary_value"))
    )


def customer_clv(orders, n=fixed.TOP_CLV):
    """Yearly order rate and value of customers with more than one order.

    Without a known time span the rate is 0 and the value is what was spent.
    """
    days = F.col("customer_lifespan_days")
    yearly_orders = (F.col("total_orders") * fixed.DAYS_PER_YEAR).cast("decimal(14,0)")
    # One division at the end: average * orders / days * 365, with average as
    # spent / amounts.
    spent = (F.col("total_spent") * 100).cast("decimal(20,0)")
    yearly_value = cents_per(spent * yearly_orders, F.col("amounts") * days)
    ranked = (
        _per_customer(orders)
        .filter(F.col("total_orders") > 1)
        .withColumn(
            "customer_lifespan_days",
            whole_days(F.col("last_order_date"), F.col("first_order_date")) + 1,
        )
        .select(
            "customer_id",
            "total_orders",
            F.col("total_spent").alias("total_revenue"),
            mean(F.col("total_spent"), F.col("amounts")).alias("avg_order_value"),
            "customer_lifespan_days",
            F.when(days > 0, F.round(yearly_orders / days.cast("decimal(10,0)"), 2))
            .otherwise(F.lit(0))
            .alias("annual_order_frequency"),
            F.when((days > 0) & (F.col("amounts") > 0), yearly_value)
            .when(days > 0, F.lit(None))
            .otherwise(F.col("total_spent"))
            .alias("estimated_annual_clv"),
        )
        .orderBy(desc("estimated_annual_clv"), asc("customer_id"))
    )
    return ranked if n is None else ranked.limit(n)


def churn_risk(orders, as_of=None):
    """Customers by days since the last order and by number of orders.

    Without any dated order a customer counts as active.
    """
    idle = F.col("days_since_last_order")
    risk = F.coalesce(
        *[F.when(idle > limit, label) for label, limit in fixed.CHURN_RISKS],
        F.lit(fixed.CHURN_ACTIVE),
    )
    kind = F.coalesce(
        *[F.when(F.col("total_orders") <= most, label) for label, most in fixed.CUSTOMER_TYPES],
        F.lit(fixed.CUSTOMER_FREQUENT),
    )
    return (
        _per_customer(orders)
        .select(
            "total_orders",
            "total_spent",
            mean(F.col("total_spent"), F.col("amounts")).alias("customer_avg"),
            whole_days(as_of_date(as_of), F.col("last_order_date")).alias(
                "days_since_last_order"
            ),
        )
        .groupBy(risk.alias("churn_risk"), kind.alias("customer_type"))
        .agg(
            F.count("*").alias("customer_count"),
            F.round(mean(F.sum("total_spent"), F.count("total_spent")), 2).alias(
                "avg_total_spent"
            ),
            F.round(F.avg("customer_avg"), 2).alias("avg_order_value"),
            F.round(mean(F.sum(idle), F.count(idle)), 0).alias("avg_days_since_last_order"),
            F.sum("total_spent").alias("segment_revenue"),
        )
        .orderBy(asc("churn_risk"), asc("customer_type"))
    )


def cohort_retention(orders, wrap_months=True):
    """Customers by month of first order and months since.

    ``wrap_months`` counts months 0 to 11 only, years aside; False counts on.
    Orders shrink to customer-months before anything is grouped by customer, so
    a customer's group never holds more rows than there are months.
    """
    active = (
        orders.filter(F.col("customer_id").isNotNull())
        .select("customer_id", month_start(F.col("order_date")).alias("month"))
        .distinct()
    )
    first = F.min("month").over(Window.partitionBy("customer_id"))
    cells = (
        active.withColumn("cohort_month", first)
        .filter(F.col("cohort_month").isNotNull())
        .withColumn(
            "month_number",
            months_between_starts(F.col("month"), F.col("cohort_month"), wrap_months),
        )
        .groupBy("cohort_month", "month_number")
        .agg(F.count_distinct("customer_id").alias("customers"))
    )
    # Every customer is active in month 0 of the own cohort.
    size = F.max(F.when(F.col("month_number") == 0, F.col("customers"))).over(
        Window.partitionBy("cohort_month")
    )
    return (
        cells.withColumn("cohort_size", size)
        .select(
            "cohort_month",
            "cohort_size",
            "month_number",
            "customers",
            F.round(percent(F.col("customers"), F.col("cohort_size")), 2).alias(
                "retention_rate"
            ),
        )
        .orderBy(asc("cohort_month"), asc("month_number"))
    )


def kpi_summary(orders, on_zero_div="raise", exact_ratio=False):
    """Totals over all orders; orders per customer is a whole number unless exact."""
    totals = orders.agg(
        F.count_distinct("customer_id").alias("total_customers"),
        F.count("*").alias("total_orders"),
        F.sum("total_amount").alias("total_revenue"),
        F.count("total_amount").alias("amounts"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    )
    days = whole_days(F.col("last_order_date"), F.col("first_order_date"))
    return totals.select(
        "total_customers",
        "total_orders",
        F.round("total_revenue", 2).alias("total_revenue"),
        F.round(mean(F.col("total_revenue"), F.col("amounts")), 2).alias("avg_order_value"),
        orders_per_customer(
            F.col("total_orders"), F.col("total_customers"), exact_ratio, on_zero_div
        ).alias("avg_orders_per_customer"),
        "first_order_date",
        "last_order_date",
        days.alias("business_days"),
        F.round(ratio(F.col("total_revenue"), days, on_zero_div), 2).alias("daily_avg_revenue"),
    )


def orders_per_customer(orders, customers, exact=False, on_zero_div="raise"):
    if exact:
        return F.round(ratio(orders, customers, on_zero_div), 2)
    if on_zero_div == "null":
        customers = F.nullif(customers, F.lit(0))
    return F.call_function("div", orders, customers)
