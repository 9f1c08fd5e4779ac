"""Sales by place, payment, shipping, age and gender.

Reports on customer attributes shrink the orders to one row per customer before
the join. A customer with very many orders then weighs no more than any other.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll import fixed_values as fixed
from tillroll.functions import (
    asc,
    band,
    desc,
    in_text_order,
    lookup,
    mean,
    percent,
    ratio,
    whole_days,
)
from tillroll.operators.lines import sold_lines
from tillroll.plans.customers import orders_per_customer


def _with_customers(orders, customers, *attributes):
    spent = orders.groupBy("customer_id").agg(
        F.count("*").alias("orders"),
        F.sum("total_amount").alias("amount"),
        F.count("total_amount").alias("amounts"),
    )
    return spent.join(customers.select("customer_id", *attributes), "customer_id")


def _totals():
    return (
        F.count_distinct("customer_id").alias("unique_customers"),
        F.sum("orders").alias("total_orders"),
        F.sum("amount").alias("total_revenue"),
        F.round(mean(F.sum("amount"), F.sum("amounts")), 2).alias("avg_order_value"),
    )


def sales_by_city(orders, customers, min_orders=fixed.MIN_CITY_ORDERS, n=fixed.TOP_CITIES):
    return (
        _with_customers(orders, customers, "customer_city", "customer_state")
        .groupBy("customer_city", "customer_state")
        .agg(*_totals())
        .filter(F.col("total_orders") >= min_orders)
        .withColumn(
            "revenue_per_customer",
            F.round(ratio(F.col("total_revenue"), F.col("unique_customers")), 2),
        )
        .orderBy(desc("total_revenue"), asc("customer_city"), asc("customer_state"))
        .limit(n)
    )


def regional_performance(orders, customers):
    region = lookup(F.col("customer_state"), fixed.REGION_STATES, fixed.OTHER_REGION)
    return (
        _with_customers(orders, customers, "customer_state")
        .groupBy(region.alias("region"))
        .agg(*_totals())
        .withColumn(
            "revenue_per_order",
            F.round(ratio(F.col("total_revenue"), F.col("total_orders")), 2),
        )
        .orderBy(desc("total_revenue"))
    )


def age_groups(orders, customers, exact_ratio=False):
    """Sales by age band; customers of unknown age are left out."""
    known = customers.filter(F.col("customer_age").isNotNull())
    return (
        _with_customers(orders, known, "customer_age")
        .groupBy(band(F.col("customer_age"), fixed.AGE_BANDS).alias("age_group"))
        .agg(*_totals())
        .withColumn(
            "avg_orders_per_customer",
            orders_per_customer(F.col("total_orders"), F.col("unique_customers"), exact_ratio),
        )
        .orderBy(desc("avg_order_value"))
    )


def gender_patterns(
    orders, customers, order_items, products, revenue="order_total", collation=None
):
    """Sales by gender over order lines, with the categories bought.

    Category names go by their bytes, or by a ``collation`` and then by their bytes.
    """
    reported = customers.select("customer_id", "customer_gender").filter(
        F.col("customer_gender").isin(*fixed.REPORTED_GENDERS)
    )
    # Orders of other customers go before their lines are joined.
    gendered = orders.join(reported, "customer_id")
    by_category = (
        sold_lines(gendered, order_items, revenue, "customer_id", "customer_gender")
        .join(products.select("product_id", "product_category"), "product_id")
        .groupBy("customer_gender", "customer_id", "product_category")
        .agg(
            F.count("*").alias("lines"),
            F.sum("amount").alias("amount"),
            F.count("amount").alias("amounts"),
        )
    )
    # Sums only per customer and per category; what is gathered are category names.
    names = (F.col("customer_id").cast("string"), F.col("product_category"))
    cells = F.explode(
        F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("name")) for k, n in enumerate(names)])
    )
    figures = ("lines", "amount", "amounts")
    by_name = (
        by_category.select("customer_gender", *figures, cells.alias("cell"))
        .groupBy("customer_gender", "cell.kind", "cell.name")
        .agg(*[F.sum(c).alias(c) for c in figures])
    )
    per_customer, per_category = F.col("kind") == 0, F.col("kind") == 1
    categories = in_text_order(F.collect_list(F.when(per_category, F.col("name"))), collation)
    amount, amounts = (F.sum(F.when(per_customer, F.col(c))) for c in ("amount", "amounts"))
    return (
        by_name.groupBy("customer_gender")
        .agg(
            F.count(F.when(per_customer, F.col("name"))).alias("unique_customers"),
            F.sum(F.when(per_customer, F.col("lines"))).alias("total_orders"),
            amount.alias("total_revenue"),
            F.round(mean(amount, amounts), 2).alias("avg_order_value"),
            F.when(F.size(categories) > 0, F.array_join(categories, ", ")).alias(
                "popular_categories"
            ),
        )
        .orderBy(desc("total_revenue"))
    )


def payment_methods(orders):
    share = percent(
        F.col("transaction_count"), F.sum("transaction_count").over(Window.partitionBy())
    )
    return (
        orders.groupBy("payment_method")
        .agg(
            F.count("*").alias("transaction_count"),
            F.sum("total_amount").alias("total_revenue"),
            F.round(mean(F.sum("total_amount"), F.count("total_amount")), 2).alias(
                "avg_transaction_value"
            ),
            F.count_distinct("customer_id").alias("unique_customers"),
        )
        .withColumn("percentage_of_orders", F.round(share, 2))
        .orderBy(desc("total_revenue"))
    )


def shipping(orders):
    """Shipped orders by method, with whole days from order to shipment."""
    days = whole_days(F.col("shipped_date"), F.col("order_date"))
    return (
        orders.filter(F.col("shipped_date").isNotNull())
        .groupBy("shipping_method")
        .agg(
            F.count("*").alias("order_count"),
            F.sum("total_amount").alias("total_revenue"),
            F.round(mean(F.sum("total_amount"), F.count("total_amount")), 2).alias(
                "avg_order_value"
            ),
            F.round(mean(F.sum("shipping_cost"), F.count("shipping_cost")), 2).alias(
                "avg_shipping_cost"
            ),
            F.round(mean(F.sum(days), F.count(days)), 1).alias("avg_processing_days"),
        )
        .orderBy(desc("order_count"))
    )
