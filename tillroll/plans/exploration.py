"""Data exploration reports."""

from pyspark.sql import functions as F

from tillroll import fixed_values as fixed
from tillroll.functions import asc, band, mean


def dataset_overview(orders):
    """Row, customer and product counts, date range, revenue. Needs product_id on orders."""
    return orders.agg(
        F.count("*").alias("total_records"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct("product_id").alias("unique_products"),
        F.min("order_date").alias("earliest_order"),
        F.max("order_date").alias("latest_order"),
        F.sum("total_amount").alias("total_revenue"),
    )


def data_quality(orders):
    """Missing keys, dates and amounts, and amounts that are not positive.

    On an empty table the figures are NULL, not 0.
    """

    def rows_where(condition):
        return F.sum(F.when(condition, 1).otherwise(0))

    checked = ("order_id", "customer_id", "order_date", "total_amount")
    return orders.agg(
        F.lit("orders").alias("table_name"),
        *[rows_where(F.col(c).isNull()).alias(f"null_{c}") for c in checked],
        rows_where(F.col("total_amount") <= 0).alias("invalid_amounts"),
    )


def revenue_distribution(orders, bands=fixed.REVENUE_BANDS):
    """Orders and revenue by order value band; a missing amount counts as the last band."""
    return (
        orders.groupBy(band(F.col("total_amount"), bands).alias("revenue_category"))
        .agg(
            F.count("*").alias("order_count"),
            F.round(mean(F.sum("total_amount"), F.count("total_amount")), 2).alias(
                "avg_order_value"
            ),
            F.sum("total_amount").alias("total_revenue"),
        )
        .orderBy(asc("avg_order_value"))
    )
