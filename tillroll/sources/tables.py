"""The four shop tables: load, type, and store."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tillroll.functions import money
from tillroll.schema import (
    CUSTOMER_COLUMNS,
    ORDER_COLUMNS,
    ORDER_ITEM_COLUMNS,
    PRODUCT_COLUMNS,
)

TABLES = {
    "orders": ORDER_COLUMNS,
    "order_items": ORDER_ITEM_COLUMNS,
    "products": PRODUCT_COLUMNS,
    "customers": CUSTOMER_COLUMNS,
}
_MONEY_COLUMNS = ("total_amount", "shipping_cost", "unit_price", "cost_price")
_TIME_COLUMNS = ("order_date", "shipped_date")


@dataclass(frozen=True)
class Shop:
    """The inputs of the reports."""

    orders: DataFrame
    order_items: DataFrame
    products: DataFrame
    customers: DataFrame


def conform(df, columns):
    """Keep the known columns and bring money and times to the report types."""
    kept = []
    for name in columns:
        if name not in df.columns:
            continue
        column = df[name]
        if name in _MONEY_COLUMNS:
            column = money(column)
        elif name in _TIME_COLUMNS:
            column = column.cast("timestamp_ntz")
        kept.append(column.alias(name))
    return df.select(*kept)


def load_shop(spark, folder):
    """Tables stored as Parquet folders under one path."""
    return Shop(
        **{n: conform(spark.read.parquet(f"{folder}/{n}"), c) for n, c in TABLES.items()}
    )


def load_shop_from_catalog(spark, database):
    return Shop(**{n: conform(spark.table(f"{database}.{n}"), c) for n, c in TABLES.items()})


def save_shop(shop, folder):
    for name in TABLES:
        getattr(shop, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def save_shop_bucketed(shop, database, buckets):
    """Store as catalog tables, bucketed by the join keys.

    Orders and their lines share the bucketing on ``order_id``, so the join
    every product report starts with needs no shuffle.
    """
    keys = {
        "orders": "order_id",
        "order_items": "order_id",
        "products": "product_id",
        "customers": "customer_id",
    }
    for name, key in keys.items():
        (
            getattr(shop, name)
            .write.mode("overwrite")
            .bucketBy(buckets, key)
            .sortBy(key)
            .saveAsTable(f"{database}.{name}")
        )
