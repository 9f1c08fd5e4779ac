"""Flat order rows to the four shop tables.

Cleaned rows hold one row per order, so orders and order lines are plain
projections of them. Rows that were not cleaned need ``unique_orders=False``.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions import money
from tillroll.operators.cleaning import DATE_FORMS, date_formats_of, order_columns, parse_dates
from tillroll.operators.dedup import first_per_key
from tillroll.schema import CUSTOMER_COLUMNS
from tillroll.sources.delimited import SOURCE_ORDER
from tillroll.sources.tables import Shop


def _dated(flat, date_formats):
    """Rows with ``order_date`` as a timestamp; what does not have the form becomes NULL.

    Text of a file has the form of its first date. Rows without a file order have no
    first date, so every form that begins with the year is read; a file that mixes
    such forms therefore keeps more dates here than by its order. State
    ``date_formats`` to have the same forms either way.
    """
    if date_formats is None:
        kind = flat.schema["order_date"].dataType
        if not isinstance(kind, T.StringType):
            date_formats = ()
        elif SOURCE_ORDER in flat.columns:
            date_formats = date_formats_of(flat, "order_date", order_columns(flat))
        else:  # no first row to go by; these forms cannot be mistaken for each other
            date_formats = [form for form in DATE_FORMS if form.startswith("yyyy-")]
    dates = parse_dates(F.col("order_date"), flat.schema["order_date"].dataType, date_formats)
    return flat.withColumn("order_date", dates)


def _column(flat, name, data_type):
    """The column, or NULLs of the given type where the file has none."""
    return (F.col(name) if name in flat.columns else F.lit(None)).cast(data_type).alias(name)


def _latest_first():
    return (F.desc_nulls_last("order_date"), F.desc_nulls_last("order_id"))


def customers_from_flat(flat, date_formats=None):
    """One row per customer, as stated by the latest order."""
    rows = _dated(flat, date_formats).filter(F.col("customer_id").isNotNull())
    kept = [c for c in CUSTOMER_COLUMNS if c in flat.columns]
    latest = first_per_key(
        rows.select(*kept, "order_date", "order_id"), ["customer_id"], _latest_first()
    )
    return latest.select(*kept)


def products_from_flat(flat, costs=None, date_formats=None):
    """One row per product, as stated by the latest order.

    ``costs`` (product_id, cost_price) supplies what the flat file lacks.
    """
    rows = _dated(flat, date_formats).filter(F.col("product_id").isNotNull())
    kept = ("product_id", "product_name", "product_category")
    latest = first_per_key(
        rows.select(*kept, "order_date", "order_id"), ["product_id"], _latest_first()
    ).select(*kept)
    if costs is None:
        return latest.withColumn("cost_price", money(F.lit(None)))
    priced = costs.select("product_id", money(F.col("cost_price")).alias("cost_price"))
    return latest.join(priced, "product_id", "left")


def order_items_from_flat(flat):
    return flat.select("order_id", "product_id", "quantity", "unit_price")


def orders_from_flat(flat, unique_orders=True, date_formats=None):
    """One row per order; ``product_id`` is kept for the dataset overview.

    With several rows per order the amounts add up; everything else is taken
    from the smallest product id. Rows without an order id count as one order.
    """
    rows = _dated(flat, date_formats).select(
        "order_id",
        "customer_id",
        "order_date",
        money(F.col("total_amount")).alias("total_amount"),
        _column(flat, "payment_method", T.StringType()),
        _column(flat, "shipping_method", T.StringType()),
        _column(flat, "shipping_cost", T.DecimalType(18, 2)),
        _column(flat, "shipped_date", T.TimestampNTZType()),
        "product_id",
    )
    if unique_orders:
        return rows
    once = ("customer_id", "order_date", "payment_method", "shipping_method",
            "shipping_cost", "shipped_date", "product_id")
    totals = rows.groupBy("order_id").agg(F.sum("total_amount").alias("total_amount"))
    order = [F.asc_nulls_last("product_id"), *[F.asc_nulls_last(c) for c in once[:-1]]]
    heads = first_per_key(rows.drop("total_amount"), ["order_id"], order)
    totals = totals.withColumnRenamed("order_id", "totalled")
    return heads.join(totals, F.col("order_id").eqNullSafe(F.col("totalled"))).select(
        "order_id",
        "customer_id",
        "order_date",
        money(F.col("total_amount")).alias("total_amount"),
        *once[2:],
    )


def normalize(flat, costs=None, unique_orders=True, date_formats=None):
    return Shop(
        orders=orders_from_flat(flat, unique_orders, date_formats),
        order_items=order_items_from_flat(flat),
        products=products_from_flat(flat, costs, date_formats),
        customers=customers_from_flat(flat, date_formats),
    )
