"""Order lines joined with their orders."""

from pyspark.sql import functions as F

from tillroll.functions import money


def sold_lines(orders, order_items, revenue, *order_columns):
    """Order lines with columns of their order and the revenue (``amount``) they count for.

    ``revenue="order_total"`` counts the total of the order for each of its
    lines, ``revenue="line"`` quantity times unit price.
    """
    if revenue not in ("order_total", "line"):
        raise ValueError(f"revenue must be 'order_total' or 'line', not {revenue!r}")
    by_order = revenue == "order_total"
    heads = orders.select("order_id", *order_columns, *(["total_amount"] if by_order else []))
    if by_order:
        amount = F.col("total_amount")
    else:
        amount = money(F.col("quantity") * F.col("unit_price"))
    return order_items.join(heads, "order_id").select(
        "product_id", "quantity", "unit_price", *order_columns, amount.alias("amount")
    )
