"""Shop tables and flat order rows from a folder of star-schema Parquet files.

The files (customer, part, orders, lineitem, nation) lack some shop columns;
those are derived from keys and existing columns by fixed rules.

Orders carry a merge hint: orders and lines grow together, so that small test
data runs through the same shuffled join as large data.
"""

from pyspark.sql import functions as F

from tillroll.functions import money
from tillroll.sources.tables import Shop

# State by nation key, gender by cents of the balance modulo 3.
STATES = (
    "CA", "OR", "WA", "TX", "AZ", "NM", "OK", "NY", "NJ", "CT", "MA", "PA", "FL",
    "GA", "SC", "NC", "VA", "IL", "CO", "NV", "TN", "MN", "MI", "MD", "OH",
)
GENDERS = ("Male", "Female", "Unknown")
# Gender as typed into flat rows, by customer key modulo 11; the last is missing.
TYPED_GENDERS = ("M", "m", "male", "MALE", "F", "f", "female", "FEMALE", "Male", "x", None)
# Payment method as typed into flat rows, by order key modulo 4; the last is missing.
TYPED_PAYMENTS = ("credit card", "PayPal", "\tDEBIT CARD ", None)


def _pick(index, values):
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


# Declared, so that no file is opened just to learn its types.
STAR_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
}


def star_files(folder):
    return [f"{folder}/{name}.parquet" for name in STAR_SCHEMAS]


def _reader(spark, folder):
    return lambda name: spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def shop_from_star(spark, folder):
    table = _reader(spark, folder)
    lines = table("lineitem")
    from_lines = lines.groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("shipped_date"), F.min("l_partkey").alias("product_id")
    )
    heads = table("orders")
    orders = heads.join(
        from_lines, F.col("o_orderkey") == F.col("l_orderkey"), "left"
    ).select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        money(F.col("o_totalprice")).alias("total_amount"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("o_orderstatus").alias("shipping_method"),
        money(money(F.col("o_orderkey") % 2500) * F.lit("0.01").cast("decimal(3,2)")).alias(
            "shipping_cost"
        ),
        "shipped_date",
        "product_id",
    ).hint("merge")
    order_items = lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        money(F.col("l_extendedprice")).alias("unit_price"),
    )
    products = table("part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("product_category"),
        money(F.col("p_retailprice")).alias("cost_price"),
    )
    # From the balance, not the key: what is derived from a join key can be filtered
    # before the join, which no real attribute allows.
    cents = F.round(F.abs("c_acctbal") * 100).cast("bigint")
    customers = table("customer").join(
        table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    ).select(
        F.col("c_custkey").alias("customer_id"),
        F.when(cents % 17 != 0, 18 + cents % 60).cast("int").alias("customer_age"),
        _pick(cents % 3, GENDERS).alias("customer_gender"),
        F.col("n_name").alias("customer_city"),
        _pick(F.col("c_nationkey"), STATES).alias("customer_state"),
    )
    return Shop(orders, order_items, products, customers)


def flat_from_star(spark, folder, in_order=False):
    """Flat order rows, one per order line, with the faults cleaning is made for.

    ``source_row`` gives the position in the "file"; an order's further lines
    are its repeats. ``in_order`` sorts by it before the rows are made, while they
    are short.
    """
    table = _reader(spark, folder)
    customers = table("customer").join(
        table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    # Orders meet customers and lines meet products while both are narrow, so the many
    # wide rows are shuffled once, by order; they come out order by order, which packs well.
    heads = table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = table("lineitem").join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.join(heads.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    order, line, customer, part = (
        F.col(c) for c in ("l_orderkey", "l_linenumber", "c_custkey", "p_partkey")
    )
    price = money(F.col("l_extendedprice"))
    source_row = F.concat_ws(
        "-",
        F.lpad(order.cast("string"), 15, "0"),
        F.lpad(line.cast("string"), 2, "0"),
        F.lpad(part.cast("string"), 12, "0"),
        F.lpad(F.col("l_suppkey").cast("string"), 12, "0"),
    )
    if in_order:
        rows = rows.orderBy(source_row)
    return rows.select(
        source_row.alias("source_row"),
        F.when((order + line) % 41 != 0, F.concat(F.lit("ORD"), order)).alias("order_id"),
        F.when((order + line) % 43 != 0, F.concat(F.lit("CUST"), customer)).alias(
            "customer_id"
        ),
        F.when(customer % 29 == 0, F.lit(None))
        .when(customer % 19 == 0, "not an address")
        .otherwise(F.concat(F.lit("buyer."), customer, F.lit("@mail.example.com")))
        .alias("customer_email"),
        F.when(customer % 17 != 0, 16 + customer % 90).cast("double").alias("customer_age"),
        _pick(customer % 11, TYPED_GENDERS).alias("customer_gender"),
        F.col("n_name").alias("customer_city"),
        _pick(F.col("c_nationkey"), STATES).alias("customer_state"),
        F.when(customer % 31 == 0, "no phone")
        .otherwise(F.concat(F.lit("+1 (555) 01-"), customer))
        .alias("customer_phone"),
        F.when((order + line) % 97 == 0, "unknown")
        .when((order + line) % 23 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("order_date"),
        F.concat(F.lit("PROD"), part).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.when(part % 5 == 0, F.concat(F.lit("  "), F.lower("p_type"), F.lit("\t")))
        .when(part % 5 == 1, F.upper("p_type"))
        .when(part % 5 == 2, F.concat(F.col("p_type"), F.lit(" women's e-commerce x1y")))
        .when(part % 5 == 3, F.col("p_type"))
        .alias("product_category"),
        F.when((order * 7 + line) % 53 == 0, 0)
        .when((order * 7 + line) % 59 == 0, -1)
        .otherwise(F.col("l_quantity"))
        .cast("bigint")
        .alias("quantity"),
        F.when((order + 3 * line) % 61 != 0, price).otherwise(money(F.lit(0))).alias(
            "unit_price"
        ),
        F.when(order % 47 == 0, F.lit(None))
        .when(order % 101 == 0, money(price * 25))
        .otherwise(price)
        .alias("total_amount"),
        _pick(order % 4, TYPED_PAYMENTS).alias("payment_method"),
        F.col("o_orderstatus").alias("shipping_method"),
        money(money(order % 2500) * F.lit("0.01").cast("decimal(3,2)")).alias("shipping_cost"),
    )
