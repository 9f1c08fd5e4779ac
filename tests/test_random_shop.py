"""Reports against the SQL texts on random shops full of gaps and repeats."""

import datetime as dt
import random
from decimal import Decimal

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as contract
import oracle_sql
from check_oracle import multiset
from tillroll.sources.star_schema import STATES
from tillroll.sources.tables import Shop

SCHEMAS = {
    "orders": "order_id string, customer_id string, order_date timestamp_ntz, "
    "total_amount decimal(18,2), payment_method string, shipping_method string, "
    "shipping_cost decimal(18,2), shipped_date timestamp_ntz, product_id string",
    "items": "order_id string, product_id string, quantity bigint, unit_price decimal(18,2)",
    "products": "product_id string, product_name string, product_category string, "
    "cost_price decimal(18,2)",
    "customers": "customer_id string, customer_age int, customer_gender string, "
    "customer_city string, customer_state string",
}

# The calendar texts leave out rows without a date; the flat rows are not part of a shop.
LEFT_OUT = {"quarterly_growth_filled", "revenue_moving_avg_filled"}
FLAT = (
    "screened", "cleaned", "cleaning", "null_counts", "profile", "csv", "normalized",
)
NAMES = [
    name
    for name in sorted(oracle_sql.oracle_sql())
    if name not in LEFT_OUT and not name.startswith(FLAT)
]


def random_tables(seed):
    source = random.Random(seed)

    def maybe(value, gap=0.08):
        return None if source.random() < gap else value

    def cents(low, high):
        return Decimal(source.randint(low * 100, high * 100)) / 100

    def moment():
        return dt.datetime(2022, 11, 1) + dt.timedelta(minutes=source.randint(0, 900_000))

    customers = [f"C{n}" for n in range(40)]
    products = [f"P{n}" for n in range(25)]
    orders = []
    for n in range(600):
        # One customer holds a third of the orders.
        customer = "C0" if source.random() < 0.33 else source.choice(customers + ["C-gone"])
        orders.append(
            (
                maybe(f"O{n}", 0.02), maybe(customer), maybe(moment()), maybe(cents(1, 300)),
                maybe(source.choice(["Card", "Cash"])), maybe(source.choice(["Air", "Sea"])),
                maybe(cents(1, 9)), maybe(moment(), 0.3), maybe(source.choice(products)),
            )
        )
    items = []
    for n in range(2500):
        order = "O1" if source.random() < 0.1 else f"O{source.randint(0, 650)}"
        items.append(
            (
                maybe(order, 0.02), maybe(source.choice(products + ["P-gone"]), 0.02),
                maybe(source.randint(1, 9)), maybe(cents(1, 90)),
            )
        )
    names = ["ale", "bun", "cup", "dip", "egg", "fig"]
    described = [
        (p, maybe(source.choice(names)), maybe(source.choice(["x", "y", "z"])), maybe(cents(1, 50)))
        for p in products
    ]
    people = [
        (
            c, maybe(source.randint(16, 90)), maybe(source.choice(["Male", "Female", "Other"])),
            maybe(source.choice(["Oslo", "Rome"])), maybe(source.choice(STATES)),
        )
        for c in customers
    ]
    return {
        "orders": orders,
        "items": items,
        "products": described + described[:3],
        "customers": people + people[5:8],
    }


@pytest.fixture(scope="module", params=[1, 2])
def shop(request, spark):
    tables = random_tables(request.param)
    frames = {name: spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in tables.items()}
    connection = duckdb.connect()
    for name, frame in frames.items():
        connection.register(f"t_{name}", pa.Table.from_batches(frame.toArrow().to_batches()))
    return (
        Shop(frames["orders"], frames["items"], frames["products"], frames["customers"]),
        connection,
    )


@pytest.fixture(scope="module")
def texts():
    before = {}
    for table in ("orders", "items", "products", "customers"):
        constant = f"S_{table.upper()}"
        before[constant] = getattr(oracle_sql, constant)
        setattr(oracle_sql, constant, f"s_{table} AS (SELECT * FROM t_{table})")
    yield contract.oracle_sql()
    for constant, value in before.items():
        setattr(oracle_sql, constant, value)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, monkeypatch, shop, texts, name):
    frames, connection = shop
    monkeypatch.setattr(contract, "shop_from_star", lambda session, folder: frames)
    result = contract.queries()[name](spark, "")
    answer = connection.execute(texts[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(result.columns)
    assert multiset(result.columns, result.collect()) == multiset(columns, answer.fetchall())
