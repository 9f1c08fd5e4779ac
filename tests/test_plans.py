"""What the physical plans may and may not contain, with broadcasts off as on large data."""

import re

import pytest
from conftest import SAMPLE, plan_of
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tillroll import plans
from tillroll.sources.star_schema import shop_from_star

LIMITED = (
    "top_customers", "customer_clv", "top_products", "market_basket", "sales_by_city",
    "product_profit",
)


@pytest.fixture
def large_data_plans(conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")


@pytest.fixture
def written_plans(monkeypatch):
    """Also collect the plans of intermediate tables."""
    from tillroll.operators import cleaning, pairs
    from tillroll.plans import customers, products
    from tillroll.sources import scratch

    collected = []

    def watch(df, name):
        collected.append(plan_of(df))
        return scratch.written(df, name)

    def watch_observed(df, path, figures):
        collected.append(plan_of(df))
        return scratch.written_and_observed(df, path, figures)

    for module in (cleaning, pairs, products):
        monkeypatch.setattr(module, "written", watch)
    monkeypatch.setattr(customers, "written_and_observed", watch_observed)
    return collected


def below_single_partitions(plan):
    """What feeds each exchange into a single task: the next three operators."""
    lines = [re.sub(r"^[\s:|+\-*()0-9]*", "", line) for line in plan.splitlines()]
    return [
        " ".join(lines[number + 1 : number + 4])
        for number, line in enumerate(lines)
        if "Exchange SinglePartition" in line
    ]


# The corpus operators, where present, have tests and plans of their own.
OWN = sorted(n for n in queries() if n != "pipeline" and not re.match(r"op\d+_", n))


@pytest.mark.parametrize("name", OWN)
def test_plans_scale(spark, large_data_plans, written_plans, name):
    result = plan_of(queries()[name](spark, SAMPLE))
    for plan in [*written_plans, result]:
        for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in plan, node
        for below in below_single_partitions(plan):
            assert "Aggregate" in below or "Generate" in below, below


def test_tiles_need_no_shuffle_once_their_bounds_are_known(spark, large_data_plans):
    orders = shop_from_star(spark, SAMPLE).orders
    assert "Exchange" not in plan_of(plans.rfm_scores(orders, "2001-08-15"))


@pytest.mark.parametrize("name", LIMITED)
def test_limits_do_not_sort_everything(spark, name):
    assert "TakeOrderedAndProject" in plan_of(queries()[name](spark, SAMPLE))


def columns_read(df):
    return [
        set(re.findall(r"(\w+):", schema))
        for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(df))
    ]


def test_scans_read_only_what_is_used(spark, large_data_plans):
    result = queries()["monthly_sales"](spark, SAMPLE)
    assert columns_read(result) == [{"o_custkey", "o_totalprice", "o_orderdate"}]
    result = queries()["product_profit"](spark, SAMPLE)
    assert {"l_partkey", "l_quantity", "l_extendedprice"} in columns_read(result)


@pytest.mark.parametrize(
    "name, scans", [("quarterly_growth_filled", 1), ("revenue_moving_avg_filled", 1)]
)
def test_orders_are_read_once(spark, large_data_plans, name, scans):
    assert plan_of(queries()[name](spark, SAMPLE)).count("FileScan") == scans


def test_gender_report_filters_customers_before_lines(spark, tmp_path, large_data_plans):
    shop = shop_from_star(spark, SAMPLE)
    shop.customers.write.parquet(f"{tmp_path}/customers")
    stored = spark.read.parquet(f"{tmp_path}/customers")
    plan = plan_of(plans.gender_patterns(shop.orders, stored, shop.order_items, shop.products))
    lines, customers = plan.index("SortMergeJoin [order_id"), plan.index("SortMergeJoin [customer_id")
    assert lines < customers  # nearer to the top
    per_customer = [x for x in plan.split("\n") if "keys=[customer_gender" in x and "customer_id" in x]
    assert per_customer and not any("collect_set" in x for x in per_customer)


def test_customer_reports_join_totals_not_orders(spark, large_data_plans):
    plan = plan_of(queries()["regional_performance"](spark, SAMPLE))
    join, *_ = [part for part in plan.split("SortMergeJoin [customer_id") if part][1:]
    assert "HashAggregate(keys=[customer_id" in join


def test_filters_reach_the_scan(spark, tmp_path, large_data_plans):
    path = str(tmp_path / "customers")
    shop = shop_from_star(spark, SAMPLE)
    shop.customers.write.parquet(path)
    stored = spark.read.parquet(path)
    plan = plan_of(plans.gender_patterns(shop.orders, stored, shop.order_items, shop.products))
    assert re.search(r"PushedFilters: \[[^]]*In\(customer_gender, \[Female,Male\]\)", plan)
    plan = plan_of(plans.age_groups(shop.orders, stored))
    assert "IsNotNull(customer_age)" in plan


def test_skewed_order_is_split(spark, conf, large_data_plans):
    """One order holding most lines: AQE cuts its partition for the join."""
    from pyspark.sql import functions as F

    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20000")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.shuffle.partitions", "64")
    # Hashed values, as shuffle files are compressed and sizes must show the skew.
    noise = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    lines = spark.range(0, 200_000, 1, 16).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(1).alias("order_id"),
        (noise % 50).alias("product_id"),
        noise.alias("quantity"),
        (noise / 100).cast("decimal(18,2)").alias("unit_price"),
    )
    orders = spark.range(200_000).select(
        F.col("id").alias("order_id"), (noise / 100).cast("decimal(18,2)").alias("total_amount")
    )
    products = spark.range(50).select(
        F.col("id").alias("product_id"),
        F.lit("n").alias("product_name"),
        F.lit("c").alias("product_category"),
    )
    result = plans.top_products(orders, lines, products, n=100)
    assert sum(r.times_ordered for r in result.collect()) == 200_000
    assert "SortMergeJoin(skew=true)" in plan_of(result)
