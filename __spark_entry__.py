"""

``entry`` runs the flagship query, ``queries`` names one callable per report,
option and pipeline stage, ``oracle_sql`` the DuckDB text of the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import oracle_sql as oracle
from tillroll import fixed_values as fixed
from tillroll import jobs, plans
from tillroll.functions import (
    as_of_date,
    day_of_week,
    month_start,
    months_between_starts,
    whole_days,
)
from tillroll.operators import cleaning, normalizing, profiling
from tillroll.session import bounded_tasks
from tillroll.sources.delimited import (
    MALFORMED,
    SOURCE_ORDER,
    numbered,
    read_flat_csv,
    write_csv,
)
from tillroll.sources.scratch import scratch_path, written
from tillroll.sources.star_schema import flat_from_star, shop_from_star, star_files

# The corpus operators are a part of their own, which may be absent, as may the
# packages only they need (see the optional dependencies in pyproject.toml).
OPTIONAL = (
    "corpus_pipeline", "tillroll.llm", "numpy", "pandas", "pyarrow", "public_tokenizers",
    "sentencepiece", "tokenizers", "xxhash",
)
try:
    import corpus_pipeline  # noqa: F401
    from tillroll.llm import queries as corpus
except ModuleNotFoundError as missing:
    if missing.name not in OPTIONAL:
        raise
    corpus = None

AS_OF = oracle.AS_OF
DATES = ("yyyy-M-d",)


def comparable(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and decimals as double, as the oracle returns them."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.IntegralType):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _on_shop(report, *tables, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shop = shop_from_star(bounded_tasks(spark, *star_files(sf_dir)), sf_dir)
        return comparable(report(*[getattr(shop, t) for t in tables], **options))

    return run


def _on_flat(stage, stored=True, in_order=False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        flat = flat_from_star(bounded_tasks(spark, *star_files(sf_dir)), sf_dir, in_order)
        if stored:  # as a parsed file would be, for stages that read the rows repeatedly
            flat = written(flat, "flat")
        return comparable(stage(spark, flat, sf_dir))

    return run


def _clv(orders, **options):
    clv = plans.customer_clv(orders, **options)
    return clv.withColumn("avg_order_value", F.round("avg_order_value", 8))


def _calendar(orders):
    date = F.col("order_date")
    return orders.select(
        "order_id",
        F.year(date).alias("year"),
        F.quarter(date).alias("quarter"),
        F.month(date).alias("month"),
        F.dayofmonth(date).alias("day"),
        day_of_week(date).alias("day_of_week"),
        F.date_format(date, "EEEE").alias("day_name"),
        month_start(date).alias("month_start"),
        months_between_starts(date, as_of_date("1995-01-01"), wrap=True).alias("age_months"),
        whole_days(F.col("shipped_date"), date).alias("processing_days"),
        whole_days(as_of_date(AS_OF), date).alias("days_ago"),
    )


def _clean(flat, gender_map=fixed.GENDER_MAP):
    cleaned = cleaning.clean_orders(flat, "source_row", gender_map=gender_map)
    return cleaned.withColumn("revenue_per_item", F.round("revenue_per_item", 8))


def _gender_counts(spark, flat, sf_dir):
    cleaned = _clean(flat, fixed.GENDER_MAP_WITH_IDENTITY)
    return cleaned.groupBy("customer_gender").agg(F.count("*").alias("orders"))


def _costs(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(
        F.concat(F.lit("PROD"), "p_partkey").alias("product_id"),
        F.col("p_retailprice").alias("cost_price"),
    )


def _csv_round_trip(spark, flat, sf_dir):
    path = scratch_path(spark, "flat-csv")
    write_csv(flat.fillna("N/A"), path, compression="gzip")
    return read_flat_csv(spark, path).drop(SOURCE_ORDER)


def _estimated_profile(spark, flat, sf_dir):
    """The exact figures, and whether the estimate is within ten percent."""
    estimated = profiling.profile_columns(flat, exact=False).select(
        "column_name", F.col("unique_count").alias("estimate")
    )
    exact = profiling.profile_columns(flat).join(estimated, "column_name")
    off = F.abs(F.col("estimate") - F.col("unique_count"))
    near = off <= F.greatest(F.lit(1), F.col("unique_count") * 0.1)
    return exact.withColumn("estimate_is_near", near).drop("estimate")


def _date_times(spark, flat, sf_dir):
    timed = flat.withColumn("order_date", F.concat("order_date", F.lit(" 10:30:00")))
    return cleaning.clean_orders(timed, "source_row").select("order_id", "order_date")


def _reread(spark, df, name):
    path = scratch_path(spark, name)
    write_csv(df, path, compression="gzip")
    return read_flat_csv(spark, path)


def _fractions(spark, flat, sf_dir):
    parts = flat.withColumn("quantity", F.col("quantity") + F.lit("0.5").cast("decimal(2,1)"))
    parts = parts.withColumn("unit_price", F.col("unit_price") * F.lit("0.001").cast("decimal(4,3)"))
    stored = _reread(spark, parts, "fractions")
    kept = cleaning.clean_orders(stored, "source_row").withColumn(
        "revenue_per_item", F.round("revenue_per_item", 8)
    )
    return kept.select("order_id", "quantity", "unit_price", "revenue_per_item")


def _reread_monthly(spark, flat, sf_dir):
    once = cleaning.clean_orders(flat, "source_row")
    again = cleaning.clean_orders(_reread(spark, once, "cleaned-csv"))
    return plans.monthly_sales(normalizing.orders_from_flat(again))


def _raw_file(spark, flat, compression="none"):
    """The flat rows as a file, in the order they come in."""
    path = scratch_path(spark, "raw-csv")
    write_csv(flat, path, compression=compression)
    return path


def _cleaning_job(spark, flat, sf_dir):
    out = scratch_path(spark, "cleaned")
    jobs.run_cleaning(spark, _raw_file(spark, flat, "gzip"), out)
    return spark.read.parquet(out).withColumn("revenue_per_item", F.round("revenue_per_item", 8))


def _cleaning_job_report(spark, flat, sf_dir):
    raw = _raw_file(spark, flat, "gzip")
    return jobs.run_cleaning(spark, raw, scratch_path(spark, "cleaned"))["report"]


def _cleaned_twice(spark, flat, sf_dir):
    """What a second run makes of the file a first one saved, numbered in file order."""
    once, twice = scratch_path(spark, "once"), scratch_path(spark, "twice")
    jobs.run_cleaning(spark, _raw_file(spark, flat), once, "csv")
    jobs.run_cleaning(spark, once, twice, "csv")
    placed = numbered(read_flat_csv(spark, twice, multiline=False))
    return placed.select(
        "place",
        "source_row",
        "order_id",
        F.col("order_date").cast("timestamp_ntz").alias("order_date"),
        "product_category",
        "age_group",
        "total_amount",
    )


def _inferred_types(spark, flat, sf_dir):
    """The type of every column by its text in a file, beside the declared one."""
    path = _raw_file(spark, flat)
    found = dict(read_flat_csv(spark, path, T.StructType(), False, infer=True).dtypes)
    declared = {f.name: f.dataType.simpleString() for f in jobs.KNOWN}
    rows = [(c, declared.get(c, "string"), kind) for c, kind in found.items()]
    return spark.createDataFrame(rows, "column_name string, declared string, inferred string")


def _malformed_csv(spark, sf_dir):
    """A file with line ends in quotes, records that are too long and some too short."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    start = F.concat(F.lit("ORD"), "l_orderkey", F.lit(","), "l_linenumber")
    ends = ((",plain",), (',"two', 'lines"'), (",long,extra",), ("",), (',"a, ""b"""',))
    texts = [F.array(F.concat(start, F.lit(e[0])), *map(F.lit, e[1:])) for e in ends]
    kind = F.col("l_orderkey") % len(ends)
    rows = lines.select(F.explode(F.get(F.array(*texts), kind.cast("int"))).alias("order_id,line,note"))
    path = scratch_path(spark, "malformed-csv")
    rows.write.option("header", True).option("sep", "\x01").option("quote", "\x02").csv(path)
    found = read_flat_csv(spark, path, malformed="column")
    return (
        found.groupBy("order_id", "note", F.col(MALFORMED).alias("record"))
        .agg(F.count("*").alias("lines"))
        .withColumn("note", F.when(F.col("record").isNull(), F.col("note")).otherwise(F.lit("long")))
    )


def _recased(report, column, *tables, **options):
    """A report with names in title case for products of even number."""

    def run(spark, sf_dir):
        shop = shop_from_star(bounded_tasks(spark, *star_files(sf_dir)), sf_dir)
        name = F.when(
            F.col("product_id").try_cast("bigint") % 2 == 0,
            F.concat(F.upper(F.substring(column, 1, 1)), F.lower(F.substring(column, 2, 1000))),
        ).otherwise(F.col(column))
        products = shop.products.withColumn(column, name)
        given = [products if t == "products" else getattr(shop, t) for t in tables]
        return comparable(report(*given, **options))

    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: category performance over orders, lines and products."""
    return queries()["category_performance"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per report, report option, cleaning stage, profile and table builder."""
    o, i, p, c = "orders", "order_items", "products", "customers"
    by_line = {"revenue": "line"}
    return {
        "dataset_overview": _on_shop(plans.dataset_overview, o),
        "data_quality": _on_shop(plans.data_quality, o),
        "revenue_distribution": _on_shop(plans.revenue_distribution, o),
        "revenue_distribution_custom_bands": _on_shop(
            plans.revenue_distribution, o, bands=oracle.WIDE_BANDS
        ),
        "monthly_sales": _on_shop(plans.monthly_sales, o),
        "day_of_week": _on_shop(plans.day_of_week_sales, o),
        "quarterly_growth": _on_shop(plans.quarterly_growth, o),
        "quarterly_growth_filled": _on_shop(plans.quarterly_growth, o, fill_gaps=True),
        "revenue_moving_avg": _on_shop(plans.revenue_moving_avg, o),
        "revenue_moving_avg_filled": _on_shop(plans.revenue_moving_avg, o, fill_gaps=True),
        "top_customers": _on_shop(plans.top_customers, o),
        "rfm_segments": _on_shop(plans.rfm_segments, o, as_of=AS_OF),
        "rfm_scores": _on_shop(plans.rfm_scores, o, as_of=AS_OF),
        "customer_clv": _on_shop(_clv, o),
        "customer_clv_all": _on_shop(_clv, o, n=None),
        "churn_risk": _on_shop(plans.churn_risk, o, as_of=AS_OF),
        "cohort_retention": _on_shop(plans.cohort_retention, o),
        "cohort_retention_elapsed": _on_shop(plans.cohort_retention, o, wrap_months=False),
        "top_products": _on_shop(plans.top_products, o, i, p),
        "top_products_by_line": _on_shop(plans.top_products, o, i, p, **by_line),
        "category_performance": _on_shop(plans.category_performance, o, i, p),
        "category_performance_by_line": _on_shop(
            plans.category_performance, o, i, p, **by_line
        ),
        "seasonal_performance": _on_shop(plans.seasonal_performance, o, i, p),
        "seasonal_performance_by_line": _on_shop(
            plans.seasonal_performance, o, i, p, **by_line
        ),
        "gender_patterns": _on_shop(plans.gender_patterns, o, c, i, p),
        "gender_patterns_by_line": _on_shop(plans.gender_patterns, o, c, i, p, **by_line),
        "market_basket": _on_shop(plans.market_basket, o, i, p),
        "market_basket_in_parts": _on_shop(plans.market_basket, o, i, p, part_width=3, narrow=3),
        "market_basket_all_pairs": _on_shop(plans.market_basket, o, i, p, n=None),
        "market_basket_by_product": _on_shop(
            plans.market_basket, o, i, p, min_pairs=2, key="product_id"
        ),
        "market_basket_collated": _recased(
            plans.market_basket, "product_name", o, i, p, n=500, collation="UNICODE"
        ),
        "gender_patterns_collated": _recased(
            plans.gender_patterns, "product_category", o, c, i, p, collation="UNICODE"
        ),
        "sales_by_city": _on_shop(plans.sales_by_city, o, c),
        "regional_performance": _on_shop(plans.regional_performance, o, c),
        "payment_methods": _on_shop(plans.payment_methods, o),
        "shipping": _on_shop(plans.shipping, o),
        "product_profit": _on_shop(plans.product_profit, i, p),
        "product_profit_all": _on_shop(plans.product_profit, i, p, n=None),
        "monthly_profit": _on_shop(plans.monthly_profit, o, i, p),
        "age_groups": _on_shop(plans.age_groups, o, c),
        "age_groups_exact_ratio": _on_shop(plans.age_groups, o, c, exact_ratio=True),
        "kpi_summary": _on_shop(plans.kpi_summary, o),
        "kpi_summary_exact_ratio": _on_shop(plans.kpi_summary, o, exact_ratio=True),
        "order_calendar": _on_shop(_calendar, o),
        "screened_orders": _on_flat(
            lambda spark, flat, sf_dir: cleaning.screen_orders(flat, "source_row")
        ),
        "cleaned_orders": _on_flat(lambda spark, flat, sf_dir: _clean(flat)),
        "cleaned_orders_identity_genders": _on_flat(_gender_counts),
        "cleaning_report": _on_flat(
            lambda spark, flat, sf_dir: cleaning.cleaning_report(flat, _clean(flat))
        ),
        "cleaning_job": _on_flat(_cleaning_job, stored=False, in_order=True),
        "cleaning_job_report": _on_flat(_cleaning_job_report, stored=False, in_order=True),
        "cleaned_twice": _on_flat(_cleaned_twice, stored=False, in_order=True),
        "csv_inferred_types": _on_flat(_inferred_types, stored=False, in_order=True),
        "csv_malformed": _malformed_csv,
        "null_counts": _on_flat(
            lambda spark, flat, sf_dir: cleaning.null_counts(flat), stored=False
        ),
        "profile_columns": _on_flat(
            lambda spark, flat, sf_dir: profiling.profile_columns(flat), stored=False
        ),
        "profile_columns_estimated": _on_flat(
            _estimated_profile,
        ),
        "profile_summary": _on_flat(
            lambda spark, flat, sf_dir: profiling.profile_summary(flat)
        ),
        "csv_round_trip": _on_flat(_csv_round_trip, stored=False),
        "normalized_customers": _on_flat(
            lambda spark, flat, sf_dir: normalizing.customers_from_flat(_clean(flat))
        ),
        "normalized_products": _on_flat(
            lambda spark, flat, sf_dir: normalizing.products_from_flat(
                _clean(flat), _costs(spark, sf_dir)
            )
        ),
        "normalized_order_items": _on_flat(
            lambda spark, flat, sf_dir: normalizing.order_items_from_flat(_clean(flat))
        ),
        "normalized_orders": _on_flat(
            lambda spark, flat, sf_dir: normalizing.orders_from_flat(_clean(flat))
        ),
        "normalized_repeated_orders": _on_flat(
            lambda spark, flat, sf_dir: normalizing.orders_from_flat(
                flat, unique_orders=False, date_formats=DATES
            )
        ),
        "cleaned_date_times": _on_flat(_date_times),
        "cleaned_fractions": _on_flat(_fractions),
        "cleaned_csv_reread_monthly": _on_flat(_reread_monthly),
        "cleaned_monthly_sales": _on_flat(
            lambda spark, flat, sf_dir: plans.monthly_sales(
                normalizing.orders_from_flat(_clean(flat))
            )
        ),
    } | (corpus.queries() if corpus else {})


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name; estimated figures have none."""
    texts = oracle.oracle_sql()
    return texts | (corpus.oracle_sql() if corpus else {})
