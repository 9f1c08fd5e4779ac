"""Sales over time. Windows here run over months or quarters, never over orders."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll import fixed_values as fixed
from tillroll.functions import asc, day_of_week, mean, month_start, percent

def average_amount(name="avg_order_value"):
    return F.round(mean(F.sum("total_amount"), F.count("total_amount")), 2).alias(name)


def monthly_sales(orders):
    return (
        orders.groupBy(
            F.year("order_date").alias("year"), F.month("order_date").alias("month")
        )
        .agg(
            F.count("*").alias("total_orders"),
            F.sum("total_amount").alias("monthly_revenue"),
            average_amount(),
            F.count_distinct("customer_id").alias("unique_customers"),
        )
        .orderBy(asc("year"), asc("month"))
    )


def day_of_week_sales(orders):
    names = F.array(*[F.lit(name) for name in fixed.DAY_NAMES])
    return (
        orders.groupBy(day_of_week(F.col("order_date")).alias("day_of_week"))
        .agg(
            F.count("*").alias("total_orders"),
            F.sum("total_amount").alias("daily_revenue"),
            average_amount(),
        )
        .select(
            "day_of_week",
            F.get(names, F.col("day_of_week")).alias("day_name"),
            "total_orders",
            "daily_revenue",
            "avg_order_value",
        )
        .orderBy(asc("day_of_week"))
    )


def _with_empty_periods(periods, start, months):
    """Follow each period by the missing ones up to the next, with revenue 0."""
    step = F.expr(f"interval {months} month")
    last_before_next = F.lead(start).over(Window.orderBy(asc(start))) - step
    return (
        periods.withColumn("until", F.coalesce(last_before_next, F.col(start)))
        .withColumn("period", F.explode_outer(F.sequence(F.col(start), F.col("until"), step)))
        .select(
            F.col("period").alias(start),
            F.when(F.col("period") > F.col(start), F.lit(0))
            .otherwise(F.col("revenue"))
            .alias("revenue"),
        )
    )


def quarterly_growth(orders, on_zero_div=None, fill_gaps=False):
    """Revenue per quarter and its change on the quarter before.

    "Before" is the previous quarter with sales; with ``fill_gaps`` it is the
    previous calendar quarter. A previous revenue of zero raises, or gives NULL
    where gaps are filled, unless ``on_zero_div`` says otherwise.
    """
    on_zero_div = on_zero_div or ("null" if fill_gaps else "raise")
    first_month = F.trunc(F.col("order_date").cast("date"), "quarter").cast("timestamp_ntz")
    quarters = orders.groupBy(first_month.alias("start")).agg(
        F.sum("total_amount").alias("revenue")
    )
    if fill_gaps:
        quarters = _with_empty_periods(quarters, "start", 3)
    previous = F.lag("revenue").over(Window.orderBy(asc("start")))
    return (
        quarters.withColumn("prev_quarter_revenue", previous)
        .select(
            F.year("start").alias("year"),
            F.quarter("start").alias("quarter"),
            "revenue",
            "prev_quarter_revenue",
            F.round(
                percent(
                    F.col("revenue") - F.col("prev_quarter_revenue"),
                    F.col("prev_quarter_revenue"),
                    on_zero_div,
                ),
                2,
            ).alias("growth_percentage"),
        )
        .orderBy(asc("year"), asc("quarter"))
    )


def revenue_moving_avg(orders, on_zero_div=None, fill_gaps=False):
    """Monthly revenue, trailing 3- and 6-row averages, month-over-month change.

    ``on_zero_div`` as in ``quarterly_growth``.
    """
    on_zero_div = on_zero_div or ("null" if fill_gaps else "raise")
    months = orders.groupBy(month_start(F.col("order_date")).alias("month")).agg(
        F.sum("total_amount").alias("revenue")
    )
    if fill_gaps:
        months = _with_empty_periods(months, "month", 1)
    by_month = Window.orderBy(asc("month"))

    def trailing(rows):
        frame = by_month.rowsBetween(1 - rows, 0)
        return F.round(
            mean(F.sum("revenue").over(frame), F.count("revenue").over(frame)), 2
        ).alias

    previous = F.lag("revenue").over(by_month)
    return months.select(
        "month",
        "revenue",
        trailing(3)("three_month_moving_avg"),
        trailing(6)("six_month_moving_avg"),
        F.round(percent(F.col("revenue") - previous, previous, on_zero_div), 2).alias(
            "month_over_month_growth"
        ),
    ).orderBy(asc("month"))
