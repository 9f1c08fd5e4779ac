import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from tillroll import fixed_values as fixed
from tillroll import functions as f


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_title_case_and_strip_follow_letter_runs(spark):
    values = [
        "PayPal",
        "women's e-commerce x1y",
        "home & kitchen",
        "  home & kitchen\t",
        "a&b",
        "two  spaces",
        "",
        None,
        "éCOLE o'brien",
        "ǅungla 中b",
        " edge ",
    ]
    got = column(spark, values, "string").select(f.strip(f.title_case(F.col("v")))).collect()
    assert [r[0] for r in got] == [None if v is None else v.title().strip() for v in values]


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.text(alphabet="abXY z&'-_.09\t\néÉ中αΩ", max_size=12),
        min_size=40,
        max_size=60,
    )
)
def test_title_case_on_random_text(spark, values):
    got = column(spark, values, "string").select(f.strip(f.title_case(F.col("v")))).collect()
    assert [r[0] for r in got] == [v.title().strip() for v in values]


def test_digits_only(spark):
    values = ["(555) 123-4567", "+1 555", "none", "", None, "٣x"]
    got = column(spark, values, "string").select(f.digits_only(F.col("v"))).collect()
    assert [r[0] for r in got] == ["5551234567", "1555", None, None, None, "٣"]


def test_calendar(spark, conf):
    conf("spark.sql.session.timeZone", "America/Sao_Paulo")
    days = [dt.datetime(2018, 11, 4, 13), dt.datetime(2024, 1, 7), dt.datetime(2023, 12, 31, 23)]
    got = (
        column(spark, days, "timestamp_ntz")
        .select(
            f.day_of_week(F.col("v")),
            f.month_start(F.col("v")),
            f.whole_days(f.as_of_date("2024-01-14"), F.col("v")),
            f.season(F.col("v")),
        )
        .collect()
    )
    assert [tuple(r) for r in got] == [
        (0, dt.datetime(2018, 11, 1), 1896, "Fall"),
        (0, dt.datetime(2024, 1, 1), 7, "Winter"),
        (0, dt.datetime(2023, 12, 1), 13, "Winter"),
    ]


def test_whole_days_cut_toward_zero(spark):
    pairs = [
        (dt.datetime(2024, 1, 14, 12), dt.datetime(2024, 1, 1), 13),
        (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2, 18), -1),
        (None, dt.datetime(2024, 1, 1), None),
    ]
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz, days bigint")
    got = df.select(f.whole_days(F.col("a"), F.col("b")), "days").collect()
    assert all(r[0] == r[1] for r in got)


def test_months_wrap_after_a_year(spark):
    df = column(spark, [dt.datetime(2025, 3, 31)], "timestamp_ntz")
    first = F.lit("2024-01-01").cast("timestamp_ntz")
    got = df.select(
        f.months_between_starts(F.col("v"), first),
        f.months_between_starts(F.col("v"), first, wrap=True),
    ).first()
    assert tuple(got) == (14, 2)


def test_bands(spark):
    ages = [None, 17, 24, 25, 34, 35, 64, 65, 101]
    got = column(spark, ages, "int").select(f.band(F.col("v"), fixed.AGE_BANDS)).collect()
    assert [r[0] for r in got] == [
        "65+", "18-24", "18-24", "25-34", "25-34", "35-44", "55-64", "65+", "65+",
    ]


def test_clean_age_groups_are_closed_on_the_right(spark):
    ages = [None, 0, 0.5, 17, 25, 26, 35, 50, 65, 66, 100, 101]
    got = (
        column(spark, [None if a is None else float(a) for a in ages], "double")
        .select(f.ranges(F.col("v"), fixed.CLEAN_AGE_GROUPS))
        .collect()
    )
    assert [r[0] for r in got] == [
        None, None, "18-25", "18-25", "18-25", "26-35", "26-35", "36-50", "51-65", "65+",
        "65+", None,
    ]


def test_lookup_default(spark):
    got = (
        column(spark, ["CA", "OK", "PA", "VA", "IL", None], "string")
        .select(f.lookup(F.col("v"), fixed.REGION_STATES, fixed.OTHER_REGION))
        .collect()
    )
    assert [r[0] for r in got] == ["West", "Southwest", "Northeast", "Southeast", "Other", "Other"]


def test_ratio_rounds_once(spark):
    df = spark.createDataFrame(
        [(Decimal("968.70"), 12), (Decimal("1.00"), 3), (Decimal("-0.05"), 2)],
        "total decimal(28,2), n bigint",
    )
    got = df.select(F.round(f.mean(F.col("total"), F.col("n")), 2)).collect()
    assert [r[0] for r in got] == [Decimal("80.73"), Decimal("0.33"), Decimal("-0.03")]


def test_zero_denominator(spark):
    df = spark.createDataFrame([(Decimal("1.00"), 0)], "a decimal(18,2), b bigint")
    assert df.select(f.ratio(F.col("a"), F.col("b"), "null")).first()[0] is None
    with pytest.raises(ArithmeticException):
        df.select(f.ratio(F.col("a"), F.col("b"))).collect()
    with pytest.raises(ValueError):
        f.ratio(F.col("a"), F.col("b"), "zero")


def test_null_order(spark):
    df = column(spark, [2, None, 1], "int")
    assert [r[0] for r in df.orderBy(f.asc("v")).collect()] == [1, 2, None]
    assert [r[0] for r in df.orderBy(f.desc("v")).collect()] == [None, 2, 1]
