import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.operators.median import exact_median, median_row, middle_sketch


def median_of(spark, values, kind, accuracy):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return median_row(df, "v", accuracy).first()[0]


@pytest.mark.parametrize("accuracy", [4, 7, 50_000])
@pytest.mark.parametrize("size", [1, 2, 3, 10, 501, 1000])
def test_decimals(spark, size, accuracy):
    source = random.Random(size)
    values = [Decimal(source.randint(-500_000, 500_000)) / 100 for _ in range(size)]
    assert median_of(spark, values, "decimal(18,2)", accuracy) == statistics.median(values)


def test_one_value_holding_most_rows(spark):
    values = [5.0] * 900 + [float(v) for v in range(100, 500)]
    random.Random(1).shuffle(values)
    assert median_of(spark, values, "double", 16) == statistics.median(values)


def test_middle_between_two_far_buckets(spark):
    assert median_of(spark, [1.0, 2.0, 1e9, 2e9], "double", 16) == 500_000_001.0


def test_nulls_are_left_out(spark):
    assert median_of(spark, [None, 3.0, None, 2.0], "double", 16) == 2.5
    assert median_of(spark, [None], "double", 16) is None
    assert median_of(spark, [], "double", 16) is None


def test_as_scalar(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,)], "v double")
    assert df.select(exact_median(df, "v")).distinct().collect() == [(2.5,)]


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_sketch_leaves_few_rows(spark, accuracy):
    df = spark.range(0, 300_001, 1, 64).select(
        F.xxhash64("id").alias("value"), F.xxhash64("id").cast("double").alias("number")
    )
    rows, (first, last) = df.agg(*middle_sketch(F.col("number"), accuracy)).first()
    inside = df.filter(F.col("number").between(first, last)).count()
    assert rows == 300_001 and inside <= 6 * rows / accuracy + 1
    below = df.filter(F.col("number") < first).count()
    assert below <= 150_000 < below + inside
    assert median_row(df, "value", accuracy).first() == df.agg(F.median("value")).first()


def test_decimals_beyond_double_precision(spark):
    values = [Decimal(10**17 + i) / 100 for i in (1, 2, 3, 9, 9, 4, 5, 6, 7)]
    assert median_of(spark, values, "decimal(20,2)", 50_000) == sorted(values)[4]


def test_too_little_accuracy_raises(spark):
    with pytest.raises(ValueError, match="accuracy"):
        median_of(spark, [1.0], "double", 3)
