"""Exact median without gathering the values in one task."""

from pyspark.sql import Window
from pyspark.sql import functions as F

#: Rank accuracy of the sketch: it is off by at most a share of 1 / ACCURACY.
ACCURACY = 50_000


def middle_sketch(number, accuracy=ACCURACY):
    """Aggregates over a column of doubles: its values, and two that the middle ones lie between."""
    if accuracy < 4:
        raise ValueError("a sketch of that accuracy bounds nothing")
    known = F.when(number == number, number)  # NaN is no value
    sides = [0.5 - 2 / accuracy, 0.5 + 2 / accuracy]
    return F.count(known), F.percentile_approx(known, sides, accuracy)


def median_row(df, column, accuracy=ACCURACY, sketch=None):
    """One row with the exact ``median`` (NULL without values), as the column's type allows.

    One pass builds a mergeable quantile sketch, whose guaranteed rank error gives
    two values the middle lies between. The plan returned counts the rows below
    them and ranks the distinct values between them; equal values collapse before
    the shuffle, and no more than four rows in ``accuracy`` are looked at. ``df``
    is read three times: pass a stored table. ``sketch`` gives the results of
    ``middle_sketch`` where they are known already.
    """
    value = F.col(column)
    # As doubles, which the sketch takes, values keep their order.
    known = df.filter(value.isNotNull()).select(value.alias("value"))
    known = known.withColumn("number", F.col("value").cast("double")).filter("number = number")
    rows, between = sketch or known.agg(*middle_sketch(F.col("number"), accuracy)).first()
    first, last = between or (None, None)
    low, high = (rows - 1) // 2, rows // 2
    below = known.filter(F.col("number") < F.lit(first)).agg(F.count("*")).scalar()
    counted = (
        known.filter(F.col("number").between(F.lit(first), F.lit(last)))
        .groupBy("value")
        .agg(F.count("*").alias("n"))
    )
    until = below + F.sum("n").over(Window.orderBy("value"))
    ranked = counted.withColumn("until", until).filter(
        (F.col("until") > low) & (F.col("until") - F.col("n") <= high)
    )
    return ranked.agg(((F.min("value") + F.max("value")) / 2).alias("median"))


def exact_median(df, column, sketch=None):
    """Scalar subquery Column holding the exact median."""
    return median_row(df, column, sketch=sketch).scalar()
