"""Decimal arithmetic and sort order helpers."""

from pyspark.sql import functions as F

# Spark caps decimal division at 38 digits and gives up scale first. Narrowing
# the operands leaves 14 decimal places in the quotient, so rounding it to two
# places does not suffer from an earlier rounding.
_NUMERATOR = "decimal(24,2)"
_DENOMINATOR = "decimal(22,2)"


def money(column):
    return column.cast("decimal(18,2)")


def ratio(numerator, denominator, on_zero_div="raise"):
    """Exact decimal quotient of counts or two-decimal amounts.

    A zero denominator raises (ANSI mode); ``on_zero_div="null"`` yields NULL.
    """
    return _divided(numerator.cast(_NUMERATOR), denominator.cast(_DENOMINATOR), on_zero_div)


def written_ratio(numerator, denominator, on_zero_div="raise"):
    """Quotient of numbers as written in a file, with up to six places each."""
    wide = "decimal(24,6)"
    return _divided(numerator.cast(wide), denominator.cast(wide), on_zero_div)


def _divided(top, bottom, on_zero_div):
    if on_zero_div == "null":
        return F.try_divide(top, bottom)
    if on_zero_div != "raise":
        raise ValueError(f"on_zero_div must be 'raise' or 'null', not {on_zero_div!r}")
    return top / bottom


def percent(numerator, denominator, on_zero_div="raise"):
    return ratio(numerator * F.lit(100), denominator, on_zero_div)


def cents_per(cents, count):
    """Whole cents divided by a count, as an amount rounded once, half away from zero.

    Whole numbers throughout: a quotient of wide decimals would be cut to a few
    places before it is rounded.
    """
    count = count.cast("decimal(18,0)")
    twice = F.abs(count) * F.lit(2).cast("decimal(1,0)")
    whole = F.abs(cents) * F.lit(2).cast("decimal(1,0)") + F.abs(count)
    size = ((whole - whole % twice) / twice).cast("decimal(20,0)")
    signed = F.when((cents < 0) != (count < 0), -size).otherwise(size)
    return signed * F.lit("0.01").cast("decimal(2,2)")


def mean(total, count):
    """Average from a sum and a count of non-null values; NULL when there are none."""
    return ratio(total, count, on_zero_div="null")


def asc(column):
    """Ascending, NULLs last."""
    return (F.col(column) if isinstance(column, str) else column).asc_nulls_last()


def desc(column):
    """Descending, NULLs first."""
    return (F.col(column) if isinstance(column, str) else column).desc_nulls_first()
