"""Calendar helpers on timestamps without time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_date(as_of=None):
    """Reference day at midnight: a date, ISO text, a Column, or today."""
    if as_of is None:
        day = F.current_date()
    elif isinstance(as_of, Column):
        day = as_of
    else:
        day = F.lit(str(as_of))
    return day.cast("date").cast("timestamp_ntz")


def whole_days(end, start):
    """Full 24-hour days from start to end, cut off toward zero."""
    elapsed = end.cast("timestamp_ntz") - start.cast("timestamp_ntz")
    return F.extract(F.lit("DAY"), elapsed).cast("bigint")


def day_of_week(column):
    """0 = Sunday … 6 = Saturday."""
    return F.dayofweek(column) - 1


def month_start(column):
    """First day of the month; stays free of the session time zone."""
    return F.trunc(column.cast("date"), "month").cast("timestamp_ntz")


def month_index(column):
    """Months since year 0, for month arithmetic on integers."""
    return F.year(column) * 12 + F.month(column) - 1


def months_between_starts(later, first_month, wrap=False):
    """Months from the start of ``first_month`` to ``later``.

    ``wrap`` keeps only the month part of the years-and-months age (0 to 11).
    """
    elapsed = month_index(later) - month_index(first_month)
    return elapsed % 12 if wrap else elapsed
