"""Labels from limits and lookups, as CASE expressions."""

from pyspark.sql import functions as F

from tillroll.fixed_values import SEASON_MONTHS


def band(column, limits):
    """Label of the first band whose exclusive upper limit exceeds the value.

    A final limit of None takes everything left, NULL included.
    """
    result = None
    for label, upper in limits:
        if upper is None:
            return F.lit(label) if result is None else result.otherwise(label)
        below = column < upper
        result = F.when(below, label) if result is None else result.when(below, label)
    return result


def ranges(column, groups):
    """Label of the (low, high] range holding the value, else NULL."""
    return F.coalesce(
        *[F.when((column > low) & (column <= high), label) for label, low, high in groups]
    )


def lookup(column, members, default=None):
    """Label whose member list contains the value, else ``default``."""
    labels = [F.when(column.isin(*values), label) for label, values in members.items()]
    return F.coalesce(*labels, F.lit(default).cast("string"))


def season(column):
    return lookup(F.month(column), SEASON_MONTHS)
