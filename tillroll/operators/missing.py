"""One notion of "missing"."""

from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_as_null(df):
    """Turn NaN into NULL, as files written by array libraries mark gaps that way."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floating:
        return df
    return df.withColumns({n: F.when(~F.isnan(f"`{n}`"), F.col(f"`{n}`")) for n in floating})
