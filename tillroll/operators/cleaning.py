"""Cleaning of flat order rows, and the figures that describe a run.

Every step applies only if its columns exist; that is decided from the schema,
without running a job.
"""

import re
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import fixed_values as fixed
from tillroll.functions import digits_only, ranges, strip, title_case, written_ratio
from tillroll.operators.dedup import first_per_key
from tillroll.operators.median import exact_median
from tillroll.operators.missing import nan_as_null
from tillroll.sources.delimited import SOURCE_ORDER
from tillroll.sources.scratch import written

#: Forms a date may have in a file, and the text each goes with. Single-digit
#: months, days and hours are accepted.
DATE_FORMS = {
    "yyyy-M-d": r"\d{4}-\d{1,2}-\d{1,2}",
    "yyyy-M-d H:mm": r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d\d",
    "yyyy-M-d H:mm:ss": r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d\d:\d\d",
    "yyyy-M-d H:mm:ss.SSSSSS": r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d\d:\d\d\.\d{6}",
    "yyyy-M-d'T'H:mm:ss": r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d\d:\d\d",
    "yyyy/M/d": r"\d{4}/\d{1,2}/\d{1,2}",
    "yyyy/M/d H:mm:ss": r"\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d\d:\d\d",
    "M/d/yyyy": r"\d{1,2}/\d{1,2}/\d{4}",
    "M/d/yyyy H:mm": r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d",
    "M/d/yyyy H:mm:ss": r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d:\d\d",
    "d.M.yyyy": r"\d{1,2}\.\d{1,2}\.\d{4}",
    "yyyyMMdd": r"\d{8}",
}


def form_of(first, column):
    """The form of a column whose first value in file order is ``first``.

    Month/day/year is read as day/month/year if the value leaves no other reading.
    A value of no known form raises, as it would lose every row; pass
    ``date_formats`` then. Without any value nothing needs a form.
    """
    if first is None:
        return ("yyyy-M-d",)
    for form, pattern in DATE_FORMS.items():
        if re.fullmatch(pattern, first):
            swapped = form.startswith("M/d") and int(first.split("/")[0]) > 12
            return (form.replace("M/d", "d/M") if swapped else form,)
    raise ValueError(f"{column} begins with {first!r}; state its form in date_formats")


def first_value(column, order):
    """Aggregate: the first value of a text column that is not missing, trimmed."""
    return F.min_by(F.trim(column), F.when(column.isNotNull(), F.struct(*order)))


def date_formats_of(df, column, order):
    """The form of the first date in file order, looked up in one row."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return ()
    return form_of(df.agg(first_value(F.col(column), order)).first()[0], column)


def parse_dates(column, data_type, formats):
    """Timestamp from text in one of the formats; anything else becomes NULL."""
    if not isinstance(data_type, T.StringType):
        return column.cast("timestamp_ntz")
    column = F.trim(column)
    # Formats without an hour go through DATE, which no time zone can shift.
    parsed = [
        F.try_to_timestamp(column, F.lit(f)) if set(f) & set("HhKk") else F.try_to_date(column, f)
        for f in formats
    ]
    return F.coalesce(*[p.cast("timestamp_ntz") for p in parsed])


def order_columns(df, order_col=None):
    """What "first" means: a given column, or the position in the file."""
    if order_col is not None:
        return [F.col(order_col)]
    if SOURCE_ORDER in df.columns:
        return [F.col(SOURCE_ORDER)]
    raise ValueError("rows have no order: name the column in order_col")


def complete(columns):
    """Whether a row has all critical columns."""
    present = [F.col(c).isNotNull() for c in fixed.CRITICAL_COLUMNS if c in columns]
    return reduce(lambda a, b: a & b, present, F.lit(True))


def first_rows(df, order, date_formats, median_age=None):
    """(rows, passes): the first complete row of each order with its gaps filled, and
    whether a row is usable.

    A repeated order is dropped before dates are checked, so a first copy with a bad
    date takes the whole order with it.
    """
    columns = set(df.columns)
    if "customer_age" in columns:
        age = F.col("customer_age").cast("double")
        if median_age is None:
            known = df.select(age.alias("customer_age"))
            median_age = exact_median(known, "customer_age")
        df = df.withColumn("customer_age", F.coalesce(age, median_age))
    if "product_category" in columns:
        df = df.fillna(fixed.UNKNOWN, subset=["product_category"])
    df = first_per_key(df.filter(complete(columns)), ["order_id"], order)

    passes = []
    if "order_date" in columns:
        parsed = parse_dates(F.col("order_date"), df.schema["order_date"].dataType, date_formats)
        df = df.withColumn("order_date", parsed)
        passes.append(F.col("order_date").isNotNull())
    if "customer_email" in columns:
        # (?d): only a line feed may follow the address, no other line end.
        passes.append(F.col("customer_email").rlike("(?d)" + fixed.EMAIL_PATTERN))
    if "customer_phone" in columns:
        df = df.withColumn("customer_phone", digits_only(F.col("customer_phone")))
    passes += [F.col(name) > 0 for name in fixed.POSITIVE_COLUMNS if name in columns]
    return df, reduce(lambda a, b: a & b, passes, F.lit(True))


def screen_orders(df, order_col=None, date_formats=None, keep_order=False):
    """Fill gaps, drop unusable rows and keep the first row of each order.

    Dates have the form of the first one in file order, unless ``date_formats`` are
    given. ``keep_order`` leaves the position in the file in place, for sinks that
    keep the order of the rows.
    """
    df = nan_as_null(df)
    order = order_columns(df, order_col)
    if date_formats is None and "order_date" in df.columns:
        date_formats = date_formats_of(df, "order_date", order)
    df, passes = first_rows(df, order, date_formats)
    df = df.filter(passes)
    return df if keep_order else df.drop(SOURCE_ORDER)


def spread_of(value):
    """Aggregate: mean and sample deviation."""
    return F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def drop_outliers(df, column="total_amount", sigmas=fixed.OUTLIER_SIGMAS, spread=None):
    """Keep values within ``sigmas`` sample deviations of the mean.

    A single row has no deviation and is dropped. Equal values all stay, even if
    their computed mean is a rounding error off. ``spread`` gives mean and
    deviation where they are known already.
    """
    value = F.col(column).cast("double")
    if spread is None:
        spread = df.agg(spread_of(value)).scalar()
        mean, sd = spread["mean"], spread["sd"]
    else:
        mean, sd = (F.lit(x).cast("double") for x in spread)
    near = F.abs(value - mean) <= sigmas * sd
    return df.filter(near | (sd == 0))


def standardize_orders(df, gender_map=fixed.GENDER_MAP, spread=None):
    """Remove outliers, unify labels and add the derived columns to screened rows.

    Without ``spread`` (mean and deviation of the amounts) ``df`` is read twice, the
    first time for ``total_amount`` only.
    """
    columns = set(df.columns)
    if "total_amount" in columns:
        df = drop_outliers(df, spread=spread)

    added = {}
    for name in ("product_category", "payment_method"):
        if name in columns:
            added[name] = strip(title_case(F.col(name)))
    if "customer_gender" in columns:
        known = F.create_map(*[F.lit(text) for pair in gender_map.items() for text in pair])
        gender = F.try_element_at(known, F.col("customer_gender"))
        added["customer_gender"] = F.coalesce(gender, F.lit(fixed.UNKNOWN))
    if "order_date" in columns:
        date = F.col("order_date")
        added["order_year"] = F.year(date)
        added["order_month"] = F.month(date)
        added["order_day"] = F.dayofmonth(date)
        added["order_weekday"] = F.date_format(date, "EEEE")
        added["order_quarter"] = F.quarter(date)
    if "customer_age" in columns:
        added["age_group"] = ranges(F.col("customer_age"), fixed.CLEAN_AGE_GROUPS)
    if {"total_amount", "quantity"} <= columns:
        added["revenue_per_item"] = written_ratio(F.col("total_amount"), F.col("quantity"))
    return df.withColumns(added) if added else df


def clean_orders(
    df,
    order_col=None,
    date_formats=None,
    gender_map=fixed.GENDER_MAP,
    stored=True,
    keep_order=False,
):
    """Screen and standardize.

    The outlier bounds and the result both read the screened rows, so these are
    written to the scratch folder once. ``stored=False`` gives one lazy plan
    that screens twice instead.
    """
    screened = screen_orders(df, order_col, date_formats, keep_order)
    if stored:
        screened = written(screened, "screened")
    return standardize_orders(screened, gender_map)


def null_counts(df):
    """One row per column: column_name, null_count."""
    names = [c for c in df.columns if c != SOURCE_ORDER]
    counted = nan_as_null(df).agg(
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names]
    )
    return counted.unpivot([], [F.col(f"`{c}`") for c in names], "column_name", "null_count")


def cleaning_report(raw, cleaned):
    """One row on a cleaning run: rows before and after, repeats, gaps, date range."""
    raw = nan_as_null(raw)
    whole = complete(raw.columns)
    before = raw.agg(
        F.count("*").alias("original_rows"),
        (F.count_if(whole) - F.count_distinct(F.when(whole, F.col("order_id")))).alias(
            "duplicates_removed"
        ),
    )
    missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in cleaned.columns), F.lit(0))
    after = cleaned.agg(
        F.struct(
            F.count("*").alias("final_rows"),
            missing.cast("bigint").alias("missing_values"),
            (F.count("order_id") - F.count_distinct("order_id")).alias("duplicate_order_ids"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
        )
    ).scalar()
    return before.withColumn("after", after).select(
        "original_rows",
        F.col("after.final_rows").alias("final_rows"),
        (F.col("original_rows") - F.col("after.final_rows")).alias("rows_removed"),
        "duplicates_removed",
        F.col("after.missing_values").alias("missing_values"),
        F.col("after.duplicate_order_ids").alias("duplicate_order_ids"),
        F.col("after.first_order_date").alias("first_order_date"),
        F.col("after.last_order_date").alias("last_order_date"),
    )
