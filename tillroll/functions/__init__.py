from tillroll.functions.bands import band, lookup, ranges, season
from tillroll.functions.dates import (
    as_of_date,
    day_of_week,
    month_index,
    month_start,
    months_between_starts,
    whole_days,
)
from tillroll.functions.numbers import asc, cents_per, desc, mean, money, percent, ratio, written_ratio
from tillroll.functions.text import (
    before,
    digits_only,
    in_text_order,
    strip,
    text_keys,
    title_case,
)

__all__ = [
    "as_of_date",
    "asc",
    "band",
    "before",
    "cents_per",
    "day_of_week",
    "desc",
    "digits_only",
    "in_text_order",
    "lookup",
    "mean",
    "money",
    "month_index",
    "month_start",
    "months_between_starts",
    "percent",
    "ranges",
    "ratio",
    "season",
    "strip",
    "text_keys",
    "title_case",
    "whole_days",
    "written_ratio",
]
