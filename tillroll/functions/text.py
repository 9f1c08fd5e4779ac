"""Text normalization on built-in expressions."""

from pyspark.sql import functions as F

# One word, or "&", between single spaces: for these initcap gives title case.
_PLAIN_WORDS = r"^(?:[A-Za-z]+|&)(?: (?:[A-Za-z]+|&))*$"
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{IsTitlecase}"


def title_case(column):
    """Upper-case the first letter of every run of letters, lower-case the rest.

    Any character without case ends a run ("women's" becomes "Women'S"), which
    initcap alone does not do; it still serves the common plain values, where
    it stays inside generated code.
    """
    runs = F.regexp_extract_all(column, F.lit(f"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
    general = F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")
    return F.when(column.rlike(_PLAIN_WORDS), F.initcap(column)).otherwise(general)


def strip(column):
    """Drop white space, tabs and line ends included, from both ends."""
    return F.regexp_replace(column, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def digits_only(column):
    """Keep the digits; NULL when there are none."""
    return F.nullif(F.regexp_replace(column.cast("string"), r"\P{Nd}", ""), F.lit(""))


def text_keys(column, collation=None):
    """Columns that sort text by its bytes, or by a collation first."""
    return [column] if collation is None else [F.collate(column, collation), column]


def in_text_order(names, collation=None):
    """An array of text, sorted; without NULL entries."""
    if collation is None:
        return F.array_sort(names)
    keyed = F.transform(names, lambda n: F.struct(F.collate(n, collation).alias("key"), n.alias("name")))
    return F.transform(F.array_sort(keyed), lambda k: k["name"])


def before(a, b, collation=None):
    """Whether text ``a`` comes before ``b``."""
    if collation is None:
        return a < b
    return F.struct(*text_keys(a, collation)) < F.struct(*text_keys(b, collation))
