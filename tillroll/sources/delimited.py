"""CSV in and out."""

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.fixed_values import NULL_TOKENS
from tillroll.schema import FLAT_SCHEMA

SOURCE_ORDER = "_source_order"
#: The text of a record with more fields than the header has, else NULL.
MALFORMED = "_malformed"


def _typed(column, data_type):
    """Lenient cast: text that does not fit the declared type becomes NULL."""
    if isinstance(data_type, T.StringType):
        return column
    text = F.trim(column)
    if isinstance(data_type, T.IntegralType):
        # Whole numbers are often written as "2.0" once a column had gaps.
        number = text.try_cast("decimal(38,10)")
        return F.when(number == F.floor(number), number.try_cast(data_type))
    return text.try_cast(data_type)


def _reader(spark, multiline):
    return (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multiline)
    )


def _records(spark, path, names, multiline):
    """The columns as text, and ``MALFORMED``; files with another header raise."""
    fields = [T.StructField(name, T.StringType()) for name in (*names, MALFORMED)]
    # Only whole records tell whether they have too many fields.
    reader = _reader(spark, multiline).option("enforceSchema", False).option("columnPruning", False)
    return reader.schema(T.StructType(fields)).option("columnNameOfCorruptRecord", MALFORMED).csv(path)


def _quoted_line_ends(spark, path):
    """Files in which a quoted value goes over a line end, found without parsing.

    Such a line holds an odd number of quotes. A file with an odd number in all
    ends inside a quoted value and raises, as everything after it is unclear.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.pmod(quotes, F.lit(2)).alias("odd")
    )
    found = lines.groupBy("file").agg(F.sum("odd").alias("odd")).filter("odd > 0").collect()
    unfinished = sorted(r["file"] for r in found if r["odd"] % 2)
    if unfinished:
        raise ValueError(f"a quoted value is never closed in {', '.join(unfinished[:5])}")
    return sorted(r["file"] for r in found)


def _positioned(records):
    """Records with their place: file, block in the file, row in the block.

    The row id alone does not follow file order, as larger files are packed first.
    """
    return records.withColumn(
        SOURCE_ORDER,
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def _too_long(names):
    """The record, if it has more fields than names; shorter ones are filled up."""
    plain = F.regexp_replace(MALFORMED, '"[^"]*"', "")
    commas = F.length(plain) - F.length(F.replace(plain, F.lit(",")))
    # Spark reads no record alone, so a column takes part, which changes nothing.
    commas = F.greatest(commas, -F.length(F.coalesce(f"`{names[0]}`", F.lit(""))))
    return F.when(commas >= len(names), F.col(MALFORMED))


def _checked(records, names, malformed):
    records = records.withColumn(MALFORMED, _too_long(names))
    if malformed == "column":
        return records
    message = F.concat(F.lit("more fields than the header has: "), MALFORMED)
    fine = F.when(F.col(MALFORMED).isNotNull(), F.raise_error(message).cast("boolean"))
    return records.filter(F.coalesce(fine, F.lit(True))).drop(MALFORMED)


def read_flat_csv(
    spark,
    path,
    schema=FLAT_SCHEMA,
    with_order=True,
    multiline=None,
    malformed="raise",
    infer=False,
):
    """Read a delimited order file (or folder of files) with a header line.

    The header decides which columns exist; those named in ``schema`` are typed,
    others stay text, or with ``infer`` get the type their values have. All files
    must have the same header. Missing-value tokens become NULL. A missing path
    raises. ``with_order`` adds a sortable position column, so that "first in the
    file" has a meaning later.

    A quoted value may hold line ends. Files can then not be split, so each is
    looked at first, and only those that hold such values are read whole;
    ``multiline`` True or False says what to do with all and saves that pass. A
    record with fewer fields than the header is filled up with NULL. One with more
    raises, or with ``malformed="column"`` is kept as text in a column of that
    name; ``split_malformed`` takes these out.
    """
    if malformed not in ("raise", "column"):
        raise ValueError(f"malformed must be 'raise' or 'column', not {malformed!r}")
    names = _reader(spark, bool(multiline)).csv(path).columns
    whole = _quoted_line_ends(spark, path) if multiline is None else []
    file = F.col("_metadata.file_path")
    if whole:
        parts = [
            _positioned(_records(spark, path, names, False).filter(~file.isin(whole))),
            _positioned(_records(spark, [unquote(f) for f in whole], names, True)),
        ]
    else:
        parts = [_positioned(_records(spark, path, names, bool(multiline)))]
    raw = reduce(lambda a, b: a.unionByName(b), [_checked(p, names, malformed) for p in parts])

    types = {field.name: field.dataType for field in schema}
    texts = {
        name: F.when(~F.col(f"`{name}`").isin(*NULL_TOKENS), F.col(f"`{name}`")) for name in names
    }
    unknown = [name for name in names if name not in types]
    if infer and unknown:
        types |= inferred_types(raw.select(*[texts[n].alias(n) for n in unknown]))
    columns = [_typed(texts[n], types.get(n, T.StringType())).alias(n) for n in names]
    columns += [MALFORMED] if malformed == "column" else []
    return raw.select(*columns, *([SOURCE_ORDER] if with_order else []))


def numbered(df):
    """Rows with ``place``, their number in file order, from 1; for whole files as read.

    Rows of a block are numbered within it already; what is added are the rows of
    the blocks before, one figure per block.
    """
    at = F.col(SOURCE_ORDER)
    blocks = df.groupBy(at["file"].alias("file"), at["block"].alias("block")).agg(
        F.count("*").alias("rows"), F.min(at["row"]).alias("first")
    )
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    here = (at["file"] == F.col("file")) & (at["block"] == F.col("block"))
    place = F.col("before") + at["row"] - F.col("first") + 1
    return df.join(blocks, here).withColumn("place", place).select(*df.columns, "place")


def split_malformed(df):
    """(rows, quarantine): the well-formed rows, and the text of the others by position."""
    place = [SOURCE_ORDER] if SOURCE_ORDER in df.columns else []
    bad = df.filter(F.col(MALFORMED).isNotNull())
    return (
        df.filter(F.col(MALFORMED).isNull()).drop(MALFORMED),
        bad.select(*place, F.col(MALFORMED).alias("record")),
    )


# Kinds of text, as bits. A column's kinds are the bits of its values together.
_MISSING, _FLAG, _WHOLE, _NUMBER, _TEXT = 1, 2, 4, 8, 16
_WHOLE_FORM = r"^\s*[+-]?\d+\s*$"
_NUMBER_FORM = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
_FLAGS = ("True", "False", "TRUE", "FALSE", "true", "false")


def _kind(column):
    text = F.col(f"`{column}`")
    fits = F.trim(text).try_cast("bigint").isNotNull()
    return (
        F.when(text.isNull(), _MISSING)
        .when(text.isin(*_FLAGS), _FLAG)
        .when(text.rlike(_WHOLE_FORM), F.when(fits, _WHOLE).otherwise(_TEXT))  # _TEXT: beyond 64 bits
        .when(text.rlike(_NUMBER_FORM), _NUMBER)
        .otherwise(_TEXT)
    )


def _type_of(kinds):
    """The narrowest type for values of these kinds; gaps turn whole numbers to doubles."""
    if kinds == _WHOLE:
        return T.LongType()
    if kinds == _FLAG:
        return T.BooleanType()
    if kinds and not kinds & (_FLAG | _TEXT):
        return T.DoubleType()  # numbers, or nothing at all
    return T.StringType()


def inferred_types(df):
    """column → type of text columns, from all values in one aggregate.

    Kinds of values join by OR, so rows may meet in any order: whole numbers stay
    whole unless there are gaps or fractions, True and False are a type if nothing
    else and no gap occurs, and everything else is text. A column of gaps only is
    DOUBLE, one without rows text.
    """
    kinds = df.agg(*[F.bit_or(_kind(c)).alias(f"k{i}") for i, c in enumerate(df.columns)]).first()
    return {c: _type_of(kinds[f"k{i}"]) for i, c in enumerate(df.columns)}


def _csv_options(writer_or_reader, timestamp_format):
    return (
        writer_or_reader.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampNTZFormat", timestamp_format)
        .option("timestampFormat", timestamp_format)
    )


CSV_TIMES = "yyyy-MM-dd HH:mm:ss"


def _in_order(df, order):
    """Rows sorted by ``order``, so that parts follow each other by name."""
    return df if order is None else df.orderBy(order)


def write_csv(df, path, timestamp_format=CSV_TIMES, order=None, compression="none"):
    """Write a folder of CSV part files with headers, replacing what was there.

    ``order`` names a column to sort by, such as the position in a file read
    before; the parts, read in the order of their names, then keep that order. The
    position column itself is not written. Compressed parts are read whole, a task
    each.
    """
    rows = _in_order(df, order).drop(SOURCE_ORDER)
    _csv_options(rows.write.mode("overwrite"), timestamp_format).csv(path, compression=compression)


def read_written_csv(spark, path, schema, timestamp_format=CSV_TIMES):
    """Rows of known types that ``write_csv`` wrote."""
    reader = _csv_options(spark.read, timestamp_format).option("multiLine", True)
    return reader.schema(schema).csv(path)


def write_parquet(df, path, order=None):
    """Write Parquet parts, replacing what was there; ``order`` as for CSV."""
    _in_order(df, order).drop(SOURCE_ORDER).write.mode("overwrite").parquet(path)
