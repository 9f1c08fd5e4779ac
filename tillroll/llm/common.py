"""What the corpus operators share."""

from contextlib import contextmanager

from pyspark.sql import functions as F

#: Rows a Python worker gets at once; with texts of some KB a few MB.
BATCH_ROWS = 300


def bounded_batches(spark):
    """Let Python workers get few rows at a time, as rows hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


@contextmanager
def batches_of(spark, rows):
    """Another number of rows at once for what is stored inside; for short rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark, sf_dir, name):
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column):
    """The text in a column, empty for null."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def labelled_sample(docs, labels, label, rows, key="doc_id", text="text"):
    """(y, text) of the documents of at most ``rows`` labels of 0 or 1.

    The labels with the lowest hashes of their key are taken, of repeated ones one;
    only they, a few bytes each, are sent to the documents. Of several documents of
    a key the text with the lowest hash stands for it, so there are at most
    ``rows`` rows and no later cut.
    """
    chosen = (
        labels.filter(F.col(f"`{label}`").isin(0, 1))
        .select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("y"))
        .distinct()
        .orderBy(F.xxhash64("key"), "key", "y")
        .limit(rows)
    )
    texts = docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")
    )
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")
    return texts.join(F.broadcast(chosen), "key").groupBy("key", "y").agg(one).select("y", "one.text")


def text_md5(column="text"):
    return F.md5(F.col(f"`{column}`").cast("string").cast("binary"))


def of_rows(docs, rows, how, key="doc_id", text="text", hint=lambda df: df):
    """``docs`` joined (semi or anti) with identities (key, text_md5), nulls equal nulls."""
    named = rows.select(F.col(key).alias("__key"), F.col("text_md5").alias("__md5"))
    same = F.col(f"`{key}`").eqNullSafe(F.col("__key")) & text_md5(text).eqNullSafe(F.col("__md5"))
    return docs.join(hint(named), same, how)
