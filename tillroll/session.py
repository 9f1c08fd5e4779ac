"""Session settings the library is tuned for."""

from pyspark.sql import SparkSession

from tillroll.sources.scratch import stored_bytes

# AQE sizes the reduce side from the real shuffle volume and splits skewed
# join partitions, so no partition count is tied to a data size. The session
# zone only matters when text is parsed; UTC has no skipped local times. The JVM
# does not compile methods beyond 8000 bytes; wide cleaning stages exceed that
# when fused into one, and run faster split up.
# What a task reads is bounded as well: stored and shuffled rows are compressed, and
# at Spark's 128 and 64 MB a task sorts and groups more of them than it has room for.
TASK_SETTINGS = {
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    **TASK_SETTINGS,
}


#: Reduce tasks a core gets before AQE joins small ones.
TASKS_PER_CORE = 4


#: Reduce tasks before AQE joins small ones, for each that the session names.
FINER = 4

#: Stored bytes of the inputs there is at least one such reduce task for: AQE joins
#: small ones, but groups them by key no finer than they come.
BYTES_PER_TASK = 2 << 20

_FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def bounded_tasks(spark, *paths):
    """Let tasks read no more than the library is tuned for, whoever started the session.

    ``paths`` are the inputs: the more they hold, the more reduce tasks there are.
    """
    for key, value in TASK_SETTINGS.items():
        spark.conf.set(key, value)
    first = spark.conf.get(_FIRST, None)
    if first is None:
        first = FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_size = sum(stored_bytes(spark, path) for path in paths) // BYTES_PER_TASK
    spark.conf.set(_FIRST, max(int(first), by_size))
    return spark


def build_session(app_name="tillroll", master=None, **settings):
    """Start (or get) a session; keyword names use ``__`` for the dots."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    if spark.conf.get(_FIRST, None) is None and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        # As many reduce tasks as the cluster can use; AQE joins those that stay small.
        spark.conf.set(_FIRST, max(FINER * 200, TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    return spark
