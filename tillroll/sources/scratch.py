"""Intermediate tables in the shared scratch folder.

A written table cuts the lineage: a lost executor costs a re-read, and every
reader sees the very same rows. Nothing here is kept on one machine.
"""

import re
import tempfile
import uuid

from pyspark.sql import Observation


def scratch_folder(spark):
    """Folder named by ``spark.checkpoint.dir``; only one-process sessions may go without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tillroll-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark, name):
    application = spark.sparkContext.applicationId
    return f"{scratch_folder(spark)}/tillroll/{application}/{name}-{uuid.uuid4().hex}"


def written(df, name, **options):
    """Write ``df`` as Parquet to the scratch folder and return the stored table."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_and_observed(df, path, figures):
    """(table stored at ``path``, figures): aggregates gathered by the tasks that write.

    These are the last tasks of the job, whose figures Spark counts once each, also
    if an executor is lost.
    """
    observation = Observation()
    observed = df.observe(observation, *[f.alias(n) for n, f in figures.items()])
    observed.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path), observation.get


def folder_of(spark, path):
    """(file system, path) of a folder, wherever it is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def stored_bytes(spark, path):
    """Size of a file or folder, 0 if there is none."""
    files, place = folder_of(spark, path)
    return files.getContentSummary(place).getLength() if files.exists(place) else 0


def delete_folder(spark, path):
    files, folder = folder_of(spark, path)
    return files.delete(folder, True)


def clear_scratch(spark):
    """Delete what this application wrote; results that read from it end there."""
    return delete_folder(
        spark, f"{scratch_folder(spark)}/tillroll/{spark.sparkContext.applicationId}"
    )
