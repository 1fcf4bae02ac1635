"""Where intermediate tables live.

Operators that need the same partitioning twice (once to count, once to read)
write it to a table in the shared folder the cluster names in
``spark.checkpoint.dir``.  Such a table survives the loss of executors, which a
cached DataFrame does not, and is read back with column pruning.

Where no folder is named, a session whose executors are the driver itself uses the
folder Spark keeps for the application and deletes with it; any other session must
name one.  Functions that write such tables run jobs when they are called: positions,
totals, chunks, prefixes, and the planning of generated lines.
"""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

_FOLDER = "lineflow"


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = SparkFiles.getRootDirectory()
    return f"{root.rstrip('/')}/{_FOLDER}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path for one intermediate table."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A DataFrame of values the driver holds.

    It is made from Arrow data, so its size is known to the optimizer, which
    broadcasts it in a join if it is small enough and shuffles otherwise.
    """
    return spark.createDataFrame(pa.table(columns))


@contextmanager
def session_setting(spark: SparkSession, name: str, value: str):
    """Set a session option while one job is planned and run."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if ``path`` exists on its file system."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return file_system.exists(hadoop_path)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it does not exist."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not file_system.exists(hadoop_path):
        return []
    return [status.getPath().getName() for status in file_system.listStatus(hadoop_path)]


def release(df: DataFrame) -> None:
    """Delete the intermediate tables ``df`` reads, and no others.

    Call it when neither ``df`` nor anything made from it is needed any more.
    """
    spark = df.sparkSession
    root = scratch_root(spark)
    tables = {match[0] for file in df.inputFiles() if (match := re.search(rf"{re.escape(_tail(root))}/[^/]+", file))}
    for table in tables:
        _delete(spark, f"{root}{table.removeprefix(_tail(root))}")


def clear_scratch(spark: SparkSession) -> None:
    """Delete all of this application's intermediate tables.

    Call it when no DataFrame returned by an operator is needed any more.
    """
    _delete(spark, scratch_root(spark))


def _tail(root: str) -> str:
    return "/" + "/".join(root.rsplit("/", 2)[1:])


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    file_system.delete(hadoop_path, True)
