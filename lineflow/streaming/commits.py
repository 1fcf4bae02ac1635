"""Which batches of which streams are whole.

A batch is committed by an entry written after all its data: one small file per batch,
named by the identifier its stream keeps in its checkpoint, and the number of the batch.
Readers take the folders that have an entry.  A folder without one is left from a batch
that failed, or is being written.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lineflow.workspace import path_exists

#: Hidden from readers of the data beside it.
COMMITS = "_commits"

SCHEMA = "run string, query string, batch long, lines long, bytes long, rejected long"


def run_name(query: str, batch: int) -> str:
    """The folder of a batch is ``run=`` and this; another checkpoint is another query."""
    return f"{query}-{batch}"


def is_committed(spark: SparkSession, path: str, run: str) -> bool:
    return path_exists(spark, f"{path}/{COMMITS}/{run}/_SUCCESS")


def commit(spark: SparkSession, path: str, query: str, batch: int, lines: int, size: int, rejected: int) -> None:
    """Write the entry of a batch; its one file appears at once."""
    run = run_name(query, batch)
    values = {"run": [run], "query": [query], "batch": [batch], "lines": [lines], "bytes": [size], "rejected": [rejected]}
    entry = spark.createDataFrame(pa.table(values), SCHEMA).coalesce(1)
    entry.write.mode("overwrite").parquet(f"{path}/{COMMITS}/{run}")


def committed_batches(spark: SparkSession, path: str) -> DataFrame:
    """The batches committed so far: run, query, batch, lines, bytes, rejected."""
    folder = f"{path}/{COMMITS}"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
