"""Sort a text of numbered lines; keep and merge sorted runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineflow.operators.ordering import range_sort
from lineflow.operators.parse import NUM, TEXT, VALUE, parse_lines
from lineflow.operators.sort import line_order
from lineflow.sinks import write_groups, write_runs, write_sorted, write_text
from lineflow.sources.text import read_lines, read_runs
from lineflow.workspace import session_setting, small_table


@dataclass(frozen=True)
class SortOptions:
    """``chunk_size_mb`` bounds a run, ``degree`` is the number of runs merged at a time."""

    chunk_size_mb: int = 512
    degree: int = 8

    def __post_init__(self) -> None:
        if self.chunk_size_mb < 1 or self.degree < 1:
            raise ValueError("chunk_size_mb and degree must be positive")


def sort_file(spark: SparkSession, path: str | list[str], output: str) -> None:
    """Read lines, drop malformed ones, sort and write.

    No runs are written: the shuffle's own sorted spills take their place.
    """
    write_sorted(parse_lines(read_lines(spark, path)), output)


def write_sorted_runs(
    spark: SparkSession, path: str | list[str], output: str, options: SortOptions = SortOptions()
) -> None:
    """Read lines in chunks and write each as a sorted run, without a shuffle."""
    with session_setting(spark, "spark.sql.files.maxPartitionBytes", f"{options.chunk_size_mb}m"):
        write_runs(parse_lines(read_lines(spark, path)), output)


def group_runs(runs: DataFrame, degree: int) -> DataFrame:
    """Add ``group_id``: every ``degree`` runs in name order form a group.

    There is one name per file; reading them takes no column of the data.
    """
    files = sorted(r.run_id for r in runs.select("run_id").distinct().collect())
    if not files:
        return runs.withColumn("group_id", F.lit(0).cast("bigint"))
    groups = small_table(runs.sparkSession, run_id=files, group_id=[place // degree for place in range(len(files))])
    return runs.join(groups, "run_id")


def merge_in_groups(spark: SparkSession, path: str, output: str, degree: int = SortOptions.degree) -> None:
    """Merge every ``degree`` runs into one, each a folder ``group_id=...`` of sorted files."""
    SortOptions(degree=degree)
    write_groups(group_runs(read_runs(spark, path), degree).drop("run_id"), output, "group_id")


def merge_runs(spark: SparkSession, path: str | list[str], output: str, format: str = "parquet") -> None:
    """Merge all runs under ``path`` into one sorted text.

    Lines of text runs are written as they are, also where their key is malformed.
    """
    runs = read_runs(spark, path, format)
    if format == "text":
        ordered = range_sort(runs.select(VALUE, NUM, TEXT), *line_order(), VALUE)
        write_text(ordered.select(VALUE), output)
    else:
        write_sorted(runs, output)
