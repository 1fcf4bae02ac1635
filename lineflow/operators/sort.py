"""Sorting and merging records by text without regard to case, then by number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineflow.functions.folding import ordinal_ci_key
from lineflow.operators.ordering import range_sort, sort_partitions, totals_before, with_positions
from lineflow.operators.parse import NUM, TEXT


def line_order(num: str = NUM, text: str = TEXT) -> tuple[Column | str, ...]:
    """The sort keys.

    Texts that differ only in case and have the same number are ties; the text
    itself comes last to make the result reproducible.
    """
    return ordinal_ci_key(text), num, text


def sort_lines(df: DataFrame) -> DataFrame:
    """Sort all records; partitions in order hold the sorted output."""
    return range_sort(df, *line_order())


def sort_chunks(df: DataFrame) -> DataFrame:
    """Sort each partition on its own, without a shuffle."""
    return sort_partitions(df, *line_order())


def merge_sorted(*inputs: DataFrame) -> DataFrame:
    """Merge records of several inputs into one sorted output; copies are kept.

    One range shuffle does it whether or not the inputs are sorted, so nothing is
    gained by sorting them first; ``sort_lines`` on an input is a shuffle of its own.
    """
    return sort_lines(reduce(DataFrame.unionByName, inputs))


def line_positions(df: DataFrame) -> DataFrame:
    """Add ``position``, the line number each record has in the sorted output."""
    return with_positions(df, *line_order())


def group_positions(df: DataFrame, *groups: str, bounded: bool = False) -> DataFrame:
    """Add ``position``, the line number each record has within its sorted group.

    Groups may be of any size.  If they are ``bounded`` by how they were made, such as
    chunks, a window does it, with one shuffle and nothing written.
    """
    if bounded:
        order = Window.partitionBy(*groups).orderBy(*line_order())
        return df.withColumn("position", F.row_number().over(order).cast("bigint"))
    counted = totals_before(df, groups, line_order(), 1, "position")
    return counted.withColumn("position", F.col("position") + 1)
