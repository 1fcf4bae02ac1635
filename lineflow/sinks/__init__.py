"""Sinks.  All but ``append_text`` replace what is at the path."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lineflow.functions.parsing import line_bytes, render_line
from lineflow.functions.sizes import size_in_bytes
from lineflow.operators.chunks import sort_groups
from lineflow.operators.parse import NUM, TEXT, VALUE
from lineflow.operators.sort import sort_chunks, sort_lines
from lineflow.sources.text import LINE_FEED
from lineflow.workspace import session_setting, small_table

__all__ = ["append_text", "write_groups", "write_parts", "write_runs", "write_single", "write_sorted", "write_text"]


# Files a task writes at the same time.
_OPEN_FILES = 32

#: Parts that are counted while they are written.
MAX_OBSERVED = 256


def write_text(lines: DataFrame, path: str) -> None:
    """Write the column ``value`` as it is."""
    lines.write.mode("overwrite").text(path, lineSep=LINE_FEED)


def append_text(lines: DataFrame, path: str) -> None:
    """Add files with the column ``value`` as it is to a folder."""
    lines.write.mode("append").text(path, lineSep=LINE_FEED)


def write_sorted(records: DataFrame, path: str) -> None:
    """Sort and write lines; the files joined in the order of their part numbers are the sorted text.

    Spark pads part numbers to five digits only, so from 100,000 files on the order of
    names is another one; ``read_lines(with_origin=True)`` gives the number.
    """
    write_text(_rendered(sort_lines(records)), path)


def write_runs(records: DataFrame, path: str) -> None:
    """Write each partition as one sorted run, without a shuffle.

    Runs are as large as the partitions read, so ``spark.sql.files.maxPartitionBytes``
    is the chunk size.
    """
    sort_chunks(records).write.mode("overwrite").parquet(path)


def write_groups(records: DataFrame, path: str, group: str) -> None:
    """Write each group as a folder of sorted files, in name order."""
    sort_groups(records, group).write.mode("overwrite").partitionBy(group).parquet(path)


def write_parts(
    records: DataFrame, path: str, part: str = "part_id", gather: bool = False, parts: int | None = None
) -> DataFrame | None:
    """Write lines to one folder per part.

    Generated lines already lie together by part and are written as they are.
    ``gather`` brings the rows of a part together first, in pieces of bounded size,
    for inputs in which every partition holds rows of many parts.

    With ``parts``, parts are ``0 .. parts - 1``, ``MAX_OBSERVED`` at most, and their lines
    and bytes are counted while they are written; part_id, lines, bytes are returned, one
    row per part, without reading anything again.

    A task keeps a file open for each part it meets instead of sorting its rows by
    part; should it meet more than ``_OPEN_FILES``, Spark sorts the rest.
    """
    observed = None
    if parts is not None:
        if not 0 < parts <= MAX_OBSERVED:
            raise ValueError(f"parts must be in 1..{MAX_OBSERVED}, not {parts}")
        observed = Observation()
        records = records.observe(observed, *_part_totals(part, parts))
    lines = records.select(part, render_line(NUM, TEXT).alias(VALUE))
    if gather:
        lines = lines.hint("rebalance", F.col(part))
    with session_setting(records.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(_OPEN_FILES)):
        lines.write.mode("overwrite").partitionBy(part).text(path, lineSep=LINE_FEED)
    if observed is None:
        return None
    totals = observed.get
    return small_table(
        records.sparkSession,
        part_id=pa.array(range(parts), pa.int32()),
        lines=[totals[f"lines_{i}"] for i in range(parts)],
        bytes=[totals[f"bytes_{i}"] for i in range(parts)],
    )


def _part_totals(part: str, parts: int) -> list[Column]:
    """Lines and bytes of each part, as aggregates of one pass."""
    size = line_bytes(NUM, TEXT)
    found = []
    for i in range(parts):
        here = F.col(part) == i
        found.append(F.count_if(here).alias(f"lines_{i}"))
        found.append(F.coalesce(F.sum(F.when(here, size)), F.lit(0).cast("bigint")).alias(f"bytes_{i}"))
    return found


def write_single(records: DataFrame, path: str, limit: str | int = "100GB") -> None:
    """Sort and write lines to a single file.

    One task writes it all, so the size is checked first.  Beyond ``limit`` use
    ``write_sorted``: its files joined by part number are the same text.
    """
    size = records.agg(F.sum(line_bytes(NUM, TEXT))).first()[0] or 0
    if size > size_in_bytes(limit):
        raise ValueError(f"{size} bytes are too many for one file; use write_sorted")
    write_text(_rendered(sort_lines(records)).coalesce(1), path)


def _rendered(records: DataFrame) -> DataFrame:
    return records.select(render_line(NUM, TEXT).alias(VALUE))
