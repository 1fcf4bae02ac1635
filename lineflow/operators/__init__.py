"""Operators: plain functions from DataFrames to DataFrames."""

from lineflow.operators.chunks import assign_chunks, greedy_chunks, run_stats, sort_groups
from lineflow.operators.ordering import range_sort, sort_partitions, totals_before, with_positions
from lineflow.operators.parse import parse_keys, parse_lines, reject_counts, rejects, render_lines
from lineflow.operators.sort import (
    group_positions,
    line_order,
    line_positions,
    merge_sorted,
    sort_chunks,
    sort_lines,
)
from lineflow.operators.take import assign_parts, part_stats, take_bytes

__all__ = [
    "assign_chunks",
    "assign_parts",
    "greedy_chunks",
    "group_positions",
    "line_order",
    "line_positions",
    "merge_sorted",
    "parse_keys",
    "parse_lines",
    "part_stats",
    "range_sort",
    "reject_counts",
    "rejects",
    "render_lines",
    "run_stats",
    "sort_chunks",
    "sort_groups",
    "sort_lines",
    "sort_partitions",
    "take_bytes",
    "totals_before",
    "with_positions",
]
