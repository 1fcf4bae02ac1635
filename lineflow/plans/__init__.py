"""Whole jobs: generate a file, sort a file, merge runs, keep a sorted text up to date."""

from lineflow.plans.generate import generate_counted, generate_file
from lineflow.plans.sort import SortOptions, merge_in_groups, merge_runs, sort_file, write_sorted_runs
from lineflow.plans.store import (
    add_runs,
    add_to_store,
    lines_between,
    rank_lines,
    read_store,
    store_files,
    texts_between,
    texts_equal,
)

__all__ = [
    "SortOptions",
    "add_runs",
    "add_to_store",
    "generate_counted",
    "generate_file",
    "lines_between",
    "merge_in_groups",
    "merge_runs",
    "rank_lines",
    "read_store",
    "sort_file",
    "store_files",
    "texts_between",
    "texts_equal",
    "write_sorted_runs",
]
