"""Command line: ``python -m lineflow`` or ``spark-submit`` on this file."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from lineflow.plans import SortOptions, generate_file, merge_in_groups, merge_runs, sort_file, write_sorted_runs
from lineflow.sources import GeneratorOptions


def parser() -> argparse.ArgumentParser:
    generator, sort = GeneratorOptions(), SortOptions()
    top = argparse.ArgumentParser(prog="lineflow", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("generate", help="write synthetic lines, one folder per part")
    job.add_argument("output")
    job.add_argument("--words", default="words.json", help="JSON array of strings")
    job.add_argument("--target-size", default=generator.target_size)
    job.add_argument("--worker-count", type=int, default=generator.worker_count)
    job.add_argument("--partition-count", type=int, default=generator.partition_count)
    job.add_argument("--duplicate-percentage", type=int, default=generator.duplicate_percentage)
    job.add_argument("--max-number", type=int, default=generator.max_number)
    job.add_argument("--seed", type=int, default=generator.seed)

    job = jobs.add_parser("sort", help="sort lines")
    job.add_argument("input", nargs="+")
    job.add_argument("output")

    job = jobs.add_parser("runs", help="write sorted runs")
    job.add_argument("input", nargs="+")
    job.add_argument("output")
    job.add_argument("--chunk-size-mb", type=int, default=sort.chunk_size_mb)

    job = jobs.add_parser("merge", help="merge sorted runs into one text, or in groups into fewer runs")
    job.add_argument("input")
    job.add_argument("output")
    job.add_argument("--degree", type=int, help="merge this many runs at a time, giving one group each")
    return top


def main(arguments: Sequence[str] | None = None) -> None:
    chosen = parser().parse_args(arguments)
    if chosen.job == "generate":
        options = GeneratorOptions(
            chosen.target_size,
            chosen.worker_count,
            chosen.partition_count,
            chosen.duplicate_percentage,
            chosen.max_number,
            chosen.seed,
        )
    spark = SparkSession.builder.appName(f"lineflow-{chosen.job}").getOrCreate()
    if chosen.job == "generate":
        generate_file(spark, chosen.output, chosen.words, options)
    elif chosen.job == "sort":
        sort_file(spark, chosen.input, chosen.output)
    elif chosen.job == "runs":
        write_sorted_runs(spark, chosen.input, chosen.output, SortOptions(chunk_size_mb=chosen.chunk_size_mb))
    elif chosen.degree is not None:
        merge_in_groups(spark, chosen.input, chosen.output, chosen.degree)
    else:
        merge_runs(spark, chosen.input, chosen.output)


if __name__ == "__main__":
    main()
