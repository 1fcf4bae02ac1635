"""Generate a text of numbered lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from lineflow.sinks import write_parts
from lineflow.sources.generator import GeneratorOptions, generate_lines
from lineflow.sources.words import read_words


def generate_file(
    spark: SparkSession,
    path: str,
    words: str | DataFrame | Iterable[str],
    options: GeneratorOptions = GeneratorOptions(),
) -> DataFrame:
    """Generate lines and write them to ``path``, one folder per part.

    ``words`` is the path of a JSON word list, a DataFrame with a column ``word`` or
    a list.  Returns the generated records.  ``generate_counted`` returns what was written
    to each part.
    """
    if isinstance(words, str):
        words = read_words(spark, words)
    generated = generate_lines(spark, words, options)
    write_parts(generated, path)
    return generated


def generate_counted(
    spark: SparkSession,
    path: str,
    words: str | DataFrame | Iterable[str],
    options: GeneratorOptions = GeneratorOptions(),
) -> DataFrame:
    """``generate_file``, returning the part_id, lines and bytes of each part, counted while writing."""
    if isinstance(words, str):
        words = read_words(spark, words)
    return write_parts(generate_lines(spark, words, options), path, parts=options.partition_count)
