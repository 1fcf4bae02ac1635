"""Sources."""

from lineflow.sources.generator import GeneratorOptions, generate_lines, lines_per_worker, word_pool
from lineflow.sources.text import clean_lines, read_lines, read_parts, read_runs
from lineflow.sources.words import FALLBACK_WORDS, read_words, word_array, word_count

__all__ = [
    "FALLBACK_WORDS",
    "GeneratorOptions",
    "clean_lines",
    "generate_lines",
    "lines_per_worker",
    "read_lines",
    "read_parts",
    "read_runs",
    "read_words",
    "word_array",
    "word_count",
    "word_pool",
]
