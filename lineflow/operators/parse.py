"""Lines to records and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.functions.parsing import line_number, line_text, reject_reason, render_line

NUM = "num"
TEXT = "text"
VALUE = "value"


def _generated(df: DataFrame, rest: list[str], **columns: Column) -> DataFrame:
    """``rest`` and the columns, which a generator makes, one row from each row.

    The optimizer puts filters on other columns below a generator, where they reach
    the source, and leaves filters on the generated columns above it.  Of a projection
    it would compute these columns twice, once to filter.
    """
    struct = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*rest, F.inline(F.array(struct)))


def parse_lines(df: DataFrame, value: str = VALUE) -> DataFrame:
    """Replace the line by ``num`` and ``text``; malformed lines are dropped."""
    rest = [c for c in df.columns if c != value]
    parsed = _generated(df, rest, **{NUM: line_number(value), TEXT: line_text(value)})
    return parsed.filter(F.col(NUM).isNotNull() & F.col(TEXT).isNotNull())


def parse_keys(df: DataFrame, value: str = VALUE) -> DataFrame:
    """Add ``num`` and ``text`` leniently and keep every line.

    A line that ends right after the dot has an empty text.  A line without a
    number gets 0 and a NULL text, which sorts before all others.
    """
    number = line_number(value)
    text = F.when(number.isNotNull(), F.coalesce(line_text(value), F.lit("")))
    return df.withColumns({NUM: F.coalesce(number, F.lit(0)), TEXT: text})


def rejects(df: DataFrame, value: str = VALUE) -> DataFrame:
    """The lines ``parse_lines`` drops, with the ``reason``."""
    return _generated(df, df.columns, reason=reject_reason(value)).filter(F.col("reason").isNotNull())


def reject_counts(df: DataFrame, value: str = VALUE) -> DataFrame:
    """Number of dropped lines by ``reason``."""
    return rejects(df, value).groupBy("reason").agg(F.count("*").alias("lines"))


def render_lines(df: DataFrame, num: str = NUM, text: str = TEXT) -> DataFrame:
    """Replace ``num`` and ``text`` by the line ``value``."""
    rest = [c for c in df.columns if c not in (num, text)]
    return df.select(*rest, render_line(num, text).alias(VALUE))
