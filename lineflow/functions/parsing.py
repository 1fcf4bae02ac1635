"""Column functions for the line grammar ``<number>. <text>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What may stand before the first dot.  White space is tab to
# carriage return and the space; trailing NULs are allowed.
NUMBER_PATTERN = r"\A[\t-\r ]*[+-]?[0-9]+[\t-\r ]*\x00*\z"

# Names of the reject reasons.
NO_DOT = "no_dot"
DOT_FIRST = "dot_first"
BAD_NUMBER = "bad_number"
NO_TEXT = "no_text"

# What a line is made of.
SEPARATOR = ". "


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_cr(line: Column | str) -> Column:
    """Remove one carriage return at the very end."""
    line = _col(line)
    return F.when(F.endswith(line, F.lit("\r")), F.left(line, F.char_length(line) - 1)).otherwise(line)


def strip_all_cr(line: Column | str) -> Column:
    """Remove every carriage return."""
    return F.replace(_col(line), F.lit("\r"), F.lit(""))


def dot_position(line: Column | str) -> Column:
    """1-based position of the first dot, 0 if there is none."""
    return F.instr(_col(line), ".")


def line_number(line: Column | str) -> Column:
    """The 32-bit integer before the first dot, NULL if that is not a number.

    A string-to-int cast alone would also trim control characters that are not
    white space here, hence the pattern.  Most numbers are in canonical form
    already; for those the cheap comparison spares the pattern.
    """
    line = _col(line)
    head = F.substring_index(line, ".", 1)
    number = head.try_cast("int")
    is_number = (number.cast("string") == head) | head.rlike(NUMBER_PATTERN)
    return F.when((dot_position(line) > 1) & is_number, number)


def has_text(line: Column | str) -> Column:
    """True if the line holds a dot and at least one character behind it."""
    line = _col(line)
    dot = dot_position(line)
    return (dot > 0) & (F.char_length(line) > dot)


def line_text(line: Column | str) -> Column:
    """Everything after the first dot and the one character behind it.

    That character is skipped, not checked.  NULL if the line ends before it.
    """
    line = _col(line)
    return F.when(has_text(line), F.substr(line, dot_position(line) + 2))


def reject_reason(line: Column | str) -> Column:
    """Why the strict parse refuses a line, NULL if it does not."""
    line = _col(line)
    dot = dot_position(line)
    return (
        F.when(dot == 0, NO_DOT)
        .when(dot == 1, DOT_FIRST)
        .when(line_number(line).isNull(), BAD_NUMBER)
        .when(line_text(line).isNull(), NO_TEXT)
    )


def render_line(num: Column | str, text: Column | str) -> Column:
    """``num`` in canonical decimal form, dot, space, ``text``."""
    return F.concat(_col(num).cast("string"), F.lit(SEPARATOR), _col(text))


def line_bytes(num: Column | str, text: Column | str) -> Column:
    """UTF-8 size of the rendered line with its line feed, without rendering it."""
    digits = F.octet_length(_col(num).cast("string"))
    return (digits + F.octet_length(_col(text)) + len(SEPARATOR) + 1).cast("bigint")
