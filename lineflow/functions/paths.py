"""Names of part files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mark the part number takes the place of.
PLACEHOLDER = "{0}"


def part_path(pattern: str, index: Column | int) -> Column | str:
    """``pattern`` with its placeholder filled in: text for an int, else a column."""
    if isinstance(index, int):
        return pattern.replace(PLACEHOLDER, str(index))
    return F.replace(F.lit(pattern), F.lit(PLACEHOLDER), index.cast("string"))


def part_number(name: Column | str) -> Column:
    """The number in the name of a file Spark wrote, ``part-00007-...``; NULL for other names.

    Names order files only as long as five digits are enough.
    """
    name = F.col(name) if isinstance(name, str) else name
    return F.nullif(F.regexp_extract(name, r"^part-([0-9]+)", 1), F.lit("")).cast("bigint")
