"""Size literals such as ``100MB``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units and their factors.
UNITS = {"KB": 2**10, "MB": 2**20, "GB": 2**30, "B": 1, "": 1}

# An integer with optional sign, then an optional unit.  White
# space may stand around the literal and between number and unit.
SIZE_PATTERN = r"\A[\t-\r ]*([+-]?[0-9]+)[\t-\r ]*\x00*(KB|MB|GB|B|)\z"

# White space (Unicode property White_Space) cut from both ends.
OUTER_SPACE = (
    "\t\n\v\f\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_MAX_BIGINT = 2**63 - 1


def parse_size(literal: Column | str) -> Column:
    """Bytes meant by a size literal; NULL if it is malformed or overflows."""
    literal = F.col(literal) if isinstance(literal, str) else literal
    trimmed = F.upper(F.btrim(literal, F.lit(OUTER_SPACE)))
    number = F.regexp_extract(trimmed, SIZE_PATTERN, 1).try_cast("bigint")
    unit = F.regexp_extract(trimmed, SIZE_PATTERN, 2)
    factor = F.lit(1).cast("bigint")
    for name, value in UNITS.items():
        if value > 1:
            factor = F.when(unit == name, F.lit(value).cast("bigint")).otherwise(factor)
    return F.try_multiply(number, factor)


def size_in_bytes(literal: str | int) -> int:
    """The same for one literal given as an argument; raises ``ValueError``."""
    if isinstance(literal, int):
        return literal
    match = re.fullmatch(SIZE_PATTERN[2:-2], literal.strip(OUTER_SPACE).upper())
    if match is None:
        raise ValueError(f"invalid size literal: {literal!r}")
    size = int(match[1]) * UNITS[match[2]]
    if abs(int(match[1])) > _MAX_BIGINT or abs(size) > _MAX_BIGINT:
        raise ValueError(f"size literal out of range: {literal!r}")
    return size
