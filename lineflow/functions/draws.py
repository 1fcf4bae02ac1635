"""Reproducible random draws.

A draw is a piece of the MD5 hash of the seed and the columns that identify the row.
Unlike ``rand(seed)`` it does not depend on how the rows are partitioned, a retried
task draws the same values again, and other engines can draw them too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first digit and the number of hexadecimal digits a purpose takes of
# a row's hash.  They do not overlap, so one hash serves all draws of a row.
PIECES = {"number": (1, 11), "repeat": (12, 6), "word": (18, 15), "pool": (1, 15)}


def draw(seed: int, tag: str, *identity: Column | str) -> Column:
    """A uniform integer of as many bits as the piece named by ``tag`` has, 24 to 60.

    Any other tag is hashed with the row and takes a piece of its own hash.
    """
    start, digits = PIECES.get(tag, (1, 15))
    given = [str(seed)] if tag in PIECES else [str(seed), tag]
    parts = [F.lit(g) for g in given] + [F.col(i).cast("string") if isinstance(i, str) else i for i in identity]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), start, digits), 16, 10).cast("bigint")


def draw_below(bound: Column | int, seed: int, tag: str, *identity: Column | str) -> Column:
    """A uniform integer in ``0 .. bound - 1``."""
    bound = F.lit(bound) if isinstance(bound, int) else bound
    return draw(seed, tag, *identity) % bound.cast("bigint")


def mixture(percent: int, chosen: Column, other: Column, seed: int, tag: str, *identity: Column | str) -> Column:
    """``chosen`` in ``percent`` out of a hundred rows, else ``other``."""
    return F.when(draw_below(100, seed, tag, *identity) < percent, chosen).otherwise(other)
