"""Case folding and ordering of texts by ordinal, case-insensitive rules.

Two texts compare by the *simple* upper-case mapping of their characters, code
unit by UTF-16 code unit.  Neither ``upper`` (a full mapping: one character may
become two), ``lower`` nor a collation gives that order, so the fold is a
character table applied with ``translate``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two characters the ordinal fold leaves alone although
# Unicode gives them an upper case (dotless i, long s).
UNFOLDED = (0x0131, 0x017F)

# The greatest code point.  Used as a lead character in the sort key, see
# ``ordinal_ci_key``.
_LAST = chr(0x10FFFF)

# Bytes that occur in UTF-8 only in U+E000..U+FFFF (their first byte) and in the
# greatest code point.
_HIGH_BYTES = (b"\xee", b"\xef", _LAST.encode())


def _simple_upper(char: str) -> str:
    """The one-character upper case of ``char``, or ``char`` itself.

    Where the full upper case has several characters, a one-character title
    case (Greek letters with iota subscript) is the simple mapping.
    """
    upper = char.upper()
    if len(upper) != 1:
        upper = char.title()
    return upper if len(upper) == 1 else char


@lru_cache(maxsize=1)
def case_table() -> tuple[str, str]:
    """Characters that fold, and what each folds to, as two aligned strings."""
    lower, upper = [], []
    for code in range(0x110000):
        if 0xD800 <= code <= 0xDFFF or code in UNFOLDED:
            continue
        char = chr(code)
        folded = _simple_upper(char)
        if folded != char:
            lower.append(char)
            upper.append(folded)
    return "".join(lower), "".join(upper)


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def fold_case(text: Column | str) -> Column:
    """``text`` with every character replaced by its simple upper case.

    ``upper`` agrees with the table on ASCII and is many times faster than
    ``translate``, so only texts with other characters pay for the table.
    """
    text = F.col(text) if isinstance(text, str) else text
    return F.when(_is_ascii(text), F.upper(text)).otherwise(F.translate(text, *case_table()))


def ordinal_ci_key(text: Column | str) -> Column:
    """Sort key: the plain order of keys is the ordinal, case-insensitive order.

    The key is the folded text; strings compare by their UTF-8 bytes, which is code
    point order.  (A binary key would compare the same but is copied out of the row
    for every comparison.)
    UTF-16 order differs from it in one place: U+E000..U+FFFF come after all
    supplementary characters.  Those characters therefore get the greatest code
    point put before them (and that code point itself a NUL after it, so the key
    stays unambiguous).  Few texts hold any of them, so their lead bytes are looked
    for first; the fold never turns a character into one of them or out of one.
    For ASCII texts the key is as long as the text.
    """
    text = F.col(text) if isinstance(text, str) else text
    folded = F.translate(text, *case_table())
    marked = F.replace(folded, F.lit(_LAST), F.lit(_LAST + "\0"))
    marked = F.regexp_replace(marked, r"([\x{E000}-\x{FFFF}])", _LAST + "$1")
    utf8 = text.cast("binary")
    has_high = F.lit(False)
    for lead in _HIGH_BYTES:
        has_high = has_high | F.contains(utf8, F.lit(bytearray(lead)))
    return F.when(_is_ascii(text), F.upper(text)).when(has_high, marked).otherwise(folded)


def ordinal_ci_equal(left: Column | str, right: Column | str) -> Column:
    """True where both texts are the same but for case (NULL equals NULL)."""
    return fold_case(left).eqNullSafe(fold_case(right))


def ordinal_ci_compare(left: Column | str, right: Column | str) -> Column:
    """-1, 0 or 1 as ``left`` sorts before, with or after ``right``."""
    a, b = ordinal_ci_key(left), ordinal_ci_key(right)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def ordinal_ci_between(text: Column | str, low: Column | str, high: Column | str) -> Column:
    """Range predicate, both ends included.

    ``low`` and ``high`` are columns; pass ``F.lit`` for constants.
    """
    key = ordinal_ci_key(text)
    return (key >= ordinal_ci_key(low)) & (key <= ordinal_ci_key(high))


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 code units (a supplementary character counts as two)."""
    text = F.col(text) if isinstance(text, str) else text
    units = F.shiftright(F.octet_length(F.encode(text, "UTF-16BE")), 1)
    return F.when(_is_ascii(text), F.char_length(text)).otherwise(units)
