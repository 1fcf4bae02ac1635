"""Helpers that several operators share: words, plain tables, column names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab,
#: form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

find_words = re.compile(WORD).findall

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

def lower_ascii(text: str) -> str:
    """``text`` with A-Z, and nothing else, in lower case."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def lower_words(text: str) -> list[bytes]:
    """The words of the lower-cased text in UTF-8; bytes are split at just this white space."""
    return text.encode().lower().split()


def split_words(texts):
    """The words of an Arrow array of texts, lower-cased in A-Z, each different one once.

    The number of each word in its order, the different words in UTF-8, and the place
    behind the last word of each text.  Arrow splits at the same white space; what it
    finds before a first one and behind a last one is empty and left out.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not len(texts):
        return np.empty(0, np.int64), [], np.empty(0, np.int64)
    if texts.offset:  # lower-casing a cast slice takes the wrong bytes
        texts = texts.take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    coded = lists.flatten().dictionary_encode()
    numbers, distinct = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()).to_pylist()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    if b"" in distinct:
        none = distinct.index(b"")
        filled = numbers != none
        ends = np.append(0, np.cumsum(filled))[ends]
        numbers = numbers[filled]
        numbers = numbers - (numbers > none)
        del distinct[none]
    return numbers, distinct, ends


def slices_of(batch, text: int, size: int):
    """Slices of an Arrow batch with ``size`` bytes and one text of the column ``text`` at most."""
    import numpy as np
    import pyarrow.compute as pc

    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // size
    starts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist()]
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        if end > start:
            yield batch.slice(start, end - start)


def lower_ascii_column(text: Column) -> Column:
    """The same as a column; a text without other characters takes the faster way."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_and_text(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The columns an operator reads, as ``doc_id`` and ``text``; null text is empty.

    Other columns, whatever their names, are left out at the scan.
    """
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )
