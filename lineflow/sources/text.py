"""Sources of lines: text files, sorted runs, part files."""

from __future__ import annotations

import logging
import re
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineflow.functions.parsing import strip_all_cr, strip_cr
from lineflow.functions.paths import PLACEHOLDER, part_number, part_path
from lineflow.operators.parse import VALUE, parse_keys
from lineflow.sources.encodings import UNIT_BYTES, aligned_lines, file_encodings
from lineflow.workspace import path_exists

# Lines end with a line feed; a lone carriage return does not end one.
LINE_FEED = "\n"

_log = logging.getLogger(__name__)


def clean_lines(raw: DataFrame, encoding: str | None = None) -> DataFrame:
    """One carriage return before the line feed goes; what cannot be decoded becomes U+FFFD.

    A byte order mark at the beginning of a line is not part of it.
    """
    if encoding is None:
        return raw.withColumn(VALUE, strip_cr(F.make_valid_utf8(VALUE)))
    decoded = F.decode(F.col(VALUE).cast("binary"), encoding)
    return raw.withColumn(VALUE, strip_cr(F.regexp_replace(decoded, "^\ufeff", "")))


def text_options(encoding: str | None) -> dict[str, str]:
    """Options of the text source: lines end with a line feed in this encoding."""
    if encoding is not None and encoding.upper() in ("UTF-16", "UTF-32"):
        raise ValueError(f"name the byte order: {encoding}LE or {encoding}BE")
    return {"lineSep": LINE_FEED} | ({"encoding": encoding} if encoding else {})


def read_lines(
    spark: SparkSession, path: str | list[str], with_origin: bool = False, encoding: str | None = None
) -> DataFrame:
    """Lines of text files in a column ``value``.

    ``with_origin`` adds what orders the lines of files Spark wrote: ``part`` (the
    number in the file's name, which outgrows its five digits, so that names do not
    sort), ``source`` (the file), ``block`` and ``seq``.

    Without an ``encoding`` each file's byte order mark tells it, UTF-8 if there is
    none; a folder may hold files of several.  The driver, which lists the files, reads
    four bytes of each for that.  Name an encoding Java knows, such as UTF-8, to spare it.
    """
    if encoding is None:
        found = file_encodings(spark, path)
        if set(found) - {"UTF-8"}:
            pieces = [_lines_in(spark, paths, kind, with_origin) for kind, paths in sorted(found.items())]
            return reduce(DataFrame.unionByName, pieces)
    return _lines_in(spark, path, encoding, with_origin)


def _lines_in(spark: SparkSession, path: str | list[str], encoding: str | None, with_origin: bool) -> DataFrame:
    """Lines of files of one encoding."""
    encoding = None if encoding is None or encoding.upper() in ("UTF-8", "UTF8") else encoding
    if encoding is not None and encoding.upper() in UNIT_BYTES:
        lines = aligned_lines(spark, path, encoding.upper())
        return lines if with_origin else lines.select(VALUE)
    raw = spark.read.options(**text_options(encoding)).text(path)
    return clean_lines(raw.select(VALUE, *(line_origin() if with_origin else [])), encoding)


def line_origin() -> list[Column]:
    """``part``, ``source``, ``block`` and ``seq`` of a line that is read."""
    return [
        part_number(F.col("_metadata.file_name")).alias("part"),
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    ]


def read_runs(spark: SparkSession, path: str | list[str], format: str = "parquet") -> DataFrame:
    """Records of sorted runs with ``run_id``, the file each came from.

    Text runs hold rendered lines: every carriage return is removed and the key is
    parsed leniently, so no line is lost.
    """
    paths = [path] if isinstance(path, str) else path
    run = F.col("_metadata.file_path").alias("run_id")
    if format == "text":
        raw = spark.read.text(paths, lineSep=LINE_FEED)
        value = strip_all_cr(F.make_valid_utf8(VALUE)).alias(VALUE)
        return parse_keys(raw.select(value, run))
    return spark.read.format(format).load(paths).select("*", run)


def read_parts(spark: SparkSession, pattern: str, parts: int, with_origin: bool = False) -> DataFrame:
    """Lines of part files ``0 .. parts - 1`` with ``part_id``; missing ones are skipped.

    A part may be a file or a folder of files.  ``with_origin`` adds the columns of
    ``read_lines``; ordered by ``part_id`` and these, lines stand as in the parts
    joined one behind the other.
    """
    existing = [i for i in range(parts) if path_exists(spark, part_path(pattern, i))]
    for i in sorted(set(range(parts)) - set(existing)):
        _log.warning("part %d not found: %s", i, part_path(pattern, i))
    if not existing:
        origin = ", part long, source string, block long, seq long" if with_origin else ""
        return spark.createDataFrame([], f"value string, part_id int{origin}")
    # The part is known by the last piece of the pattern that holds the number.
    piece = next(p for p in reversed(pattern.split("/")) if PLACEHOLDER in p)
    before, after = (re.escape(quote(p, safe="=~@:$&'()*+,;!")) for p in piece.split(PLACEHOLDER, 1))
    name = f"/{before}([0-9]+){after}(/[^/]*)?$"
    raw = spark.read.text([part_path(pattern, i) for i in existing], lineSep=LINE_FEED)
    part_id = F.regexp_extract(F.col("_metadata.file_path"), name, 1).cast("int").alias("part_id")
    return clean_lines(raw.select(VALUE, part_id, *(line_origin() if with_origin else [])))
