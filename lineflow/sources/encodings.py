"""Encodings told by byte order marks, and lines of those whose units are several bytes.

The text source looks for a line feed in bytes.  Where a unit is two or four bytes, it
also finds one across the border of two characters, at a place that is no multiple of
the unit.  Such a cut leaves pieces whose lengths are no multiples either, so running
totals of lengths tell true ends of lines from false ones, and pieces between two true
ones are put together again.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineflow.functions.parsing import strip_cr
from lineflow.functions.paths import part_number
from lineflow.operators.ordering import totals_before
from lineflow.operators.parse import VALUE

# Byte order marks, longer ones first, and the bytes of a unit.
MARKS = (
    (b"\xff\xfe\x00\x00", "UTF-32LE"),
    (b"\x00\x00\xfe\xff", "UTF-32BE"),
    (b"\xff\xfe", "UTF-16LE"),
    (b"\xfe\xff", "UTF-16BE"),
)
UNIT_BYTES = {"UTF-16LE": 2, "UTF-16BE": 2, "UTF-32LE": 4, "UTF-32BE": 4}

# Files whose beginnings the driver reads at the same time.
_READERS = 32


def file_encodings(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """The files of ``path`` by the encoding their byte order mark tells, UTF-8 without one."""
    jvm, configuration = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def encoding_of(file: str) -> tuple[str, str]:
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream = place.getFileSystem(configuration).open(place)
        try:
            head = bytes(byte for byte in (stream.read() for _ in range(4)) if byte >= 0)
        finally:
            stream.close()
        return next((kind for mark, kind in MARKS if head.startswith(mark)), "UTF-8"), place.toString()

    found: dict[str, list[str]] = {}
    files = spark.read.text(path).inputFiles()
    with ThreadPoolExecutor(_READERS) as readers:
        for kind, file in readers.map(encoding_of, files):
            # A name is not a pattern.
            found.setdefault(kind, []).append(re.sub(r"([\\*?\[\]{}])", r"\\\1", file))
    return found


def aligned_lines(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """Lines of files in UTF-16 or UTF-32: value, part, source, block, seq.

    What cannot be decoded becomes U+FFFD.  A first pass adds up lengths per piece of a
    file that a task reads; only where a line feed was found at a false place, pieces are
    put together, by an order of these pieces alone.
    """
    unit = UNIT_BYTES[encoding]
    raw = spark.read.option("lineSep", "\n").option("encoding", encoding).text(path)
    rows = raw.select(
        F.col(VALUE).cast("binary").alias("piece"),
        part_number(F.col("_metadata.file_name")).alias("part"),
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )
    over = F.octet_length("piece") % unit
    sums = rows.groupBy("source", "block").agg(F.sum(over.cast("bigint")).alias("over"), F.count_if(over > 0).alias("cuts"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("shift", F.coalesce(F.sum("over").over(before), F.lit(0)) % unit).filter("cuts > 0 OR shift > 0")
    # One entry for each of the tasks' pieces that are affected, in most inputs none.
    shifts = {(r.source, r.block): r.shift for r in sums.select("source", "block", "shift").collect()}
    schema = "value string, piece binary, ends int, part long, source string, block long, seq long"
    read = rows.mapInArrow(_aligned_batches(encoding, unit, shifts), schema)
    origin = ["part", "source", "block", "seq"]
    lines = read.select(VALUE, *origin)
    if shifts:
        pieces = read.filter("piece IS NOT NULL").drop(VALUE)
        numbered = totals_before(pieces, ["source"], ["block", "seq"], "ends", "line")
        struct = F.struct("block", "seq", "part", "piece")
        joined = numbered.groupBy("source", "line").agg(F.array_sort(F.collect_list(struct)).alias("pieces"))
        first = F.element_at("pieces", 1)
        joined = joined.select(
            F.transform("pieces", lambda p: p["piece"]).alias("pieces"), first["part"].alias("part"), "source",
            first["block"].alias("block"), first["seq"].alias("seq"),
        )
        together = joined.mapInArrow(_joined_batches(encoding), "value string, part long, source string, block long, seq long")
        lines = read.filter("piece IS NULL").select(VALUE, *origin).unionByName(together)
    return lines.withColumn(VALUE, strip_cr(F.regexp_replace(VALUE, "^\ufeff", "")))


def _aligned_batches(encoding: str, unit: int, shifts: dict):
    """Arrow function: lines decoded, and pieces between false cuts as they are.

    Nested so that executors need not have this package installed.
    """

    def align(batches):
        import pyarrow as pa

        at, shift = None, 0
        for batch in batches:
            values, pieces, ends = [], [], []
            sources, blocks = batch.column("source").to_pylist(), batch.column("block").to_pylist()
            for piece, source, block in zip(batch.column("piece").to_pylist(), sources, blocks):
                if (source, block) != at:
                    at, shift = (source, block), shifts.get((source, block), 0)
                whole = shift == 0
                shift = (shift + len(piece)) % unit
                whole = whole and shift == 0
                values.append(piece.decode(encoding, "replace") if whole else None)
                pieces.append(None if whole else piece)
                ends.append(int(shift == 0))
            columns = [pa.array(values, pa.string()), pa.array(pieces, pa.binary()), pa.array(ends, pa.int32())]
            columns += [batch.column(c) for c in ("part", "source", "block", "seq")]
            yield pa.RecordBatch.from_arrays(columns, ["value", "piece", "ends", "part", "source", "block", "seq"])

    return align


def _joined_batches(encoding: str):
    """Arrow function: pieces joined by the line feed they were cut at, decoded."""

    def join(batches):
        import pyarrow as pa

        cut = "\n".encode(encoding)
        for batch in batches:
            values = [cut.join(p).decode(encoding, "replace") for p in batch.column("pieces").to_pylist()]
            columns = [pa.array(values, pa.string()), *(batch.column(c) for c in ("part", "source", "block", "seq"))]
            yield pa.RecordBatch.from_arrays(columns, ["value", "part", "source", "block", "seq"])

    return join
