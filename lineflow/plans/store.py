"""A sorted text that is kept up to date: files that know their ranges.

A store is a folder of Parquet files, each sorted, and a manifest with one row per file:
its place in the order, its least and greatest record, its lines and the lines before it.
New records go to the file whose range they fall into, and only these files are written
again.  Every change is a generation with files of its own and, written last, a new
manifest, so readers see one state or the next and a failed change leaves nothing that
counts.

The manifest also is the index of the text: a line number, a range of texts or a record
leads to the files that hold it, and their key column, sorted, to the row groups.

The driver handles names of files, as it does in any read of them, and never their rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineflow.functions.folding import ordinal_ci_key
from lineflow.functions.paths import part_number
from lineflow.operators.ordering import range_sort, totals_before
from lineflow.operators.parse import NUM, TEXT
from lineflow.streaming import committed_batches, read_stream_runs
from lineflow.workspace import child_names, materialize, path_exists

KEY = "key"

#: What lines are sorted by; texts that differ only in case are told apart by the last.
ORDER = (KEY, NUM, TEXT)

_ROWS = f"{KEY} string, {NUM} int, {TEXT} string"
_RECORD = f"struct<{KEY}:string,{NUM}:int,{TEXT}:string>"
_MANIFEST = f"place long, file string, lines long, before long, least {_RECORD}, greatest {_RECORD}"

# Rows of a part of a file that is read or skipped as a whole.
_ROW_GROUP_BYTES = 2**23


def store_generation(spark: SparkSession, store: str) -> int | None:
    """Number of the last change that is whole, or None."""
    folder = f"{store}/_manifest"
    whole = [
        int(match[1])
        for name in child_names(spark, folder)
        if (match := re.fullmatch(r"gen=([0-9]+)", name)) and path_exists(spark, f"{folder}/{name}/_SUCCESS")
    ]
    return max(whole, default=None)


def store_files(spark: SparkSession, store: str) -> DataFrame:
    """The manifest: place, file, lines, before (lines in earlier files), least, greatest."""
    generation = store_generation(spark, store)
    if generation is None:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{store}/_manifest/gen={generation}")


def _read_files(spark: SparkSession, store: str, files: DataFrame) -> DataFrame:
    """Rows of some files of the manifest: key, num, text, row (in the file), place, before."""
    names = [r.file for r in files.select("file").collect()]
    if not names:
        return spark.createDataFrame([], f"{_ROWS}, row long, place long, before long")
    read = spark.read.schema(_ROWS).parquet(*[f"{store}/{name}" for name in names])
    rows = read.select(*ORDER, F.col("_metadata.row_index").alias("row"), _file_name().alias("file"))
    return rows.join(files.select("file", "place", "before"), "file").drop("file")


def _file_name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), "(gen=[0-9]+/at=[0-9]+/[^/]+)$", 1)


def _routed(records: DataFrame, files: DataFrame) -> DataFrame:
    """``records`` (key, num, text) and ``at``, the place of the file each belongs to.

    That is the last file whose least record is not greater.  The files' least records
    are sorted among the others and counted, so neither side has to fit anywhere.
    """
    marks = files.select("least.*", F.lit(0).alias("kind"), F.lit(1).alias("mark"))
    all_rows = marks.unionByName(records.select(*ORDER, F.lit(1).alias("kind"), F.lit(0).alias("mark")))
    counted = totals_before(all_rows, [], [*ORDER, "kind"], "mark", "marks")
    at = F.greatest(F.col("marks") - 1, F.lit(0).cast("bigint")).alias("at")
    return counted.filter("kind = 1").select(*ORDER, at)


def add_to_store(records: DataFrame, store: str, runs: DataFrame | None = None) -> bool:
    """Sort ``records`` into the store; False if there are none.

    Only files whose range they fall into are written again, each on its own, so no
    new file reaches over one that stays.  ``runs`` are names noted as taken in.
    """
    spark = records.sparkSession
    latest = store_generation(spark, store)
    files = store_files(spark, store)
    fresh = records.select(ordinal_ci_key(TEXT).alias(KEY), NUM, TEXT)
    fresh = _routed(fresh, files) if latest is not None else fresh.withColumn("at", F.lit(0).cast("bigint"))
    fresh = materialize(fresh, "store-input")
    touched = materialize(fresh.select(F.col("at").alias("place")).distinct(), "store-touched")
    if touched.isEmpty():
        return False
    generation = 0 if latest is None else latest + 1
    old = _read_files(spark, store, files.join(touched, "place", "left_semi"))
    together = fresh.unionByName(old.select(*ORDER, F.col("place").alias("at")))
    folder = f"{store}/gen={generation}"
    writer = range_sort(together, "at", *ORDER).write.mode("overwrite").partitionBy("at")
    writer = writer.option("parquet.block.size", _ROW_GROUP_BYTES).option(f"parquet.bloom.filter.enabled#{KEY}", "true")
    writer.parquet(folder)

    written = spark.read.schema(f"{_ROWS}, at long").parquet(folder)
    record = F.struct(*ORDER)
    new = written.groupBy("at", _file_name().alias("file")).agg(
        F.count("*").alias("lines"), F.min(record).alias("least"), F.max(record).alias("greatest")
    )
    kept = files.join(touched, "place", "left_anti").select(F.col("place").alias("at"), "file", "lines", "least", "greatest")
    # One row per file.
    order = Window.orderBy("at", part_number(F.element_at(F.split("file", "/"), -1)), "file")
    before = F.coalesce(F.sum("lines").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    manifest = kept.unionByName(new).select(
        (F.row_number().over(order) - 1).cast("bigint").alias("place"), "file", "lines", before.alias("before"), "least", "greatest"
    )
    if runs is not None:
        runs.write.mode("overwrite").parquet(f"{store}/_runs/gen={generation}")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{store}/_manifest/gen={generation}")
    return True


def add_runs(spark: SparkSession, runs: str, store: str) -> bool:
    """Sort the batches a stream has committed since the last time into the store."""
    latest = store_generation(spark, store)
    names = committed_batches(spark, runs).select("run")
    if latest is not None and path_exists(spark, f"{store}/_runs"):
        taken = spark.read.schema("run string, gen long").parquet(f"{store}/_runs").filter(F.col("gen") <= latest)
        names = names.join(taken, "run", "left_anti")
    names = materialize(names, "store-runs")
    records = read_stream_runs(spark, runs).join(names, "run", "left_semi")
    return add_to_store(records.select(NUM, TEXT), store, names)


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select((F.col("before") + F.col("row") + 1).alias("position"), NUM, TEXT)


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """All lines: position, num, text.  Positions come from the manifest; nothing is sorted."""
    return _placed(_read_files(spark, store, store_files(spark, store)))


def lines_between(spark: SparkSession, store: str, first: int, last: int) -> DataFrame:
    """Lines ``first .. last``, counted from 1, out of the files that hold them."""
    files = store_files(spark, store).filter((F.col("before") < last) & (F.col("before") + F.col("lines") >= first))
    return _placed(_read_files(spark, store, files)).filter(F.col("position").between(first, last))


def _key_of(spark: SparkSession, text: str) -> str:
    return spark.range(1).select(ordinal_ci_key(F.lit(text))).first()[0]


def texts_between(spark: SparkSession, store: str, low: str | None, high: str | None) -> DataFrame:
    """position, num, text of the lines whose text is in a range without regard to case, ends included.

    None leaves an end open.  Files are chosen by the manifest, row groups by the key's
    statistics.
    """
    files, inside = store_files(spark, store), F.lit(True)
    if low is not None:
        key = _key_of(spark, low)
        files, inside = files.filter(F.col("greatest.key") >= key), inside & (F.col(KEY) >= key)
    if high is not None:
        key = _key_of(spark, high)
        files, inside = files.filter(F.col("least.key") <= key), inside & (F.col(KEY) <= key)
    return _placed(_read_files(spark, store, files).filter(inside))


def texts_equal(spark: SparkSession, store: str, texts: Sequence[str]) -> DataFrame:
    """position, num, text of the lines with one of ``texts``, without regard to case."""
    keys = [_key_of(spark, text) for text in texts]
    asked = spark.createDataFrame([(k,) for k in keys], "asked string")
    inside = F.col("asked").between(F.col("least.key"), F.col("greatest.key"))
    # A few texts against one row per file.
    files = store_files(spark, store).join(F.broadcast(asked), inside, "left_semi")
    return _placed(_read_files(spark, store, files).filter(F.col(KEY).isin(keys)))


def rank_lines(records: DataFrame, store: str) -> DataFrame:
    """``records`` (num, text) with ``position``, where each stands or would stand in the text.

    That is one more than the lines that sort before it.  Only files in whose range a
    record falls are read.
    """
    spark = records.sparkSession
    files = store_files(spark, store)
    fresh = records.select(ordinal_ci_key(TEXT).alias(KEY), NUM, TEXT)
    asked = materialize(_routed(fresh, files), "ranked")
    touched = materialize(asked.select(F.col("at").alias("place")).distinct(), "store-touched")
    stored = _read_files(spark, store, files.join(touched, "place", "left_semi"))
    both = stored.select(*ORDER, F.col("place").alias("at"), F.lit(1).alias("kind")).unionByName(asked.withColumn("kind", F.lit(0)))
    counted = totals_before(both, ["at"], [*ORDER, "kind"], "kind", "inside").filter("kind = 0")
    starts = files.select(F.col("place").alias("at"), "before")
    position = F.coalesce("before", F.lit(0).cast("bigint")) + F.col("inside") + 1
    return counted.join(starts, "at", "left").select(NUM, TEXT, position.alias("position"))
