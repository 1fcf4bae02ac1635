"""Word lists."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineflow.operators.ordering import with_positions
from lineflow.workspace import materialize, path_exists

# The list used where none can be read.
FALLBACK_WORDS = ("Apple", "Banana", "Cherry")

QUOTE = '"'

_log = logging.getLogger(__name__)


def word_array(json: Column | str) -> Column:
    """The words of a JSON array of strings; the fallback list if it is not one.

    Numbers or other values among the words make the list invalid, a JSON ``null``
    is an empty list.
    """
    json = F.col(json) if isinstance(json, str) else json
    parsed = F.try_parse_json(json)
    shape = F.schema_of_variant(parsed)
    words = F.from_json(json, "array<string>")
    closed = json.rlike(r"\]\s*\z")
    fallback = F.array(*[F.lit(w) for w in FALLBACK_WORDS])
    empty = F.array().cast("array<string>")
    return (
        F.when(shape == "VOID", empty)
        .when(shape.isin("ARRAY<STRING>", "ARRAY<VOID>") & closed & words.isNotNull(), words)
        .otherwise(fallback)
    )


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a JSON file, in column ``word``, with their place in ``seq``.

    The file is cut at quotes, so a list of any size is read in pieces by many tasks.
    Every other piece is a word, unless a backslash takes away the meaning of the
    quote before it; what stands between words must be brackets, commas and nulls.  A
    missing file, and one that is not an array of strings, give the built-in list and
    a warning.
    """
    fallback = spark.createDataFrame(list(enumerate(FALLBACK_WORDS)), "seq int, word string")
    if not path_exists(spark, path):
        _log.warning("%s not found; using the built-in word list", path)
        return fallback
    pieces = materialize(_numbered_pieces(spark, path), "word-pieces")
    last = pieces.agg(F.max("quotes")).first()[0]
    if last is None:
        _log.warning("%s is empty; using the built-in word list", path)
        return fallback
    entries = materialize(_entries(pieces, last), "words")
    bad = entries.agg(F.count_if("bad").alias("bad"), F.max(F.col("kind") == "null").alias("null")).first()
    if bad.null and last == 0:
        return fallback.filter("false")
    if bad.bad or last % 2:
        _log.warning("%s is not a JSON array of strings; using the built-in word list", path)
        return fallback
    found = entries.select("quotes", F.posexplode("words").alias("place", "word"))
    placed = with_positions(found, "quotes", "place")
    return placed.select((F.col("position") - 1).cast("int").alias("seq"), "word")


def _numbered_pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between quotes, with the number of true quotes before it.

    A piece that ends in an odd number of backslashes belongs together with the next.
    Quotes are counted within each task's piece of the file and then over these, of
    which there is one per task.
    """
    raw = spark.read.text(path, lineSep=QUOTE)
    order = F.monotonically_increasing_id()
    placed = raw.select(
        F.regexp_replace("value", "^\ufeff", "").alias("piece"),
        F.col("_metadata.file_block_start").alias("block"),
        F.spark_partition_id().alias("task"),
        order.alias("seq"),
    )
    placed = materialize(placed, "quoted").withColumn("ends", F.length(F.regexp_extract("piece", r"(\\*)$", 1)) % 2 == 0)
    tasks = placed.groupBy("task", "block").agg(F.count_if("ends").alias("own"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", "block", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("task", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.withColumn("inside", F.coalesce(F.sum(F.col("ends").cast("bigint")).over(within), F.lit(0)))
    return counted.join(tasks, ["task", "block"]).select(
        "piece", "ends", "block", "seq", (F.col("before") + F.col("inside")).alias("quotes")
    )


def _entries(pieces: DataFrame, last: int) -> DataFrame:
    """The words and gaps of a list: quotes, words, kind, bad."""
    joined = pieces.groupBy("quotes").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "piece"))), lambda p: p["piece"]), QUOTE).alias("text")
    )
    is_word = F.col("quotes") % 2 == 1
    parsed = F.from_json(F.concat(F.lit('{"w":"'), "text", F.lit('"}')), "w string")["w"]
    nulls = r"\s*(null\s*,\s*)*"
    alone = F.col("quotes").eqNullSafe(F.lit(0)) & F.lit(last == 0)
    gap = (
        F.when(alone, r"^\s*(\[\s*((null\s*,\s*)*null\s*)?\]|null)\s*$")
        .when(F.col("quotes") == 0, rf"^\s*\[{nulls}$")
        .when(F.col("quotes") == last, r"^\s*(,\s*null\s*)*\]\s*$")
        .otherwise(rf"^\s*,{nulls}$")
    )
    whole_null = alone & F.col("text").rlike(r"^\s*null\s*$")
    n_nulls = F.regexp_count("text", F.lit("null"))
    words = F.when(is_word, F.array(parsed)).otherwise(F.array_repeat(F.lit(None).cast("string"), n_nulls))
    bad = F.when(is_word, parsed.isNull()).otherwise(~F.regexp_like("text", gap))
    return joined.select(
        "quotes", words.alias("words"), F.when(whole_null, "null").otherwise("entry").alias("kind"), bad.alias("bad")
    )


def word_count(words: DataFrame) -> int:
    """Size of a word list."""
    return words.count()
