"""Entry points for the driver: a flagship query, all queries and their SQL.

Every query reads whole tables of the given folder.  The tables hold no numbered
lines, so lines are made from their columns by SQL both sides share.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import lineflow as lf  # noqa: E402

# The training-data operators are a subpackage that may be absent.
try:
    import corpus_pipeline  # noqa: E402
    from lineflow.llm import queries as llm_queries  # noqa: E402
except ImportError:
    llm_queries = None

MAX_CHARS = 4096
DEGREE = 4
WORKERS = 32
PARTS = 16

# Lines of all kinds, good and malformed.
MIXED_LINE = """CASE p_partkey % 12
    WHEN 0 THEN p_name
    WHEN 1 THEN '.' || p_name
    WHEN 2 THEN cast(p_partkey AS string) || '.'
    WHEN 3 THEN cast(p_partkey AS string) || '.-' || p_name
    WHEN 4 THEN '00' || cast(p_partkey AS string) || '. ' || p_name
    WHEN 5 THEN '+' || cast(p_partkey AS string) || '. ' || p_name
    WHEN 6 THEN cast(2147483600 + p_partkey AS string) || '. ' || p_name
    WHEN 7 THEN ' -' || cast(p_partkey AS string) || ' . ' || p_name
    WHEN 8 THEN cast(p_retailprice AS string) || '. ' || p_name
    WHEN 9 THEN p_brand || '. ' || p_name
    WHEN 10 THEN cast(p_partkey AS string) || '. '
    ELSE cast(p_partkey AS string) || '. ' || p_name END"""

PART_LINE = "cast(p_partkey % 97 AS string) || '. ' || p_name"

PUNCTUATED = """CASE p_partkey % 6 WHEN 0 THEN '_' WHEN 1 THEN '[' WHEN 2 THEN '`'
    WHEN 3 THEN '^' WHEN 4 THEN 'z' ELSE '' END || p_name"""

SIZE_LITERAL = """CASE p_partkey % 10
    WHEN 0 THEN cast(p_partkey AS string) || 'KB'
    WHEN 1 THEN ' ' || cast(p_partkey AS string) || ' mb '
    WHEN 2 THEN cast(p_partkey AS string) || 'Gb'
    WHEN 3 THEN '-' || cast(p_partkey AS string) || 'B'
    WHEN 4 THEN cast(p_partkey AS string)
    WHEN 5 THEN cast(p_retailprice AS string) || 'GB'
    WHEN 6 THEN '+' || cast(p_partkey AS string) || ' kb'
    WHEN 7 THEN p_name
    WHEN 8 THEN ''
    ELSE '9999' || cast(1000000 + p_partkey AS string) || 'GB' END"""

WORD_DOCUMENT = """CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN '[]' WHEN 2 THEN '[1, ' || cast(p_size AS string) || ']'
    ELSE '["' || p_name || '", "' || p_type || '", "' || p_brand || '"]' END"""

ITEM_TEXT = "l_returnflag || ' ' || l_linestatus || ' ' || cast(cast(l_shipdate AS date) AS string)"

ORDER_TEXT = "o_orderpriority || ' ' || o_orderstatus"

# Texts differ only in case for half of the keys.
CASED_TYPE = "CASE WHEN p_partkey % 2 = 1 THEN lower(p_type) ELSE p_type END"

COMPARED_TYPE = "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END"

GURMUKHI = "text || 'ਅĀਅ'"

LISTED_WORD = "p_name || ', \"' || p_type || '\" ' || cast(p_partkey AS string)"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _records(table: DataFrame, num: str, text: str, *keep: str) -> DataFrame:
    """Rows of ``num`` and ``text`` given as SQL."""
    return table.select(*keep, F.expr(num).cast("int").alias("num"), F.expr(text).alias("text"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", F.expr(MIXED_LINE).alias("value"))


def _part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.expr(PART_LINE).alias("value"))


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text")
    )
    return lines.withColumn("num", (F.col("doc_id") % 97).cast("int"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(_read(spark, sf_dir, "lineitem"), "l_partkey", ITEM_TEXT)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "orders")
    return _records(table, "o_custkey", ORDER_TEXT, "o_orderkey", (F.col("o_custkey") % 8).cast("int").alias("worker"))


# ---- parsing ---------------------------------------------------------------


def parse_lines_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.parse_lines(_mixed(spark, sf_dir))


def parse_lines_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.parse_lines(lf.render_lines(_items(spark, sf_dir)))


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.reject_counts(_mixed(spark, sf_dir))


def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.rejects(_mixed(spark, sf_dir))


def lenient_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.parse_keys(_mixed(spark, sf_dir))


def render_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.render_lines(lf.parse_lines(_mixed(spark, sf_dir)))


def line_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = F.concat("text", F.lit("\r"))
    return (
        _document_lines(spark, sf_dir)
        .groupBy("doc_id")
        .agg(
            F.sum(F.octet_length("text").cast("bigint")).alias("bytes"),
            F.sum(lf.utf16_length("text").cast("bigint")).alias("chars"),
            F.sum(lf.dot_position("text").cast("bigint")).alias("dots"),
            F.sum(F.octet_length(lf.strip_cr(ended)).cast("bigint")).alias("stripped_bytes"),
            F.sum(F.octet_length(lf.strip_all_cr(F.concat(F.lit("\r"), ended))).cast("bigint")).alias("cleaned_bytes"),
            F.sum(lf.line_bytes("num", "text")).alias("rendered_bytes"),
        )
    )


def parse_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    literals = _read(spark, sf_dir, "part").select("p_partkey", F.expr(SIZE_LITERAL).alias("literal"))
    return literals.withColumn("bytes", lf.parse_size("literal"))


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers = lf.assign_parts(_read(spark, sf_dir, "part"), "p_partkey", WORKERS, PARTS)
    return workers.select("p_partkey", "worker", lf.part_path("data/part-{0}.tmp", F.col("part_id")).alias("path"))


# ---- comparing -------------------------------------------------------------


def ci_equal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    cased = _read(spark, sf_dir, "part").select(F.expr(CASED_TYPE).alias("text"))
    return cased.groupBy(lf.fold_case("text").alias("folded")).agg(F.count("*").alias("lines"))


def ci_compare_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    cased, punctuated = F.expr(CASED_TYPE), F.expr(PUNCTUATED)
    return part.select(
        "p_partkey",
        lf.ordinal_ci_compare(punctuated, cased).alias("compared"),
        lf.ordinal_ci_equal(cased, F.expr(COMPARED_TYPE)).alias("same"),
    )


def ci_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _document_lines(spark, sf_dir)
    inside = lf.ordinal_ci_between("text", F.lit("b"), F.lit("É"))
    return lines.filter(inside).groupBy("lang").agg(F.count("*").alias("lines"), F.sum("num").alias("nums"))


# ---- sorting and merging ---------------------------------------------------


def sorted_positions_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.line_positions(lf.parse_lines(_part_lines(spark, sf_dir)))


def sorted_positions_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.line_positions(_document_lines(spark, sf_dir).select("num", "text"))


def sorted_positions_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.line_positions(_records(_read(spark, sf_dir, "part"), "p_size", PUNCTUATED))


def sorted_positions_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.line_positions(_items(spark, sf_dir))


def sorted_lines_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.render_lines(lf.sort_lines(_items(spark, sf_dir)))


def merge_sorted_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = [
        _records(_read(spark, sf_dir, "part"), "p_size", "p_name"),
        _records(_read(spark, sf_dir, "supplier"), "s_nationkey", "s_name"),
        _records(_read(spark, sf_dir, "customer"), "c_nationkey", "lower(c_mktsegment)"),
    ]
    merged = lf.merge_sorted(*[lf.sort_chunks(i) for i in inputs])
    return lf.line_positions(merged)


def sorted_chunks_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every partition sorted on its own; rows out of order within one are counted."""
    chunks = lf.sort_chunks(_orders(spark, sf_dir).select("num", "text"))
    placed = chunks.withColumns({"chunk": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    order = F.struct(lf.ordinal_ci_key("text").alias("key"), "num", "text")
    previous = F.lag(order).over(Window.partitionBy("chunk").orderBy("place"))
    return (
        placed.withColumn("ordered", F.coalesce(previous <= order, F.lit(True)))
        .groupBy("text")
        .agg(F.count("*").alias("lines"), F.sum("num").alias("nums"), F.count_if(~F.col("ordered")).alias("out_of_order"))
    )


# ---- chunks, groups, prefixes ----------------------------------------------


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.assign_chunks(_document_lines(spark, sf_dir), MAX_CHARS, ["lang"], ["doc_id", "pos"])


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are all that is kept of the lines."""
    lengths = _document_lines(spark, sf_dir).select("lang", "doc_id", "pos", lf.utf16_length("text").alias("chars"))
    chunks = lf.assign_chunks(lengths, MAX_CHARS, ["lang"], ["doc_id", "pos"], chars="chars")
    return lf.run_stats(chunks, "lang", "chunk_id", chars="chars")


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = chunk_stats(spark, sf_dir)
    return runs.groupBy("lang").agg(F.count("*").alias("runs"))


def chunk_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).select("lang", "chunk_id", "num", "text")
    return lf.group_positions(chunks, "lang", "chunk_id", bounded=True)


def group_merge_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _chunks(spark, sf_dir).select(
        "lang", F.expr(f"chunk_id div {DEGREE}").alias("group_id"), "num", "text"
    )
    return lf.group_positions(grouped, "lang", "group_id", bounded=True)


def greedy_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as a buffer fills: the lines and lengths of each, and where its first line is."""
    lengths = _document_lines(spark, sf_dir).select("lang", "doc_id", "pos", lf.utf16_length("text").alias("chars"))
    chunks = lf.greedy_chunks(lengths, MAX_CHARS, ["lang"], ["doc_id", "pos"], chars="chars")
    return chunks.groupBy("lang", "chunk_id").agg(
        F.count("*").alias("lines"), F.sum(F.col("chars").cast("bigint")).alias("chars"), F.min("doc_id").alias("first_doc")
    )


def take_bytes_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _orders(spark, sf_dir)
    total = lines.agg(F.sum(lf.line_bytes("num", "text"))).first()[0]
    return lf.take_bytes(lines, total // 16, ["worker"], ["o_orderkey"])


def part_stats_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _records(_read(spark, sf_dir, "lineitem"), "l_partkey", ITEM_TEXT, "l_orderkey")
    return lf.part_stats(lf.assign_parts(items, "l_orderkey", WORKERS, PARTS))


# ---- files -----------------------------------------------------------------


def _lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a sorted text with their place in it."""
    lines = lf.read_lines(spark, path, with_origin=True)
    return lf.with_positions(lines, "part", "block", "seq").select("position", "value")


def sorted_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write lines, sort the file, read it back; positions follow the file order."""
    source, target = lf.scratch_path(spark, "lines"), lf.scratch_path(spark, "sorted")
    lf.write_text(_mixed(spark, sf_dir).select("value"), source)
    lf.sort_file(spark, source, target)
    return _lines_in_order(spark, target)


def runs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to sorted runs, runs merged in groups, groups merged to one text."""
    source, runs, groups, target = (lf.scratch_path(spark, n) for n in ("lines", "runs", "groups", "merged"))
    lf.write_text(lf.render_lines(_orders(spark, sf_dir).select("num", "text")), source)
    lf.write_sorted_runs(spark, source, runs)
    lf.merge_in_groups(spark, runs, groups, DEGREE)
    lf.merge_runs(spark, groups, target)
    return _lines_in_order(spark, target)


def text_runs_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text runs keep malformed lines; their key is empty and sorts first."""
    runs, target = lf.scratch_path(spark, "text-runs"), lf.scratch_path(spark, "merged-text")
    sorted_runs = lf.sort_partitions(lf.parse_keys(_mixed(spark, sf_dir)).repartition(4), *lf.line_order(), "value")
    lf.write_text(sorted_runs.select("value"), runs)
    lf.merge_runs(spark, runs, target, format="text")
    return lf.parse_keys(_lines_in_order(spark, target))


def parts_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = lf.scratch_path(spark, "parts")
    items = _records(_read(spark, sf_dir, "lineitem"), "l_partkey", ITEM_TEXT, "l_orderkey")
    assigned = lf.assign_parts(items, "l_orderkey", WORKERS, PARTS)
    lf.write_parts(assigned.select("part_id", "num", "text"), parts, gather=True)
    return lf.part_stats(lf.parse_lines(lf.read_parts(spark, parts + "/part_id={0}", PARTS)))


def parts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted lines dealt out to parts and read back in the order of parts and lines."""
    parts = lf.scratch_path(spark, "ordered-parts")
    placed = sorted_positions_part(spark, sf_dir).withColumn("part_id", (F.col("position") % PARTS).cast("int"))
    ordered = placed.repartitionByRange("part_id", "position").sortWithinPartitions("part_id", "position")
    lf.write_parts(ordered.select("part_id", "num", "text"), parts)
    lines = lf.read_parts(spark, parts + "/part_id={0}", PARTS, with_origin=True)
    return lf.with_positions(lines, "part_id", "part", "block", "seq").select("position", "part_id", "value")


def utf16_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written in UTF-16 and read again."""
    path = lf.scratch_path(spark, "utf16")
    lines = _document_lines(spark, sf_dir)
    lines = lf.render_lines(lines.select("num", "text"))
    encoded = lines.select(F.encode(F.concat("value", F.lit("\r")), "UTF-16LE").cast("string").alias("value"))
    encoded.write.option("encoding", "UTF-16LE").text(path, lineSep="\n")
    return lf.parse_lines(lf.read_lines(spark, path, encoding="UTF-16LE"))


def mixed_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of three encodings in one folder, told by their byte order marks.

    The text holds characters between whose bytes a line feed seems to stand.
    """
    folder = lf.scratch_path(spark, "encodings")
    lines = lf.render_lines(_document_lines(spark, sf_dir).select("doc_id", "num", F.expr(GURMUKHI).alias("text")))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    for place, encoding in enumerate(("UTF-8", "UTF-16LE", "UTF-16BE")):
        part = lines.filter(F.col("doc_id") % 3 == place).repartition(2)
        marked = part.select(F.when(first, F.concat(F.lit("\ufeff"), "value")).otherwise(F.col("value")).alias("value"))
        encoded = marked.select(F.encode("value", encoding).cast("string").alias("value"))
        encoded.write.option("encoding", encoding).text(f"{folder}/{encoding}", lineSep="\n")
    return lf.parse_lines(lf.read_lines(spark, f"{folder}/*"))


def observed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and bytes of each part, counted while the parts are written."""
    items = _records(_read(spark, sf_dir, "lineitem"), "l_partkey", ITEM_TEXT, "l_orderkey")
    assigned = lf.assign_parts(items, "l_orderkey", WORKERS, PARTS)
    return lf.write_parts(assigned, lf.scratch_path(spark, "observed"), gather=True, parts=PARTS)


def stream_runs_then_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files arrive as a stream, each batch leaves sorted runs, runs are merged."""
    arriving, runs, checkpoint = (lf.scratch_path(spark, n) for n in ("arriving", "stream-runs", "stream"))
    lf.write_text(_part_lines(spark, sf_dir).repartition(4), arriving)
    records = lf.stream_lines(spark, arriving, max_files=2)
    lf.stream_runs(records, runs, checkpoint).awaitTermination()
    target = lf.scratch_path(spark, "compacted")
    lf.compact_runs(spark, runs, target)
    return lf.parse_lines(_lines_in_order(spark, target))


def streams_share_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams with checkpoints of their own write to one folder; all their lines are there."""
    runs = lf.scratch_path(spark, "shared-runs")
    for half in (0, 1):
        arriving, checkpoint = (lf.scratch_path(spark, n) for n in ("arriving", "stream"))
        lf.write_text(_mixed(spark, sf_dir).filter(F.col("p_partkey") % 2 == half).select("value"), arriving)
        lf.stream_runs(lf.stream_lines(spark, arriving), runs, checkpoint).awaitTermination()
    return lf.read_stream_runs(spark, runs).groupBy("text").agg(F.count("*").alias("lines"), F.sum("num").alias("nums"))


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream keeps records and what it rejects; started again, it adds to neither."""
    arriving, runs, bad, checkpoint = (lf.scratch_path(spark, n) for n in ("arriving", "runs", "rejects", "stream"))
    lf.write_text(_mixed(spark, sf_dir).select("value"), arriving)
    for _ in range(2):
        lines = lf.stream_lines(spark, arriving, parse=False)
        lf.stream_runs(lines, runs, checkpoint, rejected=bad).awaitTermination()
    accepted = lf.read_stream_runs(spark, runs).select(F.lit("accepted").alias("reason"))
    refused = lf.read_stream_rejects(spark, runs, bad).select("reason")
    return accepted.unionByName(refused).groupBy("reason").agg(F.count("*").alias("lines"))


def _part_store(spark: SparkSession, sf_dir: str) -> str:
    """Lines of the parts, in three portions that one stream takes in turn, each sorted into a store."""
    arriving, runs, checkpoint, store = (lf.scratch_path(spark, n) for n in ("arriving", "runs", "stream", "store"))
    lines = _read(spark, sf_dir, "part").select("p_partkey", F.expr(PART_LINE).alias("value"))
    for portion in range(3):
        lf.append_text(lines.filter(F.col("p_partkey") % 3 == portion).select("value"), arriving)
        lf.stream_runs(lf.stream_lines(spark, arriving), runs, checkpoint).awaitTermination()
        lf.add_runs(spark, runs, store)
    return store


def store_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compacted, added to, and compacted again: every line's place in the text."""
    return lf.read_store(spark, _part_store(spark, sf_dir))


def store_lines_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.lines_between(spark, _part_store(spark, sf_dir), 51, 150)


def store_texts_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lf.texts_between(spark, _part_store(spark, sf_dir), "b", "LINEN")


def store_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where lines made of customers would stand among those of the parts."""
    records = _records(_read(spark, sf_dir, "customer"), "c_nationkey", "lower(c_mktsegment)", "c_custkey").drop("c_custkey")
    return lf.rank_lines(records.unionByName(_records(_read(spark, sf_dir, "part"), "p_size", "p_name")), _part_store(spark, sf_dir))


# ---- words and generated lines ---------------------------------------------


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "part").select("p_partkey", lf.word_array(F.expr(WORD_DOCUMENT)).alias("words"))
    return documents.select("p_partkey", F.posexplode("words").alias("seq", "word"))


def word_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON list of words, written to one file and read from it."""
    path = lf.scratch_path(spark, "word-file")
    word = F.replace(F.expr(LISTED_WORD), F.lit('"'), F.lit('\\"'))
    entries = _read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('"'), word, F.lit('",')).alias("value"))
    ends = spark.createDataFrame([(-1, "["), (2**62, "null]")], "p_partkey long, value string")
    lf.write_text(entries.unionByName(ends).coalesce(1).sortWithinPartitions("p_partkey").select("value"), path)
    return lf.read_words(spark, path).filter("word IS NOT NULL")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.size(lf.word_array(F.expr(WORD_DOCUMENT)))
    return _read(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum(size.cast("bigint")).alias("words"))


def _generated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines made of part names, as many bytes as the orders have lines' worth; and the words."""
    words = _read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("word")).distinct()
    size = _orders(spark, sf_dir).agg(F.sum(lf.line_bytes("num", "text"))).first()[0]
    options = lf.GeneratorOptions(size, 8, 4, 15, 1_000_000, seed=42)
    return lf.generate_lines(spark, words, options), words


def generated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generated(spark, sf_dir)[0]


def generated_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each worker's lines: how many, how large, and how many repeat a word of the small pool."""
    lines, words = _generated(spark, sf_dir)
    pool = lf.word_pool(spark, words, seed=42)
    few = pool.table.filter(F.col("word_id") < pool.repeated).select(F.col("word").alias("text"), F.lit(1).alias("few"))
    return (
        lines.join(few, "text", "left")
        .groupBy("worker", "part_id")
        .agg(
            F.count("*").alias("lines"),
            F.sum(lf.line_bytes("num", "text")).alias("bytes"),
            F.count("few").alias("of_small_pool"),
            F.sum(F.col("num").cast("bigint")).alias("nums"),
        )
    )


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: parse lines and give each its place in the sorted output."""
    return sorted_positions_part(spark, "/root/testdata/sf0.001")


_QUERIES = (
    parse_lines_part,
    parse_lines_lineitem,
    reject_reasons,
    rejected_lines,
    lenient_keys,
    render_canonical,
    line_measures,
    parse_sizes,
    part_paths,
    ci_equal_groups,
    ci_compare_columns,
    ci_range_filter,
    sorted_positions_part,
    sorted_positions_docs,
    sorted_positions_punct,
    sorted_positions_lineitem,
    sorted_lines_lineitem,
    merge_sorted_three,
    sorted_chunks_orders,
    chunk_stats,
    chunk_counts,
    chunk_positions,
    group_merge_positions,
    greedy_chunk_stats,
    take_bytes_orders,
    part_stats_lineitem,
    sorted_file_round_trip,
    runs_round_trip,
    text_runs_merge,
    parts_round_trip,
    parts_in_order,
    utf16_lines,
    mixed_encodings,
    observed_parts,
    stream_runs_then_merge,
    streams_share_runs,
    stream_rejects,
    store_positions,
    store_lines_between,
    store_texts_between,
    store_ranks,
    word_lists,
    word_file,
    word_counts,
    generated_lines,
    generated_properties,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name; each takes the session and the folder of the tables."""
    found = {query.__name__: query for query in _QUERIES}
    if llm_queries:
        found |= {query.__name__: query for query in llm_queries.QUERIES}
        found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    """The same results in SQL for DuckDB."""
    lower, upper = lf.case_table()

    def fold(text: str) -> str:
        return f"translate({text}, '{lower}', '{upper}')"

    def positions(records: str, *groups: str) -> str:
        within = f"PARTITION BY {', '.join(groups)} " if groups else ""
        keep = "".join(f"{g}, " for g in groups)
        return (
            f"SELECT {keep}num, text, "
            f"row_number() OVER ({within}ORDER BY {fold('text')}, num, text) AS position FROM ({records})"
        )

    number = r"^[\t-\r ]*([+-]?[0-9]+)[\t-\r ]*\x00*\."
    mixed = f"SELECT p_partkey, {MIXED_LINE} AS value FROM part"
    # NULL number or text: the line is malformed.
    split = f"""SELECT p_partkey, value,
        try_cast(regexp_extract(value, '{number}', 1) AS INTEGER) AS num,
        CASE WHEN length(value) > instr(value, '.') THEN substr(value, instr(value, '.') + 2) END AS text
        FROM ({mixed})"""
    strict = f"SELECT p_partkey, num, text FROM ({split}) WHERE num IS NOT NULL AND text IS NOT NULL"
    lenient = f"""SELECT p_partkey, value, coalesce(num, 0) AS num,
        CASE WHEN num IS NOT NULL THEN coalesce(text, '') END AS text FROM ({split})"""
    rejected = f"""SELECT p_partkey, value, CASE WHEN instr(value, '.') = 0 THEN 'no_dot'
        WHEN instr(value, '.') = 1 THEN 'dot_first' WHEN num IS NULL THEN 'bad_number' ELSE 'no_text' END AS reason
        FROM ({split}) WHERE num IS NULL OR text IS NULL"""
    part_records = "SELECT cast(p_partkey % 97 AS INTEGER) AS num, p_name AS text FROM part"
    documents = """SELECT doc_id, lang, pos, text, cast(doc_id % 97 AS INTEGER) AS num FROM (
        SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"""
    units = "(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"
    items = f"SELECT l_orderkey, cast(l_partkey AS INTEGER) AS num, {ITEM_TEXT} AS text FROM lineitem"
    orders = f"""SELECT o_orderkey, cast(o_custkey % 8 AS INTEGER) AS worker,
        cast(o_custkey AS INTEGER) AS num, {ORDER_TEXT} AS text FROM orders"""
    size = "(strlen(cast(num AS VARCHAR)) + strlen(text) + 3)"
    chunks = f"""SELECT *, cast((sum({units}) OVER (PARTITION BY lang ORDER BY doc_id, pos
        ROWS UNBOUNDED PRECEDING) - {units}) // {MAX_CHARS} AS BIGINT) AS chunk_id FROM ({documents})"""
    groups = f"SELECT lang, chunk_id // {DEGREE} AS group_id, num, text FROM ({chunks})"
    runs = f"""SELECT lang, chunk_id, count(*) AS lines, cast(sum({units}) AS BIGINT) AS chars
        FROM ({chunks}) GROUP BY lang, chunk_id"""
    parts = f"""SELECT cast(l_orderkey % {WORKERS} % {PARTS} AS INTEGER) AS part_id, count(*) AS lines,
        cast(sum({size}) AS BIGINT) AS bytes FROM ({items}) GROUP BY part_id"""
    literal = f"SELECT p_partkey, {SIZE_LITERAL} AS literal FROM part"
    size_number = r"regexp_extract(upper(trim(literal)), '^([+-]?[0-9]+) *(KB|MB|GB|B|)$', 1)"
    size_unit = r"regexp_extract(upper(trim(literal)), '^([+-]?[0-9]+) *(KB|MB|GB|B|)$', 2)"
    # Wide arithmetic, then NULL where a 64-bit integer would overflow.
    sizes = f"""SELECT p_partkey, literal, try_cast(cast(try_cast({size_number} AS BIGINT) AS HUGEINT) *
        CASE {size_unit} WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576 WHEN 'GB' THEN 1073741824 ELSE 1 END
        AS BIGINT) AS bytes FROM ({literal})"""
    words = """SELECT p_partkey, p_brand, CASE p_partkey % 5 WHEN 1 THEN []
        WHEN 0 THEN ['Apple', 'Banana', 'Cherry'] WHEN 2 THEN ['Apple', 'Banana', 'Cherry']
        ELSE [p_name, p_type, p_brand] END AS words FROM part"""
    merged = """SELECT p_size AS num, p_name AS text FROM part
        UNION ALL SELECT s_nationkey, s_name FROM supplier
        UNION ALL SELECT c_nationkey, lower(c_mktsegment) FROM customer"""
    left, right = fold(PUNCTUATED), fold(CASED_TYPE)
    value = "cast(num AS VARCHAR) || '. ' || text AS value"

    def draw(first: int, digits: int, row: str) -> str:
        return f"cast('0x' || substr(md5({row}), {first}, {digits}) AS BIGINT)"

    slot = "'42:' || cast(worker AS VARCHAR) || ':' || cast(seq AS VARCHAR)"
    # Generated lines are longer than those of orders, so there are slots enough.
    generated = f"""WITH words AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS word FROM part),
        pool AS (SELECT word, row_number() OVER (ORDER BY {draw(1, 15, "'42:' || word")}, word) - 1 AS word_id FROM words),
        counted AS (SELECT count(*) AS n, greatest(1, count(*) // 4) AS few FROM words),
        target AS (SELECT cast(sum({size}) AS BIGINT) AS bytes_of FROM ({orders})),
        slots AS (SELECT cast(w.range AS INTEGER) AS worker, o.seq
            FROM range(8) w, (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS seq FROM orders) o
            WHERE o.seq < (SELECT count(*) // 8 FROM orders)),
        drawn AS (SELECT worker, seq, cast({draw(1, 11, slot)} % 1000000 + 1 AS INTEGER) AS num,
            {draw(18, 15, slot)} % CASE WHEN {draw(12, 6, slot)} % 100 < 15 THEN few ELSE n END AS word_id
            FROM slots, counted),
        lines AS (SELECT worker, seq, num, word AS text, {size.replace("text", "word")} AS bytes
            FROM drawn JOIN pool USING (word_id)),
        placed AS (SELECT *, sum(bytes) OVER (PARTITION BY worker ORDER BY seq ROWS UNBOUNDED PRECEDING) - bytes AS before
            FROM lines)
        SELECT worker, cast(worker % 4 AS INTEGER) AS part_id, seq, num, text FROM placed, target
        WHERE before < bytes_of // 8 + CASE WHEN worker < bytes_of % 8 THEN 1 ELSE 0 END"""
    few_words = f"""SELECT word AS text, 1 AS few FROM (SELECT word, count(*) OVER () AS n, row_number() OVER (
        ORDER BY {draw(1, 15, "'42:' || word")}, word) - 1 AS word_id FROM (
        SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS word FROM part))
        WHERE word_id < greatest(1, n // 4)"""
    found = {
        "parse_lines_part": strict,
        "parse_lines_lineitem": f"SELECT num, text FROM ({items})",
        "reject_reasons": f"SELECT reason, count(*) AS lines FROM ({rejected}) GROUP BY reason",
        "rejected_lines": rejected,
        "lenient_keys": lenient,
        "render_canonical": f"SELECT p_partkey, {value} FROM ({strict})",
        "line_measures": f"""SELECT doc_id, cast(sum(strlen(text)) AS BIGINT) AS bytes,
            cast(sum({units}) AS BIGINT) AS chars, cast(sum(instr(text, '.')) AS BIGINT) AS dots,
            cast(sum(strlen(text)) AS BIGINT) AS stripped_bytes,
            cast(sum(strlen(replace(text, chr(13), ''))) AS BIGINT) AS cleaned_bytes,
            cast(sum({size}) AS BIGINT) AS rendered_bytes FROM ({documents}) GROUP BY doc_id""",
        "parse_sizes": sizes,
        "part_paths": f"""SELECT p_partkey, cast(p_partkey % {WORKERS} AS INTEGER) AS worker,
            'data/part-' || cast(p_partkey % {WORKERS} % {PARTS} AS VARCHAR) || '.tmp' AS path FROM part""",
        "ci_equal_groups": f"SELECT {right} AS folded, count(*) AS lines FROM part GROUP BY folded",
        "ci_compare_columns": f"""SELECT p_partkey, CASE WHEN {left} < {right} THEN -1 WHEN {left} > {right} THEN 1
            ELSE 0 END AS compared, {right} = {fold(COMPARED_TYPE)} AS same FROM part""",
        "ci_range_filter": f"""SELECT lang, count(*) AS lines, cast(sum(num) AS BIGINT) AS nums FROM ({documents})
            WHERE {fold('text')} BETWEEN 'B' AND 'É' GROUP BY lang""",
        "sorted_positions_part": positions(part_records),
        "sorted_positions_docs": positions(documents),
        "sorted_positions_punct": positions(f"SELECT p_size AS num, {PUNCTUATED} AS text FROM part"),
        "sorted_positions_lineitem": positions(items),
        "sorted_lines_lineitem": f"SELECT {value} FROM ({items})",
        "merge_sorted_three": positions(merged),
        "sorted_chunks_orders": f"""SELECT text, count(*) AS lines, cast(sum(num) AS BIGINT) AS nums,
            cast(0 AS BIGINT) AS out_of_order FROM ({orders}) GROUP BY text""",
        "chunk_stats": runs,
        "chunk_counts": f"SELECT lang, count(*) AS runs FROM ({runs}) GROUP BY lang",
        "chunk_positions": positions(chunks, "lang", "chunk_id"),
        "group_merge_positions": positions(groups, "lang", "group_id"),
        "greedy_chunk_stats": f"""WITH RECURSIVE laid AS MATERIALIZED (SELECT lang, doc_id, pos, {units} AS chars,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) AS place,
                sum({units}) OVER (PARTITION BY lang ORDER BY doc_id, pos ROWS UNBOUNDED PRECEDING) AS ending FROM ({documents})),
            starts AS (SELECT lang, 0 AS chunk_id, cast(1 AS BIGINT) AS place, cast(0 AS HUGEINT) AS base
                FROM laid GROUP BY lang
                UNION ALL SELECT s.lang, s.chunk_id + 1, n.place, n.ending - n.chars FROM starts s, LATERAL (
                    SELECT place, ending, chars FROM laid WHERE laid.lang = s.lang AND laid.place > s.place AND chars > 0
                    AND laid.ending > s.base + {MAX_CHARS} ORDER BY place LIMIT 1) n),
            ranges AS (SELECT *, lead(place, 1, 9223372036854775807) OVER (PARTITION BY lang ORDER BY chunk_id) AS next FROM starts)
            SELECT laid.lang, cast(chunk_id AS BIGINT) AS chunk_id, count(*) AS lines, cast(sum(chars) AS BIGINT) AS chars,
            min(doc_id) AS first_doc FROM laid JOIN ranges r ON laid.lang = r.lang AND laid.place >= r.place AND laid.place < r.next
            GROUP BY laid.lang, chunk_id""",
        "take_bytes_orders": f"""SELECT o_orderkey, worker, num, text FROM (
            SELECT *, sum({size}) OVER (PARTITION BY worker ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - {size}
            AS before, sum({size}) OVER () // 16 AS target FROM ({orders})) WHERE before < target""",
        "part_stats_lineitem": parts,
        "sorted_file_round_trip": f"SELECT position, {value} FROM ({positions(strict)})",
        "runs_round_trip": f"SELECT position, {value} FROM ({positions(orders)})",
        "text_runs_merge": f"""SELECT value, num, text, row_number() OVER (
            ORDER BY {fold('text')} NULLS FIRST, num, text, value) AS position FROM ({lenient})""",
        "parts_round_trip": parts,
        "stream_runs_then_merge": positions(part_records),
        "streams_share_runs": f"""SELECT text, count(*) AS lines, cast(sum(num) AS BIGINT) AS nums FROM ({strict})
            GROUP BY text""",
        "stream_rejects": f"""SELECT reason, count(*) AS lines FROM (SELECT 'accepted' AS reason FROM ({strict})
            UNION ALL SELECT reason FROM ({rejected})) GROUP BY reason""",
        "store_positions": positions(part_records),
        "store_lines_between": f"SELECT * FROM ({positions(part_records)}) WHERE position BETWEEN 51 AND 150",
        "store_texts_between": f"""SELECT * FROM ({positions(part_records)})
            WHERE {fold('text')} BETWEEN 'B' AND 'LINEN'""",
        "store_ranks": f"""SELECT cast(num AS INTEGER) AS num, text, position FROM (SELECT num, text, 1 + cast(count(*) FILTER (stored = 1) OVER (ORDER BY {fold('text')}, num, text, stored
            ROWS UNBOUNDED PRECEDING) AS BIGINT) AS position, stored FROM (
            SELECT num, text, 1 AS stored FROM ({part_records}) UNION ALL
            SELECT c_nationkey, lower(c_mktsegment), 0 FROM customer UNION ALL SELECT p_size, p_name, 0 FROM part)) WHERE stored = 0""",
        "word_lists": f"""SELECT p_partkey, cast(unnest(range(len(words))) AS INTEGER) AS seq, unnest(words) AS word
            FROM ({words})""",
        "word_file": f"""SELECT cast(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS seq, {LISTED_WORD} AS word
            FROM part""",
        "parts_in_order": f"""SELECT row_number() OVER (ORDER BY part_id, place) AS position, part_id, {value} FROM (
            SELECT num, text, position AS place, cast(position % {PARTS} AS INTEGER) AS part_id
            FROM ({positions(part_records)}))""",
        "utf16_lines": f"SELECT num, text FROM ({documents})",
        "mixed_encodings": f"SELECT num, {GURMUKHI} AS text FROM ({documents})",
        "observed_parts": parts,
        "generated_lines": generated,
        "word_counts": f"SELECT p_brand, cast(sum(len(words)) AS BIGINT) AS words FROM ({words}) GROUP BY p_brand",
        "generated_properties": f"""SELECT worker, part_id, count(*) AS lines, cast(sum({size}) AS BIGINT) AS bytes,
            count(few) AS of_small_pool, cast(sum(num) AS BIGINT) AS nums FROM ({generated})
            LEFT JOIN ({few_words}) USING (text) GROUP BY worker, part_id""",
    }
    if llm_queries:
        found |= llm_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
