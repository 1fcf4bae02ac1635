"""What the plans must look like for the work to scale."""

import re

import pytest
from pyspark.sql import functions as F

import lineflow as lf


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Records on disk, with a column no operator needs."""
    path = str(tmp_path_factory.mktemp("stored") / "records")
    rows = spark.range(0, 5000, 1, 4).select(
        F.col("id").cast("int").alias("num"), F.concat(F.lit("t"), F.col("id") % 50).alias("text"), F.lit("x").alias("unused")
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def text(spark, tmp_path_factory, stored):
    path = str(tmp_path_factory.mktemp("stored") / "lines")
    lf.write_text(lf.render_lines(stored.select("num", "text")), path)
    return lf.read_lines(spark, path)


def test_parse_is_one_stage_and_runs_once(text):
    shape = plan(lf.parse_lines(text))
    assert "Exchange" not in shape and "Python" not in shape
    # The filter is on the parsed columns, the line is not parsed again for it.
    assert re.search(r"Filter \(isnotnull\(num#\d+\) AND isnotnull\(text#\d+\)\)", shape)
    assert shape.count("RLIKE") == 1


def test_filters_reach_the_source_through_parsing(spark, tmp_path):
    lines = spark.range(0, 100).select((F.col("id") % 5).alias("day"), "id", F.lit("1. x").alias("value"))
    lines.write.partitionBy("day").parquet(str(tmp_path / "lines"))
    stored = spark.read.parquet(str(tmp_path / "lines"))
    for parsed in (lf.parse_lines(stored), lf.rejects(stored), lf.parse_keys(stored)):
        shape = plan(parsed.filter("id = 5 AND day = 0"))
        assert "EqualTo(id,5)" in shape and re.search(r"PartitionFilters: \[[^\]]*day", shape)


def test_sort_ships_records_only(stored):
    shape = plan(lf.sort_lines(stored.select("num", "text")))
    exchange = shape[shape.index("Exchange") :]
    assert shape.count("Exchange") == 1 and "rangepartitioning" in exchange
    assert "__key0" not in exchange and "unused" not in shape


def test_chunk_sort_does_not_shuffle(stored):
    shape = plan(lf.sort_chunks(stored))
    assert "Exchange" not in shape and shape.count("Sort ") == 1


def test_merging_sorted_runs_shuffles_once(stored):
    records = stored.select("num", "text")
    shape = plan(lf.merge_sorted(lf.sort_chunks(records), lf.sort_chunks(records)))
    assert shape.count("Exchange") == 1 and shape.count("rangepartitioning") == 1


def test_positions_move_no_records_after_the_sort(stored):
    shape = plan(lf.line_positions(stored.select("num", "text")))
    assert shape.count("BroadcastHashJoin") == 1
    # Only partition numbers and counts are exchanged, read from one narrow column.
    counted = shape[shape.index("BroadcastExchange") :]
    assert "ReadSchema: struct<__ordinal:bigint>" in counted
    assert "Exchange" not in shape[: shape.index("BroadcastExchange")]


def test_totals_move_no_records_after_the_sort(stored):
    shape = plan(lf.group_positions(stored.select("num", "text"), "text"))
    assert shape.count("BroadcastHashJoin") == 1 and "MapInArrow" not in shape
    assert "ReadSchema: struct<text:string,__amount:bigint,__partition:int>" in shape
    assert "Exchange" not in shape[: shape.index("BroadcastExchange")]


def test_statistics_combine_before_the_shuffle(stored):
    shape = plan(lf.part_stats(lf.assign_parts(stored, "num", 32, 16)))
    assert "partial_count" in shape and "partial_sum" in shape and shape.count("Exchange") == 1
    assert "ReadSchema: struct<num:int,text:string>" in shape


def test_prefix_sorts_one_range_only(stored):
    """Rows before the cut come out of a scan; what is sorted is one range."""
    shape = plan(lf.take_bytes(stored.select("num", "text"), 20_000, [], ["num"]))
    before = shape[: shape.index("Scan parquet")]
    assert "Exchange rangepartitioning" not in shape and "MapInArrow" not in shape and "Sort" not in before
