import datetime
import random

import pytest
from pyspark.sql import functions as F

from lineflow import operators as op
from tests.test_functions import utf16_key


def expected_order(rows):
    return sorted(rows, key=lambda r: (utf16_key(r[1]), r[0], r[1].encode()))


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(5)
    words = ["Apple", "apple", "_x", "[z", "Zed", "stra\u00dfe", "\u00e9", "", "\ue000", "\U00010428", "banana split"]
    return [(rng.randint(-5, 50), rng.choice(words) + rng.choice(["", "", " tail"])) for _ in range(3000)]


@pytest.fixture(scope="module")
def table(spark, sample):
    return spark.createDataFrame(sample, "num int, text string").repartition(5).cache()


def collected(df):
    return [(r.num, r.text) for r in df.collect()]


def test_parse_lines_and_rejects_are_complements(lines):
    df = lines("1. a", "x", ".y", "z. a", "2.", "3. ").withColumn("id", F.monotonically_increasing_id())
    parsed = op.parse_lines(df)
    assert parsed.columns == ["id", "num", "text"]
    assert sorted((r.num, r.text) for r in parsed.collect()) == [(1, "a"), (3, "")]
    assert {r.reason: r.lines for r in op.reject_counts(df).collect()} == {
        "no_dot": 1, "dot_first": 1, "bad_number": 1, "no_text": 1,
    }


def test_lenient_keys_sort_first(lines):
    keyed = op.parse_keys(lines("2. b", "5.", "abc. d", "1. A"))
    rows = [(r.value, r.num, r.text) for r in op.sort_lines(keyed).collect()]
    assert rows == [("abc. d", 0, None), ("5.", 5, ""), ("1. A", 1, "A"), ("2. b", 2, "b")]


def test_render_round_trip(table):
    again = op.parse_lines(op.render_lines(table))
    assert again.exceptAll(table).count() == 0 and table.exceptAll(again).count() == 0


def test_sort_lines(table, sample):
    assert collected(op.sort_lines(table)) == expected_order(sample)


def test_sort_is_idempotent_and_uses_one_shuffle(table, sample):
    once = op.sort_lines(table)
    assert collected(op.sort_lines(once)) == expected_order(sample)
    plan = op.sort_lines(table.sparkSession.range(5).select(F.lit(1).alias("num"), F.col("id").cast("string").alias("text")))
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1 and "rangepartitioning" in plan


def test_copies_of_one_line_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = spark.range(0, 2000000, 1, 4).select(
            F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).cast("int").alias("num"), F.lit("same").alias("text")
        )
        sizes = op.sort_lines(hot).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r[1] for r in sizes) == 2000000
        assert max(r[1] for r in sizes) < 2000000 / 8 * 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_sort_chunks_keeps_partitions(table):
    before = table.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    chunks = op.sort_chunks(table).withColumn("p", F.spark_partition_id()).collect()
    by_partition = {}
    for r in chunks:
        by_partition.setdefault(r.p, []).append((r.num, r.text))
    assert {r.p: r.n for r in before.collect()} == {p: len(rows) for p, rows in by_partition.items()}
    assert all(rows == expected_order(rows) for rows in by_partition.values())


def test_merge_sorted_keeps_copies(records):
    merged = op.merge_sorted(records((1, "b"), (3, "A")), records((1, "b")), records((2, "a")))
    assert collected(merged) == [(2, "a"), (3, "A"), (1, "b"), (1, "b")]


def test_line_positions(table, sample):
    rows = op.line_positions(table).collect()
    assert sorted(r.position for r in rows) == list(range(1, len(sample) + 1))
    assert [(r.num, r.text) for r in sorted(rows, key=lambda r: r.position)] == expected_order(sample)


def test_positions_of_an_empty_input(records):
    assert op.line_positions(records()).count() == 0
    assert op.group_positions(records().withColumn("g", F.lit(1)), "g").count() == 0


@pytest.mark.parametrize("groups", [["g"], ["g", "h"]])
def test_totals_before(spark, groups):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([0, 1, None]), i, rng.randint(0, 9)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, h int, i int, v int").repartition(6)
    totals, expected = {}, {}
    for g, h, i, v in sorted(rows, key=lambda r: r[2]):
        key = (g, h)[: len(groups)]
        expected[i] = totals.get(key, 0)
        totals[key] = expected[i] + v
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = op.totals_before(df, groups, ["i"], "v")
        assert {r.i: r.before for r in got.collect()} == expected
        for below in (0, 5, 700, 10**6):
            got = op.totals_before(df, groups, ["i"], "v", below=below)
            assert {r.i: r.before for r in got.collect()} == {i: t for i, t in expected.items() if t < below}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_group_positions(table, sample):
    grouped = table.withColumn("g", F.abs("num") % 3)
    got = {}
    for r in op.group_positions(grouped, "g").collect():
        got.setdefault(r.g, []).append((r.position, (r.num, r.text)))
    for g, rows in got.items():
        rows.sort()
        assert [p for p, _ in rows] == list(range(1, len(rows) + 1))
        assert [x for _, x in rows] == expected_order([s for s in sample if abs(s[0]) % 3 == g])


def test_assign_chunks(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, "x" * rng.randint(0, 9) + rng.choice(["", "\U0001f600"])) for i in range(500)]
    df = spark.createDataFrame(rows, "src string, seq int, text string").repartition(4)
    chunked = op.assign_chunks(df, 40, ["src"], ["seq"])
    units = lambda t: len(t.encode("utf-16-be")) // 2
    expected, used = {}, {"a": 0, "b": 0}
    for src, seq, text in rows:
        expected[seq] = used[src] // 40
        used[src] += units(text)
    assert {r.seq: r.chunk_id for r in chunked.collect()} == expected
    stats = op.run_stats(chunked, "src", "chunk_id").collect()
    assert sum(r.lines for r in stats) == 500
    assert sum(r.chars for r in stats) == sum(used.values())
    assert all(r.chars < 40 + 11 for r in stats)


def test_take_bytes(spark):
    rows = [(w, i, 1, "x" * (i % 7)) for w in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "worker int, seq int, num int, text string").repartition(4)
    kept = op.take_bytes(df, 60, ["worker"], ["seq"])
    expected = set()
    for w in range(3):
        used = 0
        for _, i, n, t in [r for r in rows if r[0] == w]:
            if used < 60:
                expected.add((w, i))
            used += len(f"{n}. {t}\n")
    assert {(r.worker, r.seq) for r in kept.collect()} == expected
    stats = op.part_stats(kept, "worker").collect()
    assert all(60 <= r.bytes < 60 + 11 for r in stats)


def test_assign_parts(spark):
    got = op.assign_parts(spark.range(100), "id", 6, 4).select("id", "worker", "part_id").collect()
    assert all((r.worker, r.part_id) == (r.id % 6, r.id % 6 % 4) for r in got)


def test_nan_and_null_groups(spark):
    rows = [(float("nan"), 3, "c"), (float("nan"), 1, "a"), (None, 2, "b"), (float("nan"), 2, "b"), (1.0, 1, "x"), (None, 1, "a")]
    df = spark.createDataFrame(rows, "g double, num int, text string")
    for bounded in (False, True):
        found = op.group_positions(df, "g", bounded=bounded).collect()
        assert {(str(r.g), r.text): r.position for r in found} == {
            ("nan", "a"): 1, ("nan", "b"): 2, ("nan", "c"): 3, ("None", "a"): 1, ("None", "b"): 2, ("1.0", "x"): 1,
        }


def test_chunks_of_null_texts(spark):
    df = spark.createDataFrame([("s", 1, "abc"), ("s", 2, None), ("s", 3, "def")], "source string, place int, text string")
    chunks = {r.place: r.chunk_id for r in op.assign_chunks(df, 3, ["source"], ["place"]).collect()}
    assert chunks == {1: 0, 2: 1, 3: 1}


def test_rows_from_a_shuffle_are_written_before_they_are_split(spark):
    """The partitions of a sort must not depend on the order a task sees its rows in."""
    copies = spark.range(0, 40_000, 1, 4).select((F.col("id") % 3).alias("k"), F.lit(1).cast("int").alias("num"), F.lit("x").alias("text"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    shuffled = op.sort_lines(copies.repartition(7, "k").select("num", "text"))
    assert "Scan parquet" in plan(shuffled) and "hashpartitioning" not in plan(shuffled)
    sizes = [[len(p) for p in op.sort_lines(copies.select("num", "text")).rdd.glom().collect()] for _ in range(2)]
    assert sizes[0] == sizes[1] and sum(sizes[0]) == 40_000


# ---- greedy chunks ---------------------------------------------------------


def plain_greedy(rows, most):
    """(source, place) to chunk, filling one buffer after the other."""
    found, state = {}, {}
    for source, place, length in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        chunk, used, any_chars = state.get(source, (0, 0, False))
        length = length or 0
        if length and any_chars and used + length > most:
            chunk, used = chunk + 1, 0
        state[source] = chunk, used + length, any_chars or length > 0
        found[source, place] = chunk
    return found


@pytest.mark.parametrize(
    "most, lengths, n", [(20, [0, 3, 5, 9, 12], 900), (20, [0, 1, 30, 700, 15], 400), (1, [0, 1, 2], 50), (10**7, [0, 900_000, 5_000_000], 60), (50, [0, None], 9)]
)
def test_greedy_chunks_against_one_buffer(spark, most, lengths, n):
    rng = random.Random(most)
    rows = [(source, i, rng.choice(lengths)) for source in ("a", None, "b c") for i in rng.sample(range(10**6), n if source else 40)]
    df = spark.createDataFrame(rows, "source string, place long, length int").repartition(5)
    chunks = op.greedy_chunks(df.withColumn("block", F.lit("clash")), most, ["source"], ["place"], chars="length")
    assert chunks.columns == ["source", "place", "length", "block", "chunk_id"]
    assert {(r.source, r.place): r.chunk_id for r in chunks.collect()} == plain_greedy(rows, most)


def test_greedy_chunks_of_texts(spark):
    rows = [("x", 1, "🙂🙂"), ("x", 2, "ab"), ("x", 3, None), ("x", 4, "c"), ("x", 5, "🙂")]
    df = spark.createDataFrame(rows, "source string, place int, text string")
    chunks = op.greedy_chunks(df, 6, ["source"], ["place"])
    assert [r.chunk_id for r in chunks.orderBy("place").collect()] == [0, 0, 0, 1, 1]
    assert op.greedy_chunks(df.filter("false"), 6, ["source"], ["place"]).collect() == []
    with pytest.raises(ValueError):
        op.greedy_chunks(df, 0, ["source"], ["place"])


# ---- prefixes by selection -------------------------------------------------


def plain_prefix(rows, target):
    """rows (group, key, num, text) in order, each group until its bytes are reached."""
    kept, before = [], {}
    for group, key, num, text in rows:
        if before.get(group, 0) < target:
            kept.append((group, key, num, text))
        before[group] = before.get(group, 0) + (0 if text is None else len(f"{num}. {text}\n".encode()))
    return kept


KEYS = {
    "long": lambda rng: rng.choice([None, -5, 2**60, rng.randrange(1000), rng.randrange(10)]),
    "double": lambda rng: rng.choice([None, float("inf"), float("-inf"), 0.5, rng.random(), -rng.random() * 1e300, 1e300]),
    "string": lambda rng: rng.choice([None, "", "a", "same prefix " + str(rng.randrange(50)), "é🙂" * rng.randrange(3), chr(rng.randrange(65, 120))]),
    "date": lambda rng: rng.choice([None, datetime.date(1960 + rng.randrange(100), 1, 5)]),
    "boolean": lambda rng: rng.choice([None, True, False]),
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("target", [0, 1, 300, 10**6])
def test_prefix_against_a_loop(spark, kind, target):
    rng = random.Random(f"{kind}{target}")
    rows = [(rng.choice(["a", "b", None]), KEYS[kind](rng), i, rng.choice([None, "x" * rng.randrange(30)])) for i in range(300)]
    df = spark.createDataFrame(rows, f"grp string, key {kind}, num int, text string")
    ordered = [tuple(r) for r in df.orderBy("key", "num").collect()]
    found = op.take_bytes(df.repartition(4), target, ["grp"], ["key", "num"])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain_prefix(ordered, target), key=repr)
    alone = [(None, *row[1:]) for row in ordered]
    found = op.take_bytes(df.drop("grp"), target, [], ["key", "num"]).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((r[1:] for r in plain_prefix(alone, target)), key=repr)


def test_prefix_of_nan_keys(spark):
    rows = [(float(k), i, "text") for i, k in enumerate(["nan", "1", "inf", "nan", "2"])]
    df = spark.createDataFrame(rows, "key double, num int, text string")
    assert sorted(r.num for r in op.take_bytes(df, 3 * 8 + 1, [], ["key", "num"]).collect()) == [0, 1, 2, 4]
