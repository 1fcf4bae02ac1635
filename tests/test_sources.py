import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from lineflow import plans, sinks, sources, streaming
from lineflow import operators as op
from lineflow.__main__ import main
from lineflow.functions import line_bytes, part_path
from lineflow.workspace import clear_scratch, scratch_path
from tests.test_operators import expected_order, sample, table  # noqa: F401


@pytest.fixture
def many_files(spark):
    """No merging of small partitions, so that writes give several files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def joined(folder):
    """The files of a folder joined in name order."""
    return b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{folder}/part-*")))


def rendered(rows):
    return "".join(f"{n}. {t}\n" for n, t in rows).encode()


# ---- text ------------------------------------------------------------------


def test_read_lines_splits_on_line_feed_only(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_bytes(b"\xef\xbb\xbf415. Apple\r\n30432. a\rb\n\n1. x\r\r\n2. \xff\xc3\xa9\n12. last")
    values = [r.value for r in sources.read_lines(spark, str(path)).collect()]
    assert values == ["415. Apple", "30432. a\rb", "", "1. x\r", "2. \ufffd\u00e9", "12. last"]


def test_read_lines_with_origin_keeps_file_order(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("".join(f"{i}. {name}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = sources.read_lines(spark, str(tmp_path), with_origin=True)
        assert df.select("source", "block").distinct().count() > 4
        rows = op.parse_lines(df).orderBy("source", "block", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.num, r.text) for r in rows] == [(i, n) for n in "ab" for i in range(3000)]


def test_lines_in_utf16(spark, tmp_path):
    for order in ("LE", "BE"):
        path = tmp_path / f"{order}.txt"
        path.write_bytes("\ufeff415. Äpfel\r\n2. 漢🙂\n3. last".encode(f"utf-16-{order.lower()}"))
        lines = sources.read_lines(spark, str(path), encoding=f"UTF-16{order}")
        assert sorted(r.value for r in lines.collect()) == ["2. 漢🙂", "3. last", "415. Äpfel"]
    with pytest.raises(ValueError):
        sources.read_lines(spark, str(path), encoding="UTF-16")


def test_sort_file(spark, tmp_path, sample, many_files):
    source = tmp_path / "in.txt"
    source.write_bytes(b"garbage\n" + b"".join(f"{n:+d}.?{t}\r\n".encode() for n, t in sample) + b"9.")
    plans.sort_file(spark, str(source), str(tmp_path / "out"))
    assert len(glob.glob(f"{tmp_path}/out/part-*")) > 1
    assert joined(tmp_path / "out") == rendered(expected_order(sample))
    plans.sort_file(spark, str(tmp_path / "out"), str(tmp_path / "again"))
    assert joined(tmp_path / "again") == joined(tmp_path / "out")


def test_write_single(spark, tmp_path, table, sample, many_files):
    sinks.write_single(table, str(tmp_path / "one"))
    assert len(glob.glob(f"{tmp_path}/one/part-*")) == 1
    assert joined(tmp_path / "one") == rendered(expected_order(sample))
    with pytest.raises(ValueError):
        sinks.write_single(table, str(tmp_path / "two"), limit="1KB")


def test_parts_round_trip(spark, tmp_path, table):
    parted = table.withColumn("part_id", F.abs("num") % 4).filter("part_id != 2")
    for gather in (False, True):
        path = str(tmp_path / f"parts-{gather}")
        sinks.write_parts(parted, path, gather=gather)
        back = sources.read_parts(spark, path + "/part_id={0}", 5)
        assert sorted(r[0] for r in back.select("part_id").distinct().collect()) == [0, 1, 3]
        records = op.parse_lines(back).select("num", "text", "part_id")
        assert records.exceptAll(parted).count() == 0 and parted.exceptAll(records).count() == 0


def test_more_parts_than_open_files(spark, tmp_path):
    parted = spark.range(0, 3000, 1, 2).select(
        F.col("id").cast("int").alias("num"), F.lit("x").alias("text"), (F.col("id") % 100).cast("int").alias("part_id")
    )
    sinks.write_parts(parted, str(tmp_path / "parts"))
    back = op.parse_lines(sources.read_parts(spark, f"{tmp_path}/parts/part_id={{0}}", 100))
    assert back.count() == 3000 and back.filter("num % 100 != part_id").count() == 0
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_read_part_files_by_pattern(spark, tmp_path):
    pattern = f"{tmp_path}/big part-{{0}}.tmp"
    for i in (0, 2, 11):
        with open(part_path(pattern, i), "w") as f:
            f.write(f"{i}. x\n")
    rows = sources.read_parts(spark, pattern, 12).collect()
    assert sorted((r.part_id, r.value) for r in rows) == [(0, "0. x"), (2, "2. x"), (11, "11. x")]
    assert sources.read_parts(spark, str(tmp_path / "none-{0}"), 2).count() == 0


# ---- runs ------------------------------------------------------------------


def run_rows(spark, path):
    """Rows of each file, in file order."""
    rows = {}
    for file in glob.glob(f"{path}/**/part-*.parquet", recursive=True):
        if "/_commits/" not in file:
            rows[file] = [(r.num, r.text) for r in spark.read.parquet(file).collect()]
    return rows


def test_runs_and_merges(spark, tmp_path, table, sample, many_files):
    runs, grouped, merged = (str(tmp_path / n) for n in ("runs", "grouped", "merged"))
    sinks.write_runs(table, runs)
    files = run_rows(spark, runs)
    assert len(files) == 5
    assert all(rows == expected_order(rows) for rows in files.values())

    plans.merge_in_groups(spark, runs, grouped, degree=2)
    assert sorted(os.listdir(grouped))[-3:] == ["group_id=0", "group_id=1", "group_id=2"]
    names = sorted(files)
    for group in range(3):
        members = [row for name in names[2 * group : 2 * group + 2] for row in files[name]]
        pieces = run_rows(spark, f"{grouped}/group_id={group}")
        assert [row for name in sorted(pieces) for row in pieces[name]] == expected_order(members)

    for path in (runs, grouped):
        plans.merge_runs(spark, path, merged)
        assert joined(merged) == rendered(expected_order(sample))


def test_chunk_size_bounds_runs(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("".join(f"{i}. {'x' * 100}\n" for i in range(30000)))
    plans.write_sorted_runs(spark, str(source), str(tmp_path / "runs"), plans.SortOptions(chunk_size_mb=1))
    assert len(run_rows(spark, str(tmp_path / "runs"))) >= 3
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 30000
    with pytest.raises(ValueError):
        plans.SortOptions(degree=0)


def test_text_runs_keep_malformed_lines(spark, tmp_path):
    for name, text in (("a", "3. a\rb\nbad\n"), ("b", "5.\n1. AB\n")):
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    runs = sources.read_runs(spark, str(tmp_path), "text")
    assert runs.select("run_id").distinct().count() == 2
    plans.merge_runs(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/b.txt"], str(tmp_path / "out"), "text")
    assert joined(tmp_path / "out") == b"bad\n5.\n1. AB\n3. ab\n"


# ---- words and generator ---------------------------------------------------

WORD_DOCUMENTS = {
    '["Apple", "Two words"]': ["Apple", "Two words"],
    ' [ "\\u00e9" ]\n': ["\u00e9"],
    "[]": [],
    "null": [],
    "": ["Apple", "Banana", "Cherry"],
    "no json": ["Apple", "Banana", "Cherry"],
    '["a", 1]': ["Apple", "Banana", "Cherry"],
    "[1, 2]": ["Apple", "Banana", "Cherry"],
    '{"a": "b"}': ["Apple", "Banana", "Cherry"],
    '["a"] tail': ["Apple", "Banana", "Cherry"],
    '["a"': ["Apple", "Banana", "Cherry"],
    '"a"': ["Apple", "Banana", "Cherry"],
}


def test_word_array(lines):
    got = lines(*WORD_DOCUMENTS).select("value", sources.word_array("value")).collect()
    assert {r[0]: r[1] for r in got} == WORD_DOCUMENTS


@pytest.mark.parametrize(
    "document, words",
    [
        ('["x","y"]', ["x", "y"]),
        ('\ufeff["x","y"]', ["x", "y"]),
        ("[]", []),
        (" null ", []),
        ('["a\\"b","c\\\\","\\u00e9,]\\n", "" ]', ['a"b', "c\\", "é,]\n", ""]),
        ('["a",null, null,"b"]', ["a", None, None, "b"]),
        ("[null]", [None]),
        ('[1,"a"]', None),
        ('["a",]', None),
        ('["a" "b"]', None),
        ('["a"', None),
        ("", None),
        ('{"a":"b"}', None),
        ('["a"] x', None),
        ('"a"', None),
        ('["a\nb"]', None),
    ],
)
def test_word_files(spark, tmp_path, document, words):
    path = tmp_path / "words.json"
    path.write_text(document, encoding="utf-8")
    found = [r.word for r in sources.read_words(spark, str(path)).orderBy("seq").collect()]
    assert found == (list(sources.FALLBACK_WORDS) if words is None else words)


def test_a_large_word_file_is_read_whole_by_many_tasks(spark, tmp_path):
    """140 MB, more than one JSON value may have in Spark, with quotes at the borders of pieces."""
    words = [("w" * 999 + '\\",') * (i % 3 + 2) + str(i) for i in range(47_000)]
    path = tmp_path / "words.json"
    path.write_text(json.dumps(words))
    assert path.stat().st_size > 140_000_000
    found = sources.read_words(spark, str(path))
    assert found.count() == len(words)
    digest = lambda column: F.sum(F.xxhash64(column, "seq") % 1_000_003)
    some = found.filter("seq % 997 = 0").orderBy("seq").collect()
    assert [r.word for r in some] == words[::997] and found.agg(digest("word")).first()[0] is not None


def test_read_words(spark, tmp_path):
    path = tmp_path / "words.json"
    path.write_text('[\n  "Apple",\n  "Orange"\n]')
    words = sources.read_words(spark, str(path))
    assert [(r.seq, r.word) for r in words.collect()] == [(0, "Apple"), (1, "Orange")]
    assert sources.word_count(sources.read_words(spark, str(tmp_path / "none.json"))) == 3


WORDS = ["Apple", "Banana", "Cherry", "Orange", "Something something something", "\u00e9t\u00e9", "x", "y"]


@pytest.mark.parametrize("workers,size", [(4, 200_000), (3, 2_500), (7, 40)])
def test_generated_sizes(spark, workers, size):
    options = sources.GeneratorOptions(size, workers, 2, 15, 1000, seed=3)
    rows = sources.generate_lines(spark, WORDS, options).withColumn("bytes", line_bytes("num", "text")).collect()
    per_worker = {}
    for r in rows:
        per_worker.setdefault(r.worker, []).append(r)
    assert sorted(per_worker) == list(range(workers))
    for worker, mine in per_worker.items():
        mine.sort(key=lambda r: r.seq)
        assert [r.seq for r in mine] == list(range(len(mine)))
        assert all(r.part_id == worker % 2 and 1 <= r.num <= 1000 and r.text in WORDS for r in mine)
        total = sum(r.bytes for r in mine)
        assert total - mine[-1].bytes < size // workers <= total


def test_sizes_with_very_uneven_words(spark):
    # Few lines are long, so the first estimate of the number of lines is too low.
    words = ["x"] * 999 + ["y" * 200_000]
    options = sources.GeneratorOptions("40KB", 2, 2, 0, 9)
    rows = sources.generate_lines(spark, words, options).withColumn("bytes", line_bytes("num", "text"))
    for r in rows.groupBy("worker").agg(F.sum("bytes").alias("all"), F.max_by("bytes", "seq").alias("last")).collect():
        assert r["all"] - r["last"] < 20 * 1024 <= r["all"]


def test_generator_is_reproducible_and_seeded(spark):
    def rows(parallelism, seed):
        spark.conf.set("spark.sql.shuffle.partitions", parallelism)
        options = sources.GeneratorOptions("20KB", 3, 2, seed=seed)
        return sorted(sources.generate_lines(spark, WORDS, options).collect())

    try:
        assert rows(3, 1) == rows(8, 1) != rows(8, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_duplicates_come_from_a_quarter_of_the_words(spark):
    def texts(percent):
        options = sources.GeneratorOptions("30KB", 2, 2, percent)
        counts = sources.generate_lines(spark, WORDS, options).groupBy("text").agg(F.count("*").alias("n"))
        return {r.text: r.n for r in counts.collect()}

    assert len(texts(100)) == 2
    spread = texts(0)
    assert len(spread) == 8 and max(spread.values()) < 2 * min(spread.values())


def test_shares_are_spread_to_the_byte(spark):
    lines = sources.generate_lines(spark, WORDS, sources.GeneratorOptions("10B", 32, 4))
    assert sorted(r.worker for r in lines.collect()) == list(range(10))
    assert sources.generate_lines(spark, WORDS, sources.GeneratorOptions("0B", 4, 4)).count() == 0


def test_generated_lines_need_no_shuffle(spark):
    df = sources.generate_lines(spark, WORDS, sources.GeneratorOptions("10KB", 2, 2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 2


@pytest.mark.parametrize(
    "bad", [{"target_size": "x"}, {"target_size": "-5KB"}, {"duplicate_percentage": 101}, {"max_number": 0}, {"partition_count": 0}, {"worker_count": 0}]
)
def test_generator_options_are_checked(bad):
    with pytest.raises(ValueError):
        sources.GeneratorOptions(**bad)


def test_bad_word_lists(spark):
    for words in ([], ["a", None]):
        with pytest.raises(ValueError):
            sources.generate_lines(spark, words, sources.GeneratorOptions("1KB", 1, 1))


def test_generate_and_sort_file(spark, tmp_path):
    words = tmp_path / "words.json"
    words.write_text('["pear", "Apple", "_"]')
    options = sources.GeneratorOptions("50KB", 4, 3, 15, 1000)
    generated = plans.generate_file(spark, str(tmp_path / "parts"), str(words), options)
    expected = [(r.num, r.text) for r in generated.collect()]
    back = sources.read_parts(spark, f"{tmp_path}/parts/part_id={{0}}", 3)
    assert back.count() == len(expected)
    plans.sort_file(spark, f"{tmp_path}/parts", str(tmp_path / "sorted"))
    assert joined(tmp_path / "sorted") == rendered(expected_order(expected))


def test_command_line(spark, tmp_path):
    parts, runs, grouped, merged, output = (f"{tmp_path}/{n}" for n in ("parts", "runs", "grouped", "merged", "sorted"))
    (tmp_path / "w.json").write_text('["pear", "Apple"]')
    size = ["--target-size", "20KB", "--worker-count", "4", "--partition-count", "2", "--seed", "5"]
    main(["generate", parts, "--words", f"{tmp_path}/w.json", *size])
    main(["sort", f"{parts}/part_id=0", f"{parts}/part_id=1", output])
    main(["runs", parts, runs, "--chunk-size-mb", "1"])
    main(["merge", runs, grouped, "--degree", "2"])
    main(["merge", grouped, merged])
    assert len(joined(output)) > 20 * 2**10 and joined(output) == joined(merged)
    with pytest.raises(ValueError):
        main(["generate", parts, "--target-size", "many"])


# ---- streaming -------------------------------------------------------------


def test_stream_runs(spark, tmp_path, sample):
    arriving, runs, checkpoint = (str(tmp_path / n) for n in ("in", "runs", "checkpoint"))
    os.makedirs(arriving)
    expected = []

    def arrive(name, rows):
        expected.extend(rows)
        with open(f"{arriving}/{name}.txt", "wb") as f:
            f.write(rendered(rows) + b"not a line\r\n")

    def drain():
        query = streaming.stream_runs(streaming.stream_lines(spark, arriving, max_files=1), runs, checkpoint)
        query.awaitTermination()

    arrive("a", sample[:100])
    arrive("b", sample[100:150])
    drain()
    assert sorted(name[-2:] for name in os.listdir(runs) if name.startswith("run=")) == ["-0", "-1"]
    drain()
    arrive("c", sample[150:300])
    drain()
    files = run_rows(spark, runs)
    assert all(rows == expected_order(rows) for rows in files.values())
    assert streaming.read_stream_runs(spark, runs).select("run").distinct().count() == 3
    streaming.compact_runs(spark, runs, str(tmp_path / "out"))
    assert joined(tmp_path / "out") == rendered(expected_order(expected))


def lines_and_rejects(spark, runs, bad):
    kept = sorted((r.num, r.text) for r in streaming.read_stream_runs(spark, runs).collect())
    return kept, sorted((r.value, r.reason) for r in streaming.read_stream_rejects(spark, runs, bad).collect())


def test_streams_with_checkpoints_of_their_own_share_a_folder(spark, tmp_path):
    runs, bad = str(tmp_path / "runs"), str(tmp_path / "bad")
    assert lines_and_rejects(spark, runs, bad) == ([], [])
    for name in "ab":
        os.makedirs(tmp_path / name)
        (tmp_path / name / "in.txt").write_text(f"2. {name}\n1. {name}\nbad {name}\n")
        lines = streaming.stream_lines(spark, str(tmp_path / name), parse=False)
        streaming.stream_runs(lines, runs, str(tmp_path / f"check-{name}"), rejected=bad).awaitTermination()
    kept = [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert lines_and_rejects(spark, runs, bad) == (kept, [("bad a", "no_dot"), ("bad b", "no_dot")])
    entries = streaming.committed_batches(spark, runs).collect()
    assert sorted((e.batch, e.lines, e.bytes, e.rejected) for e in entries) == [(0, 2, 10, 1)] * 2
    assert len({e.query for e in entries}) == 2


@pytest.mark.parametrize("entry", ["written", "missing"])
def test_a_replayed_batch_adds_nothing(spark, tmp_path, entry):
    """The checkpoint forgets that the batch was done; its entry may be there or not."""
    runs, bad, checkpoint = (str(tmp_path / n) for n in ("runs", "bad", "check"))
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "in.txt").write_text("2. x\n1. x\nbad\n")
    for _ in range(2):
        lines = streaming.stream_lines(spark, str(tmp_path / "in"), parse=False)
        streaming.stream_runs(lines, runs, checkpoint, rejected=bad).awaitTermination()
        assert lines_and_rejects(spark, runs, bad) == ([(1, "x"), (2, "x")], [("bad", "no_dot")])
        os.remove(f"{checkpoint}/commits/0")
        for crc in glob.glob(f"{checkpoint}/commits/.*"):
            os.remove(crc)
        if entry == "missing":
            os.rename(f"{runs}/_commits", str(tmp_path / f"forgotten-{len(os.listdir(tmp_path))}"))
            assert lines_and_rejects(spark, runs, bad) == ([], [])


def test_a_batch_without_lines(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "in.txt").write_text("no line\n")
    runs = str(tmp_path / "runs")
    streaming.stream_runs(streaming.stream_lines(spark, str(tmp_path / "in")), runs, str(tmp_path / "check")).awaitTermination()
    assert streaming.read_stream_runs(spark, runs).collect() == []
    assert [(e.lines, e.bytes) for e in streaming.committed_batches(spark, runs).collect()] == [(0, 0)]


def test_stream_with_interval(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.txt").write_text("2. b\n1. a\n")
    records = streaming.stream_lines(spark, str(tmp_path / "in"))
    query = streaming.stream_runs(records, str(tmp_path / "runs"), str(tmp_path / "checkpoint"), "1 second")
    query.processAllAvailable()
    query.stop()
    assert sorted((r.num, r.text) for r in streaming.read_stream_runs(spark, str(tmp_path / "runs")).collect()) == [
        (1, "a"), (2, "b"),
    ]


def test_tables_of_one_query_are_released(spark, table):
    from lineflow.workspace import release

    one, other = op.line_positions(table), op.line_positions(table)
    assert one.count() == other.count()
    release(one)
    spark.catalog.clearCache()
    assert not any(os.path.exists(f.removeprefix("file:")) for f in one.inputFiles())
    assert all(os.path.exists(f.removeprefix("file:")) for f in other.inputFiles())


def test_scratch(spark, tmp_path):
    path = scratch_path(spark, "t")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    clear_scratch(spark)
    assert not os.path.exists(path)
