import random

import pytest
from pyspark.sql import functions as F

import lineflow as lf
from lineflow.plans import store as st


def key(row):
    """Order of lines: these texts are plain letters."""
    return row[1].upper(), row[0], row[1]


def some_rows(seed, n, letters="abcdefgh"):
    rng = random.Random(seed)
    return [(rng.randrange(20), "".join(rng.choice(letters + letters.upper()) for _ in range(rng.choice([1, 2, 5])))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "num int, text string").repartition(3)


@pytest.fixture
def files_of_40(spark):
    """Small partitions stay, so every change writes several files."""
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], "5")
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def listed(spark, path):
    files = st.store_files(spark, path).orderBy("place").collect()
    assert [f.place for f in files] == list(range(len(files)))
    assert [f.before for f in files] == [sum(g.lines for g in files[:i]) for i in range(len(files))]
    assert all(a.greatest <= b.least for a, b in zip(files, files[1:]))
    return files


def check(spark, path, rows):
    wanted = [(i + 1, *row) for i, row in enumerate(sorted(rows, key=key))]
    assert sorted(map(tuple, lf.read_store(spark, path).collect())) == wanted
    return wanted


def test_additions_keep_the_order(spark, tmp_path, files_of_40):
    path, rows = str(tmp_path / "store"), []
    assert lf.read_store(spark, path).collect() == [] and not lf.add_to_store(table(spark, some_rows(0, 0)), path)
    for seed, n in [(1, 200), (2, 1), (3, 150), (4, 30)]:
        more = some_rows(seed, n)
        rows += more
        assert lf.add_to_store(table(spark, more), path)
        check(spark, path, rows)
        listed(spark, path)
    assert not lf.add_to_store(table(spark, some_rows(0, 0)), path)
    # A third of all lines are one line; they may fill several files.
    rows += [(7, "ccc")] * 150
    lf.add_to_store(table(spark, [(7, "ccc")] * 150), path)
    lf.add_to_store(table(spark, [(7, "ccc"), (0, "A"), (99, "zz")]), path)
    check(spark, path, rows + [(7, "ccc"), (0, "A"), (99, "zz")])


def test_untouched_files_keep_their_names(spark, tmp_path, files_of_40):
    path = str(tmp_path / "store")
    lf.add_to_store(table(spark, some_rows(1, 400)), path)
    before = listed(spark, path)
    inside = before[2].least
    lf.add_to_store(table(spark, [(inside.num, inside.text)]), path)
    after = listed(spark, path)
    gone = {f.file for f in before} - {f.file for f in after}
    assert gone == {before[2].file} and len(before) >= 4
    assert all(f.file.startswith("gen=1/") for f in after if f.file not in {b.file for b in before})


def test_a_failed_change_does_not_count(spark, tmp_path):
    path, rows = str(tmp_path / "store"), some_rows(1, 50)
    lf.add_to_store(table(spark, rows), path)
    for folder in ("gen=1/at=0", "_manifest/gen=1"):  # written, but without the mark of a whole write
        (tmp_path / "store" / folder).mkdir(parents=True)
    check(spark, path, rows)
    lf.add_to_store(table(spark, [(1, "x")]), path)
    check(spark, path, rows + [(1, "x")])


def test_runs_are_taken_once(spark, tmp_path):
    arriving, runs, path = (str(tmp_path / n) for n in ("in", "runs", "store"))
    rows = []
    assert not lf.add_runs(spark, runs, path)
    for seed in (1, 2):
        rows += some_rows(seed, 60)
        lf.append_text(lf.render_lines(table(spark, some_rows(seed, 60))), arriving)
        lf.stream_runs(lf.stream_lines(spark, arriving), runs, str(tmp_path / "check")).awaitTermination()
        assert lf.add_runs(spark, runs, path)
        assert not lf.add_runs(spark, runs, path)
        check(spark, path, rows)


def test_lookups(spark, tmp_path, files_of_40):
    path, rows = str(tmp_path / "store"), some_rows(5, 500)
    lf.add_to_store(table(spark, rows), path)
    lf.add_to_store(table(spark, rows[:40]), path)
    placed = check(spark, path, rows + rows[:40])
    for first, last in [(1, 1), (100, 180), (530, 10**6), (0, 0), (9, 8)]:
        found = lf.lines_between(spark, path, first, last)
        assert sorted(map(tuple, found.collect())) == placed[max(first, 1) - 1 : last if last >= first else 0]
    few = lf.lines_between(spark, path, 100, 110)
    assert 0 < sum("_manifest" not in f for f in few.inputFiles()) <= 3 < len(listed(spark, path))
    for low, high in [("b", "D"), (None, "aaa"), ("FF", None), ("x", "y"), (None, None)]:
        found = sorted(map(tuple, lf.texts_between(spark, path, low, high).collect()))
        assert found == [r for r in placed if (low is None or r[2].upper() >= low.upper()) and (high is None or r[2].upper() <= high.upper())]
    found = sorted(map(tuple, lf.texts_equal(spark, path, ["A", "hG", "none"]).collect()))
    assert found == [r for r in placed if r[2].upper() in ("A", "HG")]
    asked = some_rows(6, 40) + rows[:10] + [(5, "zzz"), (-1, "")]
    ranks = sorted(map(tuple, lf.rank_lines(table(spark, asked), path).collect()))
    assert ranks == sorted((n, t, 1 + sum(key(r[1:]) < key((n, t)) for r in placed)) for n, t in asked)


def test_lookups_are_pushed_to_the_files(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(0, 1000, 1, 4).select(F.col("id").cast("int").alias("num"), F.concat(F.lit("t"), "id").alias("text"))
    lf.add_to_store(rows, path)
    shape = lf.texts_between(spark, path, "t5", "t6")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,T5)" in shape and "LessThanOrEqual(key,T6)" in shape
    assert "In(key, [T5,T6])" in lf.texts_equal(spark, path, ["t5", "T6"])._jdf.queryExecution().executedPlan().toString()
