import pytest
from pyspark.sql import functions as F

from lineflow.llm import mixing
from tests.llm.cases import WORDS


def targets_by_rounds(sizes, weights=(1, 2, 3), most=3):
    """The excess is shared again until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize(
    "shape", [{"a": 400, "b": 30, "c": 5}, {"a": 10, "b": 900, "Z": 3, None: 40}, {"x": 100}, {"a": 1, "b": 1, "c": 800}]
)
def test_targets_and_taken(spark, shape):
    rows, doc = [], 0
    for name, n in shape.items():
        for i in range(n):
            rows.append((doc, name, " ".join(["w"] * (1 + (i * 7) % 23))))
            doc += 1
    sizes = {}
    for _, name, text in rows:
        sizes[name] = sizes.get(name, 0) + len(WORDS.findall(text))
    wanted = targets_by_rounds(sizes)
    mix = mixing.curriculum(table(spark, rows)).join(table(spark, rows).select("doc_id", "source"), "doc_id")
    found = mix.collect()
    assert len(found) == len(rows)
    for name, target in wanted.items():
        own = [r for r in found if r.source == name]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == sizes[name] for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 12
    assert all(r.taken <= 3 * r.size for r in found)


def test_odd_rows_and_reruns(odd):
    first = mixing.curriculum(odd).collect()
    assert len(first) == odd.count()
    assert first == mixing.curriculum(odd.repartition(5)).collect()
    assert {r.taken for r in first if r.size == 0} == {0}
    places = [r.position for r in first if r.position is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)


def test_empty_table_and_tables_without_words(empty, docs):
    assert mixing.curriculum(empty).collect() == []
    assert [r.taken for r in mixing.curriculum(docs((1, None), (2, ""))).collect()] == [0, 0]


def test_due_time_inverts_the_schedule(spark):
    schedule = ((0.0, 2.0), (0.25, 0.0), (1.0, 4.0))
    pieces = mixing._segments(schedule)
    shares = spark.range(101).select((F.col("id") / 100).alias("share"))
    for row in shares.withColumn("time", mixing.due_time(schedule, F.col("share"))).collect():
        start, end, rate, slope, before = next(p for p in reversed(pieces) if row.time >= p[0] - 1e-12)
        t = row.time - start
        assert before + rate * t + slope * t * t / 2 == pytest.approx(row.share, abs=1e-9)


def test_bad_schedules_are_refused():
    for schedule in [((0.0, 0.0), (1.0, 0.0)), ((0.0, 1.0), (0.0, 2.0)), ((0.0, -1.0), (1.0, 2.0))]:
        with pytest.raises(ValueError):
            mixing._segments(schedule)


def test_an_early_source_comes_before_a_late_one(spark):
    rows = [(i, "abc"[i % 3], "one two three") for i in range(3000)]
    found = mixing.training_order(mixing.curriculum(table(spark, rows))).collect()
    mean = {k: [r.position for r in found if r.doc_id % 3 == k] for k in range(3)}
    means = [sum(v) / len(v) for v in mean.values()]
    assert means[0] < means[1] < means[2]
    assert [r.position for r in found] == sorted(r.position for r in found)


def test_documents_come_as_often_as_they_are_taken(spark):
    rows = [(i, "ab"[i < 20], "one two") for i in range(400)]
    source = table(spark, rows)
    mixed = mixing.mix_documents(source)
    assert mixed.columns == source.columns
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert times == {r.doc_id: r.passes for r in mixing.curriculum(source).collect() if r.passes}


def test_small_buckets_give_the_same(odd, monkeypatch):
    whole = mixing.curriculum(odd).collect()
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    assert mixing.curriculum(odd).collect() == whole


def test_null_and_repeated_ids_come_as_often_as_they_are_taken(spark):
    """Three sources; ids null, repeated with other texts, and rows repeated whole."""
    rows = [(None, "abc"[i % 3], f"null {i} " + "w " * (i % 5)) for i in range(60)]
    rows += [(7, "a", f"seven {i}") for i in range(30)] + [(8, "b", "the same words")] * 20
    rows += [(100 + i, "c", f"c {i} has more words than the others") for i in range(80)]
    source = table(spark, rows)
    mix = mixing.curriculum(source).collect()
    found = mixing.mix_documents(source).collect()
    assert len(found) == sum(r.passes for r in mix) > 0
    taken, size = {}, lambda text: len(WORDS.findall(text))
    for r in mix:
        taken[r.doc_id, r["size"]] = taken.get((r.doc_id, r["size"]), 0) + r.passes
    came, times = {}, {}
    for r in found:
        came[r.doc_id, size(r.text)] = came.get((r.doc_id, size(r.text)), 0) + 1
        times[tuple(r)] = times.get(tuple(r), 0) + 1
    assert came == {k: n for k, n in taken.items() if n}
    assert all(n <= 3 * rows.count(row) for row, n in times.items())
