"""Mixing sources to target weights by a curriculum that varies over time.

Every source has a schedule, its relative rate over the training time 0 to 1.
Integrated, it gives the share of the source's target that is due until a time;
inverted, it gives the time at which a document is due.  Documents are then put in
the order of these times.  All of it is DataFrame operations on narrow rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineflow.llm.words import WORD
from lineflow.workspace import materialize

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)

#: No source, and so no document, is taken more often.
MOST_PASSES = 3

#: Rates over time, (time, rate) joined by straight lines: early, steady, late.
#: Each integrates to 1, so that a source's target is its weight's share.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)

#: Rows of a source are summed in buckets of about this many.
BUCKET_ROWS = 4096


def _segments(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(start, end, rate at start, slope, integral before) of each piece, the integral being 1 at the end."""
    area = sum((b - a) * (x + y) / 2 for (a, x), (b, y) in zip(schedule, schedule[1:]))
    if area <= 0 or any(rate < 0 for _, rate in schedule) or any(b <= a for (a, _), (b, _) in zip(schedule, schedule[1:])):
        raise ValueError(f"not a schedule: {schedule}")
    pieces, before = [], 0.0
    for (a, x), (b, y) in zip(schedule, schedule[1:]):
        pieces.append((a, b, x / area, (y - x) / area / (b - a), before))
        before += (b - a) * (x + y) / 2 / area
    return pieces


def due_time(schedule: Sequence[tuple[float, float]], share: Column) -> Column:
    """The time at which ``share`` of the source's tokens are due: the integral, inverted.

    In a piece with rate r and slope k the integral grows by r·t + k·t²/2, so t is
    2·d / (r + sqrt(r² + 2·k·d)) for the part d of the share that falls into it.
    """
    time = None
    for start, end, rate, slope, before in _segments(schedule):
        part = share - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(rate * rate) + 2 * slope * part, F.lit(0.0)))
        here = F.least(F.lit(start) + F.when(part <= 0, F.lit(0.0)).otherwise(2 * part / (F.lit(rate) + root)), F.lit(end))
        time = here if time is None else F.when(part >= 0, here).otherwise(time)
    return time


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """source, source_size, target, place of each source of ``sizes`` (source, size).

    All sizes are shared by weight.  A target stops at ``most`` times its source's
    size and the excess is shared anew: in the order of cap by weight, a source is
    capped if its fair share of what the earlier ones left is no less than its cap.
    One row per source, so the windows see few rows.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("place", place).withColumns(
        {
            "weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1),
            "cap": most * F.col("source_size").cast("double"),
        }
    )
    everywhere = Window.partitionBy()
    earlier = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    weight_left = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    shared = weighed.withColumns({"left": left, "weight_left": weight_left}).withColumn(
        "capped", F.col("cap") * F.col("weight_left") <= F.col("weight") * F.col("left")
    )
    level = F.min(F.when(~F.col("capped"), F.struct("place_in_order", F.col("left") / F.col("weight_left")))).over(everywhere)
    order = F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), "place"))
    return shared.withColumn("place_in_order", order).select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level["col2"]).alias("target"),
        "place",
    )


def curriculum(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    most: int = MOST_PASSES,
    row: str | None = None,
) -> DataFrame:
    """What the mix takes of each row: doc_id, size, source_size, target, taken, passes, position.

    ``size`` counts words (null text: 0).  The documents of a source stand in the
    order of the md5 of their id.  It is passed through whole, ``passes`` times, and
    then as far as the target goes: a document is taken once more if at least half of
    it lies below the target, so what a source gives misses its target by half a
    document at most.  ``position`` is the training time, 0 to 1, at which the first
    pass takes the document, null if none does.  Rows are sorted by position over all
    partitions, nulls last.

    Null sources are a source of their own, the last.  A null id is ordered like an
    empty one.  Rows that repeat an id are all taken alike but for the last pass, and stand
    in the order of their size and text.  Sources without words have target 0.  An empty
    table gives an empty one.  ``row`` names a column that is passed on with each row.

    A source may hold any share of the rows: sums run over buckets of the md5 order,
    and then within a bucket, so no task sees a whole source.
    """
    key = F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
        F.xxhash64(F.col(f"`{text}`").cast("string")).alias("tie"),
        *([F.col(f"`{row}`").alias("row")] if row else []),
    )
    rows = materialize(rows, "sizes")
    targets = materialize(source_targets(rows, weights, most), "targets")
    digits = 1
    while 16**digits * BUCKET_ROWS < rows.count():
        digits += 1
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    buckets = buckets.select(
        F.col("source").alias("in_source"),
        F.col("bucket").alias("in_bucket"),
        F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("before_bucket"),
    )
    order = ["key", "doc_id", "size", "tie", *(["row"] if row else [])]
    within = Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in_bucket_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same_bucket = placed["source"].eqNullSafe(buckets["in_source"]) & (placed["bucket"] == buckets["in_bucket"])
    placed = placed.join(buckets, same_bucket).withColumn("before", F.col("before_bucket") + F.col("in_bucket_before"))
    targets = targets.withColumnRenamed("source", "of_source")
    placed = placed.join(targets, placed["source"].eqNullSafe(targets["of_source"]))

    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(times), F.lit(most))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    again = (2 * F.col("before") + F.col("size") <= 2 * F.col("rest")) & (F.col("whole") < most) & (F.col("size") > 0)
    share = F.when(F.col("target") > 0, F.col("before") / F.col("target")).otherwise(F.lit(0.0))
    time = None
    for k, schedule in enumerate(schedules):
        at = due_time(schedule, share)
        time = at if time is None else F.when(F.col("place") % len(schedules) == k, at).otherwise(time)
    mixed = (
        placed.withColumn("whole", whole)
        .withColumn("rest", rest)
        .withColumn("passes", (F.col("whole") + again.cast("int")).cast("int"))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("size") * F.col("passes")).alias("taken"),
            "passes",
            F.when(F.col("passes") > 0, time).alias("position"),
            "before",
            "place",
            *(["row"] if row else []),
        )
    )
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(mix: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """doc_id, pass, position of every taken copy, and row if ``mix`` has it, range-sorted by position.

    ``mix`` is what :func:`curriculum` returns.  A later pass of a document is due
    when its source has been passed through that many times more.
    """
    copies = mix.filter("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    share = ((F.col("pass") - 1) * F.col("source_size") + F.col("before")) / F.col("target")
    share = F.when(F.col("target") > 0, share).otherwise(F.lit(0.0))
    time = None
    for k, schedule in enumerate(schedules):
        at = due_time(schedule, share)
        time = at if time is None else F.when(F.col("place") % len(schedules) == k, at).otherwise(time)
    row = ["row"] if "row" in mix.columns else []
    return copies.select("doc_id", "pass", time.alias("position"), *row).orderBy("position", "doc_id", "pass", *row)


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents of the mix in training order, each as often as it is taken; columns unchanged.

    Rows without words, and those the last pass does not reach, are left out.  Rows are
    numbered in a copy of ``docs``, so that each is taken by its own passes also where
    ids are null or repeated.
    """
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    order = training_order(curriculum(numbered, doc_id, source, text, row="__row"))
    joined = numbered.join(order.toDF("__of", "__pass", "__position", "__of_row"), F.col("__row") == F.col("__of_row"))
    return joined.orderBy("__position", "__of", "__pass", "__row").select(*[f"`{c}`" for c in docs.columns])
