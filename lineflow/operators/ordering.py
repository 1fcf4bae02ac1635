"""Total order at scale: sorting, positions and totals of earlier rows.

Everything here rests on one shuffle, a range partitioning on *all* sort keys
plus the place of the row in the input.  The last one splits copies of one row
over several partitions, so a group of equal rows of any size cannot end up in
one task.

The place must be the same when a task runs again.  Rows read from files have it;
rows that come out of a shuffle may arrive in another order, so these are written to
the shared folder first.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineflow.workspace import materialize

_SALT = "__salt"
_PARTITION = "__partition"
_ORDINAL = "__ordinal"

# Rows next to each other in the input share a salt.  1,024 copies stay together,
# 130 MB of the longest lines; the salt still compresses to nothing in the shuffle.
_SALT_BITS = 10

# monotonically_increasing_id() holds the partition above this bit and the row
# number within the partition below it.
_ORDINAL_BITS = 33


def range_sort(df: DataFrame, *by: Column | str) -> DataFrame:
    """Sort ``df`` over all partitions: partition 0 first, ascending, NULLs first.

    Keys given as expressions are computed on either side of the shuffle and not
    sent through it; after it each is a plain column, so that comparing two rows
    does not compute it again.  Input that holds a shuffle is written first, by a job
    at the time of the call.
    """
    df = stable_order(df)
    salt = F.shiftright(F.monotonically_increasing_id(), _SALT_BITS)
    spread = df.withColumn(_SALT, salt).repartitionByRange(*by, _SALT).drop(_SALT)
    return sort_partitions(spread, *by)


def stable_order(df: DataFrame) -> DataFrame:
    """``df``, read from a table if its rows could come in another order when a task runs again."""
    return materialize(df, "sort-input") if _order_may_change(df) else df


# Steps of a plan that give their rows in the order of what they read, whenever they run.
_STEADY = re.compile(
    r"AdaptiveSparkPlan|WholeStageCodegen|InputAdapter|ColumnarToRow|Project|Filter|Generate|Union|Range\b|LocalTableScan|"
    r"Scan (?!ExistingRDD)|FileScan|MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython|CollectMetrics|Sort\b|"
    r"BroadcastHashJoin|BroadcastNestedLoopJoin|Expand|EmptyRelation|=="
)


def _order_may_change(df: DataFrame) -> bool:
    """True unless every step of the plan is known to repeat its rows in the same order.

    What is broadcast need not: it is looked up, not passed on.
    """
    hidden = None
    for place, line in enumerate(df._jdf.queryExecution().executedPlan().toString().split("\n")):
        shape = re.match(r"^((?:[ :]*[+:]- )?)(?:\*\(\d+\) )?(\S.*)$", line)
        if shape is None or (place and not shape[1]):  # a text in the step before holds a line feed
            continue
        depth, step = len(shape[1]), shape[2]
        if hidden is not None and depth > hidden:
            continue
        hidden = None
        if step.startswith(("BroadcastExchange", "BroadcastQueryStage", "ReusedExchange", "Subquery")):
            hidden = depth
        elif not _STEADY.match(step):
            return True
    return False


def sort_partitions(df: DataFrame, *by: Column | str) -> DataFrame:
    """Sort inside each partition only; no shuffle."""
    computed = {f"__key{i}": key for i, key in enumerate(by) if not isinstance(key, str)}
    names = [key if isinstance(key, str) else f"__key{i}" for i, key in enumerate(by)]
    return df.withColumns(computed).sortWithinPartitions(*names).drop(*computed)


def with_positions(df: DataFrame, *by: Column | str, name: str = "position") -> DataFrame:
    """Add the 1-based position each row has in the order ``by``.

    The sorted rows are written once; the count per partition comes from the
    narrow id column alone.  There is one offset per partition, so that side of
    the join is bounded by the number of shuffle partitions.
    """
    ordinal = F.col(_ORDINAL)
    numbered = range_sort(df, *by).withColumn(_ORDINAL, F.monotonically_increasing_id())
    table = materialize(numbered, "positions").withColumn(_PARTITION, F.shiftright(ordinal, _ORDINAL_BITS))
    before = Window.orderBy(_PARTITION).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        table.groupBy(_PARTITION)
        .agg(F.count("*").alias("__rows"))
        .select(_PARTITION, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    )
    within = ordinal.bitwiseAND(F.lit((1 << _ORDINAL_BITS) - 1))
    return (
        table.join(F.broadcast(offsets), _PARTITION)
        .withColumn(name, F.col("__offset") + within + 1)
        .drop(_PARTITION, _ORDINAL, "__offset")
    )


def totals_before(
    df: DataFrame,
    groups: Sequence[str],
    by: Sequence[Column | str],
    amount: Column | str | int,
    name: str = "before",
    below: int | None = None,
) -> DataFrame:
    """Add the total ``amount`` of all earlier rows of the same group in the order ``by``.

    A window over ``groups`` would put a whole group into one task.  Here the
    rows are range-sorted by group and order, so a large group covers many
    partitions; each partition adds up its own rows while streaming through them,
    and the totals of earlier partitions are joined back.  Only the first group of
    a partition can have begun earlier, so there is at most one carried total per
    partition and that side of the join is bounded by the number of partitions.

    ``amount`` is a column or 1 for a row number.  It must not be negative; NULL adds
    nothing.  NaN is equal to itself as a group.

    With ``below`` only rows whose total is below it are returned.  A row that
    reaches it within its own partition is dropped at once, so little is written
    where little is kept.  What a partition then carries over is too small only if
    it is no less than ``below``, which drops all later rows of the group as well.
    """
    amount = F.lit(amount) if isinstance(amount, int) else amount
    amount = F.col(amount) if isinstance(amount, str) else amount
    ordered = range_sort(df, *groups, *by)
    ordered = ordered.withColumns({"__amount": F.coalesce(amount.cast("bigint"), F.lit(0).cast("bigint")), _PARTITION: F.spark_partition_id()})
    fields = [*ordered.schema.fields, T.StructField(name, T.LongType(), False)]
    summed = ordered.mapInArrow(_partition_totals(list(groups), name, below), T.StructType(fields))
    table = materialize(summed, "totals")

    earlier = Window.partitionBy(*groups).orderBy(_PARTITION).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        table.groupBy(_PARTITION, *groups)
        .agg(F.sum("__amount").alias("__total"))
        .select(_PARTITION, *groups, F.sum("__total").over(earlier).alias("__carried"))
        .filter(F.col("__carried") > 0)
        .select(F.col(_PARTITION).alias("__in"), *[F.col(g).alias(f"__group{i}") for i, g in enumerate(groups)], "__carried")
    )
    same = F.col(_PARTITION) == F.col("__in")
    for i, group in enumerate(groups):
        same = same & F.col(group).eqNullSafe(F.col(f"__group{i}"))
    joined = table.join(F.broadcast(carried), same, "left")
    total = F.col(name) + F.coalesce("__carried", F.lit(0))
    totals = joined.select(*df.columns, total.alias(name))
    return totals if below is None else totals.filter(F.col(name) < below)


def _partition_totals(groups: list[str], name: str, below: int | None):
    """Arrow function: total of earlier ``__amount``, restarting where a group does.

    Nested so that executors need not have this package installed.
    """

    def _comparable(value):
        return "NaN" if isinstance(value, float) and value != value else value

    def add_totals(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        last, total = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = [batch.column(g) for g in groups]
            starts = np.zeros(batch.num_rows, dtype=bool)
            for key in keys:
                here, there = key.slice(1), key.slice(0, len(key) - 1)
                differs = pc.fill_null(pc.not_equal(here, there), False)
                if pa.types.is_floating(key.type):  # NaN is a group of its own
                    nans = pc.and_(pc.is_nan(here), pc.is_nan(there))
                    differs = pc.and_(differs, pc.invert(pc.fill_null(nans, False)))
                nulls = pc.not_equal(pc.is_null(here), pc.is_null(there))
                starts[1:] |= pc.or_(differs, nulls).to_numpy(zero_copy_only=False)
            first = [_comparable(key[0].as_py()) for key in keys]
            if first != last:
                total = 0
            amounts = batch.column("__amount").to_numpy(zero_copy_only=False)
            sums = np.cumsum(amounts) + total
            firsts = np.flatnonzero(starts)
            if len(firsts):
                lengths = np.diff(np.append(firsts, batch.num_rows))
                sums[firsts[0]:] -= np.repeat(sums[firsts - 1], lengths)
            last, total = [_comparable(key[-1].as_py()) for key in keys], int(sums[-1])
            before = sums - amounts
            columns = [*batch.columns, pa.array(before, pa.int64())]
            result = pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, name])
            yield result if below is None else result.filter(pa.array(before < below))

    return add_totals
