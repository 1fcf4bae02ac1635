"""Size-bounded prefixes and statistics per part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineflow.functions.parsing import line_bytes
from lineflow.operators.ordering import stable_order, totals_before
from lineflow.operators.parse import NUM, TEXT
from lineflow.workspace import materialize


# Coarse ranges of the first key in which bytes are added up.
_RANGES = 4_096


def take_bytes(df: DataFrame, target: int, groups: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first lines of each group, in ``order``, until ``target`` bytes are reached.

    A line is kept while the bytes before it are fewer than ``target``; the last
    one may overshoot.  A line with a NULL has no bytes.

    Bytes are added up per coarse range of the first key.  What lies in ranges before
    the one in which a group reaches the target is kept as it is, what lies behind is
    left out, and only that one range is sorted.  A first key that is no number, text,
    date or time has no ranges, and all rows are sorted.
    """
    first = order[0] if order else None
    if first is None or (place := _coarse(df, first)) is None:
        return totals_before(df, groups, order, line_bytes(NUM, TEXT), "_before", below=target).drop("_before")
    df = stable_order(df)
    size = F.coalesce(line_bytes(NUM, TEXT), F.lit(0).cast("bigint"))
    known = F.when(F.abs(place) < float("inf"), place)
    low, high = df.agg(F.min(known), F.max(known)).first()
    ranged = df.withColumn("__range", _range_of(place, low, high))

    totals = ranged.groupBy(*groups, "__range").agg(F.sum(size).alias("__bytes"))
    earlier = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__bytes").over(earlier), F.lit(0).cast("bigint")))
    reached = totals.filter((F.col("__before") < target) & (F.col("__before") + F.col("__bytes") >= target))
    named = [F.col(g).alias(f"__group{i}") for i, g in enumerate(groups)]
    cuts = materialize(reached.select(*named, F.col("__range").alias("__cut"), "__before"), "cuts")
    same = F.lit(target > 0)
    for i, group in enumerate(groups):
        same = same & F.col(group).eqNullSafe(F.col(f"__group{i}"))
    placed = ranged.join(cuts, same, "left") if groups else ranged.crossJoin(F.broadcast(_one_row(cuts)))
    inside = F.col("__cut").isNull() | (F.col("__range") < F.col("__cut"))
    whole = placed.filter(inside & F.lit(target > 0)).select(*df.columns)
    cut = placed.filter(F.col("__range") == F.col("__cut")).select(*df.columns, "__before")
    sorted_cut = totals_before(cut, groups, order, line_bytes(NUM, TEXT), "_before")
    kept = sorted_cut.filter(F.col("__before") + F.col("_before") < target).select(*df.columns)
    return whole.unionByName(kept)


def _one_row(cuts: DataFrame) -> DataFrame:
    """The cut of the only group, or a row of NULLs if its target is not reached."""
    return cuts.agg(F.first("__cut").alias("__cut"), F.first("__before").alias("__before"))


def _coarse(df: DataFrame, key: Column | str) -> Column | None:
    """A number that never falls where the key rises, or None for a key of another kind."""
    key = F.col(key) if isinstance(key, str) else key
    kind = df.select(key).schema[0].dataType
    if isinstance(kind, T.StringType) and kind.simpleString() == "string":
        # The first bytes; texts are in the order of their bytes.
        head = F.rpad(F.hex(F.substring(key.cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("double")
    if isinstance(kind, (T.NumericType, T.TimestampType)):
        return key.cast("double")
    return None


def _range_of(place: Column, low: float | None, high: float | None) -> Column:
    """Number of the range, 0 for NULL, then ascending; NaN is above all numbers."""
    if low is None or not high > low:
        inside = F.lit(0)
    else:
        share = (place - F.lit(low)) / F.lit(high - low)
        inside = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * _RANGES)
    below, above = F.lit(float("-inf")), F.lit(float("inf"))
    return (
        F.when(place.isNull(), 0).when(F.isnan(place), _RANGES + 4).when(place == above, _RANGES + 3).when(place == below, 1)
        .otherwise(inside + 2).cast("int")
    )


def assign_parts(df: DataFrame, key: Column | str, workers: int, parts: int) -> DataFrame:
    """Spread rows over workers by ``key`` and deal the workers out to parts in turn."""
    key = F.col(key) if isinstance(key, str) else key
    worker = F.pmod(key.cast("bigint"), F.lit(workers).cast("bigint")).cast("int")
    return df.withColumn("worker", worker).withColumn("part_id", F.pmod("worker", F.lit(parts)))


def part_stats(df: DataFrame, *part: str) -> DataFrame:
    """Lines and UTF-8 bytes (line feeds included) of each part."""
    return df.groupBy(*(part or ("part_id",))).agg(
        F.count("*").alias("lines"),
        F.sum(line_bytes(NUM, TEXT)).alias("bytes"),
    )
