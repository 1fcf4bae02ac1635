"""Synthetic lines up to a target size."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineflow.functions.draws import draw, draw_below, mixture
from lineflow.functions.parsing import SEPARATOR
from lineflow.functions.sizes import size_in_bytes
from lineflow.operators.ordering import with_positions
from lineflow.operators.parse import NUM, TEXT
from lineflow.workspace import materialize, small_table

# Sizes of the blocks in which the end of a worker's share is searched.
_MIN_BLOCK = 2**10
_MAX_BLOCK = 2**20

# Bytes of output per input partition of the finished generator.
_PARTITION_BYTES = 2**27


@dataclass(frozen=True)
class GeneratorOptions:
    """What to generate.

    Each of ``worker_count`` independent streams of lines gets an equal share of
    ``target_size``, the first ones a byte more if it cannot be divided; streams are dealt out to ``partition_count`` parts in turn.
    ``duplicate_percentage`` of the lines take their word from a fixed random
    quarter of the words.  Numbers are 1 .. ``max_number``.
    """

    target_size: str | int = "1GB"
    worker_count: int = 8
    partition_count: int = 8
    duplicate_percentage: int = 10
    max_number: int = 100_000
    seed: int = 0

    def __post_init__(self) -> None:
        if size_in_bytes(self.target_size) < 0:
            raise ValueError(f"target_size must not be negative: {self.target_size}")
        _check("duplicate_percentage", self.duplicate_percentage, 0, 100)
        _check("max_number", self.max_number, 1, 2**31 - 1)
        _check("partition_count", self.partition_count, 1, 2**31 - 1)
        _check("worker_count", self.worker_count, 1, 2**31 - 1)

    def share(self, worker: Column | str) -> Column:
        """Bytes a worker is to reach."""
        each, left = divmod(size_in_bytes(self.target_size), self.worker_count)
        worker = F.col(worker) if isinstance(worker, str) else worker
        return F.lit(each).cast("bigint") + (worker < left).cast("bigint")


def _check(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be in {low}..{high}, not {value}")


@dataclass(frozen=True)
class _Pool:
    """Words in a fixed random order, numbered from 0, with their sizes."""

    table: DataFrame
    size: int
    shortest: int
    mean: float
    # The first so many words form the pool of repeated texts.
    repeated: int
    repeated_mean: float


def word_pool(spark: SparkSession, words: DataFrame | Iterable[str], seed: int) -> _Pool:
    """Number the words.

    The table is read back from storage, so its true size is known when it is
    joined: a short list is broadcast, a very long one is shuffled.
    """
    if not isinstance(words, DataFrame):
        words = spark.createDataFrame([(w,) for w in words], "word string")
    ranked = with_positions(words.select("word"), draw(seed, "pool", "word"), "word", name="_place")
    numbered = ranked.select(
        (F.col("_place") - 1).alias("word_id"), "word", F.octet_length("word").alias("word_bytes")
    )
    table = materialize(numbered, "words")
    total = table.agg(
        F.count("*").alias("n"),
        F.count("word").alias("known"),
        F.min("word_bytes").alias("low"),
        F.avg("word_bytes").alias("mean"),
    ).first()
    if total.n == 0:
        raise ValueError("the word list is empty")
    if total.known < total.n:
        raise ValueError("the word list holds NULL")
    repeated = max(1, total.n // 4)
    repeated_mean = table.filter(F.col("word_id") < repeated).agg(F.avg("word_bytes")).first()[0]
    return _Pool(table, total.n, total.low, total.mean, repeated, repeated_mean)


def _numbers(options: GeneratorOptions) -> Column:
    number = draw_below(options.max_number, options.seed, "number", "worker", "seq") + 1
    return number.cast("int").alias(NUM)


def _word_ids(options: GeneratorOptions, pool: _Pool) -> Column:
    bound = mixture(
        options.duplicate_percentage, F.lit(pool.repeated), F.lit(pool.size), options.seed, "repeat", "worker", "seq"
    )
    return draw_below(bound, options.seed, "word", "worker", "seq").alias("word_id")


def _slots(spark: SparkSession, workers: int, per_worker: int, partitions: int) -> DataFrame:
    """Rows ``(worker, seq)`` with the rows of one worker next to each other."""
    slots = spark.range(0, workers * per_worker, 1, partitions)
    return slots.select(
        F.expr(f"cast(id div {per_worker} as int)").alias("worker"), F.expr(f"id % {per_worker}").alias("seq")
    )


def _sizes(slots: DataFrame, options: GeneratorOptions, pool: _Pool) -> DataFrame:
    """Bytes of the line each slot would hold."""
    rest = len(SEPARATOR) + 1
    drawn = slots.select("*", _numbers(options), _word_ids(options, pool))
    sized = drawn.join(pool.table.select("word_id", "word_bytes"), "word_id", "left")
    size = F.octet_length(F.col(NUM).cast("string")) + F.col("word_bytes") + rest
    return sized.withColumn("bytes", size.cast("bigint"))


def _expected_bytes(options: GeneratorOptions, pool: _Pool) -> float:
    """Mean size of a line."""
    most = options.max_number
    digits = sum(most - 10**place + 1 for place in range(len(str(most)))) / most
    share = options.duplicate_percentage / 100
    return digits + len(SEPARATOR) + 1 + share * pool.repeated_mean + (1 - share) * pool.mean


def lines_per_worker(spark: SparkSession, options: GeneratorOptions, pool: _Pool) -> dict[int, int]:
    """How many lines each worker emits until its share of bytes is reached.

    A line is a function of worker and place, so the end of a worker's stream is
    found without keeping or moving lines: bytes are added up per block of places,
    and only the block in which the share is reached is looked at line by line.
    The result has one entry per worker.
    """
    workers, size = options.worker_count, size_in_bytes(options.target_size)
    share = -(-size // workers)
    if size == 0:
        return dict.fromkeys(range(workers), 0)
    # The others have nothing to reach.
    busy = min(workers, size)
    reach = options.share("worker")
    shortest = pool.shortest + len(SEPARATOR) + 2
    most = -(-share // shortest)
    expected = _expected_bytes(options, pool)
    budget = min(most, int(share / expected * 1.02) + _MIN_BLOCK)
    by_place = Window.partitionBy("worker")
    while True:
        block = min(_MAX_BLOCK, max(_MIN_BLOCK, budget // 1024))
        partitions = max(spark.sparkContext.defaultParallelism, workers * budget * int(expected) // _PARTITION_BYTES)
        slots = _slots(spark, workers, budget, partitions).withColumn("block", F.expr(f"seq div {block}"))
        blocks = _sizes(slots, options, pool).groupBy("worker", "block").agg(F.sum("bytes").alias("bytes"))
        ends = blocks.withColumn("end", F.sum("bytes").over(by_place.orderBy("block")))
        last = ends.filter((F.col("end") >= reach) & (F.col("end") - F.col("bytes") < reach))
        last = last.select("worker", "block", (F.col("end") - F.col("bytes")).alias("start")).collect()
        if len(last) == busy:
            break
        # Too few lines planned; at ``most`` lines every share is reached.
        budget = min(most, budget * 2)

    workers_cut, blocks_cut, starts = zip(*last)
    cut = small_table(spark, worker=list(workers_cut), block=list(blocks_cut), start=list(starts))
    partitions = max(spark.sparkContext.defaultParallelism, workers * block // _MAX_BLOCK)
    inside = _slots(spark, workers, block, partitions).join(cut, "worker")
    inside = inside.withColumn("seq", F.col("seq") + F.col("block") * block).filter(F.col("seq") < budget)
    before = by_place.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sized = _sizes(inside, options, pool).withColumn(
        "before", F.col("start") + F.coalesce(F.sum("bytes").over(before), F.lit(0))
    )
    counts = sized.filter(F.col("before") < reach).groupBy("worker").agg((F.max("seq") + 1).alias("lines"))
    return dict.fromkeys(range(workers), 0) | {r.worker: r.lines for r in counts.collect()}


def generate_lines(
    spark: SparkSession, words: DataFrame | Iterable[str], options: GeneratorOptions = GeneratorOptions()
) -> DataFrame:
    """Lines as ``worker, part_id, seq, num, text``.

    The number of lines per worker is settled first; what is returned is then a
    plain projection of a range, without a shuffle, and has the same rows however
    it is partitioned.
    """
    pool = word_pool(spark, words, options.seed)
    counts = lines_per_worker(spark, options, pool)
    longest = max(max(counts.values()), 1)
    partitions = max(spark.sparkContext.defaultParallelism, size_in_bytes(options.target_size) // _PARTITION_BYTES)
    shares = small_table(spark, worker=list(counts), lines=list(counts.values()))
    kept = _slots(spark, len(counts), longest, partitions).join(shares, "worker").filter(F.col("seq") < F.col("lines"))
    part = F.pmod("worker", F.lit(options.partition_count)).alias("part_id")
    drawn = kept.select("worker", part, "seq", _numbers(options), _word_ids(options, pool))
    words_by_id = pool.table.select("word_id", F.col("word").alias(TEXT))
    # Every id has its word; an outer join spares the test of the drawn id for NULL.
    return drawn.join(words_by_id, "word_id", "left").select("worker", "part_id", "seq", NUM, TEXT)
