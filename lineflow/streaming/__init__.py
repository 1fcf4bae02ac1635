"""The sort's first phase as a stream: files arrive, sorted runs are written."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lineflow.functions.parsing import line_bytes
from lineflow.operators.parse import NUM, TEXT, VALUE, parse_lines, rejects
from lineflow.sinks import write_runs, write_sorted
from lineflow.sources.text import clean_lines, read_runs, text_options
from lineflow.streaming.commits import commit, committed_batches, is_committed, run_name
from lineflow.workspace import path_exists

__all__ = [
    "committed_batches",
    "compact_runs",
    "read_stream_rejects",
    "read_stream_runs",
    "stream_lines",
    "stream_runs",
]


def stream_lines(
    spark: SparkSession, path: str, max_files: int | None = None, encoding: str | None = None, parse: bool = True
) -> DataFrame:
    """Parsed records of the text files that arrive in a folder.

    ``max_files`` bounds the files taken into one batch; ``encoding`` is as in
    ``read_lines``.  Without ``parse`` the lines come as they are, for a stream that
    keeps what it rejects.
    """
    reader = spark.readStream.options(**text_options(encoding))
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = clean_lines(reader.text(path), encoding)
    return parse_lines(lines) if parse else lines


def stream_runs(
    records: DataFrame, path: str, checkpoint: str, interval: str | None = None, rejected: str | None = None
) -> StreamingQuery:
    """Write each batch as sorted runs to its own folder.

    Folders are named by the stream, which its checkpoint tells, and the batch, so
    streams with checkpoints of their own can share a ``path``.  A batch counts once its
    entry is written, after its data; one that is repeated after a failure replaces what
    it left, and one that has its entry is not written again.

    With ``rejected`` the stream is one of lines (``stream_lines(parse=False)``); those
    that do not parse go to that path with their ``reason``, under the same entry.

    Without an ``interval`` the query takes what is there and ends.
    """
    query_id, known = [], threading.Event()

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        known.wait()
        query, spark = query_id[0], batch.sparkSession
        run = run_name(query, batch_id)
        if is_committed(spark, path, run):
            return
        # Totals are taken while the runs are written.
        written = Observation()
        parsed = batch if rejected is None else parse_lines(batch)
        counted = parsed.observe(
            written, F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(line_bytes(NUM, TEXT)), F.lit(0)).alias("bytes")
        )
        write_runs(counted, f"{path}/run={run}")
        n_rejected = 0
        if rejected is not None:
            refused = Observation()
            bad = rejects(batch).select(VALUE, "reason").observe(refused, F.count(F.lit(1)).alias("lines"))
            bad.write.mode("overwrite").parquet(f"{rejected}/run={run}")
            n_rejected = refused.get["lines"]
        commit(spark, path, query, batch_id, written.get["lines"], written.get["bytes"], n_rejected)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = records.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    started = writer.trigger(**trigger).start()
    query_id.append(started.id)
    known.set()
    return started


def read_stream_runs(spark: SparkSession, path: str) -> DataFrame:
    """Records of all batches committed so far, with their batch in ``run`` and file in ``run_id``."""
    committed = committed_batches(spark, path).filter("lines > 0").select("run")
    if not path_exists(spark, path) or committed.isEmpty():
        return spark.createDataFrame([], f"{NUM} int, {TEXT} string, run string, run_id string")
    return read_runs(spark, path).join(committed, "run", "left_semi")


def read_stream_rejects(spark: SparkSession, path: str, rejected: str) -> DataFrame:
    """value, reason, run of the lines refused by the batches committed at ``path``."""
    committed = committed_batches(spark, path).filter("rejected > 0").select("run")
    if not path_exists(spark, rejected) or committed.isEmpty():
        return spark.createDataFrame([], f"{VALUE} string, reason string, run string")
    return spark.read.parquet(rejected).join(committed, "run", "left_semi").select(VALUE, "reason", "run")


def compact_runs(spark: SparkSession, path: str, output: str) -> None:
    """Merge all runs committed so far into one sorted text.

    ``add_runs`` keeps a sorted store up to date instead of writing all of it again.
    """
    write_sorted(read_stream_runs(spark, path).select(NUM, TEXT), output)
