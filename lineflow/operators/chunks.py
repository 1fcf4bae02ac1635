"""Size-bounded chunks of records, and groups of sorted runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.functions.folding import utf16_length
from lineflow.operators.ordering import range_sort, totals_before
from lineflow.operators.parse import TEXT
from lineflow.operators.sort import line_order
from lineflow.workspace import materialize


def assign_chunks(
    df: DataFrame,
    max_chars: int,
    source: Sequence[str],
    order: Sequence[Column | str],
    text: str = TEXT,
    chars: Column | str | None = None,
) -> DataFrame:
    """Number the chunks of each source: ``chunk_id`` counts from 0 in ``order``.

    A record belongs to the chunk its first character falls into when the texts of
    a source are laid end to end and cut every ``max_chars`` characters.  A chunk
    therefore holds less than ``max_chars`` characters plus one text.  A NULL text
    has no characters.

    Where the texts themselves are not needed, leave them out and give their lengths
    in ``chars``.
    """
    if max_chars < 1:
        raise ValueError("max_chars must be positive")
    placed = totals_before(df, source, order, utf16_length(text) if chars is None else chars, "chunk_id")
    return placed.withColumn("chunk_id", F.expr(f"chunk_id div {max_chars}"))


#: A block holds so many chunks, fewer if they are so many characters, and at least one.
_BLOCK_CHUNKS = 16
_BLOCK_CHARS = 2**22


def greedy_chunks(
    df: DataFrame,
    max_chars: int,
    source: Sequence[str],
    order: Sequence[Column | str],
    text: str = TEXT,
    chars: Column | str | None = None,
) -> DataFrame:
    """Number the chunks of each source as a buffer of ``max_chars`` fills: ``chunk_id`` from 0.

    A record that does not fit any more begins the next chunk.  A chunk therefore holds
    at most ``max_chars`` characters, or one record that is longer.  A NULL text has no
    characters; records without any stay with the one before them.

    Where a chunk ends depends on where it began, but not on more: within a block of a
    source, each record that may be the first one to begin a chunk leads to the record
    behind the block that begins one.  Blocks are worked out on their own, and the leads
    from block to block are followed by doubling their length.  Only lengths take part;
    records are sorted once and then find their chunk among those of their block.

    The lengths of a block's records fit a task, which holds about as many as a chunk.
    """
    if max_chars < 1:
        raise ValueError("max_chars must be positive")
    length = utf16_length(text) if chars is None else F.col(chars) if isinstance(chars, str) else chars
    length = F.coalesce(length.cast("bigint"), F.lit(0).cast("bigint"))
    placed = totals_before(df.withColumn("__chars", length), source, order, "__chars", "__start")
    placed = materialize(placed, "placed")
    block_chars = max_chars * max(1, min(_BLOCK_CHUNKS, _BLOCK_CHARS // max_chars))
    block = F.expr(f"__start div {block_chars}").alias("__block")

    # Groups may be null and may be anything; they are told by their place in this struct.
    of = F.struct(*[F.col(s).alias(f"s{i}") for i, s in enumerate(source)]).alias("of")
    filled = placed.filter("__chars > 0").select(of, block, "__start", "__chars")
    # The head of a block also goes to the block before, where the last chunk ends.
    head = filled.filter(F.expr(f"__block > 0 AND __start % {block_chars} < {max_chars}"))
    head = head.withColumn("__block", F.col("__block") - 1)
    both = filled.withColumn("own", F.lit(True)).unionByName(head.withColumn("own", F.lit(False)))
    kind = f"of {filled.schema['of'].dataType.simpleString()}, block long, at long, goes long, chunks long, ends long, starts array<long>"
    leads = both.groupBy("of", "__block").applyInArrow(_block_leads(max_chars, block_chars), kind)
    leads = materialize(leads, "leads")

    reached = _followed(leads)
    found = reached.join(leads, (leads["at"] == reached["from"]) & leads["of"].eqNullSafe(reached["source"]))
    begun = found.select("of", "block", "first", "starts")
    # A block may hold the end of what began before it and no chunk's beginning.
    none = F.array().cast("array<bigint>").alias("starts")
    tails = found.select(
        "of", F.expr(f"ends div {block_chars}").alias("block"), (F.col("first") + F.col("chunks")).alias("first"), none
    )
    has_start = begun.select(F.col("of").alias("has"), F.col("block").alias("there"))
    missing = (F.col("block") == F.col("there")) & F.col("of").eqNullSafe(F.col("has"))
    blocks = begun.unionByName(tails.join(has_start, missing, "left_anti"))
    # No name of a column of the caller's.
    blocks = materialize(blocks.toDF("__source", "__at", "__first", "__starts"), "chunk-blocks")
    same = (F.col("__block") == F.col("__at")) & F.col("__of").eqNullSafe(F.col("__source"))
    joined = placed.select("*", of.alias("__of"), block).join(blocks, same, "left")
    # A record without characters stands before the one that starts at the same place.
    inside = F.filter("__starts", lambda s: (s < F.col("__start")) | ((s == F.col("__start")) & (F.col("__chars") > 0)))
    chunk = F.greatest(F.coalesce(F.col("__first") + F.size(inside) - 1, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    return joined.select(*df.columns, chunk.alias("chunk_id"))


def _block_leads(max_chars: int, block_chars: int):
    """Arrow function: of, block, at, goes, chunks, ends, starts of a block.

    ``at`` is where a record starts that may begin the block's first chunk, ``starts``
    are the chunks that follow in the block, ``goes`` is where the first one behind it
    begins, ``ends`` where the block's last record ends.  Nested so that executors need not have this package installed.
    """

    def leads(key, table):
        import numpy as np
        import pyarrow as pa

        own = table.column("own").to_numpy()
        start, length = table.column("__start").to_numpy(), table.column("__chars").to_numpy()
        order = np.argsort(start)
        own, start, end = own[order], start[order], (start + length)[order]
        last = int(np.flatnonzero(own)[-1]) if own.any() else -1
        # The record that begins the next chunk: the first that ends too late, but not itself.
        follows = np.maximum(np.searchsorted(end, start + max_chars, side="right"), np.arange(len(start)) + 1)
        edge = key[1].as_py() * block_chars + max_chars
        rows = []
        for first in range(last + 1):
            if first and start[first] >= edge:
                break
            chain, at = [], first
            while at <= last:
                chain.append(int(start[at]))
                at = int(follows[at])
            goes = int(start[at]) if at < len(start) else int(end[-1])
            rows.append((int(start[first]), goes, len(chain), int(end[last]), chain))
        at, goes, chunks, ends, starts = zip(*rows) if rows else ((), (), (), (), ())
        of = pa.array([key[0].as_py()] * len(rows), table.schema.field("of").type)
        columns = [of, pa.array([key[1].as_py()] * len(rows), pa.int64())]
        columns += [pa.array(c, pa.int64()) for c in (at, goes, chunks, ends)] + [pa.array(starts, pa.list_(pa.int64()))]
        return pa.table(columns, ["of", "block", "at", "goes", "chunks", "ends", "starts"])

    return leads


def _followed(leads: DataFrame) -> DataFrame:
    """source, from, first: where the first chunk of each block begins, and its number.

    From each source's start the leads are followed; each round joins them with
    themselves, so rounds grow with the logarithm of the blocks.
    """
    steps = leads.select(F.col("of").alias("source"), "at", "goes", "chunks")
    begins = leads.groupBy(F.col("of").alias("source")).agg(F.min("at").alias("from"))
    reached = materialize(begins.withColumn("first", F.lit(0).cast("bigint")), "reached")
    while True:
        from_here = steps.select(F.col("source").alias("of"), F.col("at"), "goes", "chunks")
        same = (reached["from"] == from_here["at"]) & reached["source"].eqNullSafe(from_here["of"])
        ends = leads.select(F.col("of").alias("end_of"), F.col("at").alias("end"))
        further = reached.join(from_here, same).select("source", F.col("goes").alias("from"), (F.col("first") + F.col("chunks")).alias("first"))
        is_there = (further["from"] == ends["end"]) & further["source"].eqNullSafe(ends["end_of"])
        further = materialize(further.join(ends, is_there, "left_semi"), "reached")
        if further.isEmpty():
            return reached
        reached = materialize(reached.unionByName(further), "reached")
        then = steps.select(F.col("source").alias("of"), F.col("at").alias("via"), F.col("goes").alias("ahead"), F.col("chunks").alias("more"))
        meets = (steps["goes"] == then["via"]) & steps["source"].eqNullSafe(then["of"])
        doubled = steps.join(then, meets).select("source", "at", F.col("ahead").alias("goes"), (F.col("chunks") + F.col("more")).alias("chunks"))
        steps = materialize(doubled, "steps")


def run_stats(df: DataFrame, *run: str, text: str = TEXT, chars: Column | str | None = None) -> DataFrame:
    """Records and characters of each run or chunk; one row per run.

    ``chars`` gives the lengths where the texts are left out.
    """
    length = utf16_length(text) if chars is None else F.col(chars) if isinstance(chars, str) else chars
    return df.groupBy(*run).agg(
        F.count("*").alias("lines"),
        F.sum(length.cast("bigint")).alias("chars"),
    )


def sort_groups(df: DataFrame, group: str) -> DataFrame:
    """Sort records by ``group`` and then as lines.

    A group of any size is spread over as many partitions as it needs, in order.
    """
    return range_sort(df, group, *line_order())
