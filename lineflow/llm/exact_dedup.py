"""Exact duplicates by recipes of content-defined chunks, in DataFrame operations only.

A text is cut where its own content says so, each chunk gets a verified
identifier, and two texts are equal if their ordered lists of identifiers are.
Texts cross the network at most once, as distinct chunks, to verify the
identifiers; what is compared and grouped afterwards is one long per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.llm.words import id_and_text, lower_ascii_column
from lineflow.workspace import materialize

MIN_CHUNK = 256
MAX_CHUNK = 4096

#: A chunk ends behind one of these, once it is MIN_CHUNK long.
CUT = r"[\n.!?。！？]"


def chunks_of(text: Column) -> Column:
    """The chunks of a text, in order; joined they are the text.  Empty: no chunk.

    A cut depends only on the characters since the last cut, so texts that share a
    passage share its chunks from the first common cut on.  Without a cut in
    MAX_CHUNK characters the chunk ends there.
    """
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?{CUT}|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``recipe`` (identifiers in order) and ``text_sha256`` of each normalised text.

    The recipe of equal texts is equal, and of different texts different: chunk
    hashes are checked against chunk contents over the whole table, and the chunks
    of a hash that stands for several contents get identifiers of their own.
    """
    normal = id_and_text(docs, doc_id, text).select("doc_id", lower_ascii_column(F.col("text")).alias("text"))
    sha256 = F.sha2(F.col("text"), 256).alias("text_sha256")
    cut = normal.select("doc_id", "text", chunks_of(F.col("text")).alias("chunks"))
    table = materialize(
        cut.select("doc_id", F.transform("chunks", lambda chunk: F.xxhash64(chunk)).alias("recipe"), sha256),
        "recipes",
    )
    chunks = cut.select(sha256, F.posexplode("chunks").alias("place", "chunk")).withColumn("id", F.xxhash64("chunk"))
    shared = (
        chunks.groupBy("id")
        .agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
        .filter(F.col("least") != F.col("most"))
        .select("id")
    )
    shared = materialize(shared, "shared-ids")
    if shared.isEmpty():
        return table
    return _told_apart(table, chunks.join(shared, "id", "left_semi"))


def _told_apart(table: DataFrame, chunks: DataFrame) -> DataFrame:
    """Recipes in which the given chunks, whose ids are ambiguous, are written out."""
    entries = F.collect_set(F.struct("place", "chunk"))
    written = chunks.groupBy("text_sha256").agg(F.map_from_entries(entries).alias("chunks"))
    spelled = F.zip_with(
        "recipe",
        F.sequence(F.lit(0), F.size("recipe") - 1),
        lambda id, place: F.struct(id.alias("id"), F.try_element_at("chunks", place).alias("chunk")),
    )
    whole = F.when(F.size("recipe") == 0, F.array().cast("array<struct<id:bigint,chunk:string>>")).otherwise(spelled)
    return table.join(written, "text_sha256", "left").select("doc_id", whole.alias("recipe"), "text_sha256")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal if they are the same after lower-casing A-Z.  Of each group the
    row with the largest id stays.  Null text is empty, and empty texts are a group.
    Rows that repeat an id share its fate and count in ``group_size``; a null id is
    smaller than any other.  An empty table gives an empty one.

    A group may hold any share of all rows: it is aggregated before the shuffle, and
    only groups with copies are joined back, an equi-join whose large keys Spark
    splits at run time.
    """
    table = recipes(docs, doc_id, text)
    copies = (
        table.groupBy("recipe")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return table.join(copies, "recipe", "left").select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the copies :func:`exact_groups` does not keep; columns unchanged.

    Only what to drop is joined, by id and text, so rows that share an id, or have
    none, go or stay each by its own text.
    """
    gone = exact_groups(docs, doc_id, text).filter("NOT kept")
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__gone_sha256")).distinct()
    normal = lower_ascii_column(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__gone")) & (F.sha2(normal, 256) == F.col("__gone_sha256"))
    return docs.join(gone, same, "left_anti").select(*[f"`{c}`" for c in docs.columns])
