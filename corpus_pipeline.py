"""A corpus pipeline over ``documents``: its stages, and a run of them all.

Each stage takes the session, the documents the stage before it kept and the folder
of the tables.  Its result is written as Parquet in the shared folder and read again
as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineflow.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality_rules
from lineflow.llm.queries import BYTE_PATTERN, BYTE_RANKS
from lineflow.workspace import materialize


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bad lines go, and documents that fail or lost too much; ``n_chars`` follows the text."""
    return quality_rules.keep_good_documents(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their 5-word shingles, the one with the smallest id stays."""
    return near_dedup.drop_near_copies(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids, and of what they decode to."""
    encoded = byte_bpe.encode_documents(docs, BYTE_RANKS, BYTE_PATTERN)
    return byte_bpe.token_digests(byte_bpe.decode_documents(encoded, BYTE_RANKS))


STAGES = [
    ("quality_rules", clean),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Near duplicates and BPE have no SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
