"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineflow.workspace import materialize


def _least_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least_neighbour(both).select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    hung = both.join(least, both["a"] == least["node"]).filter(F.col("b") > F.col("a"))
    return hung.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the least of them."""
    least = _least_neighbour(links).withColumnRenamed("a", "node")
    hung = links.join(least, links["a"] == least["node"])
    own = least.select(F.col("node").alias("a"), F.col("least").alias("b"))
    return hung.filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(own).distinct()


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, of all nodes in ``links`` (a, b).

    Links have no direction; repeated ones and those of a node with itself do no
    harm, and those with a null end are left out.  No links give no rows.

    Each round is two star operations, an aggregation and a join on the node, so a
    node with very many links is combined before the shuffle and split in the join.
    Rounds grow with the logarithm of the longest chain; each is written to the
    shared folder, and only a row count and a checksum reach the driver.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    before = _signature(links)
    while before[0]:
        links = materialize(_small_star(_large_star(links)), "links")
        after = _signature(links)
        if after == before:
            break
        before = after
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
