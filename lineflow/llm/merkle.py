"""Merkle manifest of a table of documents, by nested intervals.

Each document is a leaf with a rank in its tree, the documents of one language in the
order of their ids.  A node carries the interval of leaf ranks it covers; its digest is
the hash of its children's digests.  Nothing else links nodes: a node's parent is the
node of the next level whose interval contains its own, found by an equality join on the
bucket of that level, and its siblings are what is left of the parent's interval when
its own is taken away.

Levels are built upwards, each from the one below, so they shrink by the fanout.  Paths
are then handed down: a node's path is what its siblings add, followed by its parent's
path.  A leaf meets one row of the level above it, not one of every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.operators.ordering import totals_before, with_positions
from lineflow.workspace import materialize

FANOUT = 8


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the texts joined."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself; ``-`` if null."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest(*[framed(v) for v in values])


def _levels(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """Level 1 and up of ``tree, lo, n, digest``: tree, lo, hi, n, digest, children.

    ``children`` are the nodes in the interval, at most ``fanout``.  A tree of ``n``
    leaves ends with the level on which one node covers all; the driver learns the
    greatest ``n`` only.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    level = leaves.select("tree", "lo", (F.col("lo") + 1).alias("hi"), "n", "digest")
    found, width = [], 1
    while width < most:
        width *= fanout
        children = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
        grown = (
            level.filter("hi - lo < n")
            .groupBy("tree", F.expr(f"lo div {width}").alias("bucket"))
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("n").alias("n"), children.alias("children"))
        )
        joined = F.array_join(F.transform("children", lambda c: c["digest"]), "")
        grown = grown.select("tree", "lo", "hi", "n", digest(joined).alias("digest"), "children")
        found.append(materialize(grown, "merkle-level"))
        level = found[-1].drop("children")
    return found


def _roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree, digest of the nodes that cover their whole tree, one each."""
    roots = leaves.filter("n = 1").select("tree", "digest")
    for level in levels:
        roots = roots.unionByName(level.filter("hi - lo = n").select("tree", "digest"))
    return roots


def _with_paths(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """``leaves`` with ``path`` and what else ``above`` has for their tree.

    ``above`` holds tree, path of each tree's root and further columns.  A step of a
    path is ``left`` and ``right``, the digests of the siblings before and behind.
    """
    rest = [c for c in above.columns if c not in ("tree", "path")]
    parents = None
    for height in range(len(levels), -1, -1):
        level = levels[height - 1] if height else leaves.withColumn("hi", F.col("lo") + 1)
        found = level.filter("hi - lo = n").join(above, "tree")
        if parents is not None:
            found = found.unionByName(_below(level.filter("hi - lo < n"), parents, fanout ** (height + 1), rest))
        if height:
            parents = materialize(found.drop("digest"), "merkle-paths")
    return found.drop("hi")


def _below(nodes: DataFrame, parents: DataFrame, width: int, rest: list[str]) -> DataFrame:
    """``nodes`` with the path through the parent whose interval contains theirs.

    Parents cover ``width`` leaves each and share a bucket with at most a fanout of nodes.
    """
    bucket = F.expr(f"lo div {width}")
    renamed = parents.select(
        F.col("tree").alias("of"), bucket.alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"),
        F.col("children").alias("run"), F.col("path").alias("further"), *rest,
    )
    contained = (F.col("lo") >= F.col("from")) & (F.col("hi") <= F.col("to"))
    joined = nodes.join(renamed, (F.col("tree") == F.col("of")) & (bucket == F.col("bucket")) & contained)
    step = F.struct(
        _digests(lambda c: c["hi"] <= F.col("lo")).alias("left"), _digests(lambda c: c["lo"] >= F.col("hi")).alias("right")
    )
    return joined.select(*nodes.columns, *rest, F.concat(F.array(step), "further").alias("path"))


def _digests(which) -> Column:
    """The digests of those nodes of the parent's interval, joined."""
    return F.array_join(F.transform(F.filter("run", which), lambda c: c["digest"]), "")


def folded(path: Column | str, start: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    return F.aggregate(path, start, lambda so_far, step: digest(step["left"], so_far, step["right"]))


def proof_digest(path: Column | str) -> Column:
    """Digest of all siblings along a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(
    docs: DataFrame,
    text_now: Column | None = None,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tree: str = "lang",
    order: str = "doc_id",
    text: str = "text",
    fanout: int = FANOUT,
) -> DataFrame:
    """One row per row of ``docs``: its id under ``order``, leaf, leaf_now, subroot, root, path.

    The leaves of a ``tree`` ascend by ``order``, null first; leaves of one id by
    digest.  Every ``fanout`` consecutive nodes become their parent until one is left,
    the subroot; the subroots of all trees, null first and then by UTF-8 bytes, become
    the root in the same way.  A run of one node becomes a parent of one.

    ``leaf_now`` is the digest with ``text_now``, an expression over the columns of
    ``docs``, in place of the text; without it, ``leaf`` itself.  Nulls are told from
    empty values.  Equal rows are leaves of their own.  Other columns do not count, an
    empty table gives an empty one.
    """
    values = {name: F.col(f"`{name}`") for name in fields}
    now = values if text_now is None else values | {text: text_now}
    # A prefix tells a null from any name and puts it first.
    named = F.col(f"`{tree}`").cast("string")
    leaves = docs.select(
        values[order].alias("id"),
        F.when(named.isNull(), "-").otherwise(F.concat(F.lit("."), named)).alias("tree"),
        leaf_digest(*values.values()).alias("digest"),
        leaf_digest(*now.values()).alias("leaf_now"),
    )
    ranked = totals_before(leaves, ["tree"], ["id", "digest"], 1, "lo")
    sizes = materialize(leaves.groupBy("tree").agg(F.count("*").alias("n")), "merkle-sizes")
    # One row per tree: broadcast if that is small, and split where a tree is hot if not.
    leaves = materialize(ranked.join(sizes, "tree"), "merkle-leaves")
    levels = _levels(leaves, fanout)

    roots = materialize(_roots(leaves, levels), "merkle-roots")
    ordered = with_positions(roots, "tree").select(
        F.col("tree").alias("name"), F.lit("").alias("tree"), (F.col("position") - 1).alias("lo"), "digest"
    )
    tops = materialize(ordered.withColumn("n", F.lit(roots.count()).cast("bigint")), "merkle-tops")
    top_levels = _levels(tops, fanout)
    none = F.array().cast("array<struct<left:string,right:string>>")
    whole = _roots(tops, top_levels).select("tree", F.col("digest").alias("root"), none.alias("path"))
    named_paths = _with_paths(tops, top_levels, materialize(whole, "merkle-root"), fanout)
    above = materialize(
        named_paths.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path"), "merkle-above"
    )
    found = _with_paths(leaves, levels, above, fanout)
    return found.select(F.col("id").alias(order), F.col("digest").alias("leaf"), "leaf_now", "subroot", "root", "path")


def audit(found: DataFrame, order: str = "doc_id") -> DataFrame:
    """A manifest's rows with the root each one's ``leaf_now`` leads to, and whether it is the root."""
    with_root = found.withColumn("folded_root", folded("path", F.col("leaf_now")))
    return with_root.select(
        order, "leaf", "subroot", "root", proof_digest("path").alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
