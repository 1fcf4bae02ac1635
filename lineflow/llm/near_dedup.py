"""Near duplicates by bottom-k sketches and inverted lists.

One hash function maps shingles to 64 bits; the k smallest values of a document's
set are its sketch.  Documents that share retained values meet in the inverted lists
of these values, the bottom-k of the union of two sketches estimates how similar
they are, and the full sets decide.

Three things keep this short without losing a link.  Of a sketch only the rarest
values are listed: similar documents share so many values that the rest alone cannot
hold all of them.  Within a list, documents are first compared with the list's leader
only; whatever that connects need not be compared again, so a group of copies takes as
many comparisons as it has members.  What is left are members of different components
that share a list.  Where these are few they are paired; where they are many, as in a
group of documents that are all just too different, they are compared in blocks, a
product of two small matrices that gives the sizes of all intersections, and only
links leave a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineflow.llm.components import components
from lineflow.llm.shipping import ship_package
from lineflow.llm.words import id_and_text, lower_words
from lineflow.workspace import materialize

SKETCH = 32

#: The chance that the sketches of a pair at the threshold share too few values.
RISK = 1e-9

#: Documents on either side of a block, and comparisons under one leader beyond which
#: blocks are made; the links that follow are the same.
BLOCK = 256
BLOCK_COMPARISONS = 2_000

#: Comparisons under one leader beyond which its members are first compared within blocks.
WITHIN_COMPARISONS = 100

#: Pieces into which the members of one leader are dealt where they are joined with it.
DEALT = 16

ROWS_AT_A_TIME = 256


def least_overlap(size: int, percent: int, risk: float = RISK) -> int:
    """The most values that sketches of ``size`` share all but surely at this similarity.

    Each of the ``size`` smallest values of the union is common with the chance of the
    similarity; the number of common ones falls below the result with less than ``risk``.
    """
    share, below = percent / 100, 0.0
    for common in range(size + 1):
        below += comb(size, common) * share**common * (1 - share) ** (size - common)
        if below >= risk:
            return max(1, common)
    return max(1, size)


def shingle_hashes(text: str, width: int):
    """Sorted, different 64-bit hashes of a text's shingles; a short text has one."""
    import numpy as np
    import xxhash

    words = lower_words(text)
    if not words:
        return np.empty(0, np.int64)
    hashed = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), "<u8")
    width = min(width, len(words))
    count = len(words) - width + 1
    joined = np.full(count, width, np.uint64)
    for place in range(width):
        joined = _mixed(joined + hashed[place : place + count])
    return np.unique(joined.view(np.int64))


def _mixed(values):
    """A bijection of 64-bit integers that spreads them evenly."""
    import numpy as np

    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def set_key(shingles) -> bytes:
    """Equal sets, and all but surely no others, have the same key."""
    return hashlib.md5(shingles).digest()


def _sketch_batches(words: int, size: int) -> Callable[[Iterator], Iterator]:
    def sketch(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(start, ROWS_AT_A_TIME)
                sets = [shingle_hashes(text, words) for text in part.column("text").to_pylist()]
                columns = [
                    part.column("doc_id"),
                    part.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) for s in sets], pa.binary()),
                    pa.array([s[:size] for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "node", "sketch"])

    return sketch


def _set_batches(words: int) -> Callable[[Iterator], Iterator]:
    def full_sets(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(start, ROWS_AT_A_TIME)
                sets = [shingle_hashes(text, words) for text in part.column("text").to_pylist()]
                columns = [pa.array([set_key(s) for s in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])

    return full_sets


def _keyed_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, text_key of each row; rows of one id are told apart by the last."""
    return id_and_text(docs, doc_id, text).withColumn("text_key", F.xxhash64("text"))


def near_components(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SKETCH,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if ``100 * common >= percent * all`` holds for their sets of
    ``words``-word shingles, lower-cased in A-Z.  ``component_id`` is the smallest id
    that links lead to; that document is kept.  Null and empty texts, and texts
    without words, have empty sets and no links.  Rows that repeat an id are one
    document, linked by any of its texts.  Rows with a null id take no part: their
    component is null and they are kept.  An empty table gives an empty one.

    Equal sets are one class before anything is compared.  A link between classes is
    confirmed on the full sets; none is made otherwise, and one is missed with a
    chance below RISK.
    """
    sketches, found = _sketches_and_components(docs, words, percent, doc_id, text, size)
    filled = sketches.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # Rows that repeat an id have several sets; the id itself links them.
    several = filled.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a != last")
    same_id = filled.join(several, "doc_id").select("a", F.col("node").alias("b")).filter("a != b").distinct()
    labels = _labelled(filled, _linked_further(found, materialize(same_id, "same-id")))
    least = labels.groupBy("label").agg(F.min("doc_id").alias("component"))
    of_id = materialize(labels.select("doc_id", "label").distinct().join(least, "label").select("doc_id", "component"), "of-id")
    found = sketches.join(of_id.withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def _labelled(filled: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text_key, node and the ``label`` of the node's component."""
    joined = filled.join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    return materialize(joined.select("doc_id", "text_key", "node", F.coalesce("component", "node").alias("label")), "labels")


def _linked_further(found: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after more ``links``, which connect components rather than nodes.

    There are few of these, so what is searched for components again is small.
    """
    if links.isEmpty():
        return found

    def of(end: str) -> DataFrame:
        return found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))

    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b"))
    ends = materialize(ends, "linked-components")
    upper = components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    upper = materialize(upper.select(F.col("node").alias("below"), F.col("component").alias("above")), "upper")
    alone = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct()
    alone = alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    joined = found.unionByName(alone).join(upper, F.col("component") == F.col("below"), "left")
    return materialize(joined.select("node", F.coalesce("above", "component").alias("component")), "components")


def _sketches_and_components(docs: DataFrame, words: int, percent: int, doc_id: str, text: str, size: int):
    """doc_id, text_key, n_shingles, node, sketch of each row; and the component of each linked node.

    A node is the key of a set, so equal sets are one.  Of all links, enough are made to
    connect what any links connect.
    """
    ship_package(docs.sparkSession)
    rows = _keyed_rows(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key long, n_shingles long, node binary, sketch array<long>"
    sketches = materialize(rows.mapInArrow(_sketch_batches(words, size), schema), "sketches")
    filled = sketches.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = filled.groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    )
    classes = materialize(classes, "classes")
    lists = materialize(_inverted_lists(classes, percent, size), "lists")
    # Ids alone are a small table; another text of one of them gives a set that nobody asks for.
    members = lists.select("node").distinct().join(classes.select("node", F.col("least").alias("of")), "node")
    members = materialize(members.select("of").distinct(), "members")
    needed = rows.join(members, rows["doc_id"] == members["of"], "left_semi")
    sets = materialize(needed.mapInArrow(_set_batches(words), "node binary, shingles array<long>"), "sets")
    if sets.count() > members.count():  # rows that repeat an id
        sets = materialize(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

    leaders = lists.groupBy("value").agg(F.min("node").alias("leader"))
    lists = materialize(lists.join(leaders, "value"), "led-lists")
    led = lists.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    links = materialize(_confirmed(led, classes, sets, percent, size), "led-links")
    found = materialize(components(links), "components")
    mixed = _mixed_lists(lists, found, WITHIN_COMPARISONS)
    within = materialize(_compared_within_blocks(mixed.filter("many"), sets, percent), "block-links")
    found = _linked_further(found, within)
    mixed = _mixed_lists(lists, found, BLOCK_COMPARISONS)
    few = _confirmed(_paired(mixed.filter("NOT many"), percent), classes, sets, percent, size)
    many = _compared_in_blocks(mixed.filter("many"), sets, percent)
    return sketches, _linked_further(found, materialize(few.unionByName(many), "near-links"))


def _inverted_lists(classes: DataFrame, percent: int, size: int) -> DataFrame:
    """value, node, n of the values each class is listed under; only values of two classes or more.

    A class that shares ``m`` values at least with any partner shares one of its
    ``s - m + 1`` rarest, and so does the partner, as all rank values alike.  Values
    of one class alone are the rarest of all and lead nowhere.
    """
    listed = classes.select("node", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    often = listed.groupBy("value").agg(F.count("*").alias("often")).filter("often > 1")
    shared = listed.join(often, "value")
    own = Window.partitionBy("node")
    rank = F.row_number().over(own.orderBy("often", "value"))
    least = F.element_at(F.array(*[F.lit(least_overlap(s, percent)) for s in range(1, size + 1)]), F.col("s"))
    ranked = shared.withColumns({"rank": rank, "shared": F.count("*").over(own), "least": least})
    return ranked.filter(F.col("rank") + F.col("s") - F.col("shared") <= F.col("s") - F.col("least") + 1).select(
        "value", "node", "n"
    )


def _mixed_lists(lists: DataFrame, first: DataFrame, comparisons: int) -> DataFrame:
    """The lists that more than one component shares: value, leader, node, n, component, main, many.

    Under each leader the component with the most members is the ``main`` one; the
    other members are compared with all.  ``many`` is true where that is more than so many
    ``comparisons``.  Lists of one leader hold much the same documents.
    """
    labelled = lists.join(first, "node", "left").select(
        "value", "leader", "node", "n", F.coalesce("component", "node").alias("component")
    )
    labelled = materialize(labelled, "labelled")
    ends = labelled.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = labelled.join(ends.filter("low != high").select("value"), "value")
    parts = mixed.groupBy("leader", "component").agg(F.count_distinct("node").alias("members"))
    of_leader = parts.groupBy("leader").agg(
        F.max_by("component", F.struct("members", "component")).alias("main"),
        (F.sum("members") * (F.sum("members") - F.max("members")) > comparisons).alias("many"),
    )
    return materialize(_with_leader(mixed, of_leader), "mixed")


def _with_leader(members: DataFrame, of_leader: DataFrame) -> DataFrame:
    """``members`` joined with one row per leader; the members of one are dealt out, its row is repeated."""
    dealt = members.withColumn("deal", F.pmod(F.xxhash64("node"), F.lit(DEALT)))
    copies = of_leader.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(DEALT - 1).cast("bigint"))))
    return dealt.join(copies, ["leader", "deal"]).drop("deal")


def _paired(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a list."""
    minor = mixed.filter("component != main").select(
        "value", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("of_a")
    )
    other = mixed.select(
        "value", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("of_b"), "main"
    )
    once = (F.col("of_b") == F.col("main")) | (F.col("a") < F.col("b"))
    close = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = minor.join(other, "value").filter((F.col("of_a") != F.col("of_b")) & once & close)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _compared_within_blocks(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components within blocks of one leader's members.

    Every member is in one block, that of one of its leaders, so this takes time and
    moves sets in proportion to the members.  It connects most of what can be, and leaves
    few members to be compared with all.
    """
    members = mixed.groupBy("node", "component").agg(F.min("leader").alias("leader"))
    counts = members.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = _with_leader(members, counts)
    dealt = dealt.withColumns({"minor": F.lit(None).cast("boolean"), "block": F.pmod(F.xxhash64("node", "leader"), "blocks")})
    rows = dealt.select("leader", "block", "node", "component", "minor").join(sets, "node")
    return rows.groupBy("leader", "block").applyInArrow(_block_links(percent), "a binary, b binary").distinct()


def _compared_in_blocks(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components under one leader.

    The minor members and all members of a leader are dealt into blocks of about
    BLOCK documents by a hash, and every minor block meets every block, a task of
    bounded size each.
    """
    members = mixed.select("leader", "node", "component", "main").distinct()
    counts = members.groupBy("leader").agg(
        F.ceil(F.count_if(F.col("component") != F.col("main")) / BLOCK).alias("minor_blocks"),
        F.ceil(F.count("*") / BLOCK).alias("blocks"),
    )
    dealt = _with_leader(members, counts).withColumn("place", F.xxhash64("node"))
    shape = ["leader", "node", "component"]
    minor = dealt.filter("component != main").select(
        *shape,
        F.lit(True).alias("minor"),
        F.pmod("place", "minor_blocks").alias("row"),
        F.explode(F.expr("sequence(0L, blocks - 1)")).alias("column"),
    )
    other = dealt.select(
        *shape,
        F.lit(False).alias("minor"),
        F.explode(F.expr("sequence(0L, minor_blocks - 1)")).alias("row"),
        F.pmod("place", "blocks").alias("column"),
    )
    rows = minor.unionByName(other).join(sets, "node")
    grouped = rows.groupBy("leader", "row", "column")
    return grouped.applyInArrow(_block_links(percent), "a binary, b binary").distinct()


def _block_links(percent: int) -> Callable:
    """Links between the minor members and the others of a block, or among all if none is marked.

    Only as many as connect what is linked: a spanning forest of the components.
    """

    def links(table):
        import numpy as np
        import pyarrow as pa

        minor = table.column("minor").to_pylist()
        nodes, parts = table.column("node").to_pylist(), table.column("component").to_pylist()
        sets = [np.asarray(s.values) for s in table.column("shingles")]
        left = np.array([i for i, m in enumerate(minor) if m is not False], np.int64)
        right = np.array([i for i, m in enumerate(minor) if m is not True], np.int64)
        names = {part: number for number, part in enumerate(dict.fromkeys(parts))}
        part = np.array([names[p] for p in parts], np.int64)
        found = []
        if len(left) and len(right) and len(names) > 1:
            common = np.intersect1d(
                np.unique(np.concatenate([sets[i] for i in left])), np.unique(np.concatenate([sets[i] for i in right]))
            )
            inside = np.zeros((len(left), len(right)), np.float32)
            for start in range(0, len(common), 8192):
                values = common[start : start + 8192]
                inside += _indicator(sets, left, values) @ _indicator(sets, right, values).T
            sizes = np.array([len(s) for s in sets], np.int64)
            inside = inside.astype(np.int64)
            all_of = sizes[left][:, None] + sizes[right][None, :] - inside
            linked = (100 * inside >= percent * all_of) & (part[left][:, None] != part[right][None, :])
            parent = list(range(len(names)))

            def root(of):
                while parent[of] != of:
                    parent[of] = of = parent[parent[of]]
                return of

            for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
                i, j = int(left[i]), int(right[j])
                a, b = root(part[i]), root(part[j])
                if a != b:
                    parent[a] = b
                    found.append(sorted((nodes[i], nodes[j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    return links


def _indicator(sets: list, chosen, values):
    """Row i has a one where set i holds the value of the column; values are sorted."""
    import numpy as np

    matrix = np.zeros((len(chosen), len(values)), np.float32)
    for row, i in enumerate(chosen):
        at = np.searchsorted(values, sets[i])
        at[at == len(values)] = 0
        matrix[row, at[values[at] == sets[i]]] = 1
    return matrix


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    First the sketches: of the bottom-k of their union, enough must be common.  Both
    joins are on one node, with one row of sketch or set per node on the other side.
    """

    def side(name: str) -> DataFrame:
        return classes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    union = F.array_sort(F.array_union("sketch_a", "sketch_b"))
    lowest = F.slice(union, 1, size)
    common = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), lowest))
    least = F.element_at(F.array(*[F.lit(least_overlap(s, percent)) for s in range(1, size + 1)]), F.size(lowest))
    close = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    likely = materialize(both.filter(close & (common >= least)).select("a", "b").distinct(), "likely-pairs")
    sets_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    sets_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    joined = likely.join(sets_a, "a").join(sets_b, "b")
    inside = F.size(F.array_intersect("set_a", "set_b"))
    all_of = F.size("set_a") + F.size("set_b") - inside
    return joined.filter(100 * inside >= percent * all_of).select("a", "b").distinct()


def drop_near_copies(
    docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; columns unchanged.

    Each row is judged by its own text, also where ids repeat: of a component one text of
    the smallest id stays, the one with the smallest set key.  Rows equal in id and text
    are one document and stay or go together.  Rows with a null id and those without
    words stay.
    """
    sketches, found = _sketches_and_components(docs, words, percent, doc_id, text, SKETCH)
    labels = _labelled(sketches.filter("doc_id IS NOT NULL AND n_shingles > 0"), found)
    stays = labels.groupBy("label").agg(F.min(F.struct("doc_id", "node", "text_key")).alias("row")).select("row.*")
    gone = labels.join(stays, ["doc_id", "node", "text_key"], "left_anti").select(
        F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")
    )
    same = (docs[f"`{doc_id}`"] == F.col("gone_id")) & (F.xxhash64(F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))) == F.col("gone_key"))
    return docs.join(materialize(gone.distinct(), "gone"), same, "left_anti").select(*[f"`{c}`" for c in docs.columns])
