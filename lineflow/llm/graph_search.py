"""Nearest neighbours by inner product over robust-pruned directed graphs.

Vectors are dealt into shards by a hash of their components; each shard is a directed
graph with a bounded number of edges per node.  A new node's neighbours are proposed by
a greedy search for it in the graph so far; of what the search met, edges are kept from
near to far, and one is dropped if a kept neighbour is closer to its end than the node
is by more than a factor.  That keeps edges in all directions, so that a beam search
reaches any part of the shard; it begins with the nearest of some nodes that are spread
over it.  Each query searches every shard.

The graph is over Euclidean distances.  One more component makes all vectors of a shard
equally long, and then the nearest ones have the largest inner product.  The graph works
in single precision; what it finds is scored again in double precision on the vectors as
they are.

Equal vectors are one node with its smallest ids: as many as can be among a query's
nearest.  So a group of copies of any size is no obstacle in a graph, and nothing that
could be found is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineflow.llm.shipping import ship_package
from lineflow.workspace import materialize

#: Nodes of a shard.  Every query searches every shard, so larger tables want larger ones.
SHARD_ROWS = 8_192

#: Queries that one task searches a shard with.
QUERY_ROWS = 4_096

#: Edges that leave a node, candidates kept when a node is inserted and when a query is
#: searched, and the factor of the pruning.
DEGREE = 32
BUILD_BEAM = 64
BEAM = 96
SLACK = 1.2

#: A shard has a start for so many nodes, and at least so many starts.
NODES_PER_START = 64
MIN_STARTS = 64

#: Nodes inserted together, queries searched together, nodes expanded together.
BATCH = 512
WIDTH = 4

SEED = 20_240_229


def level_vectors(vectors):
    """Rows in single precision, scaled to at most length 1, with a component that fills each up to it."""
    import numpy as np

    scaled = vectors / max(np.abs(vectors).max(initial=0), np.finfo(float).tiny)
    squares = np.einsum("ij,ij->i", scaled, scaled)
    longest = max(squares.max(initial=0), np.finfo(float).tiny)
    rest = np.sqrt(np.maximum(0, 1 - squares / longest))
    return np.column_stack([scaled / np.sqrt(longest), rest]).astype(np.float32)


def beam_search(points, edges, starts, targets, beam: int, width: int = WIDTH):
    """Nodes found and expanded for each of the ``targets``, all searched in step.

    A search begins with the nearest of the ``starts``.

    Returns found (targets by ``beam``, best first, -1 where there are none), and the
    expanded nodes of each target, padded by -1.  In each step a target expands its
    ``width`` best nodes that are not expanded yet, until all it has found are.
    """
    import numpy as np

    count, degree = len(targets), edges.shape[1]
    found = np.full((count, beam), -1, np.int64)
    near = np.full((count, beam), -np.inf, np.float32)
    opened = np.ones((count, beam), bool)
    first = targets @ points[starts].T
    order = np.argsort(-first, axis=1, kind="stable")[:, :beam]
    known = order.shape[1]
    found[:, :known], near[:, :known], opened[:, :known] = starts[order], np.take_along_axis(first, order, 1), False
    seen = np.zeros((count, len(points)), bool)
    seen[:, starts] = True
    steps = []
    active = np.arange(count)
    while len(active):
        # Best first, so the first ones that are not opened are the next.
        waiting = ~opened[active]
        turn = np.cumsum(waiting, axis=1)
        chosen = waiting & (turn <= width)
        opened[active] |= chosen
        row, column = np.nonzero(chosen)
        node = found[active[row], column]
        step = np.full((len(active), width), -1, np.int64)
        step[row, turn[row, column] - 1] = node
        steps.append((active, step))

        fresh = np.full((len(active), width * degree), -1, np.int64)
        for place in range(width):
            ends = np.where(step[:, place, None] >= 0, edges[step[:, place]], -1)
            new = (ends >= 0) & ~seen[active[:, None], ends]
            at, end = np.nonzero(new)
            seen[active[at], ends[at, end]] = True
            fresh[:, place * degree : (place + 1) * degree][at, end] = ends[at, end]
        at, place = np.nonzero(fresh >= 0)
        close = np.full(fresh.shape, -np.inf, np.float32)
        close[at, place] = np.einsum("ij,ij->i", targets[active[at]], points[fresh[at, place]])

        nodes = np.concatenate([found[active], fresh], axis=1)
        values = np.concatenate([near[active], close], axis=1)
        done = np.concatenate([opened[active], fresh < 0], axis=1)
        best = np.argsort(-values, axis=1, kind="stable")[:, :beam]
        found[active], near[active] = np.take_along_axis(nodes, best, 1), np.take_along_axis(values, best, 1)
        opened[active] = np.take_along_axis(done, best, 1)
        active = active[~opened[active].all(axis=1)]
    expanded = np.full((count, len(steps) * width), -1, np.int64)
    for turn, (rows, step) in enumerate(steps):
        expanded[rows, turn * width : (turn + 1) * width] = step
    return found, expanded


def robust_prune(points, nodes, candidates, degree: int, slack: float):
    """Edges of ``nodes`` out of their ``candidates`` (padded by -1): nodes by ``degree``.

    The nearest candidate is kept; those closer to it than to the node by more than the
    factor ``slack`` go; and so on with the nearest one left.
    """
    import numpy as np

    own = points[nodes]
    safe = np.maximum(candidates, 0)
    ends = points[safe]
    away = 2 - 2 * np.einsum("ij,ikj->ik", own, ends)
    away[(candidates < 0) | (candidates == nodes[:, None])] = np.inf
    order = np.argsort(away, axis=1, kind="stable")
    order = order[:, : int(np.isfinite(away).sum(axis=1).max(initial=0))]
    away = np.take_along_axis(away, order, 1)
    safe = np.take_along_axis(safe, order, 1)
    ends = points[safe]
    between = 2 - 2 * (ends @ ends.transpose(0, 2, 1))
    alive = np.isfinite(away)
    edges = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for place in range(degree):
        rows = rows[alive[rows].any(axis=1)]
        if not len(rows):
            break
        first = alive[rows].argmax(axis=1)
        edges[rows, place] = safe[rows, first]
        alive[rows] &= slack**2 * between[rows, first] > away[rows]
        alive[rows, first] = False
    return edges


def build_graph(points, degree: int = DEGREE, beam: int = BUILD_BEAM, slack: float = SLACK):
    """Edges (nodes by ``degree``, padded by -1) and the start nodes of a graph over ``points``.

    The starts go first, the other nodes follow in a fixed random order, in batches that
    double up to BATCH: all of a batch search the graph before it, so a retried task
    builds the same graph.  A node that no path leads to becomes a start itself.
    """
    import numpy as np

    count = len(points)
    edges = np.full((count, degree), -1, np.int64)
    starts = spread_nodes(points, max(MIN_STARTS, count // NODES_PER_START))
    order = np.random.default_rng(SEED).permutation(count)
    order = np.concatenate([starts, order[~np.isin(order, starts)]])
    begun, size = 1, 1
    while begun < count:
        batch = order[begun : begun + size]
        _, expanded = beam_search(points, edges, starts[:begun], points[batch], beam)
        edges[batch] = robust_prune(points, batch, expanded, degree, slack)
        _add_backward(points, edges, batch, degree, slack)
        begun += size
        size = min(2 * size, BATCH)
    return edges, _reaching_all(edges, starts)


def spread_nodes(points, number: int):
    """Nodes far from each other: the middle one, then always the one farthest from all before.

    Clusters may be so dense that no edge leaves them; each has its own way in.
    """
    import numpy as np

    if not len(points):
        return np.empty(0, np.int64)
    chosen = [int(np.argmax(points @ points.mean(axis=0)))]
    nearest = points @ points[chosen[0]]
    while len(chosen) < min(number, len(points)):
        nearest[chosen[-1]] = np.inf
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
        nearest[chosen] = np.inf
    return np.array(chosen, np.int64)


def _reaching_all(edges, starts):
    """``starts`` and, of the nodes they do not lead to, as many as lead to all."""
    import numpy as np

    reached = np.zeros(len(edges), bool)
    found, ahead = list(starts), np.asarray(starts)
    while True:
        while len(ahead):
            reached[ahead] = True
            ends = np.unique(edges[ahead])
            ahead = ends[(ends >= 0) & ~reached[np.maximum(ends, 0)]]
        if reached.all():
            return np.array(found, np.int64)
        found.append(int(np.argmin(reached)))
        ahead = np.array(found[-1:])


def _add_backward(points, edges, batch, degree: int, slack: float) -> None:
    """Each new edge also leads back; nodes that get too many are pruned again."""
    import numpy as np

    source = np.repeat(batch, degree)
    target = edges[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, added = np.unique(target, return_index=True, return_counts=True)
    has = (edges[nodes] >= 0).sum(axis=1)
    # Few nodes get very many edges; those of like counts are pruned together.
    by_size = np.argsort(has + added, kind="stable")
    at = 0
    while at < len(by_size):
        some = by_size[at : at + BATCH]
        most = int((has + added)[some].max())
        if most > degree:
            some = some[: max(1, min(len(some), 2**23 // most**2))]
            most = int((has + added)[some].max())
        candidates = np.full((len(some), max(most, degree)), -1, np.int64)
        candidates[:, :degree] = edges[nodes[some]]
        # Edges fill their rows from the left, new ones go behind them.
        row = np.repeat(np.arange(len(some)), added[some])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(added[some]) - added[some], added[some])
        candidates[row, has[some][row] + nth] = source[first[some][row] + nth]
        if most > degree:
            edges[nodes[some]] = robust_prune(points, nodes[some], candidates, degree, slack)
        else:
            edges[nodes[some]] = candidates[:, :degree]
        at += len(some)


def _vectors_of(table, name: str):
    import numpy as np

    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _index_shard(table):
    """The nodes of a shard with their edges, by place in the shard."""
    import numpy as np
    import pyarrow as pa

    # A shuffle brings rows in any order; the graph must not depend on it.
    table = table.take(np.lexsort(_vectors_of(table, "v").T))
    edges, starts = build_graph(level_vectors(_vectors_of(table, "v")))
    lists = pa.array([row[row >= 0].tolist() for row in edges], pa.list_(pa.int32()))
    place = np.arange(table.num_rows)
    columns = [table.column(c) for c in ("dims", "shard", "v", "ids")]
    columns += [pa.array(place, pa.int32()), lists, pa.array(np.isin(place, starts))]
    return pa.table(columns, ["dims", "shard", "v", "ids", "place", "edges", "start"])


def _search_shard(nearest: int, beam: int) -> Callable:
    def search(index, queries):
        import numpy as np
        import pyarrow as pa

        names = ["query_id", "query", "vec_id", "score"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.float64()]
        if not index.num_rows or not queries.num_rows:
            return pa.table([pa.array([], kind) for kind in kinds], names)
        index = index.sort_by("place")
        vectors, ids = _vectors_of(index, "v"), index.column("ids").to_pylist()
        lists = index.column("edges").to_pylist()
        edges = np.full((len(lists), max(1, max(map(len, lists)))), -1, np.int64)
        for row, ends in enumerate(lists):
            edges[row, : len(ends)] = ends
        starts = np.flatnonzero(index.column("start").to_numpy())
        points = level_vectors(vectors)
        wanted, query_ids, keys = _vectors_of(queries, "v"), queries.column("query_id").to_numpy(), queries.column("query")
        largest = np.abs(wanted).max(axis=1, keepdims=True)
        targets = np.column_stack([wanted / largest, np.zeros(len(wanted))]).astype(np.float32)
        chunks = []
        for begin in range(0, len(wanted), BATCH):
            rows = np.arange(begin, min(begin + BATCH, len(wanted)))
            found, _ = beam_search(points, edges, starts, targets[rows], beam)
            at, place = np.nonzero(found >= 0)
            node = found[at, place]
            with np.errstate(over="ignore", invalid="ignore"):
                score = np.zeros(len(node))
                for axis in range(vectors.shape[1]):  # in the order of the components
                    score += wanted[rows[at], axis] * vectors[node, axis]
            many = np.array([len(ids[n]) for n in node])
            query = np.repeat(rows[at], many)
            other = np.fromiter((i for n in node for i in ids[n]), np.int64, many.sum())
            score = np.repeat(score, many)
            keep = other != query_ids[query]
            query, other, score = query[keep], other[keep], score[keep]
            order = np.lexsort((other, -score, query))
            query, other, score = query[order], other[order], score[order]
            first = np.searchsorted(query, query)
            keep = np.arange(len(query)) - first < nearest
            query, other, score = query[keep], other[keep], score[keep]
            columns = [pa.array(query_ids[query], pa.int64()), keys.take(pa.array(query)).combine_chunks()]
            chunks.append(pa.table([*columns, pa.array(other, pa.int64()), pa.array(score)], names))
        return pa.concat_tables(chunks)

    return search


def usable_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v, dims of the rows with an id and a finite vector that is not all zero."""
    wide = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(wide, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    some = F.exists(wide, lambda x: F.coalesce(x != 0, F.lit(False)))
    usable = table.filter(F.col(f"`{vec_id}`").isNotNull() & wide.isNotNull() & finite & some).select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.transform(wide, lambda x: x + 0.0).alias("v")
    )  # adding zero makes one of the two zeros, which are equal
    return usable.withColumn("dims", F.size("v"))


def build_index(vectors: DataFrame, nearest: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Graphs of all ``vectors`` (vec_id, v, dims): dims, shard, v, ids, place, edges, start.

    ``ids`` holds the ``nearest + 1`` smallest ids of the vector, all that can be among
    the nearest of a query other than itself.
    """
    same = Window.partitionBy("v").orderBy("vec_id")
    # Ranks beyond the limit go before the shuffle, so a vector's copies do not meet in one task.
    least = vectors.distinct().withColumn("rank", F.row_number().over(same)).filter(F.col("rank") <= nearest + 1)
    nodes = least.groupBy("v").agg(F.first("dims").alias("dims"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(nodes, "nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    schema = "dims int, shard int, v array<double>, ids array<long>, place int, edges array<int>, start boolean"
    return materialize(dealt.groupBy("dims", "shard").applyInArrow(_index_shard, schema), "graphs")


def search_index(
    index: DataFrame, queries: DataFrame, nearest: int, beam: int = BEAM, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``nearest`` of each query (vec_id, v, dims) found in all shards."""
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, -(-queries.count() // query_rows))
    asked = queries.select(
        F.col("vec_id").alias("query_id"), F.unhex(F.md5(F.to_json(F.struct("v")))).alias("query"), "v", "dims",
        F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("dims", "shard", "block")
    met = copies.groupBy(*keys).cogroup(asked.groupBy(*keys))
    found = met.applyInArrow(_search_shard(nearest, beam), "query_id long, query binary, vec_id long, score double")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(
    table: DataFrame,
    queries: DataFrame,
    nearest: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    beam: int = BEAM,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The ``nearest`` rows of ``table`` found for each row of ``queries``: query_id, rank, vec_id, score.

    ``score`` is the inner product in double precision; the largest is nearest, ties go
    to the smaller id.  A query's own id is no candidate.  Vectors that are null, all
    zero, or hold null or non-finite components take no part, nor do rows without an id;
    only vectors of one length are compared.  Repeated rows are one row; an id with
    several vectors is a candidate by each of them, and searched by each.  Empty tables
    give an empty result.
    """
    ship_package(table.sparkSession)
    index = build_index(usable_vectors(table, vec_id, vector), nearest, shard_rows)
    asked = materialize(usable_vectors(queries, vec_id, vector).distinct(), "queries")
    return search_index(index, asked, nearest, beam)
