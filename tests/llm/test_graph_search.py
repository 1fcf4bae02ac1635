import numpy as np
import pytest

from lineflow.llm import graph_search as gs

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_nearest(rows, queries, nearest):
    """Of each query all candidates, best first."""
    found = {}
    for query_id, query in queries:
        scored = []
        for vec_id, vector in rows:
            if vec_id != query_id and len(vector) == len(query):
                score = 0.0
                for x, y in zip(query, vector):
                    score += x * y
                scored.append((-score, vec_id))
        found[query_id] = [(v, -s) for s, v in sorted(set(scored))[:nearest]]
    return found


def searched(spark, rows, query_ids, nearest=20, **options):
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    queries = table.filter(table.vec_id.isin(query_ids))
    result = {}
    for row in gs.nearest_neighbours(table, queries, nearest, **options).orderBy("query_id", "rank").collect():
        result.setdefault(row.query_id, []).append((row.vec_id, row.score))
        assert row.rank == len(result[row.query_id])
    return result


def clustered(seed, n, dims, scale=0.0):
    """Clusters, lengths that vary by ``scale``, as floats."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    vectors = centres[rng.integers(12, size=n)] + rng.normal(size=(n, dims))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors *= np.exp(scale * rng.normal(size=(n, 1)))
    return [(i, [float(x) for x in v]) for i, v in enumerate(vectors.astype(np.float32))]


@pytest.mark.parametrize("seed, n, dims, scale, shard_rows", [(1, 3000, 64, 0.0, 8192), (2, 3000, 24, 0.5, 700), (3, 900, 4, 1.0, 100)])
def test_recall_against_all_rows(spark, seed, n, dims, scale, shard_rows):
    rows = clustered(seed, n, dims, scale)
    ids = [i for i, _ in rows if i % 20 == 0]
    found = searched(spark, rows, ids, shard_rows=shard_rows)
    wanted = plain_nearest(rows, [rows[i] for i in ids], 20)
    hits = [len({v for v, _ in found[i]} & {v for v, _ in wanted[i]}) / 20 for i in ids]
    assert np.mean(hits) > 0.95
    scores = {(q, v): s for q, best in plain_nearest(rows, [rows[i] for i in ids], n).items() for v, s in best}
    for query, best in found.items():
        assert len(best) == 20 and best == sorted(best, key=lambda x: (-x[1], x[0]))
        assert all(score == scores[query, v] for v, score in best)


def test_few_candidates_and_copies(spark):
    """A third of all rows is one vector; ties go to the smaller ids, and few rows give few."""
    rows = clustered(4, 200, 8) + [(1000 - i, [1.0] * 8) for i in range(100)]
    found = searched(spark, rows, [1000, 20])
    assert found[1000] == plain_nearest(rows, [(1000, [1.0] * 8)], 20)[1000]
    few = clustered(5, 6, 3)
    assert searched(spark, few, [0, 3]) == plain_nearest(few, [few[0], few[3]], 20)
    assert searched(spark, few[:1], [0]) == {}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, -0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, -inf]), (None, [1.0, 1.0]), (6, [])]
    good = [(7, [1.0, 2.0]), (8, [2.0, 1.0]), (8, [2.0, 1.0]), (9, [-3e38, 3e38]), (10, [1e-40, 0.0]), (11, [1.0, 2.0, 3.0])]
    found = searched(spark, rows + good, [1, 2, 3, 4, 5, 6, 7, 9, 11])
    usable = [(i, [float(np.float32(x)) for x in v]) for i, v in good]
    assert found == {q: best for q, best in plain_nearest(usable, [usable[0], usable[3]], 20).items()}


def test_an_id_with_two_vectors_and_no_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])]
    assert searched(spark, rows, [1])[1] == [(3, 2.0), (2, 1.0), (2, 0.0)]
    table = spark.createDataFrame([], SCHEMA).selectExpr("*", "1 AS score", "'a' AS v", "2 AS shard")
    assert gs.nearest_neighbours(table, table).collect() == []


@pytest.mark.parametrize("clusters", [3, 40, 150])
def test_clusters_far_apart(clusters):
    """No edge leads from one cluster to another; every one is found all the same."""
    rng = np.random.default_rng(clusters)
    vectors = rng.normal(size=(clusters, 32))[rng.integers(clusters, size=4000)] * 10 + rng.normal(size=(4000, 32))
    points = gs.level_vectors(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    edges, starts = gs.build_graph(points)
    found, _ = gs.beam_search(points, edges, starts, points[::20], gs.BEAM)
    every = np.argsort(-(points[::20] @ points.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b[:20])) / 20 for a, b in zip(every.tolist(), found.tolist())]) > 0.95


def test_pruning_keeps_directions():
    """Of points on a line only the next one on each side is kept."""
    points = gs.level_vectors(np.array([[np.cos(a), np.sin(a)] for a in np.linspace(0, 1, 11)]))
    edges = gs.robust_prune(points, np.array([5]), np.array([[0, 1, 2, 3, 4, 6, 7, 8, 9, 10, -1]]), 4, 1.0)
    assert sorted(edges[0][edges[0] >= 0].tolist()) == [4, 6]


def test_graphs_are_whole_and_repeatable():
    points = gs.level_vectors(np.array([v for _, v in clustered(6, 1500, 16)]))
    edges, starts = gs.build_graph(points)
    again, _ = gs.build_graph(points)
    assert (edges == again).all() and edges.shape == (1500, gs.DEGREE)
    reached, ahead = set(starts.tolist()), starts.tolist()
    while ahead:
        ends = {int(e) for e in edges[ahead].ravel() if e >= 0} - reached
        reached |= ends
        ahead = list(ends)
    assert len(reached) == 1500
