import hashlib
import math
import random

import numpy as np
import pytest

from lineflow.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Every part against every entry, in plain integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[math.floor(1024 * x) for x in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for v in cut:
                members.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            for i, own in members.items():
                books[p][i] = [sum(column) // len(own) for column in zip(*own)]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for row, error in zip(kept, errors):
        by_label[row[2]] = by_label.get(row[2], 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(
        [(r[0], "".join(f"{i:02x}" for _, i in f), e, by_label[r[2]], digest) for r, f, e in zip(kept, found, errors)], key=repr
    )


def vectors(seed, n, dims=8):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(size=dims).astype(np.float32)], int(rng.integers(3))) for i in rng.permutation(n)]
    return rows + [(n + i, rows[0][1], None) for i in range(40)]


def coded(spark, rows, **options):
    return sorted(map(tuple, vc.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()), key=repr)


@pytest.mark.parametrize("seed, n, entries, rounds", [(1, 300, 256, 4), (2, 90, 16, 4), (3, 120, 7, 1), (4, 20, 256, 2)])
def test_codes_against_all_entries(spark, seed, n, entries, rounds):
    rows = vectors(seed, n)
    assert coded(spark, rows, entries=entries, rounds=rounds) == plain_codes(rows, entries=entries, rounds=rounds)


def test_odd_vectors(spark):
    rows = [
        (1, None, 1),
        (2, [1.0, None, 0.0, 0.0], 1),
        (3, [float("nan"), 0.0, 0.0, 0.0], 1),
        (4, [0.0, float("-inf"), 0.0, 0.0], 1),
        (9, [-0.00001, 0.25, -0.0, 1.0], None),
        (8, [0.5, 0.5, 0.5, 0.5], None),
        (8, [0.5, 0.5, 0.5, 0.5], 2),
        (None, [0.1, 0.2, 0.3, 0.4], 2),
        (7, [0.0, 0.0, 0.0, 0.0], None),
    ]
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, rows, entries=2) == plain_codes(rows, entries=2)


def test_vectors_that_cannot_be_coded(spark):
    rows = [(1, [1.0] * 4, 1), (2, [1.0] * 6, 1), (3, [], 1), (4, [1e30] * 4, 1), (5, [1.0] * 8, 1)]
    assert [r[0] for r in coded(spark, rows)] == [1]
    assert coded(spark, rows[1:4]) == []


def test_columns_of_clashing_names(spark):
    table = spark.createDataFrame(vectors(5, 30), SCHEMA).selectExpr("*", "'x' AS code", "1 AS error", "'y' AS v", "2 AS part")
    assert vc.compress(table).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vc.compress(table).count() == 70 and vc.compress(table.filter("false")).count() == 0


@pytest.mark.parametrize("width", [1, 4, 16])
def test_nearest_entries_with_ties(width):
    rng = random.Random(width)
    book = np.array([[rng.randrange(-3, 4) for _ in range(width)] for _ in range(60)])
    parts = np.array([[rng.randrange(-4, 5) for _ in range(width)] for _ in range(500)])
    index, distance = vc.nearest_entries(parts, book)
    every = ((parts[:, None] - book[None]) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_search_stops_early(monkeypatch):
    """Sums far apart: few entries are visited."""
    visited = []
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a: visited.append(len(a[1])) or einsum(*a))
    book = np.arange(256)[:, None] * 1000 + np.zeros((1, 4), np.int64)
    vc.nearest_entries(book.astype(np.int64), book.astype(np.int64))
    assert sum(visited) == 256
