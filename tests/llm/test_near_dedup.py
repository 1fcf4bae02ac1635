import random

import pytest

from lineflow.llm import near_dedup as nd
from lineflow.llm.components import components
from tests.llm.cases import ODD_ROWS, plain_components, plain_shingles


def variant(words, seed, changes):
    rng = random.Random(seed)
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"changed{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    """Copies, near copies around the threshold, chains, a passage many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for group in range(6):
        base = [word() for _ in range(rng.choice([8, 40, 200, 400]))]
        texts += [variant(base, i, rng.choice([0, 0, 1, 2, 3, 5, 8])) for i in range(rng.choice([2, 5, 30]))]
    chain = [word() for _ in range(300)]
    for step in range(12):
        chain[step * 20 : step * 20 + 8] = [word() for _ in range(8)]
        texts.append(" ".join(chain))
    texts += [" ".join(passage + [word() for _ in range(rng.choice([5, 20, 100]))]) for _ in range(40)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 6))) for _ in range(20)] + ["", None, "a", "A", " a "]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(
    "seed, width, percent, block, many", [(1, 3, 85, 256, 2000), (2, 5, 80, 256, 0), (3, 1, 60, 7, 0), (4, 3, 85, 5, 100)]
)
def test_components_against_all_pairs(docs, monkeypatch, seed, width, percent, block, many):
    """Comparing in pairs, in one block, and in many small ones."""
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "BLOCK_COMPARISONS", many)
    monkeypatch.setattr(nd, "WITHIN_COMPARISONS", many // 20)
    rows = corpus(seed)
    found = nd.near_components(docs(*rows), words=width, percent=percent).collect()
    wanted = plain_components(rows, width, percent)
    assert {r.doc_id: r.component_id for r in found} == wanted
    assert {r.doc_id: r.n_shingles for r in found} == {d: len(plain_shingles(t, width)) for d, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_odd_rows(odd):
    found = nd.near_components(odd, words=3, percent=85).collect()
    wanted = plain_components([r[:2] for r in ODD_ROWS], 3, 85)
    assert len(found) == len(ODD_ROWS)
    assert all(r.component_id == wanted.get(r.doc_id) for r in found)
    assert all(r.kept for r in found if r.doc_id is None)


def test_an_id_with_several_texts_is_one_document(docs):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    found = nd.near_components(docs((1, one), (2, one), (2, two), (3, two)), words=3, percent=85).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (2, 1), (3, 1)}


def test_empty_table(empty):
    assert nd.near_components(empty).collect() == []
    assert nd.drop_near_copies(empty).columns == empty.columns


def test_one_of_each_group_stays(docs):
    rows = corpus(4)
    kept = nd.drop_near_copies(docs(*rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept.collect()} == set(plain_components(rows, 5, 80).values())


def test_a_group_takes_no_more_pairs_than_members(docs, monkeypatch):
    """300 near copies: the leaders connect them, and nothing is left to compare."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, variant(base, i, 2)) for i in range(300)]
    pairs = []
    confirmed = nd._confirmed

    def counted(candidates, *rest):
        pairs.append(candidates.distinct().count())
        return confirmed(candidates, *rest)

    monkeypatch.setattr(nd, "_confirmed", counted)
    found = nd.near_components(docs(*rows), words=3, percent=85).collect()
    assert {r.component_id for r in found} == {0}
    assert pairs[0] < 300 * 25 and pairs[1] == 0


@pytest.mark.parametrize("size", [100, 200, 400])
def test_links_grow_with_members_only(docs, monkeypatch, size):
    """Near copies around the threshold: each doubling doubles the links, not more."""
    rng = random.Random(size)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, variant(base, i, rng.choice([0, 4, 8, 12]))) for i in range(size)]
    counted = []
    monkeypatch.setattr(nd, "components", lambda links: counted.append(links.count()) or components(links))
    found = nd.near_components(docs(*rows), words=5, percent=80).collect()
    assert {r.doc_id: r.component_id for r in found} == plain_components(rows, 5, 80)
    assert sum(counted) < 3 * size


def test_rows_of_one_id_are_judged_by_their_own_text(docs):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    kept = nd.drop_near_copies(docs((3, one), (5, one + " end"), (5, two), (None, one), (None, one)))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, one), (0, one), (3, one), (5, two)]


def test_least_overlap():
    assert nd.least_overlap(1, 85) == 1
    assert 8 <= nd.least_overlap(32, 80) <= nd.least_overlap(32, 85) <= 20
    assert nd.least_overlap(32, 100) == 32


@pytest.mark.parametrize("shape", ["none", "chain", "star", "rings", "random"])
def test_connected_components(spark, shape):
    rng = random.Random(5)
    links = {
        "none": [(1, 1), (None, 2), (3, None)],
        "chain": [(i, i + 1) for i in range(300)],
        "star": [(500, i) for i in range(200)],
        "rings": [(10 * r + i, 10 * r + (i + 1) % 7) for r in range(20) for i in range(7)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)],
    }[shape]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent}
