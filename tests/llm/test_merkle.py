import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lineflow.llm import merkle
from tests.llm.cases import LOW, ODD_ROWS, SCHEMA


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha(*map(framed, (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves, fanout):
    """Root of a list of digests, and for each leaf the steps (before, after) up to it."""
    paths = [[] for _ in leaves]
    groups = [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        above, joined = [], []
        for start in range(0, len(leaves), fanout):
            run = leaves[start : start + fanout]
            for place, members in enumerate(groups[start : start + fanout]):
                for leaf in members:
                    paths[leaf].append(("".join(run[:place]), "".join(run[place + 1 :])))
            above.append(sha(*run))
            joined.append(sum(groups[start : start + fanout], []))
        leaves, groups = above, joined
    return leaves[0], paths


def plain_manifest(rows, fanout=8):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    found, subroots = [], []
    for name in names:
        ordered = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        subroot, paths = plain_tree([leaf_of(r, r[1]) for r in ordered], fanout)
        subroots.append(subroot)
        found += [(row, path, name, subroot) for row, path in zip(ordered, paths)]
    root, tops = plain_tree(subroots, fanout)
    result = []
    for row, path, name, subroot in found:
        path = path + tops[names.index(name)]
        changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        text = row[1].translate(LOW) if changed and row[1] is not None else row[1]
        folded = leaf_of(row, text)
        for before, after in path:
            folded = sha(before, folded, after)
        proof = sha(*[before + after for before, after in path])
        result.append((row[0], leaf_of(row, row[1]), subroot, root, proof, folded, folded == root))
    return sorted(result, key=repr)


def tampered():
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(changed, F.translate("text", "".join(map(chr, LOW)), "".join(map(chr, LOW.values())))).otherwise(F.col("text"))


def audited(docs, fanout=8):
    return sorted(map(tuple, merkle.audit(merkle.manifest(docs, tampered(), fanout=fanout)).collect()), key=repr)


@pytest.mark.parametrize("fanout, sizes", [(8, [1, 7, 8, 9, 64, 65, 200]), (2, [1, 2, 3, 17]), (3, [30] * 11)])
def test_trees_of_many_sizes(spark, fanout, sizes):
    rng = random.Random(1)
    ids = rng.sample(range(10**6), sum(sizes))
    rows = []
    for place, size in enumerate(sizes):
        lang = None if place == 2 else f"l{place}é"
        rows += [(ids.pop(), f"Text {rng.random()}", lang, rng.choice(["a", None, ""]), 7) for _ in range(size)]
    assert audited(spark.createDataFrame(rows, SCHEMA), fanout) == plain_manifest(rows, fanout)


def test_odd_rows(odd):
    assert audited(odd) == plain_manifest(ODD_ROWS)


def test_one_document_and_none(spark, empty):
    row = (3, "Only ONE", "en", "a", 8)
    assert audited(spark.createDataFrame([row], SCHEMA)) == plain_manifest([row])
    assert audited(empty) == []


def test_any_changed_field_is_found(docs):
    rows = docs(*[(i, f"text {i}") for i in range(100)])
    untouched = merkle.audit(merkle.manifest(rows)).filter("NOT verified")
    assert untouched.count() == 0
    changed = F.when(F.col("doc_id") == 57, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    found = merkle.audit(merkle.manifest(rows, changed)).filter("NOT verified")
    assert [r.doc_id for r in found.collect()] == [57]
