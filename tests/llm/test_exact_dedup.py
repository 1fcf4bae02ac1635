import hashlib

from pyspark.sql import functions as F

from lineflow.llm import exact_dedup
from tests.llm.cases import LOW, ODD_ROWS, sentence


def brute(rows):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault((text or "").translate(LOW), []).append(doc)
    found = []
    for doc, text, *_ in rows:
        normal = (text or "").translate(LOW)
        ids = groups[normal]
        keep = max((i for i in ids if i is not None), default=None)
        found.append((doc, keep, len(ids), doc == keep, hashlib.sha256(normal.encode()).hexdigest()))
    return sorted(found, key=str)


def rows_of(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()], key=str)


def test_odd_rows(odd):
    assert rows_of(exact_dedup.exact_groups(odd)) == brute(ODD_ROWS)


def test_empty_table(empty):
    assert exact_dedup.exact_groups(empty).collect() == []
    assert exact_dedup.drop_exact_copies(empty).columns == empty.columns


def test_texts_that_differ_in_one_place(docs):
    text = sentence(3, 5000)
    rows = [(1, text), (2, text.upper()), (3, text[:-1] + "!"), (4, text + " "), (5, "É" + text), (6, "é" + text)]
    assert rows_of(exact_dedup.exact_groups(docs(*rows))) == brute(rows)


def test_chunks_join_to_the_text(docs, spark):
    texts = [sentence(4, 3000), "a" * 9000, "", "x\n" * 4000, "漢。" * 3000, "🙂" * 5000]
    cut = docs(*enumerate(texts)).select("doc_id", exact_dedup.chunks_of(F.col("text")).alias("chunks"))
    for row in cut.collect():
        assert "".join(row.chunks) == texts[row.doc_id]
        assert all(len(c) <= exact_dedup.MAX_CHUNK for c in row.chunks)


def test_a_shared_passage_shares_chunks(docs):
    tail = ". ".join(sentence(i, 40) for i in range(40))
    cut = docs((1, sentence(50, 200) + tail), (2, tail)).select(exact_dedup.chunks_of(F.col("text")).alias("chunks"))
    first, second = (set(row.chunks) for row in cut.collect())
    assert len(first & second) > len(second) / 2


def test_ids_that_stand_for_several_chunks_are_told_apart(docs, monkeypatch):
    """With a hash that cannot tell any chunks apart, results stay right."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [(1, sentence(1, 900)), (2, sentence(2, 900)), (3, sentence(1, 900).upper()), (4, None), (5, "")]
    assert rows_of(exact_dedup.exact_groups(docs(*rows))) == brute(rows)


def test_copies_go_and_columns_stay(odd):
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([None, None, -5, 2, 3, 5, 5, 6, 8, 9, 10, 11, 12, 13], key=str)


def test_no_python_runs(odd):
    plan = exact_dedup.exact_groups(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_rows_of_one_id_and_of_none_go_by_their_own_text(docs):
    rows = [(5, "a text of its own"), (5, "A copy"), (9, "a copy"), (None, "a COPY"), (None, "none has it"), (None, "nor this"), (5, None), (7, "")]
    kept = exact_dedup.drop_exact_copies(docs(*rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([rows[i] for i in (0, 2, 4, 5, 7)], key=str)


def test_shared_hashes_under_repeated_and_null_ids(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    texts = [sentence(1, 900), sentence(2, 900), sentence(1, 900).upper()]
    rows = [(i, t) for i in (1, 1, None) for t in texts] + [(2, texts[0])]
    assert rows_of(exact_dedup.exact_groups(docs(*rows))) == brute(rows)
