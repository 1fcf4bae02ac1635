import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lineflow.llm import byte_bpe, mixing, quality_rules, queries
from lineflow.workspace import materialize
from tests.llm.cases import LOW, plain_components
from tests.llm.test_mixing import targets_by_rounds

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_force(rows):
    """The stages with plain Python; returns what each keeps."""
    clean = []
    for row in rows:
        counts, left = quality_rules.assess(row["text"] or "", quality_rules.Rules())
        if quality_rules.verdict(counts, quality_rules.Rules())[1]:
            clean.append(row | {"text": left, "n_chars": len(left)})
    last = {}
    for row in clean:
        key = row["text"].translate(LOW)
        last[key] = max(last.get(key, -1), row["doc_id"])
    exact = [r for r in clean if last[r["text"].translate(LOW)] == r["doc_id"]]
    component = plain_components([(r["doc_id"], r["text"]) for r in exact], 5, 80)
    near = [r for r in exact if component[r["doc_id"]] == r["doc_id"]]
    return clean, exact, near, mixed(near)


def mixed(rows):
    """Documents in md5 order, whole passes and then as far as the target goes."""
    size = {r["doc_id"]: len(quality_rules.find_words(r["text"])) for r in rows}
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    totals = {s: sum(size[r["doc_id"]] for r in own) for s, own in by_source.items()}
    taken = []
    for source, target in targets_by_rounds(totals).items():
        whole = min(3, int(target / totals[source] + 1e-12))
        before = 0
        for r in sorted(by_source[source], key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest()):
            more = whole < 3 and 2 * before + size[r["doc_id"]] <= 2 * (target - whole * totals[source])
            taken += [r] * (whole + more)
            before += size[r["doc_id"]]
    return taken


def test_stages_and_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    wanted = brute_force([r.asDict() for r in docs.collect()])
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], wanted):
        docs = materialize(stage(spark, docs, SF_DIR), name)
        assert docs.columns == COLUMNS
        key = lambda r: str([r[c] for c in COLUMNS])
        assert sorted((r.asDict() for r in docs.collect()), key=key) == sorted(rows, key=key), name
    with open(queries.BYTE_RANKS, "rb") as file:
        ranks = byte_bpe.parse_ranks(file.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in wanted[-1]:
        ids = library.encode_ordinary(r["text"])
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((r["doc_id"], len(ids), digest, hashlib.sha256(r["text"].encode()).hexdigest()))
    found = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd, empty, stage):
    assert stage(spark, empty, SF_DIR).collect() == []
    found = stage(spark, odd, SF_DIR)
    assert found.count() > 0
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert found.columns == odd.columns


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names
    assert sorted({int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()}) == list(range(1, 14))
    assert {"op9_exact_dedup", "op10_mixing", "op11_merkle", "op12_vector_codes"} <= set(entry.oracle_sql())
    assert mixing.WEIGHTS == (1, 2, 3) and F is not None
