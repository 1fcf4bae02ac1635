import hashlib
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lineflow.llm import byte_bpe
from tests.llm.cases import ODD_ROWS

FILES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


def pair(name):
    with open(public_tokenizers.path(name), "rb") as file:
        ours = byte_bpe.encoder_of(file.read())
    theirs = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={}
    )
    return ours, theirs


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aebt hing'é🙂漢\n\t 01", max_size=120)))
def test_pieces_against_the_library(name, text):
    ours, theirs = pair(name)
    if text:
        assert ours.encode_bytes(text.encode()) == theirs._encode_single_piece(text)


def test_long_repetitive_pieces():
    ours, theirs = pair(FILES[0])
    for text in ("a" * 5000, "ab" * 3000, " " * 4000, "thethe" * 800, "!?" * 2000):
        assert ours.encode_bytes(text.encode()) == theirs._encode_single_piece(text)


def test_odd_rows_and_the_table(spark, odd):
    _, theirs = pair(FILES[0])
    path = public_tokenizers.path(FILES[0])
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    for table, rows in ((odd, [r[:2] for r in ODD_ROWS]), (documents, list(texts.items()))):
        encoded = byte_bpe.encode_documents(table, path, public_tokenizers.PATTERN)
        decoded = byte_bpe.decode_documents(encoded, path)
        got = sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in decoded.collect()), key=str)
        want = [(d, theirs.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows]
        assert got == sorted(want, key=str)
    digests = {r.doc_id: r for r in byte_bpe.token_digests(decoded).collect()}
    for doc, text in texts.items():
        ids = theirs.encode_ordinary(text or "")
        assert digests[doc].n_tokens == len(ids)
        assert digests[doc].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_null_ids_and_empty_tables(spark, empty):
    path = public_tokenizers.path(FILES[0])
    encoded = spark.createDataFrame([(1, None), (2, []), (3, [64])], "doc_id long, ids array<int>")
    decoded = {r.doc_id: r.decoded for r in byte_bpe.decode_documents(encoded, path).collect()}
    assert decoded == {1: None, 2: b"", 3: b"a"}
    assert byte_bpe.encode_documents(empty, path, public_tokenizers.PATTERN).collect() == []


def test_forgotten_pieces_are_encoded_again(monkeypatch):
    ours, theirs = pair(FILES[0])
    monkeypatch.setattr(byte_bpe, "REMEMBERED_PIECES", 5)
    monkeypatch.setattr(byte_bpe, "REMEMBERED_PAIRS", 5)
    for _ in range(3):
        for i in range(40):
            ids = ours.pieces[f" word{i}ing"]
            assert list(memoryview(ids).cast("i")) == theirs._encode_single_piece(f" word{i}ing")


def test_workers_keep_only_the_vocabulary():
    """Spark keeps workers beside the heap: after a task nothing remembered is left, and decoding needs no encoder."""
    with open(public_tokenizers.path(FILES[0]), "rb") as file:
        vocabulary = SimpleNamespace(value=file.read())
    encoder = byte_bpe.encoder_of(vocabulary.value)
    rows = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words, Überraschungen"])], ["doc_id", "text"])
    tasks = byte_bpe._encode_batches(vocabulary, public_tokenizers.PATTERN)(iter([rows]))
    ids = next(tasks).column("ids")[0].as_py()
    assert encoder.pieces and encoder.compatible
    assert list(tasks) == []
    assert not encoder.pieces and not encoder.pieces.older and not encoder.compatible
    table = byte_bpe.token_table(vocabulary.value)
    assert b"".join(table[i] for i in ids).decode() == "some words, Überraschungen"
