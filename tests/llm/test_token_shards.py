import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from lineflow.llm import token_shards as ts
from lineflow.llm.words import slices_of
from lineflow.workspace import scratch_path
from tests.llm.cases import ODD_ROWS

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 70_000])
@pytest.mark.parametrize("bits", [1, 5, 16, 17])
def test_matrix_against_a_list(n, bits, monkeypatch):
    monkeypatch.setattr(ts, "BLOCK_BYTES", 64 if n < 1000 else 1 << 12)
    random = np.random.default_rng(n + bits)
    ids = (random.zipf(1.3, n) % (1 << bits)).astype(np.uint32)
    matrix = ts.WaveletMatrix(ts.write_matrix(ids, [None, 5], [0, n], bits) + b"\n")
    assert len(matrix) == n and np.array_equal(matrix.all_ids(), ids)
    assert matrix.documents()[0] == [None, 5] and list(matrix.documents()[1]) == [0, n]
    for place in random.integers(0, n, min(n, 20)):
        assert matrix.access(int(place)) == ids[place]
    for value in [*np.unique(ids)[:5].tolist(), (1 << bits) - 1]:
        places = np.flatnonzero(ids == value)
        assert matrix.count(value) == len(places)
        low, high = n // 3, n - n // 4
        assert matrix.count(value, low, high) == ((places >= low) & (places < high)).sum()
        for number in {0, len(places) // 2, len(places) - 1} & set(range(len(places))):
            assert matrix.find(value, number) == places[number]
        assert matrix.find(value, len(places)) == -1
    with pytest.raises(IndexError):
        matrix.access(n)
    assert matrix.count(1 << bits) == 0


def test_not_a_shard():
    with pytest.raises(ValueError):
        ts.WaveletMatrix(b"something else")


WORDS = [
    "it's don't I'LL. x's, 'S 'st ab's. ΑΣ, Σ. İ. ſ, K. é. á, <|endoftext|>. a<|endoftext|>, 12.5, x.y. ..., .,.",
    "first text.<|endoftext|>second text. <|startoftext|> <|ENDOFTEXT|>x <|endoftext|><|endoftext|>",
    "Before <|StartOfText|> and <|endoftext|>After.",
    "ABC.DEF, 日本語. ﬁne. a.́ b,̀ \x1f \x1fa a\x1f   a b \x85 x y",
]


def test_words_against_whole_texts(plain, monkeypatch):
    monkeypatch.setattr(ts, "REMEMBERED_WORDS", 20)
    with open(PATH, encoding="utf-8") as file:
        ours = ts.WordTokenizer(file.read())
    texts = [*WORDS, *(r[1] or "" for r in ODD_ROWS), *WORDS]
    for start in range(0, len(texts), 3):
        for text, ids in zip(texts[start : start + 3], ours.encode(texts[start : start + 3])):
            assert ids == ts.ids_bytes(plain(text))


def expected(rows, plain):
    start, found = 0, []
    # Rows of one id follow each other by the hash that Spark's xxhash64 gives.
    hashed = lambda text: np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42)).astype(np.int64)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1])))
    for doc, text in order:
        ids = plain(text) + [2]
        found.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


@pytest.mark.parametrize("chars, ids", [(1_000_000_000, 1 << 30), (20_000, 1 << 30), (1_000_000_000, 5)])
def test_shards_round_trip(spark, odd, plain, monkeypatch, chars, ids):
    monkeypatch.setattr(ts, "SHARD_IDS", ids)
    path = scratch_path(spark, "shards")
    ts.write_shards(odd, path, PATH, 2, shard_chars=chars)
    found = sorted((tuple(r) for r in ts.shard_documents(spark, path).collect()), key=lambda r: r[1])
    assert found == expected([r[:2] for r in ODD_ROWS], plain)


def test_special_tokens_in_the_table(spark, docs, plain):
    rows = [(i, text) for i, text in enumerate([*WORDS, "x", None])]
    path = scratch_path(spark, "shards")
    ts.write_shards(docs(*rows), path, PATH, 2)
    found = sorted((tuple(r) for r in ts.shard_documents(spark, path).collect()), key=lambda r: r[1])
    assert found == expected(rows, plain)


def test_long_words_are_not_remembered(plain):
    with open(PATH, encoding="utf-8") as file:
        ours = ts.WordTokenizer(file.read())
    texts = ["x" * 5000 + ". y", "y " + "é" * 300]
    for _ in range(2):
        assert ours.encode(texts) == [ts.ids_bytes(plain(text)) for text in texts]
    assert max(map(len, ours.known)) <= ts.LONG_WORD


def test_western_words_are_looked_up_once(plain, monkeypatch):
    """Words with letters of Latin-1 skip the slow way, one lookup for all their places and signs."""
    with open(PATH, encoding="utf-8") as file:
        ours = ts.WordTokenizer(file.read())
    letters = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
    texts = [letters, " ".join(letters), "Été, été. ÉTÉ naïve ×÷ a×b ñ. ÿ, ß ŷ é́ " * 20, "été, ÿ. a,", "  ", "\x0bx\r\n\x1cy "]
    calls = []
    slow = ours._encoded
    monkeypatch.setattr(ours, "_encoded", lambda words: calls.extend(words) or slow(words))
    array = pa.array(["left out", *texts])[1:]
    assert ours.encode(array) == [ts.ids_bytes(plain(text)) for text in texts]
    assert not any(word.isalpha() and max(word) < "Ā" for word in calls) and len(calls) == len(set(calls))
    assert b"a" in ours.known and not any(word in ours.known for word in (b"a,", "été,".encode(), "ÿ.".encode()))


def test_slices_hold_every_row():
    texts = ["", "a" * 50, None, "b" * 500, "c", "", "d" * 99]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    parts = list(slices_of(batch, "text", 100))
    assert [t for part in parts for t in part.column(1).to_pylist()] == texts and len(parts) > 2
    assert list(slices_of(batch.slice(0, 0), "text", 100)) == []


def test_the_table_and_a_token(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    path = scratch_path(spark, "shards")
    ts.write_shards(docs, path, PATH, 2, shard_chars=100_000)
    found = sorted((tuple(r) for r in ts.shard_documents(spark, path).collect()), key=lambda r: r[1])
    assert found == expected(rows, plain)
    assert sum(r.n for r in ts.find_token(spark, path, 2).collect()) >= len(rows)
    assert ts.read_shards(spark, path).count() > 1


def test_empty_table(spark, empty):
    path = scratch_path(spark, "shards")
    ts.write_shards(empty, path, PATH, 2)
    assert ts.shard_documents(spark, path).collect() == []
