"""Byte-level BPE, encoded by backtracking over longest matches.

Bytes stand for Latin-1 characters, so that an Aho-Corasick automaton over the
vocabulary finds the longest token at every place of a piece in one pass.  A
sequence of tokens is what the merges would give if and only if any two adjacent
ones are; so the encoder takes the longest token that is compatible with the one
before it, falls back to that token's own longest prefix, and steps back where none
fits.  Each place is given up at most once, which makes it linear.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineflow.llm.shipping import give_memory_back, ship_package
from lineflow.llm.words import id_and_text

#: Pieces whose encoding a worker remembers at least, and at most twice as many; and
#: pairs of tokens.  Both are forgotten with the end of a task, as Spark keeps workers.
REMEMBERED_PIECES = 200_000
REMEMBERED_PAIRS = 400_000

#: Rows that are encoded at a time.
ROWS_AT_A_TIME = 256


class Remembered(dict):
    """Encodings by piece, as bytes; what has not been asked for in a long time is forgotten."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED_PIECES:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.encode(piece.encode())).tobytes()
        self[piece] = ids
        return ids


class BacktrackingEncoder:
    """Encodes single pieces of text by the ranks of a vocabulary file."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        # How a token came about: its last merge, or itself twice for a byte.
        self.parts = {rank: self._last_merge(token, rank) for token, rank in ranks.items()}
        self.merged = {parts: rank for rank, parts in self.parts.items() if parts[0] != rank}
        self.shorter = {}
        for token, rank in ranks.items():
            prefixes = (ranks.get(token[:n]) for n in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next((p for p in prefixes if p is not None), None)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        #: By the left token's rank times ``span`` and the right one's: such a key is one small object.
        self.compatible: dict[int, bool] = {}
        self.span = max(ranks.values(), default=0) + 1
        self.pieces = Remembered(self.encode_bytes)

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two parts the merges of lower rank leave of a token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [self.ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            lowest = min(pairs)
            if lowest >= rank:
                break
            at = pairs.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) != 2:
            return rank, rank
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _stay_apart(self, left: int, right: int) -> bool:
        """True if merging the bytes of both tokens gives just these two.

        The later of two merges is undone, again and again, down to the bytes on
        either side of the border.  They stay apart unless two parts that meet there
        would have been merged before the merges undone so far took place.
        """
        limit = len(self.ranks) + 1
        while True:
            together = self.merged.get((left, right))
            if together is not None and together < limit:
                return False
            left_parts, right_parts = self.parts[left], self.parts[right]
            left_whole, right_whole = left_parts[0] == left, right_parts[0] == right
            if left_whole and right_whole:
                return True
            if right_whole or (not left_whole and left > right):
                limit, left = left, left_parts[1]
            else:
                # On the right, an equal rank merges first, as it stands earlier.
                limit, right = right + 1, right_parts[0]

    def _fits(self, left: int, right: int) -> bool:
        """Find out, and remember, if two tokens are compatible."""
        if len(self.compatible) >= REMEMBERED_PAIRS:
            self.compatible.clear()
        fit = self.compatible[left * self.span + right] = self._stay_apart(left, right)
        return fit

    def forget(self) -> None:
        """Drop what is remembered; the vocabulary stays."""
        self.pieces.clear()
        self.pieces.older = {}
        self.compatible.clear()

    def encode_bytes(self, piece: bytes) -> list[int]:
        """The tokens of a piece."""
        end, text = len(piece), piece.decode("latin-1")
        length, shorter, longest_from = self.length, self.shorter, self.automaton.iter_long
        known_fit, fits, span = self.compatible.get, self._fits, self.span
        longest: list[int | None] = [None] * (end + 1)  # at each place, once looked up
        given_up = bytearray(end + 1)
        tokens: list[int] = []
        at, token = 0, None
        while at < end:
            if token is None:
                token = longest[at]
                if token is None:
                    token = longest[at] = next(longest_from(text, at))[1]
            while token is not None:
                if not given_up[at + length[token]]:
                    if not tokens:
                        break
                    fit = known_fit(tokens[-1] * span + token)
                    if fit or (fit is None and fits(tokens[-1], token)):
                        break
                token = shorter[token]
            if token is not None:
                tokens.append(token)
                at += length[token]
                token = None
            else:
                given_up[at] = 1
                token = tokens.pop()  # exists: the merges do encode the piece
                at -= length[token]
        return tokens


def parse_ranks(file: bytes) -> dict[bytes, int]:
    """Token and rank of each line of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file.splitlines() if line)}


@functools.lru_cache(maxsize=2)
def encoder_of(file: bytes) -> BacktrackingEncoder:
    """One encoder for each vocabulary and worker."""
    return BacktrackingEncoder(parse_ranks(file))


@functools.lru_cache(maxsize=2)
def token_table(file: bytes):
    """The bytes of each rank; decoding needs nothing else of a vocabulary."""
    import numpy as np

    ranks = parse_ranks(file)
    table = np.full(max(ranks.values()) + 1, None, dtype=object)
    table[list(ranks.values())] = list(ranks)
    return table


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id and ``ids`` (array of int) of each row, in place, without a shuffle.

    Each match of ``pattern`` is encoded separately, without special tokens.  Null
    and empty texts have no ids.  Null and repeated doc_ids pass through.

    The vocabulary file, under a megabyte, is read by the driver and broadcast; its
    size does not depend on the documents.
    """
    ship_package(docs.sparkSession)
    with open(ranks_path, "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = id_and_text(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encode_batches(vocabulary, pattern), f"doc_id {kind}, ids array<int>")


def _encode_batches(vocabulary, pattern: str) -> Callable[[Iterator], Iterator]:
    def encode(batches):
        import numpy as np
        import pyarrow as pa
        import regex

        encoder = encoder_of(vocabulary.value)
        ids_of = encoder.pieces.__getitem__
        find = regex.compile(pattern).findall
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                    part = batch.slice(start, ROWS_AT_A_TIME)
                    ids = [b"".join(map(ids_of, find(text))) for text in part.column(1).to_pylist()]
                    offsets = pa.array(np.cumsum([0, *map(len, ids)]) // 4, pa.int32())
                    values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"]
                    )
        finally:
            encoder.forget()
            give_memory_back()

    return encode


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``, the bytes the ids stand for.

    Null ids decode to null; an id that is not in the vocabulary is an error.
    """
    ship_package(encoded.sparkSession)
    with open(ranks_path, "rb") as file:
        vocabulary = encoded.sparkSession.sparkContext.broadcast(file.read())
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        token = token_table(vocabulary.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(start, ROWS_AT_A_TIME)
                lists = part.column("ids")
                ends = np.cumsum(lists.value_lengths().fill_null(0)).tolist()
                tokens = token[lists.flatten().to_numpy()].tolist()
                joined = [b"".join(tokens[a:b]) for a, b in zip([0, *ends], ends)]
                decoded = [text if known else None for text, known in zip(joined, lists.is_valid().to_pylist())]
                columns = [part.column("doc_id"), part.column("ids"), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, ids array<int>, decoded binary")


def token_digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what :func:`decode_documents` returns."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
