"""Token ids in wavelet matrices, one compressed file per shard.

A shard holds the ids of consecutive documents.  The wavelet matrix keeps one plane
of bits for each bit of an id, from the highest down; below each plane, ids with a
0 there stand before those with a 1, otherwise in their order.  With counts of ones
in front of every block, it gives single ids, counts of an id up to a place, and the
places of an id, without decoding the rest.

Spark's text writer writes the files and commits them: a row is the bytes of one
file.  It ends each with a line feed, which the format allows for.  ``binaryFile``
reads them back, so any file system Spark reaches will do.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineflow.llm.shipping import give_memory_back, ship_package
from lineflow.llm.words import id_and_text, slices_of, split_words

MAGIC = b"WAVM"
BLOCK_BYTES = 1 << 16  # of a plane; each block is compressed by itself
RANK_BITS = 512  # ones of a block are counted by so many bits

#: Characters of text that go into a shard, about, and ids after which one ends.
SHARD_CHARS = 16_000_000
SHARD_IDS = 1 << 23

#: Words whose ids a worker remembers at least, and at most about twice as many.
REMEMBERED_WORDS = 300_000
#: Bytes of a word beyond which it is not remembered.
LONG_WORD = 64

#: Letters of ASCII and Latin-1: no other character composes with them, and each has one lower case.
WESTERN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
#: The alphabet of byte-level models: bytes that are no printable character of Latin-1 are moved behind it.
ALPHABET = {byte: 256 + n for n, byte in enumerate([*range(33), *range(127, 161), 173])}

#: Bytes of text that are encoded at a time, about; no text is divided.
BYTES_AT_A_TIME = 4_000_000


# ---- the file --------------------------------------------------------------


def write_matrix(ids, doc_ids, lengths, bits: int, place: int = 0) -> bytes:
    """The bytes of a shard: ``ids`` of all documents, their ids and numbers of ids."""
    import numpy as np

    plane_kind = np.uint16 if bits <= 16 else np.uint32
    current = np.ascontiguousarray(ids, dtype=plane_kind)
    zeros, blocks, ones_before, body, at = [], [], [], [], 0
    for level in range(bits):
        bit = (current & plane_kind(1 << (bits - 1 - level))) != 0
        plane = np.packbits(bit, bitorder="little").tobytes()
        ones = 0
        starts, counts = [], []
        for start in range(0, len(plane), BLOCK_BYTES):
            block = plane[start : start + BLOCK_BYTES]
            packed = zlib.compress(block, 1)
            starts.append(at)
            counts.append(ones)
            body.append(packed)
            at += len(packed)
            ones += int(np.bitwise_count(np.frombuffer(block, np.uint8)).sum())
        blocks.append(starts)
        ones_before.append(counts)
        zeros.append(len(current) - ones)
        if level + 1 < bits:
            below = np.empty_like(current)
            below[: zeros[-1]] = current[~bit]
            below[zeros[-1] :] = current[bit]
            current = below
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    numbers = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    directory = zlib.compress(known.tobytes() + numbers.tobytes() + np.asarray(lengths, dtype="<i8").tobytes())
    head = {
        "n": len(ids), "docs": len(doc_ids), "bits": bits, "place": place, "zeros": zeros,
        "blocks": blocks, "ones": ones_before, "directory": [at, len(directory)], "bytes": at + len(directory),
    }
    packed_head = zlib.compress(json.dumps(head).encode())
    return b"".join([MAGIC, struct.pack("<I", len(packed_head)), packed_head, *body, directory])


class WaveletMatrix:
    """Reads a shard.  Only the blocks a call needs are decompressed."""

    def __init__(self, file: bytes):
        if file[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        size = struct.unpack_from("<I", file, 4)[0]
        self.head = json.loads(zlib.decompress(file[8 : 8 + size]))
        self.body = memoryview(file)[8 + size : 8 + size + self.head["bytes"]]
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        self._block: dict[tuple[int, int], object] = {}

    def __len__(self) -> int:
        return self.n

    def documents(self):
        """Ids and numbers of token ids of the documents, in order."""
        import numpy as np

        start, size = self.head["directory"]
        raw, docs = zlib.decompress(self.body[start : start + size]), self.head["docs"]
        known = np.frombuffer(raw, np.uint8, docs)
        numbers = np.frombuffer(raw, "<i8", docs, docs)
        lengths = np.frombuffer(raw, "<i8", docs, docs * 9)
        return [int(d) if k else None for d, k in zip(numbers, known)], lengths

    def _bits_of(self, level: int, block: int):
        import numpy as np

        known = self._block.get((level, block))
        if known is None:
            starts = self.head["blocks"][level]
            end = starts[block + 1] if block + 1 < len(starts) else self._end_of(level)
            plane = np.frombuffer(zlib.decompress(self.body[starts[block] : end]), np.uint8)
            bits = np.unpackbits(plane, bitorder="little")
            padded = np.zeros(-(-len(bits) // RANK_BITS) * RANK_BITS, np.uint8)
            padded[: len(bits)] = bits
            counts = padded.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.int64)
            known = self._block[level, block] = bits, np.concatenate([[0], np.cumsum(counts)])
            if len(self._block) > 4 * self.bits:
                self._block.pop(next(iter(self._block)))
        return known

    def _end_of(self, level: int) -> int:
        below = self.head["blocks"][level + 1 :]
        return next((starts[0] for starts in below if starts), self.head["directory"][0])

    def _ones(self, level: int, place: int) -> int:
        """Ones of a plane before ``place``."""
        if place >= self.n:
            return self.n - self.zeros[level]
        block, within = divmod(place, BLOCK_BYTES * 8)
        bits, counts = self._bits_of(level, block)
        near = within // RANK_BITS
        return self.head["ones"][level][block] + int(counts[near]) + int(bits[near * RANK_BITS : within].sum())

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for level in range(self.bits):
            block, within = divmod(place, BLOCK_BYTES * 8)
            bit, ones = int(self._bits_of(level, block)[0][within]), self._ones(level, place)
            value = value << 1 | bit
            place = self.zeros[level] + ones if bit else place - ones
        return value

    def _range_of(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id before place ``end`` stand below the last plane."""
        low, high = 0, min(end, self.n)
        for level in range(self.bits):
            low_ones, high_ones = self._ones(level, low), self._ones(level, high)
            if value >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + low_ones, self.zeros[level] + high_ones
            else:
                low, high = low - low_ones, high - high_ones
        return low, high

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in places ``start`` up to ``end``."""
        if not 0 <= value < 1 << self.bits:
            return 0
        low, high = self._range_of(value, self.n if end is None else end)
        before = self._range_of(value, start) if start else (low, low)
        return max(0, high - before[1])

    def find(self, value: int, number: int) -> int:
        """The place of the occurrence of an id with this number, from 0; -1 if there is none."""
        if number < 0 or number >= self.count(value):
            return -1
        place = self._range_of(value, self.n)[0] + number
        for level in reversed(range(self.bits)):
            if value >> (self.bits - 1 - level) & 1:
                place = self._nth(level, place - self.zeros[level], one=True)
            else:
                place = self._nth(level, place, one=False)
        return place

    def _nth(self, level: int, number: int, one: bool) -> int:
        """The place of a one or zero of a plane by its number."""
        import bisect

        import numpy as np

        width, counts = BLOCK_BYTES * 8, self.head["ones"][level]
        before = counts if one else [i * width - c for i, c in enumerate(counts)]
        block = bisect.bisect_right(before, number) - 1
        bits = self._bits_of(level, block)[0][: self.n - block * width]
        return block * width + int(np.flatnonzero(bits == one)[number - before[block]])

    def all_ids(self):
        """All ids at once, from the lowest plane up."""
        import numpy as np

        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, dtype=kind)
        for level in reversed(range(self.bits)):
            starts = self.head["blocks"][level]
            ends = [*starts[1:], self._end_of(level)]
            plane = b"".join(zlib.decompress(self.body[a:b]) for a, b in zip(starts, ends))
            bit = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(values)
            above[~bit] = values[: self.zeros[level]]
            above[bit] = values[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            values = above
        return values


# ---- tokens of a text ------------------------------------------------------


class WordTokenizer:
    """Ids of texts by a tokenizer that never joins words.

    The tokenizer drops white space and looks at nothing across it, so a text's ids
    are those of its words, and a word that ends in a full stop or comma behind a
    letter has that sign's ids after its own.  Each word is encoded when it is met and
    remembered; what has not been met for long is forgotten.
    """

    def __init__(self, tokenizer: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [token.content.lower() for token in added]
        self.signs = {sign for token in self.special for sign in (token[:1], token[:1].upper())}
        # Words are looked up here only where no special token can be, which spares its search.
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.sign = dict(zip((b".", b","), self._encoded([".", ","])))

    def _encoded(self, words: list[str]) -> list[bytes]:
        return [ids_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Ids of words into ``known``; of a word with a sign behind it, those of the word before the sign."""
        known, older, sign = self.known, self.older, self.sign
        unread, tokenize = [], self.tokenizer.model.tokenize
        for word in words:
            if word[-1:] in sign and (word[-2:-1].isalpha() or WESTERN(word[-3:-1])):
                word = word[:-1]
                if word in known:
                    continue
            ids = older.get(word)
            if ids is not None:
                known[word] = ids
            elif word.isalpha():  # ASCII letters: a single piece, in the model's own alphabet
                known[word] = ids_bytes([token.id for token in tokenize(word.decode())])
            elif WESTERN(word):  # a single piece too, once in lower case and in that alphabet
                piece = word.decode().lower().encode().decode("latin-1").translate(ALPHABET)
                known[word] = ids_bytes([token.id for token in tokenize(piece)])
            else:
                unread.append(word)
        known.update(zip(unread, self._encoded([word.decode() for word in unread])))

    def encode(self, texts) -> list[bytes]:
        """The ids of texts, best an Arrow array of them, as little-endian 32-bit integers.

        Arrow splits the texts and numbers their different words; only these are looked
        up, and their ids are dealt to the places where they stand.
        """
        import numpy as np
        import pyarrow as pa

        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if len(self.known) > REMEMBERED_WORDS:
            self.older, self.known = self.known, {}
        # The tokenizer looks for its special tokens before it folds case: such texts are its own.
        whole = self._special_texts(texts)
        numbers, distinct, word_ends = split_words(texts)
        known, sign = self.known, self.sign
        own = list(map(known.get, distinct))
        new = [(place, distinct[place]) for place, ids in enumerate(own) if ids is None]
        self._learn([word for _, word in new])
        for place, word in new:
            ids = known.get(word)
            own[place] = known[word[:-1]] + sign[word[-1:]] if ids is None else ids
        for _, word in new:
            if len(word) > LONG_WORD:
                known.pop(word, None)
                known.pop(word[:-1], None)
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts = np.cumsum(sizes) - sizes
        each = sizes[numbers]
        ends = np.cumsum(each)
        places = np.repeat(starts[numbers] - ends + each, each)
        places += np.arange(len(places))
        ids = np.frombuffer(b"".join(own), "<u4")[places].tobytes()
        text_ends = (4 * np.append(0, ends)[word_ends]).tolist()
        found = [ids[start:end] for start, end in zip([0, *text_ends], text_ends)]
        if whole:
            self.tokenizer.encode_special_tokens = False
            for place, ids in zip(whole, self._encoded(texts.take(pa.array(whole)).to_pylist())):
                found[place] = ids
            self.tokenizer.encode_special_tokens = True
        return found

    def _special_texts(self, texts) -> list[int]:
        """The places of the texts that may hold a special token."""
        import pyarrow.compute as pc

        places = set()
        for sign in self.signs:
            signed = pc.indices_nonzero(pc.match_substring(texts, sign))
            places.update(signed.to_pylist())
        return [place for place in sorted(places) if self._may_be_special(texts[place].as_py())]

    def _may_be_special(self, text: str) -> bool:
        folded = text.lower()
        return any(token in folded for token in self.special)


def ids_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


_TOKENIZERS: dict[int, WordTokenizer] = {}


def tokenizer_of(tokenizer: str) -> WordTokenizer:
    """One tokenizer for each file and worker."""
    key = hash(tokenizer)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordTokenizer(tokenizer)
    return _TOKENIZERS[key]


# ---- shards ----------------------------------------------------------------


def write_shards(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_chars: int = SHARD_CHARS,
) -> None:
    """Encode every row, append ``end_id``, and write shards in ascending order of doc_id.

    Null text is empty: the end id alone.  Null ids come first.  Rows that repeat an
    id are neighbours, ordered by a hash of the text.  An empty table writes no shard.

    One range shuffle by id; a partition is written as one shard, or as several if it
    holds more than SHARD_IDS ids, so a task keeps one shard in memory.  A document is
    never split.  The tokenizer file, of fixed size, is broadcast.
    """
    ship_package(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = id_and_text(docs, doc_id, text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = rows.agg(F.sum(F.char_length("text").cast("long"))).first()[0] or 0
    # Rows of one id, or without one, are told apart by their text, and copies by their place.
    keyed = rows.withColumns({"key": F.xxhash64("text"), "salt": F.shiftright(F.monotonically_increasing_id(), 10)})
    ranged = keyed.repartitionByRange(1 + chars // shard_chars, "doc_id", "key", "salt")
    ordered = ranged.sortWithinPartitions("doc_id", "key").select("doc_id", "text")
    files = ordered.mapInArrow(_shard_batches(tokenizer, end_id), "file binary")
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def _shard_batches(tokenizer, end_id: int) -> Callable[[Iterator], Iterator]:
    def shards(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = tokenizer_of(tokenizer.value)
        bits = max(1, max(encoder.size - 1, end_id).bit_length())
        end = ids_bytes([end_id])
        place = TaskContext.get().partitionId() << 32
        doc_ids, lengths, ids = [], [], []

        def shard():
            joined = np.frombuffer(b"".join(ids), "<u4")
            file = write_matrix(joined, doc_ids, lengths, bits, place)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.binary())], ["file"])

        held = 0
        for batch in batches:
            for part in slices_of(batch, 1, BYTES_AT_A_TIME):
                for doc_id, own in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                    own += end
                    if doc_ids and held + len(own) // 4 > SHARD_IDS:
                        yield shard()
                        doc_ids, lengths, ids, held, place = [], [], [], 0, place + 1
                    doc_ids.append(doc_id)
                    lengths.append(len(own) // 4)
                    ids.append(own)
                    held += len(own) // 4
        if doc_ids:
            yield shard()
        doc_ids, lengths, ids = [], [], []
        give_memory_back()

    return shards


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The files: ``place`` of the shard, ``n_ids``, ``n_docs``, ``content``."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def heads(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                head = WaveletMatrix(content.as_buffer().to_pybytes()).head
                columns = [[head["place"]], [head["n"]], [head["docs"]]]
                arrays = [*(pa.array(c, pa.int64()) for c in columns), pa.array([content.as_py()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["place", "n_ids", "n_docs", "content"])

    return files.mapInArrow(heads, "place long, n_ids long, n_docs long, content binary")


def shard_documents(spark: SparkSession, path: str) -> DataFrame:
    """Of each document in the shards of ``path``: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it, over all shards.  The window
    sees one row per shard.
    """
    shards = read_shards(spark, path)
    earlier = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("place", "n_ids").select(
        F.col("place").alias("of_shard"), F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("shard_start")
    )

    def documents(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for place, content in zip(batch.column("place").to_pylist(), batch.column("content")):
                matrix = WaveletMatrix(content.as_buffer().to_pybytes())
                doc_ids, lengths = matrix.documents()
                ids = matrix.all_ids()
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e].astype("<u4")) for e, n in zip(ends.tolist(), lengths.tolist())]
                arrays = [
                    pa.array([place] * len(doc_ids), pa.int64()), pa.array(doc_ids, pa.int64()),
                    pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["place", "doc_id", "before", "n_tokens", "ids_crc32"])

    schema = "place long, doc_id long, before long, n_tokens long, ids_crc32 long"
    found = shards.select("place", "content").mapInArrow(documents, schema)
    return found.join(starts, found["place"] == starts["of_shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def find_token(spark: SparkSession, path: str, token: int, number: int = 0) -> DataFrame:
    """Of each shard: place, how often ``token`` occurs, and where it does for the ``number``-th time (-1: nowhere)."""

    def look(batches):
        import pyarrow as pa

        for batch in batches:
            for place, content in zip(batch.column("place").to_pylist(), batch.column("content")):
                matrix = WaveletMatrix(content.as_buffer().to_pybytes())
                row = [[place], [matrix.count(token)], [matrix.find(token, number)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in row], ["place", "n", "at"])

    return read_shards(spark, path).select("place", "content").mapInArrow(look, "place long, n long, at long")
