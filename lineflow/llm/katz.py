"""A Katz backoff language model: counts, discounts, backoff weights, scores.

The model has three levels.  A word that was seen after the one before it gets its
Good-Turing discounted share of that context; otherwise the context's backoff weight
times its discounted unigram share; an unknown word gets the mass the unigram
discounts left.  The weights make every context sum to one exactly.

The model is three tables in a folder:

* ``words``: word, count;
* ``pairs``: context, words, counts, one row per context and bucket, in a folder per
  bucket;
* ``contexts``: context, total, norm, weight.

Words are 64-bit hashes.  What is counted moves through the network as blocks, sorted
arrays that hold a context once and then its words, since single rows would be several
times the size of the text.  Blocks go to buckets of a fixed number of tokens.  A
context, or word, with more than a quarter of that number, or more than HOT_SHARE of all
tokens if that is less, is hot: it is spread over all buckets pair by pair.  A pair
that is hot itself is one row of a block when counted, but a row per token when texts
are scored; there it is spread by text, and its count is looked up.  So what is in one
bucket does not grow with the corpus.  There are at most four hot words for each bucket,
or 1 / HOT_SHARE if that is more, and as many hot pairs: tasks hold them as sorted arrays.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineflow.llm.shipping import ship_package
from lineflow.llm.words import id_and_text, lower_words
from lineflow.workspace import materialize, small_table

#: Stand for the beginning and the end of a text.
START, END = -1, -2

#: Counts up to this are discounted.
DISCOUNTED = 5

HOT_SHARE = 0.005
BUCKET_TOKENS = 1_000_000
BATCH_TOKENS = 1_500_000
ROWS_AT_A_TIME = 256

TABLES = {
    "words": "word long, n long",
    "pairs": "context long, total long, low array<long>, words array<long>, counts array<long>, bucket int",
    "contexts": "context long, total long, norm double, weight double",
}

#: Scoring goes through the texts this often, each time for part of the buckets; more
#: passes need less disk at a time.
PASSES = 3


# ---- inside tasks ----------------------------------------------------------


#: Marks blocks of postings, in their number of columns.
POSTINGS = 1 << 31

_END_BYTES = END.to_bytes(8, "little", signed=True)


def _tokens(text: str) -> bytes:
    """The hashes of a text's words, and the end."""
    import xxhash

    return b"".join([*map(xxhash.xxh3_64_digest, lower_words(text)), _END_BYTES])


def _token_batches(batches: Iterator, text: str):
    """Of about BATCH_TOKENS at a time: the rows' other columns, tokens, and where texts end."""
    import numpy as np
    import pyarrow as pa

    held, parts, count = [], [], 0
    for batch in batches:
        at = batch.schema.get_field_index(text)
        for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
            part = batch.slice(start, ROWS_AT_A_TIME)
            own = [_tokens(t) for t in part.column(at).to_pylist()]
            held.extend(own)
            parts.append(part.drop_columns([text]))
            count += sum(map(len, own)) // 8
            if count >= BATCH_TOKENS:
                yield pa.Table.from_batches(parts), *_joined(held)
                held, parts, count = [], [], 0
    if held:
        yield pa.Table.from_batches(parts), *_joined(held)


def _joined(held: list[bytes]):
    import numpy as np

    lengths = np.fromiter((len(own) // 8 for own in held), np.int64, len(held))
    return np.frombuffer(b"".join(held), "<i8"), np.cumsum(lengths)


def _contexts(tokens, ends):
    """The token before each, START at the beginning of a text."""
    import numpy as np

    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[0] = START
    before[ends[:-1]] = START
    return before


def _places(values, known):
    """The place of each value in the sorted array ``known``; -1: not in it."""
    import numpy as np

    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


class _HotPairs:
    """Sorted hot words and codes of hot pairs, to look up pairs in."""

    def __init__(self, model: Model):
        import numpy as np

        self.words = np.array(sorted(model.hot), np.int64)
        pairs = np.array(list(model.hot_pairs), np.int64).reshape(-1, 2)
        codes = _places(pairs[:, 0], self.words) * len(self.words) + _places(pairs[:, 1], self.words)
        order = np.argsort(codes)
        self.codes, self.counts = codes[order], np.array(list(model.hot_pairs.values()), np.int64)[order]

    def places(self, context, word):
        """The place of each pair among the hot ones; -1: not hot."""
        import numpy as np

        place = np.full(len(context), -1)
        if len(self.codes):
            first = _places(context, self.words)
            maybe = np.flatnonzero(first >= 0)
            second = _places(word[maybe], self.words)
            maybe, second = maybe[second >= 0], second[second >= 0]
            place[maybe] = _places(first[maybe] * len(self.words) + second, self.codes)
        return place


def _bucket_of(key, other, hot, n_buckets: int, also=None):
    """The bucket of each pair: by ``key``, or by both where the key is hot.

    ``also`` holds rows and what they are spread by besides.
    """
    import numpy as np

    spread = key.view(np.uint64).copy()
    is_hot = _places(key, hot) >= 0
    spread[is_hot] ^= other.view(np.uint64)[is_hot] * np.uint64(0x9E3779B97F4A7C15)
    if also is not None:
        rows, by = also
        spread[rows] ^= by.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    spread = (spread ^ (spread >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((spread >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int32)


def _pack(key, other, *columns) -> bytes:
    """A block: rows sorted by key, each key held once."""
    import numpy as np

    starts = _starts(key)
    runs = np.diff(np.append(starts, len(key))).astype("<u4")
    sizes = np.array([len(starts), len(key), len(columns)], "<u4").tobytes()
    body = [key[starts].astype("<i8"), runs, other.astype("<i8"), *(c.astype("<u4") for c in columns)]
    return sizes + b"".join(b.tobytes() for b in body)


def _unpack(block: bytes, each: bool = True):
    """key, other and the columns of a block; and the offset behind them.

    In a block of postings the first column says how often each pair stands there; it
    is repeated as often, unless ``each`` is false.
    """
    import numpy as np

    n_keys, n, n_columns = np.frombuffer(block, "<u4", 3).tolist()
    at = 12
    keys = np.frombuffer(block, "<i8", n_keys, at)
    runs = np.frombuffer(block, "<u4", n_keys, at := at + 8 * n_keys)
    other = np.frombuffer(block, "<i8", n, at := at + 4 * n_keys)
    at += 8 * n
    columns = []
    for _ in range(n_columns & ~POSTINGS):
        columns.append(np.frombuffer(block, "<u4", n, at))
        at += 4 * n
    key = np.repeat(keys, runs)
    if each and n_columns & POSTINGS:
        return np.repeat(key, columns[0]), np.repeat(other, columns[0]), columns, at
    return key, other, columns, at


def _pack_postings(key, other, doc, doc_keys, batch: int) -> bytes:
    """A block of pairs sorted by key and other, each held once, and the documents of each place.

    Behind the pairs stand the batch, the numbers of documents and places, the
    documents' keys, and for every place its document among these.
    """
    import numpy as np

    starts = _starts(key, other)
    head = bytearray(_pack(key[starts], other[starts], np.diff(np.append(starts, len(key)))))
    head[8:12] = np.uint32(1 | POSTINGS).tobytes()
    docs, place = np.unique(doc, return_inverse=True)
    place = place.astype("<u2" if len(docs) <= 1 << 16 else "<u4")
    sizes = np.array([batch, len(docs), len(place)], "<i8")
    return b"".join([head, sizes.tobytes(), doc_keys[docs].tobytes(), place.tobytes()])


def _unpack_postings(block: bytes):
    """context, word and times of the pairs; the batch, its documents' keys, and the document of each place."""
    import numpy as np

    context, word, (times,), at = _unpack(block, each=False)
    batch, n_docs, n_places = np.frombuffer(block, "<i8", 3, at).tolist()
    doc_keys = np.frombuffer(block, "<i8", n_docs, at + 24)
    place = np.frombuffer(block, "<u2" if n_docs <= 1 << 16 else "<u4", n_places, at + 24 + 8 * n_docs)
    return context, word, times, batch, doc_keys, place


def _blocks(key, other, columns, bucket, n_buckets: int, tail: Callable | None = None):
    """Arrow batch of (bucket, block) of rows sorted by key."""
    import numpy as np
    import pyarrow as pa

    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    numbers, blocks = [], []
    for number in range(n_buckets):
        rows = order[bounds[number] : bounds[number + 1]]
        if len(rows):
            own = [c[rows] for c in columns]
            block = tail(key[rows], other[rows], own) if tail else _pack(key[rows], other[rows], *own)
            numbers.append(number)
            blocks.append(block)
    arrays = [pa.array(numbers, pa.int32()), pa.array(blocks, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "block"])


def _starts(*columns):
    """Where a row of sorted columns differs from the one before it."""
    import numpy as np

    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _summed(key, other, n):
    """Equal pairs added up, sorted."""
    import numpy as np

    order = np.lexsort((other, key))
    key, other = key[order], other[order]
    starts = _starts(key, other)
    total = np.add.reduceat(n[order].astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)
    return key[starts], other[starts], total


# ---- discounts -------------------------------------------------------------


def good_turing(how_many: list[int]) -> list[float]:
    """The factors of counts 1 to DISCOUNTED; ``how_many[r - 1]`` things have count r.

    Katz's formula, which leaves counts above DISCOUNTED alone and frees the mass of
    the things seen once.  Where too few things were counted for it to give a factor
    between 0 and 1, half a count is taken off instead.
    """
    factors = []
    things = [float(n) for n in how_many]
    last = (DISCOUNTED + 1) * things[DISCOUNTED] / things[0] if things[0] else 1.0
    for r in range(1, DISCOUNTED + 1):
        factor = 0.0
        if things[r - 1] and last < 1:
            factor = ((r + 1) * things[r] / things[r - 1] / r - last) / (1 - last)
        factors.append(factor if 0 < factor < 1 else (r - 0.5) / r)
    return factors


@dataclass(frozen=True)
class Model:
    """Where the tables are, and what is small enough to hold."""

    path: str
    n_tokens: int
    n_words: int
    n_texts: int
    n_buckets: int
    word_factors: list[float]
    pair_factors: list[float]
    word_norm: float
    unknown: float
    #: word: count of the hot words.
    hot: dict[int, int] = field(default_factory=dict)
    #: (context, word): count of the hot pairs; both are hot words.
    hot_pairs: dict[tuple[int, int], int] = field(default_factory=dict)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return read_table(spark, self.path, name)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a model; one without rows may have no file to take a schema from."""
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")


def _discounted(counts, factors: list[float]):
    """Discounted counts of an array of counts."""
    import numpy as np

    factor = np.ones(DISCOUNTED + 1)
    factor[: DISCOUNTED + 1] = [0.0, *factors]
    low = counts <= DISCOUNTED
    return np.where(low, factor[np.where(low, counts, 0)] * counts, counts)


def word_share(count: Column, model: Model) -> Column:
    """The unigram probability of a word by its count; null: unknown."""
    factor = F.element_at(F.array(*map(F.lit, model.word_factors)), F.least(count, F.lit(DISCOUNTED)).cast("int"))
    discounted = F.when(count <= DISCOUNTED, factor * count).otherwise(count.cast("double"))
    return F.coalesce(discounted / F.lit(model.word_norm), F.lit(model.unknown))


# ---- fitting ---------------------------------------------------------------


def _release() -> None:
    """Drop references to finished DataFrames; Spark then deletes their shuffle files."""
    gc.collect()
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()


def fit(texts: DataFrame, path: str, text: str = "text", bucket_tokens: int = BUCKET_TOKENS) -> Model:
    """Count the words and pairs of ``texts`` and write the model's tables below ``path``.

    Null texts count as empty ones, a start and an end.  Without any text the model
    knows the end alone, counted once.  Other columns are not read.
    """
    spark = texts.sparkSession
    ship_package(spark)
    rows = texts.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    words = rows.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words.write.parquet(f"{path}/words")
    words = read_table(spark, path, "words")
    lows = [F.count_if(F.col("n") == r) for r in range(1, DISCOUNTED + 2)]
    found = words.agg(F.sum("n"), F.count("*"), F.max(F.when(F.col("word") == END, F.col("n"))), *lows).first()
    n_tokens, n_words, n_texts = found[0] or 0, found[1], found[2] or 0
    # At most n_tokens / limit of them.
    limit = min(HOT_SHARE * n_tokens, bucket_tokens / 4)
    hot = {row.word: row.n for row in words.filter(F.col("n") > F.lit(limit)).collect()}
    if n_texts > limit:
        hot[START] = n_texts
    n_buckets = 1 + n_tokens // bucket_tokens
    hot_words = sorted(hot)
    _release()

    pairs = rows.mapInArrow(_pair_blocks(hot_words, n_buckets), "bucket int, block binary")
    schema = "bucket int, context long, total long, low array<long>, words array<long>, counts array<long>"
    pairs = pairs.groupBy("bucket").applyInArrow(_merge_pairs, schema)
    pairs.write.partitionBy("bucket").parquet(f"{path}/pairs")
    pairs = read_table(spark, path, "pairs")
    lows = [F.sum(F.element_at("low", r)) for r in range(1, DISCOUNTED + 2)]
    pair_lows = [n or 0 for n in pairs.agg(*lows).first()]
    frequent = pairs.filter(F.col("total") > F.lit(limit)).select("context", F.inline(F.arrays_zip("words", "counts")))
    hot_pairs = frequent.filter(F.col("counts") > F.lit(limit)).collect()
    _release()

    word_lows = list(found[3:])
    word_factors, pair_factors = good_turing(word_lows), good_turing(pair_lows)
    lost = sum((1 - d) * r * n for r, (d, n) in enumerate(zip(word_factors, word_lows), 1))
    # Without any low count nothing is lost, and one count is set aside for the unknown.
    norm = float(n_tokens) if lost > 0 else n_tokens + 1.0
    model = Model(
        path, n_tokens, n_words, n_texts, n_buckets, word_factors, pair_factors, norm,
        (lost if lost > 0 else 1.0) / norm, hot, {(row[0], row[1]): row[2] for row in hot_pairs},
    )
    _write_contexts(spark, model)
    _release()
    return model


def _word_counts(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for _, tokens, _ in _token_batches(batches, "text"):
        words, counts = np.unique(tokens, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], ["word", "n"])


def _pair_blocks(hot: list[int], n_buckets: int) -> Callable[[Iterator], Iterator]:
    def blocks(batches):
        import numpy as np

        hot_words = np.array(hot, np.int64)
        for _, tokens, ends in _token_batches(batches, "text"):
            context, word, n = _summed(_contexts(tokens, ends), tokens, np.ones(len(tokens), np.int64))
            yield _blocks(context, word, [n], _bucket_of(context, word, hot_words, n_buckets), n_buckets)

    return blocks


def _all_pairs(blocks):
    """The pairs of several blocks, one behind the other."""
    import numpy as np

    unpacked = [_unpack(block.as_buffer().to_pybytes()) for block in blocks]
    keys = np.concatenate([u[0] for u in unpacked])
    others = np.concatenate([u[1] for u in unpacked])
    return keys, others, np.concatenate([u[2][0] for u in unpacked])


def _merge_pairs(key, table):
    """The contexts of one bucket: a bucket holds a bounded number of tokens."""
    import numpy as np
    import pyarrow as pa

    context, word, n = _summed(*_all_pairs(table.column("block")))
    starts = _starts(context)
    offsets = pa.array(np.append(starts, len(context)), pa.int32())
    low = np.zeros((len(starts), DISCOUNTED + 1), np.int64)
    place = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(context))))
    for r in range(1, DISCOUNTED + 2):
        low[:, r - 1] = np.bincount(place[n == r], minlength=len(starts))
    low_offsets = pa.array(np.arange(len(starts) + 1) * (DISCOUNTED + 1), pa.int32())
    columns = {
        "bucket": pa.array(np.full(len(starts), key[0].as_py()), pa.int32()),
        "context": pa.array(context[starts]),
        "total": pa.array(np.add.reduceat(n, starts)),
        "low": pa.ListArray.from_arrays(low_offsets, pa.array(low.ravel())),
        "words": pa.ListArray.from_arrays(offsets, pa.array(word)),
        "counts": pa.ListArray.from_arrays(offsets, pa.array(n)),
    }
    return pa.table(columns)


def _write_contexts(spark: SparkSession, model: Model) -> None:
    """The backoff weight of each context.

    What the discounts freed goes to the words not seen after the context, in
    proportion to their unigram shares.  These sum to one less those of the seen
    words, which are added up by word and then by context.  A context none of whose
    counts is discounted sets one count aside.
    """
    pairs = model.table(spark, "pairs")
    by_word = pairs.select("context", "words", "counts").mapInArrow(_reversed_blocks(model), "bucket int, block binary")
    seen = by_word.groupBy("bucket").applyInArrow(_seen_shares(model), "context long, seen double")
    seen = seen.groupBy("context").agg(F.sum("seen").alias("seen"))
    freed = sum(
        (1 - d) * r * F.element_at("low", r) for r, d in enumerate(model.pair_factors, 1)
    )
    totals = pairs.select("context", "total", freed.alias("freed"))
    totals = totals.groupBy("context").agg(F.sum("total").alias("total"), F.sum("freed").alias("freed"))
    some = F.col("freed") > 0
    norm = F.col("total") + F.when(some, F.lit(0.0)).otherwise(F.lit(1.0))
    left = F.when(some, F.col("freed")).otherwise(F.lit(1.0)) / norm
    unseen = F.greatest(F.lit(1.0) - F.col("seen"), F.lit(model.unknown))
    contexts = totals.join(seen, "context").select("context", "total", norm.alias("norm"), (left / unseen).alias("weight"))
    contexts.write.parquet(f"{model.path}/contexts")


def _reversed_blocks(model: Model) -> Callable[[Iterator], Iterator]:
    hot, n_buckets = sorted(model.hot), model.n_buckets

    def blocks(batches):
        import numpy as np

        hot_words, held, count = np.array(hot, np.int64), [], 0

        def packed():
            context, word, n = (np.concatenate(part) for part in zip(*held))
            order = np.lexsort((context, word))
            word, context, n = word[order], context[order], n[order]
            return _blocks(word, context, [n], _bucket_of(word, context, hot_words, n_buckets), n_buckets)

        for batch in batches:
            words, counts = batch.column("words"), batch.column("counts")
            sizes = np.diff(words.offsets.to_numpy())
            context = np.repeat(batch.column("context").to_numpy(), sizes)
            held.append((context, words.flatten().to_numpy(), counts.flatten().to_numpy()))
            count += len(context)
            if count >= BATCH_TOKENS:
                yield packed()
                held, count = [], 0
        if held:
            yield packed()

    return blocks


def _seen_shares(model: Model) -> Callable:
    hot = sorted(model.hot)
    hot_counts = [model.hot[word] for word in hot]

    def shares(table):
        import numpy as np
        import pyarrow as pa

        word, context, n = _all_pairs(table.column("block"))
        words, place = np.unique(word, return_inverse=True)
        total = np.bincount(place, weights=n, minlength=len(words)).astype(np.int64)
        if hot:  # their pairs are in all buckets
            at = _places(words, np.array(hot, np.int64))
            total = np.where(at >= 0, np.array(hot_counts, np.int64)[at], total)
        share = _discounted(total, model.word_factors) / model.word_norm
        contexts, of = np.unique(context, return_inverse=True)
        seen = np.bincount(of, weights=share[place], minlength=len(contexts))
        return pa.table({"context": pa.array(contexts), "seen": pa.array(seen)})

    return shares


# ---- scoring ---------------------------------------------------------------


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", passes: int = PASSES) -> DataFrame:
    """Of each row: doc_id, n_tokens, n_known, base_score, score.

    ``score`` is the model's log10 probability of the text and its end;
    ``base_score`` the sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))).  Null
    text is empty: its end alone is scored.  Rows are told apart by a 64-bit hash of
    id and text, so null and repeated ids, also with different texts, are scored each
    by its own text; rows that repeat both share their scores.

    A pair meets its context's row in the bucket of both.  Pairs found there, and hot
    ones wherever they are, are scored; the others, with their weight and unigram share still to come, are joined
    with ``contexts`` and ``words``.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ship_package(spark)
    rows = id_and_text(docs, doc_id, text).withColumn("key", F.xxhash64("doc_id", "text"))
    own = materialize(rows.select("doc_id", "key"), "text-keys")
    weights = model.table(spark, "contexts").select("context", "total", "norm", "weight")
    # At most as many rows as there are hot words.
    spread = weights.join(small_table(spark, context=pa.array(sorted(model.hot), pa.int64())), "context").collect()
    hot_totals = {row.context: (row.total, row.norm) for row in spread}
    resolved = []
    for number in range(passes):
        resolved.append(_score_pass(rows, model, hot_totals, number, passes))
        _release()
    parts = resolved[0]
    for part in resolved[1:]:
        parts = parts.unionByName(part)
    unseen = parts.filter("word IS NOT NULL").select("key", "context", "word", "n")
    counts = model.table(spark, "words").select("word", F.col("n").alias("count"))
    backed = unseen.join(weights.select("context", "weight"), "context", "left").join(counts, "word", "left")
    backed = backed.select(
        "key",
        (F.col("n") * F.log10(F.coalesce("weight", F.lit(1.0)) * word_share(F.col("count"), model))).alias("score"),
    )
    sums = parts.filter("word IS NULL").select("key", "n", "score", "base", "known").unionByName(
        backed.selectExpr("key", "0L AS n", "score", "0D AS base", "0L AS known")
    )
    sums = sums.groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("score").alias("score"), F.sum("base").alias("base"), F.sum("known").alias("known")
    )
    repeats = own.groupBy("key").agg(F.count("*").alias("repeats"))
    return own.join(sums.join(repeats, "key"), "key").select(
        "doc_id",
        (F.col("n") / F.col("repeats")).cast("long").alias("n_tokens"),
        (F.col("known") / F.col("repeats")).cast("long").alias("n_known"),
        (F.col("base") / F.col("repeats")).alias("base_score"),
        (F.col("score") / F.col("repeats")).alias("score"),
    )


def _score_pass(
    rows: DataFrame, model: Model, hot_totals: dict[int, tuple[int, float]], number: int, passes: int
) -> DataFrame:
    """The written sums, and pairs still to be scored, of the buckets of one pass."""
    postings = rows.select("key", "text").mapInArrow(
        _posting_blocks(model, number, passes), "bucket int, block binary"
    )
    pairs = model.table(rows.sparkSession, "pairs").filter(F.col("bucket") % passes == number)
    discounted = sum(F.element_at("low", r) for r in range(1, DISCOUNTED + 1)) > 0
    norm = F.col("total") + F.when(discounted, F.lit(0.0)).otherwise(F.lit(1.0))
    pairs = pairs.select("bucket", "context", "total", norm.alias("norm"), "words", "counts")
    met = pairs.groupBy("bucket").cogroup(postings.groupBy("bucket"))
    met = met.applyInArrow(_meet(model, hot_totals), "batch long, sums binary, unseen binary")
    added = met.groupBy("batch").applyInArrow(
        _added_up, "key long, context long, word long, n long, score double, base double, known long"
    )
    return materialize(added, "scores")


def _posting_blocks(model: Model, number: int, passes: int) -> Callable[[Iterator], Iterator]:
    hot, n_buckets = _HotPairs(model), model.n_buckets

    def blocks(batches):
        import numpy as np
        from pyspark import TaskContext

        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 32
        for batch, (table, tokens, ends) in enumerate(_token_batches(batches, "text"), first):
            doc_keys = table.column("key").to_numpy()
            doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            context = _contexts(tokens, ends)
            rows = np.flatnonzero(hot.places(context, tokens) >= 0)
            place = rows - np.append(0, ends[:-1])[doc[rows]]
            bucket = _bucket_of(context, tokens, hot.words, n_buckets, (rows, doc_keys[doc[rows]] + place))
            mine = bucket % passes == number
            context, word, doc, bucket = context[mine], tokens[mine], doc[mine], bucket[mine]
            order = np.lexsort((word, context))  # stable: documents stay in order
            context, word, doc, bucket = context[order], word[order], doc[order], bucket[order]

            def with_keys(context, word, columns):
                return _pack_postings(context, word, columns[0], doc_keys, batch)

            yield _blocks(context, word, [doc], bucket, n_buckets, tail=with_keys)

    return blocks


def _meet(model: Model, hot_totals: dict[int, tuple[int, float]]) -> Callable:
    """Scores of a bucket's postings by the bucket's contexts.

    Each pair of a block is looked up once.  A block of postings gives one row: sums for
    its documents, and the places whose pairs were not seen.  So there are as many rows
    as blocks, however many documents meet a bucket.
    """
    hot = _HotPairs(model)

    def meet(pairs, postings):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("batch", pa.int64()), ("sums", pa.binary()), ("unseen", pa.binary())])
        if not postings.num_rows:
            return schema.empty_table()
        blocks = [_unpack_postings(block.as_buffer().to_pybytes()) for block in postings.column("block")]
        context, word, times = (np.concatenate([block[i] for block in blocks]) for i in range(3))

        known = pairs.combine_chunks()
        known_context = known.column("context").to_numpy()
        lists = known.column("words").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        known_words = lists.flatten().to_numpy()
        known_counts = known.column("counts").combine_chunks().flatten().to_numpy()
        totals = known.column("total").to_numpy()

        # Contexts and words as places in sorted lists, so that a pair is one integer.
        order = np.argsort(known_context, kind="stable")
        sorted_context = known_context[order]
        at = np.searchsorted(sorted_context, context)
        inside = at < len(sorted_context)
        inside[inside] = sorted_context[at[inside]] == context[inside]
        row = np.full(len(context), -1)
        row[inside] = order[at[inside]]
        total = np.zeros(len(context), np.int64)
        total[inside] = totals[row[inside]]
        norm = np.ones(len(context))
        norm[inside] = known.column("norm").to_numpy()[row[inside]]
        specials = sorted(hot_totals)
        special = _places(context, np.array(specials, np.int64))
        spread = np.flatnonzero(special >= 0)
        if len(spread):
            of_all = [hot_totals[c] for c in specials]
            total[spread] = np.array([t for t, _ in of_all], np.int64)[special[spread]]
            norm[spread] = np.array([n for _, n in of_all], float)[special[spread]]

        vocabulary = np.unique(known_words)
        width = max(1, len(vocabulary))
        codes = np.repeat(np.arange(len(known_context)), sizes) * width + np.searchsorted(vocabulary, known_words)
        by_code = np.argsort(codes)
        word_at = np.searchsorted(vocabulary, word)
        there = inside & (word_at < len(vocabulary))
        there[there] = vocabulary[word_at[there]] == word[there]
        wanted = row[there] * width + word_at[there]
        found_at = np.searchsorted(codes[by_code], wanted)
        hit = found_at < len(codes)
        hit[hit] = codes[by_code[found_at[hit]]] == wanted[hit]
        count = np.zeros(len(context), np.int64)
        count[np.flatnonzero(there)[hit]] = known_counts[by_code[found_at[hit]]]
        at = hot.places(context, word)  # their texts are in all buckets
        count[at >= 0] = hot.counts[at[at >= 0]]

        seen = count > 0
        score = np.zeros(len(context))
        score[seen] = np.log10(_discounted(count[seen], model.pair_factors) / norm[seen])

        # A token's own count is that of the contexts it makes; the end makes none.
        floor = model.n_tokens + 0.1 * (model.n_words + 1)
        base = np.where(context == START, 0.0, np.log10((total + 0.1) / floor))
        base += np.where(word == END, np.log10((model.n_texts + 0.1) / floor), 0.0)
        is_known = (context != START) & (total > 0)
        is_known = is_known.astype(np.int64) + ((word == END) & (model.n_texts > 0))

        batch, sums, unseen, at = [], [], [], 0
        for own_context, own_word, own_times, number, doc_keys, place in blocks:
            rows = slice(at, at := at + len(own_times))
            added = [
                np.bincount(place, weights=np.repeat(values[rows], own_times), minlength=len(doc_keys))
                for values in (score, base, is_known)
            ]
            counts = np.bincount(place, minlength=len(doc_keys))
            columns = [doc_keys, added[0], added[1], counts.astype("<u4"), added[2].astype("<u4")]
            left = np.repeat(~seen[rows], own_times)
            found = [doc_keys[place[left]], np.repeat(own_context, own_times)[left], np.repeat(own_word, own_times)[left]]
            batch.append(number)
            sums.append(b"".join(c.tobytes() for c in columns))
            unseen.append(b"".join(c.tobytes() for c in found))
        return pa.table({"batch": batch, "sums": sums, "unseen": unseen}, schema=schema)

    return meet


def _added_up(table):
    """Of one batch of texts: a row of sums for each key, and a row for each place whose pair was not seen.

    A batch holds a bounded number of tokens.  Here n is how often a pair is still to be scored.
    """
    import numpy as np
    import pyarrow as pa

    parts = []
    for raw in (block.as_buffer().to_pybytes() for block in table.column("sums")):
        n = len(raw) // 32
        parts.append([*np.frombuffer(raw, "<i8", 3 * n).reshape(3, n), *np.frombuffer(raw, "<u4", 2 * n, 24 * n).reshape(2, n)])
    key, score, base, n, known = (np.concatenate(column) for column in zip(*parts))
    docs, of = np.unique(key, return_inverse=True)

    def total(values):
        return np.bincount(of, weights=values, minlength=len(docs))

    unseen = [np.frombuffer(block.as_buffer().to_pybytes(), "<i8").reshape(3, -1) for block in table.column("unseen")]
    left = np.concatenate(unseen, axis=1)
    none, zeros = pa.nulls(len(docs), pa.int64()), np.zeros(left.shape[1])
    columns = {
        "key": np.append(docs, left[0]),
        "context": pa.concat_arrays([none, pa.array(left[1])]),
        "word": pa.concat_arrays([none, pa.array(left[2])]),
        "n": np.append(total(n), zeros + 1).astype(np.int64),
        "score": np.append(total(score.view("<f8")), zeros),
        "base": np.append(total(base.view("<f8")), zeros),
        "known": np.append(total(known), zeros).astype(np.int64),
    }
    return pa.table({name: column if isinstance(column, pa.Array) else pa.array(column) for name, column in columns.items()})
