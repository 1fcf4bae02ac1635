"""Vector codes: product quantization with equal-average nearest-neighbour search.

A vector is cut into equal parts; each part is replaced by the index of the nearest
entry of the part's codebook.  Codebooks are trained in a few rounds of assigning and
averaging.  Everything is integer arithmetic, so results do not depend on how rows are
partitioned.

The nearest entry is found by sums: of two vectors of ``d`` components, the squared
distance is at least the squared difference of their sums over ``d``.  Entries are
sorted by sum, and the search goes outward from the part's own sum until that bound
strictly exceeds the best distance, so that ties are still met.

A round moves no vector: each task adds up its parts per entry and sends one row per
entry; the driver holds the codebooks only, whose size is set by the parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.llm.shipping import ship_package
from lineflow.workspace import materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024

ROWS_AT_A_TIME = 8_192


def nearest_entries(parts, book):
    """Index and squared distance of each row's nearest entry, ties to the lower index.

    ``parts`` (rows by components) and ``book`` (entries by components) hold integers
    below ``component_limit`` in size.
    """
    import numpy as np

    width = max(1, book.shape[1])
    order = np.lexsort((np.arange(len(book)), book.sum(1)))
    sums, entries = book.sum(1)[order], book[order]
    own = parts.sum(1)
    right = np.searchsorted(sums, own)
    left = right - 1
    best = np.full(len(parts), np.iinfo(np.int64).max)
    index = np.full(len(parts), len(book))
    rows = np.arange(len(parts))
    while len(rows):
        low, high = left[rows], right[rows]
        has_low, has_high = low >= 0, high < len(book)
        below, above = own[rows] - sums[np.maximum(low, 0)], sums[np.minimum(high, len(book) - 1)] - own[rows]
        down = has_low & (~has_high | (below <= above))
        gap = np.where(down, below, above)
        # best * width could overflow before a first distance is known.
        known = index[rows] < len(book)
        near = ~known | (gap * gap <= np.where(known, best[rows], 0) * width)
        keep = (has_low | has_high) & near
        rows, down, low, high = rows[keep], down[keep], low[keep], high[keep]
        at = np.where(down, low, high)
        difference = parts[rows] - entries[at]
        distance = np.einsum("ij,ij->i", difference, difference)
        place = order[at]
        better = (distance < best[rows]) | ((distance == best[rows]) & (place < index[rows]))
        best[rows[better]], index[rows[better]] = distance[better], place[better]
        left[rows[down]] -= 1
        right[rows[~down]] += 1
    return index, best


def component_limit(width: int) -> int:
    """Components of this size and below keep all arithmetic within 64 bits."""
    return 2**30 // max(1, width)


def _cut(batch, parts: int):
    """The batch's vectors as rows by parts by components."""
    vectors = batch.column("v")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), parts, -1)


def _sum_batches(books) -> Callable[[Iterator], Iterator]:
    """Per task: part, entry, n, and the total of each component of the parts of an entry."""

    def add_up(batches):
        import numpy as np
        import pyarrow as pa

        parts, entries, width = books.shape
        counts, totals = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                vectors = _cut(batch.slice(start, ROWS_AT_A_TIME), parts)
                for part in range(parts):
                    index, _ = nearest_entries(vectors[:, part], books[part])
                    np.add.at(totals[part], index, vectors[:, part])
                    counts[part] += np.bincount(index, minlength=entries)
        part, entry = np.nonzero(counts)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64())]
        columns += [pa.array(totals[part, entry, place], pa.int64()) for place in range(width)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *[f"t{place}" for place in range(width)]])

    return add_up


def _code_batches(books) -> Callable[[Iterator], Iterator]:
    def encode(batches):
        import numpy as np
        import pyarrow as pa

        parts, entries, _ = books.shape
        digits = len(f"{max(1, entries - 1):x}")
        names = [f"{entry:0{max(2, digits)}x}" for entry in range(entries)]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                rows = batch.slice(start, ROWS_AT_A_TIME)
                vectors = _cut(rows, parts)
                found = [nearest_entries(vectors[:, part], books[part]) for part in range(parts)]
                codes = ["".join(names[i] for i in row) for row in zip(*[index.tolist() for index, _ in found])]
                errors = np.sum([distance for _, distance in found], axis=0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("vec_id"), rows.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    return encode


def integer_vectors(
    table: DataFrame, parts: int = PARTS, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """vec_id, label, v of the vectors that can be coded: ``floor(1024 * x)`` of each component.

    Vectors that are null, or hold null or non-finite components, are left out; so are
    those that do not cut into equal parts, and those with a component so large that
    squared distances would leave 64 bits (2^26 after scaling, in parts of 16).
    """
    wide = F.col(f"`{vector}`").cast("array<double>")
    width = F.greatest(F.lit(1), F.size(wide) / parts)
    limit = F.lit(float(component_limit(1))) / width / SCALE
    # A NaN is greater than any number, so it fails here too.
    known = F.forall(wide, lambda x: F.coalesce(F.abs(x) < limit, F.lit(False)))
    cuts = (F.size(wide) > 0) & (F.size(wide) % parts == 0)
    scaled = F.transform(wide, lambda x: F.floor(x * SCALE).cast("bigint"))
    kept = table.filter(wide.isNotNull() & cuts & known)
    return kept.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), scaled.alias("v"))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """Codebooks, an array of parts by entries by components, from all ``vectors`` (vec_id, v).

    They start as the parts of the vectors with the smallest ids, null last, ties by the
    components.  Entries that no part is nearest to stay as they are.
    """
    import numpy as np

    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64)
    books = np.ascontiguousarray(books.reshape(len(first), parts, -1).transpose(1, 0, 2))
    width = books.shape[2]
    totals = [f"t{place}" for place in range(width)]
    schema = "part int, entry int, n long, " + ", ".join(f"{t} long" for t in totals)
    for _ in range(rounds):
        sums = vectors.select("v").mapInArrow(_sum_batches(books), schema)
        found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in totals])
        updated = books.copy()
        for row in found.collect():  # one row per entry
            updated[row.part, row.entry] = np.array(row[3:], np.int64) // row.n
        books = updated
    return books


def books_digest(books) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books) -> DataFrame:
    """vec_id, label, code, error of ``vectors`` (vec_id, label, v)."""
    kind = vectors.schema
    schema = f"vec_id {kind['vec_id'].dataType.simpleString()}, label {kind['label'].dataType.simpleString()}, code string, error long"
    return vectors.mapInArrow(_code_batches(books), schema)


def compress(
    table: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """One row per vector: vec_id, code, error, label_error, codebooks_sha256.

    What ``integer_vectors`` leaves out has no row; of the rest, vectors of another
    length than the one with the smallest id have none either.  Repeated rows and ids
    are vectors of their own, and one with a null id comes last for the first entries.
    With fewer vectors than entries, codebooks are smaller.  An empty table gives an
    empty one.  Errors add up per label, nulls together; null if beyond 64 bits.
    """
    spark = table.sparkSession
    ship_package(spark)
    vectors = integer_vectors(table, parts, vec_id, vector, label)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    if first is None:
        return vectors.select(
            "vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"),
            F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"),
        )
    vectors = materialize(vectors.filter(F.size("v") == first[0]), "vectors")
    books = train(vectors, parts, entries, rounds)
    coded = materialize(encode(vectors, books), "codes")
    return _with_label_errors(coded).withColumn("codebooks_sha256", F.lit(books_digest(books)))


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """The totals are stored, so Spark knows their size: few are broadcast, many are joined."""
    same: Column = F.col("label").eqNullSafe(F.col("of"))
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    totals = materialize(totals, "label-errors")
    return coded.join(totals, same, "left").select("vec_id", "code", "error", "label_error")
