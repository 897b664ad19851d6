"""Vector codes: each part of a vector becomes the number of its nearest entry in that part's codebook.

Nearest entries are found by partial distances. The dimensions of a part are taken in descending variance of its codebook; an
entry's integer distance is added up dimension by dimension, and the entry is dropped once that strictly exceeds the vector's
best complete distance so far, so that ties are always seen. Codebooks are small and go to all tasks; the sums that
renew them are added up by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, mapped, stored
from tessera.llm.integers import integer_vectors, matrix, summed

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows that are searched at once.
BLOCK = 2048


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of a codebook for each row (ties: the lower number), and its squared distance."""
    order = np.argsort(-book.astype(float).var(0), kind="stable")
    far = (x[:, order[0], None] - book[None, :, order[0]]) ** 2
    best = _complete(x, book, np.arange(len(x)), far.argmin(1))
    row, entry = np.nonzero(far <= best[:, None])
    sums = far[row, entry]
    for d in order[1:]:
        sums = sums + (x[row, d] - book[entry, d]) ** 2
        # The row's least sum so far is completed: it may lower the best.
        first = np.flatnonzero(np.diff(row, prepend=-1))
        lowest = np.minimum.reduceat(sums, first)
        at = np.repeat(lowest, np.diff(np.append(first, len(row)))) == sums
        at = np.flatnonzero(at)
        at = at[np.unique(row[at], return_index=True)[1]]
        best[row[at]] = np.minimum(best[row[at]], _complete(x, book, row[at], entry[at]))
        kept = sums <= best[row]
        row, entry, sums = row[kept], entry[kept], sums[kept]
    # What is left is complete and no larger than the best: all nearest entries, by row and number.
    return entry[np.unique(row, return_index=True)[1]], best


def _complete(x: np.ndarray, book: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
    return ((x[row] - book[entry]) ** 2).sum(1)


def _assigned(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of rows: the rows, their parts, the entry and the squared distance of each part."""
    for first in range(0, len(batch), BLOCK):
        part = batch.slice(first, BLOCK)
        x = matrix(part.column("x")).reshape(len(part), len(books), -1)
        found = [nearest(x[:, p], books[p]) for p in range(len(books))]
        yield part, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(books: np.ndarray):
    def add(sums: np.ndarray, batch: pa.RecordBatch) -> None:
        table = sums.reshape(len(books), books.shape[1], -1)
        for part, x, entry, _ in _assigned(batch, books):
            for p in range(len(books)):
                np.add.at(table[p], entry[:, p], np.column_stack([np.ones(len(part), np.int64), x[:, p]]))

    return add


def _codes(books: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, entry, squares in _assigned(batch, books):
                width = max(2, len(f"{books.shape[1] - 1:x}"))
                code = ["".join(f"{e:0{width}x}" for e in row) for row in entry.tolist()]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(code, pa.string()), pa.array(squares.sum(1))], ["vec_id", "label", "code", "error"])

    return work


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """parts x entries x width codebooks of the integer vectors (vec_id, dim, x), which all have one length.

    Each starts as that part of the vectors with the smallest ids (of a repeated id the smaller bytes first, nulls last), as
    many as there are; each round assigns all vectors and puts every entry that is used to the floor of its parts' mean.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    books = matrix(pa.array([bytes(r.x) for r in first], pa.binary()))
    books = np.ascontiguousarray(books.reshape(len(books), parts, books.shape[1] // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        if not books.size:
            break
        sums = summed(rows.select("x"), books.size + books.shape[0] * books.shape[1], _sums(books)).reshape(*books.shape[:2], -1)
        books = np.where(sums[..., :1] > 0, sums[..., 1:] // np.maximum(sums[..., :1], 1), books)
    return books


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors (vec_id, embedding, label) that can be coded.

    code holds two hexadecimal digits for each part, error the squared distance between the integer vector floor(scale * component)
    and its entries, label_error that summed over equal labels (nulls together; null where it leaves the range of a long),
    codebooks_sha256 the digest of all entries' components, comma-joined. Left out are vectors that are null, that hold a null or
    non-finite component, that can't be cut into equal parts, and those of another length than the one with the smallest id.
    Repeated ids are rows of their own, ties go to the lower number, an empty table gives an empty result; extra columns are ignored.
    """
    whole = stored(integer_vectors(vectors, scale, "label").where((F.col("dim") > 0) & (F.col("dim") % parts == 0)))
    dim = whole.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("dim").limit(1).collect()
    rows = whole.where(F.col("dim") == (dim[0].dim if dim else 0))
    books = fit_codebooks(rows, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    kind = vectors.schema["label"].dataType.simpleString()
    if not books.size:
        coded = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = stored(mapped(rows.select("vec_id", "label", "x"), _codes(books), f"vec_id long, label {kind}, code string, error long"))
        discard(whole)
    # A stored table's size is known when the join is planned, so a few labels are broadcast and many are shuffled.
    sums = stored(coded.groupBy(F.col("label").alias("key")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("key")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
