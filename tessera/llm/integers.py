"""Vectors of integers, their exact distances, and sums that Spark adds up over all partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import binaries, mapped


def reach(dim: int) -> int:
    """The largest size of a component with which squared distances of ``dim`` components fit in a long."""
    return 1 << max(0, (62 - (max(1, dim) - 1).bit_length()) // 2 - 1)


def integer_vectors(vectors: DataFrame, scale: int, *extra: str) -> DataFrame:
    """(vec_id, dim, x, extra columns) of the vectors without a null or non-finite component: x holds floor(scale * component).

    x is little-endian int32. A component beyond reach(dim), whose square would leave the range of a long, is held at it.
    Rows without a vector are left out; a null id stays.
    """
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype(float)  # a null is not a number here
            size = np.diff(offsets)
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])[offsets]
            good = lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(odd) == 0)
            most = np.repeat(np.array([reach(n) for n in size.tolist()], float), size)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.clip(np.floor(scale * values[offsets[0] : offsets[-1]]), -most, most)
            kept = x[np.repeat(good, size)].astype("<i4")
            rows = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(size[good].astype(np.int32)), binaries(kept.view(np.uint8), 4 * size[good]), *rows.columns[2:]], ["vec_id", "dim", "x", *extra]
            )

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *extra)
    return mapped(rows, work, ", ".join(["vec_id long", "dim int", "x binary", *(f"`{name}` {kinds[name]}" for name in extra)]))


def matrix(rows: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of integers."""
    if not len(rows):
        return np.zeros((0, 0), np.int64)
    return np.frombuffer(b"".join(rows.to_pylist()), "<i4").reshape(len(rows), -1).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 53:  # doubles hold all sums exactly, in any order
        x, c = x.astype(float), c.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1) if len(c) else np.zeros((len(x), 0), np.int64)


def summed(frame: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """``size`` exact sums over all rows: add() adds a batch to its partition's sums, Spark adds up the partitions'."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            add(sums, batch)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], ["place", "total"])

    out = np.zeros(size, np.int64)
    for row in mapped(frame, work, "place int, total long").groupBy("place").agg(F.sum("total").alias("total")).collect():
        out[row.place] = row.total
    return out
