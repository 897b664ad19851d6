"""Which hashes of a corpus stand in two of its texts, by a shuffle whose size follows the data.

Rows of hashes carry a chunk, a number that groups rows of about one Arrow batch. Each chunk's hashes are made
distinct and counted, dealt out by hash in sorted blocks, counted over all chunks, and those of two or more rows go
back to the chunks that hold them. A hash travels once a chunk however many of its rows hold it, so one that stands
in a third of all rows fills no task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import binaries, mapped, packed, unpacked

#: Hashes of one task, and the buckets among which it has them.
TASK_HASHES, BUCKETS = 4_000_000, 16
#: Partitions of a shuffle at most; beyond, a task works through more buckets, one after the other.
MOST_PARTS = 20_000
#: Hashes of a chunk that a task holds before it sends them on.
CHUNK_HASHES = 2_000_000


def parts_of(hashes: int) -> int:
    """Partitions for so many hashes."""
    return min(MOST_PARTS, max(1, -(-hashes // TASK_HASHES)))


def buckets_of(hashes: int) -> int:
    """Buckets for so many hashes, each of which a task holds at once."""
    return BUCKETS * max(1, -(-hashes // TASK_HASHES))


def kept_bytes(hashes: int) -> int:
    """Leading bytes of each of so many hashes that are counted: enough that one in 32 at most agrees with another by chance.

    Hashes that agree in them count as one, which costs work but no result.
    """
    return min(8, max(5, -(-(max(1, hashes).bit_length() + 5) // 8)))


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each stands there."""
    hashes = np.sort(hashes)
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    start = np.flatnonzero(fresh)
    return hashes[start], np.diff(np.append(start, len(hashes)))


def blocks(chunk: int, hashes: list[np.ndarray], buckets: int, kept: int) -> pa.RecordBatch:
    """(bucket, chunk, hashes, counts) of one chunk's hashes, shifted down to ``kept`` bytes; a value stands once for each row that holds it."""
    value, count = counted(np.concatenate(hashes))
    bucket = (value % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    value, count, bucket = value[order], np.minimum(count[order], 255).astype(np.uint8), bucket[order]
    start = np.flatnonzero(np.diff(bucket, prepend=-1))
    sizes = np.diff(np.append(start, len(bucket)))
    raw = packed(value << np.uint64(64 - 8 * kept), kept)
    columns = [pa.array(bucket[start]), pa.array(np.full(len(start), chunk, np.int64)), binaries(raw, sizes * kept), binaries(count, sizes)]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "hashes", "counts"])


BLOCKS = "bucket int, chunk long, hashes binary, counts binary"


def several(rows: DataFrame, parts: int, kept: int, frequencies: bool = False) -> DataFrame:
    """(chunk, hashes, df): for each chunk its hashes that stand in two rows or more of all.

    df: in how many (4 bytes each; 255 a chunk at most count), or empty without frequencies. rows: BLOCKS, dealt to ``parts`` partitions.
    """
    width = 4 if frequencies else 0

    def solve(chunks: list[int], raw: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) for x in raw])
        value, count = np.concatenate(raw), np.concatenate(counts)
        order = np.argsort(value, kind="stable")
        fresh = np.ones(len(value), bool)
        fresh[1:] = np.diff(value[order]) != 0
        start = np.flatnonzero(fresh)
        total = np.add.reduceat(count[order].astype(np.int64), start)
        df = np.empty(len(value), np.int64)
        df[order] = total[np.cumsum(fresh) - 1]
        keep = df > 1
        left = np.add.reduceat(keep.astype(np.int64), np.cumsum(sizes) - sizes)
        some = np.flatnonzero(left)
        if len(some):
            out = packed(value[keep] << np.uint64(64 - 8 * kept), kept)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(chunks, np.int64)[some]), binaries(out, left[some] * kept), binaries(np.minimum(df[keep], 2**32 - 1).astype(np.uint32).view(np.uint8), left[some] * width)], ["chunk", "hashes", "df"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, chunks, raw, counts = None, [], [], []
        for batch in batches:
            for b, c, h, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != bucket:
                    if chunks:
                        yield from solve(chunks, raw, counts)
                    bucket, chunks, raw, counts = b, [], [], []
                chunks.append(c)
                raw.append(unpacked(h.as_buffer(), kept))
                counts.append(np.frombuffer(n.as_buffer(), np.uint8).copy())
        if chunks:
            yield from solve(chunks, raw, counts)

    return mapped(rows.repartition(parts, "bucket").sortWithinPartitions("bucket"), work, "chunk long, hashes binary, df binary")


def chunk_blocks(sets: DataFrame, buckets: int, kept: int) -> DataFrame:
    """BLOCKS of rows (chunk, hashes), each a set of packed hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and (chunk != at or size > CHUNK_HASHES):
                    yield blocks(at, held, buckets, kept)
                    held, size = [], 0
                at = chunk
                held.append(unpacked(raw.as_buffer(), kept))
                size += len(held[-1])
        if held:
            yield blocks(at, held, buckets, kept)

    return mapped(sets.select("chunk", "hashes"), work, BLOCKS)


def beside(sets: DataFrame, shared: DataFrame, parts: int) -> DataFrame:
    """The rows of sets (chunk, hashes and more) behind those that several() gives for their chunk, chunk after chunk in each partition.

    Columns: those of sets, then df, which is null in the rows of sets.
    """
    ours = sets.withColumn("df", F.lit(None).cast("binary"))
    theirs = shared.select(*[F.col(c) if c in ("chunk", "hashes") else F.lit(None).cast(t).alias(c) for c, t in sets.dtypes], "df")
    return ours.unionByName(theirs).repartition(parts, "chunk").sortWithinPartitions("chunk", F.col("df").isNull())


class ChunkTable:
    """Reads rows of beside() in order and looks hashes up among those that their chunk shares."""

    def __init__(self, kept: int):
        self.kept = kept
        self.chunk, self.parts, self.value, self.df = None, [], None, None

    def see(self, chunk: int, hashes: pa.Buffer, df: pa.Buffer) -> None:
        if chunk != self.chunk:
            self.chunk, self.parts, self.value = chunk, [], None
        value = unpacked(hashes, self.kept)
        self.parts.append((value, np.frombuffer(df, np.uint32).copy() if df.size else np.full(len(value), 2, np.uint32)))

    def look_up(self, chunk: int, hashes: np.ndarray) -> np.ndarray:
        """In how many rows each hash stands (2 where frequencies aren't given), 1 for those of one row."""
        if chunk != self.chunk:
            self.chunk, self.parts, self.value = chunk, [], None
        if self.value is None:
            value = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in self.parts)])
            df = np.concatenate([np.zeros(0, np.uint32), *(x for _, x in self.parts)])
            order = np.argsort(value)
            self.value, self.df, self.parts = value[order], df[order], []
        if not len(self.value):
            return np.ones(len(hashes), np.int64)
        at = np.searchsorted(self.value, hashes)
        at[at == len(self.value)] = 0
        return np.where(self.value[at] == hashes, self.df[at].astype(np.int64), 1)
