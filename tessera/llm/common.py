"""What the operators share: checkpoints, Arrow text blocks and byte hashing.

Conventions for every operator: a null text counts as an empty text unless the docstring says
otherwise, repeated ids are treated as separate rows, extra columns are ignored, and an empty table
gives an empty result with the full schema.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in a local session, which has no other machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpoint(frame: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


#: Bytes of one Arrow batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def mapped(frame: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """frame.mapInArrow over batches of bounded size; freed memory goes back to the system once a partition is done."""
    conf = frame.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != f"{BATCH_BYTES}b":
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return frame.mapInArrow(trimmed(work), schema)


def packed(hashes: np.ndarray, kept: int) -> np.ndarray:
    """The leading bytes of each 64-bit hash, one after the other, so that byte strings sort as the hashes do."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :kept].ravel()


def unpacked(data: bytes | pa.Buffer | np.ndarray, kept: int) -> np.ndarray:
    """The numbers that packed() wrote: each hash shifted down to its leading bytes."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, kept)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - kept :] = raw
    return out.view(">u8").ravel().astype(np.uint64)


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array whose values are consecutive runs of data of these sizes in bytes."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, giving freed memory back to the system once a partition is done; workers are used again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                with contextlib.suppress(OSError, AttributeError):
                    ctypes.CDLL(None).malloc_trim(0)

    return run


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id falls in fold -1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)).cast("int"), F.lit(-1))


def text_blocks(texts: pa.Array | pa.ChunkedArray, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, row after the last, their UTF-8 bytes, the offsets in those.

    A text longer than the limit is a run of its own, whole. Nulls are empty texts.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):  # no chunk at all
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


#: Odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte, by rule.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            _powers = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, BASE, np.uint64))])
            _inverses = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, inverse, np.uint64))])
    return _powers[:n], _inverses[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], equal for equal bytes wherever they stand."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


#: Words up to this many bytes are hashed by span_hashes, where equal sums of different words begin far beyond.
WORD_BYTES = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], equal for equal bytes.

    Sums of powers modulo 2**64 agree for some long words that a rule makes, whatever the base; longer words are digested instead.
    """
    out = span_hashes(data, starts, ends)
    for k in np.flatnonzero(ends - starts > WORD_BYTES):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased and everything else as it is."""
    return _FOLDED[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, none across rows, and the index of each row's first word (one more at the end)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def stored(frame: DataFrame, free: bool = False) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again.

    free: what led to the table moved much, so its shuffle files are to go now. Spark deletes them once the driver has collected
    the garbage that refers to them, which takes two collections.
    """
    context = frame.sparkSession.sparkContext
    path = f"{shared_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    for wait in (0, 0.15) if free else ():
        time.sleep(wait)
        gc.collect()
        context._jvm.System.gc()
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Delete the files of a frame that stored() gave, once nothing reads them any more."""
    context = frame.sparkSession.sparkContext
    folder = shared_folder(frame.sparkSession)
    for path in {name.rsplit("/", 1)[0] for name in frame.inputFiles()}:
        if "/table-" in path and path.split(":", 1)[-1].lstrip("/").startswith(folder.split(":", 1)[-1].lstrip("/")):
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def unused(name: str, names: list[str]) -> str:
    """The name, with underscores before it until no column in names has it, whatever its case."""
    taken = {x.lower() for x in names}
    while name in taken:
        name = f"_{name}"
    return name
