"""Harmonic packing of token sequences.

A length in (C/(k+1), C/k] belongs to class k of capacity C, and each bin of class k takes k pieces. As
documents may be cut, each is cut to the capacity's unit fractions: whole sequences first, then the largest
C//k that fits, until a tail of at most ``TAIL`` tokens is left, which goes to the class of its length.
Every worker fills bins of its own. The pieces of bins that are not full at the end of a worker's input are
laid end to end and cut at the capacity, so each worker pads one sequence besides the classes' rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mapped
from tessera.llm.tokens import encoder, vocabulary_files

CAPACITY = 1024
END_OF_TEXT = 0
TAIL = 64
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[int]:
    """Lengths of the pieces into which n tokens are cut."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > tail:
        k = -(-capacity // n)
        while capacity // k > n:
            k += 1
        out.append(capacity // k)
        n -= capacity // k
    return out + [n] if n else out


class Packer:
    """The open bins of one worker; emits rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, tail: int = TAIL):
        self.capacity, self.tail, self.sequence = capacity, tail, first_sequence
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def close(self, bin_: list[tuple]) -> None:
        offset = 0
        for doc_id, start, length, ids, total in bin_:
            self.rows.append((doc_id, start, length, ids, total, self.sequence, offset))
            offset += length
        self.sequence += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        start = 0
        for length in cuts(total, self.capacity, self.tail):
            k = self.capacity // length
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], total))
            start += length
            if len(bin_) == k:
                self.close(self.open.pop(k))

    def finish(self) -> None:
        room, bin_ = self.capacity, []
        for k in sorted(self.open):
            for doc_id, start, length, ids, total in self.open[k]:
                while length:
                    n = min(length, room)
                    bin_.append((doc_id, start, n, ids[: 4 * n], total))
                    start, length, ids, room = start + n, length - n, ids[4 * n :], room - n
                    if not room:
                        self.close(bin_)
                        room, bin_ = self.capacity, []
        if bin_:
            self.close(bin_)
        self.open = {}

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pack(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str] | None = None, emit: int = 4_000) -> DataFrame:
    """Pack whole texts into sequences of at most ``capacity`` tokens; one row per piece.

    ids: the piece's token ids as little-endian unsigned 32-bit integers. Every document ends with id 0,
    so a null or empty text is one piece of one token. Rows that repeat an id are packed each, texts of any length whole; extra columns are ignored. A sequence's
    pieces lie gapless from offset 0. ``sequence_id`` is unique; its upper bits are the worker's number.
    Holds at most one bin for each class, and ``emit`` rows, at a time.
    """
    files = files or vocabulary_files()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(*files)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        end = np.array([END_OF_TEXT], "<u4").tobytes()
        for batch in batches:
            last: dict[str, bytes] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = last.get(text)
                if ids is None:
                    ids = encode(text) + end
                    if len(last) < 2000 and len(text) < 20_000:
                        last[text] = ids
                packer.add(doc_id, ids)
                if len(packer.rows) >= emit:
                    yield _batch(packer.take())
        packer.finish()
        yield _batch(packer.take())

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, SCHEMA)


def packing_digest(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pack() with each piece's ids as their unsigned crc32."""
    return pack(docs, capacity).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
