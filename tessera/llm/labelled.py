"""Bounded samples of labelled rows for fitting, and scoring of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mapped, text_blocks


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most ``limit`` labelled documents, the first by a hash of their id.

    Half the bound is kept for each label, so a rare label isn't crowded out. learn: which ids may be
    learned from. Null labels and labels without a document are ignored; an id that is labelled more than
    once counts by its mean label, 1 from one half.
    """
    known = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    halves = [known.where(F.col("y") == y).orderBy(*order).limit(limit // 2) for y in (0, 1)]
    chosen = halves[0].unionByName(halves[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id").limit(2 * limit).select("text", "y").collect()
    return [r.text or "" for r in rows], np.array([r.y for r in rows], float)


def score_texts(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], held_out: Column, block: int = 1 << 18) -> DataFrame:
    """(doc_id, held_out, score, predicted): a score for every whole text, in blocks of about ``block`` bytes.

    score: from the bytes of some texts and their offsets to one probability for each text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(data, offsets) for _, _, data, offsets in text_blocks(batch.column(2), block)]
            scores = np.concatenate([*scores, np.zeros(0)]).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return mapped(rows, work, "doc_id long, held_out boolean, score double, predicted int")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
