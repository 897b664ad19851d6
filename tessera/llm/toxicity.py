"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_VALUES, fold, folded, mix, powers
from tessera.llm.labelled import labelled_sample, score_texts, sigmoid

GRAMS = (4, 6)
BUCKET_BITS = 18
#: Labelled rows that the classifier is fitted on, at most.
FIT_ROWS = 4000
#: A bucket counts from so many texts, and from so large a log-count ratio; less tells nothing about other texts.
LEAST_TEXTS, LEAST_RATIO = 8, 1.0
FOLDS = 5
_LETTER = np.zeros(256, bool)
_LETTER[np.r_[48:58, 97:123, 128:256]] = True
_SPACE = np.uint8(32)


def gram_buckets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each position, and whether it lies within one text.

    Letters are lower-cased (A-Z) and all else is a space; n-grams of texts that follow each other are void.
    """
    if len(data) < n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    low = folded(data)
    low = np.where(_LETTER[low], low, _SPACE)
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[low] * power[:-1], out=sums[1:])
    m = len(data) - n + 1
    value = mix((sums[n:] - sums[:m]) * inverse[:m] + np.uint64(n))
    inside = np.ones(m, bool)
    for back in range(1, n):
        inner = offsets[1:-1] - back
        inside[inner[(inner >= 0) & (inner < m)]] = False
    return (value >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), inside


def _padded(text: str) -> bytes:
    return b" " + text.encode() + b" "


class CharNB:
    """score = sigmoid(bias + mean over a text's n-grams of the weights of their buckets)."""

    def __init__(self) -> None:
        self.weights = np.zeros((len(GRAMS), 1 << BUCKET_BITS), np.float32)
        self.bias = 0.0

    def fit(self, texts: list[str], y: np.ndarray, rounds: int = 60, rate: float = 0.3, decay: float = 1e-5) -> CharNB:
        """Logistic regression by Adam over relative counts times log-count ratios; a constant where one class is missing."""
        if not len(y) or y.min() == y.max():
            self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
            return self
        columns, values, sizes = [], [], []
        for text in texts:
            data = np.frombuffer(_padded(text), np.uint8)
            found = []
            for g, n in enumerate(GRAMS):
                bucket, inside = gram_buckets(data, np.array([0, len(data)]), n)
                found.append(bucket[inside] + (g << BUCKET_BITS))
            found, count = np.unique(np.concatenate(found), return_counts=True)
            columns.append(found.astype(np.int32))
            values.append((count * (100.0 / max(1, len(data)))).astype(np.float32))
            sizes.append(len(found))
        column, row = np.concatenate(columns), np.repeat(np.arange(len(texts)), sizes)
        width = len(GRAMS) << BUCKET_BITS
        pos = np.bincount(column, y[row] == 1, width) + 0.5
        neg = np.bincount(column, y[row] == 0, width) + 0.5
        ratio = np.log((pos / (y == 1).sum()) / (neg / (y == 0).sum())).astype(np.float32)
        seen = np.bincount(column, minlength=width) >= LEAST_TEXTS
        ratio[~seen | (np.abs(ratio) < LEAST_RATIO)] = 0
        use = ratio[column] != 0
        column, row, value = column[use], row[use], np.concatenate(values)[use] * ratio[column[use]]
        # Classes weigh alike while the weights are learned; the bias then takes the frequencies back.
        weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()) / len(y)
        w, bias = np.zeros(width, np.float32), 0.0
        m, v, mb, vb = np.zeros(width, np.float32), np.zeros(width, np.float32), 0.0, 0.0
        for t in range(1, rounds + 1):
            p = sigmoid(np.bincount(row, value * w[column], len(y)) + bias)
            error = (p - y) * weight
            grad = np.bincount(column, value * error[row].astype(np.float32), width).astype(np.float32) + decay * w
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.99 * vb + 0.01 * error.sum() ** 2
            step = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
            w -= step * 0.1 * m / (np.sqrt(v) + 1e-6)
            bias -= step * 0.1 * mb / (np.sqrt(vb) + 1e-6)
        self.weights = (100.0 * w * ratio).reshape(self.weights.shape).astype(np.float32)
        self.bias = float(bias)
        return self

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability for each text."""
        # A space goes before and after each text, so that its first and last words have their ends.
        n_texts = len(offsets) - 1
        size = np.diff(offsets)
        padded = np.full(len(data) + 2 * n_texts, _SPACE, np.uint8)
        shifted = offsets + 2 * np.arange(n_texts + 1)
        place = np.arange(len(data)) + np.repeat(2 * np.arange(n_texts) + 1, size)
        padded[place] = data
        total = np.zeros(n_texts)
        for g, n in enumerate(GRAMS):
            bucket, inside = gram_buckets(padded, shifted, n)
            sums = np.concatenate([[0.0], np.cumsum(np.where(inside, self.weights[g][bucket], 0), dtype=float)])
            total += np.diff(sums[np.minimum(shifted, len(bucket))])
        return sigmoid(self.bias + total / np.maximum(1, size + 2))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, learned from labels.toxic outside the held-out fold.

    A null or empty text gets the score of a text without n-grams that were learned. Without labels of both
    kinds the score is a constant. Rows that repeat an id are scored each, texts of any length whole; a score of one half
    predicts 1. Extra columns are ignored.
    """
    texts, y = labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), FOLDS) != 0, fit_rows)
    return score_texts(docs, CharNB().fit(texts, y).score, fold(F.col("doc_id"), FOLDS) == 0)
