"""Text quality by a factorisation machine over hashed words, structure statistics and metadata of the text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold, mapped, span_hashes, text_blocks, word_bounds
from tessera.llm.labelled import labelled_sample, score_texts, sigmoid

RANK = 8
WORD_BITS = 16
BINS = 12
#: Labelled rows that the machine is fitted on, at most.
FIT_ROWS = 3000
FOLDS, HELD_OUT = 3, 1
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_kinds = np.arange(256)
_UPPER, _LOWER, _DIGIT, _LINE = (_kinds >= 65) & (_kinds < 91), (_kinds >= 97) & (_kinds < 123), (_kinds >= 48) & (_kinds < 58), _kinds == 10
_MARK = (_kinds > 32) & (_kinds < 127) & ~_UPPER & ~_LOWER & ~_DIGIT
_BAR = _kinds == 124
_HIGH = _kinds >= 128
STATISTICS = 11


def _rate(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(hit)])
    return np.diff(sums[offsets]) / np.maximum(1, np.diff(offsets))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: word buckets (flat, each word and its ending), their bounds, and the active bin of each statistic."""
    starts, ends, first = word_bounds(data, offsets, _WORD)
    whole = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    tail = span_hashes(data, np.maximum(starts, ends - 2), ends) if len(starts) else whole
    words = np.empty(2 * len(starts), np.int64)
    words[0::2] = (whole >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    words[1::2] = (tail >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    n_words = np.diff(first)
    n_bytes = np.diff(offsets)
    row = np.repeat(np.arange(len(n_words)), n_words)
    order = np.lexsort((whole, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (whole[order][1:] != whole[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][fresh], minlength=len(n_words))
    mean = np.bincount(row, ends - starts, len(n_words)) / np.maximum(1, n_words)
    space = (n_bytes - np.bincount(row, ends - starts, len(n_words))) / np.maximum(1, n_bytes)
    rates = [_rate(kind[data], offsets) for kind in (_UPPER, _MARK, _DIGIT, _BAR, _LINE, _HIGH)]
    spread = [np.sqrt(r) * BINS for r in rates]  # finer for small rates
    stats = [*spread, np.log2(1 + n_words), np.log2(1 + n_bytes) - 3, mean, BINS * distinct / np.maximum(1, n_words), np.sqrt(space) * BINS]
    bins = np.stack([np.clip(s, 0, BINS - 1).astype(np.int64) + k * BINS for k, s in enumerate(stats)], 1)
    return words, 2 * first, bins + (1 << WORD_BITS)


class FactorisationMachine:
    """bias + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j, the pairs by (sum of v x)**2 - sum of (v x)**2.

    x is 1 for the active bin of a statistic and 1 / (number of word features) for each word feature.
    """

    def __init__(self) -> None:
        size = (1 << WORD_BITS) + STATISTICS * BINS
        self.w = np.zeros(size, np.float32)
        self.v = np.random.default_rng(7).normal(0, 0.05, (size, RANK)).astype(np.float32)
        self.bias = 0.0

    def raw(self, words: np.ndarray, bounds: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The machine's value and the factor sums of each text, in time linear in the features."""
        n = np.maximum(1, np.diff(bounds)).astype(np.float32)
        total = lambda x: np.diff(np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0, dtype=float)])[bounds], axis=0)
        linear = total(self.w[words]) / n + self.w[bins].sum(1)
        sums = self.v[bins].sum(1, dtype=float)
        squares = (self.v[bins] ** 2).sum(1, dtype=float)
        v = self.v[words]
        sums += total(v) / n[:, None]
        squares += total(v * v) / (n * n)[:, None]
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(1), sums

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(*features(data, offsets))[0])

    def fit(self, texts: list[str], y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.1) -> FactorisationMachine:
        """Adagrad over batches of texts in a fixed random order; a constant where one class is missing."""
        if not len(y) or y.min() == y.max():
            self.w[:], self.v[:] = 0, 0
            self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
            return self
        made = [features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t in texts]
        weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
        gw, gv, gb = np.full(self.w.shape, 1e-4, np.float32), np.full(self.v.shape, 1e-4, np.float32), 1e-4
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                rows = order[k : k + batch]
                words = np.concatenate([made[i][0] for i in rows])
                bounds = np.concatenate([[0], np.cumsum([len(made[i][0]) for i in rows])])
                bins = np.concatenate([made[i][2] for i in rows])
                value, sums = self.raw(words, bounds, bins)
                error = ((sigmoid(value) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                n = np.diff(bounds)
                x = np.concatenate([np.repeat(1 / np.maximum(1, n), n), np.ones(bins.size)]).astype(np.float32)
                at = np.concatenate([words, bins.ravel()])
                owner = np.concatenate([np.repeat(np.arange(len(rows)), n), np.repeat(np.arange(len(rows)), bins.shape[1])])
                keys, place = np.unique(at, return_inverse=True)
                ex = error[owner] * x
                dw = np.bincount(place, ex, len(keys)).astype(np.float32) + 1e-5 * self.w[keys]
                exx = np.bincount(place, ex * x, len(keys))
                dv = np.stack([np.bincount(place, ex * sums[owner, f], len(keys)) for f in range(RANK)], 1) - self.v[keys] * exx[:, None] + 1e-4 * self.v[keys]
                gw[keys] += dw**2
                gv[keys] += dv.astype(np.float32) ** 2
                gb += float(error.sum()) ** 2
                self.w[keys] -= rate * dw / np.sqrt(gw[keys])
                self.v[keys] -= (rate * 0.3 * dv / np.sqrt(gv[keys])).astype(np.float32)
                self.bias -= rate * float(error.sum()) / gb**0.5
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> FactorisationMachine:
    texts, y = labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), FOLDS) != HELD_OUT, fit_rows)
    return FactorisationMachine().fit(texts, y)


def quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, learned from labels.quality outside the held-out fold.

    A null or empty text is scored by its statistics alone. Without labels of both kinds the score is a constant. Rows that
    repeat an id are scored each, texts of any length whole; a score of one half predicts 1. Extra columns are ignored.
    """
    return score_texts(docs, fit_quality(docs, labels, fit_rows).score, fold(F.col("doc_id"), FOLDS) == HELD_OUT)


def keep_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that the classifier doesn't reject (score of one half or more), in the columns of docs."""
    from collections.abc import Iterator

    import pyarrow as pa

    score = fit_quality(docs, labels, fit_rows).score
    text = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.concatenate([*[score(data, offsets) for _, _, data, offsets in text_blocks(batch.column(text))], np.zeros(0)])
            yield batch.filter(pa.array(scores >= 0.5))

    return mapped(docs, work, docs.schema)
