"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte position gets a distribution over the languages; a document's is their mean. The network is
trained here by backpropagation through time. Texts are read whole, in segments of ``SEGMENT`` bytes that
each begin from the zero state, many segments side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold, mapped, text_blocks

FOLDS = 5
HIDDEN = 8
SEGMENT = 128
#: Documents of each language that the network is trained on, at most; segments are drawn from their whole texts.
FIT_DOCS = 400
#: Segments times languages that are scored side by side, at most.
SIDE_BY_SIDE = 1024 * 100
UNDETERMINED = "und"


class Direction:
    """One gated recurrent layer; gates and candidate side by side in the weights (z, r, n)."""

    def __init__(self, rng: np.random.Generator, classes: int, hidden: int):
        self.e = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        self.o = rng.normal(0, hidden**-0.5, (hidden, classes)).astype(np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.e, self.u, self.o]

    def run(self, x: np.ndarray, keep: bool = False):
        """x: time x batch bytes. Yields each step's state; with keep, also what the backward pass needs."""
        k = self.u.shape[0]
        h = np.zeros((x.shape[1], k), np.float32)
        for row in x:
            a, b = self.e[row], h @ self.u
            gates = a[:, : 2 * k] + b[:, : 2 * k]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :k], gates[:, k:]
            n = np.tanh(a[:, 2 * k :] + r * b[:, 2 * k :])
            new = n + z * (h - n)
            yield (new, (row, h, z, r, n, b[:, 2 * k :])) if keep else new
            h = new


class BiGRU:
    """Probabilities of the languages at each byte, from a forward and a backward pass."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.sides = [Direction(rng, len(languages), hidden) for _ in range(2)]
        self.bias = np.zeros(len(languages), np.float32)

    def positions(self, x: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
        """time x batch x languages probabilities. length: the bytes of each segment; what stands behind them changes nothing before."""
        forward, backward = self.sides
        out, back = (np.empty((*x.shape, len(self.bias)), np.float32) for _ in range(2))
        for t, h in enumerate(forward.run(x)):
            np.matmul(h, forward.o, out=out[t])
        # The backward pass begins at each segment's own last byte.
        lane = np.arange(x.shape[1])
        place = np.maximum((len(x) if length is None else length) - 1 - np.arange(len(x))[:, None], 0) + 0 * lane
        for t, h in enumerate(backward.run(x[place, lane])):
            np.matmul(h, backward.o, out=back[t])
        out += back[place, lane]
        out += self.bias
        out -= out.max(2, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(2, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of the labels over all positions of x (time x batch), and its gradient for each side's weights and the bias."""
        length, batch = x.shape
        k = self.sides[0].u.shape[0]
        runs = [list(self.sides[0].run(x, True)), list(self.sides[1].run(x[::-1], True))[::-1]]
        logits = np.stack([f[0] @ self.sides[0].o + b[0] @ self.sides[1].o for f, b in zip(*runs, strict=True)]) + self.bias
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        loss = -float(np.log(p[:, np.arange(batch), label]).mean())
        p[:, np.arange(batch), label] -= 1
        p /= p.shape[0] * batch
        grads = []
        for s, side in enumerate(self.sides):
            de, du, do = np.zeros_like(side.e), np.zeros_like(side.u), np.zeros_like(side.o)
            dh = np.zeros((batch, k), side.u.dtype)
            for t in range(length - 1, -1, -1) if s == 0 else range(length):
                h, (row, old, z, r, n, bn) = runs[s][t]
                do += h.T @ p[t]
                dh = dh + p[t] @ side.o.T
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (old - n) * z * (1 - z)
                dr = dn * bn * r * (1 - r)
                da = np.concatenate([dz, dr, dn], 1)
                db = np.concatenate([dz, dr, dn * r], 1)
                np.add.at(de, row, da)
                du += old.T @ db
                dh = dh * z + db @ side.u.T
            grads += [de, du, do]
        grads.append(p.sum((0, 1)))
        return loss, grads

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = 240, batch: int = 128, length: int = 48, rate: float = 0.02) -> BiGRU:
        """Cross-entropy at every position of random segments, languages drawn alike; Adam."""
        rng = np.random.default_rng(3)
        by_class = [np.flatnonzero(y == c) for c in range(len(self.languages))]
        weights = [w for side in self.sides for w in side.weights()] + [self.bias]
        m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, steps + 1):
            label = rng.integers(0, len(self.languages), batch)
            x = np.full((batch, length), 32, np.uint8)
            for i, c in enumerate(label):
                text = texts[rng.choice(by_class[c])]
                at = rng.integers(0, max(1, len(text) - length + 1))
                piece = np.frombuffer(text[at : at + length], np.uint8)
                x[i, : len(piece)] = piece
            _, grads = self.gradients(np.ascontiguousarray(x.T), label)
            lr = rate * min(1, 2 * (1 - step / (steps + 1)))
            for w, g, a, b in zip(weights, grads, m, v, strict=True):
                np.clip(g, -1, 1, out=g)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return self

    def pooled(self, data: np.ndarray, offsets: np.ndarray, side_by_side: int = 1024) -> np.ndarray:
        """Mean distribution over all bytes of each text; zeros for an empty one."""
        size = np.diff(offsets)
        pieces = -(-size // SEGMENT)
        row = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[:-1][row] + nth * SEGMENT
        length = np.minimum(SEGMENT, offsets[1:][row] - start)
        total = np.zeros((len(size), len(self.bias)))
        order = np.argsort(length, kind="stable")
        step = np.arange(SEGMENT)
        side_by_side = max(1, min(side_by_side, SIDE_BY_SIDE // len(self.bias)))
        for k in range(0, len(order), side_by_side):
            part = order[k : k + side_by_side]
            most = length[part[-1]]
            inside = step[:most, None] < length[part]
            at = np.where(inside, start[part] + step[:most, None], 0)
            p = self.positions(np.where(inside, data[at], np.uint8(32)), length[part])
            p *= inside[:, :, None]
            np.add.at(total, row[part], p.sum(0))
        return total / np.maximum(1, size)[:, None]


def fit_language(docs: DataFrame, fit_docs: int = FIT_DOCS) -> BiGRU | None:
    """A network for the non-null languages outside the held-out fold; None where there is none.

    The sample is bounded by fit_docs for each language, the first by a hash of the id.
    """
    known = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) > 0))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    lottery = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, fit_docs / counts[lang])))])
    drawn = known.where(lottery < F.element_at(share, F.col("lang"))).select("doc_id", "lang", "text")
    rows = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * fit_docs * len(languages)).collect()
    rows = [r for r in rows if r.text]
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    return BiGRU(languages).fit([r.text.encode() for r in rows], np.array([languages.index(r.lang) for r in rows]))


def language(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document.

    A text that is null or has no letter (Unicode category L) is ``und`` with score 0; so is every text where no language is
    known to learn from. The score is the mean probability of the predicted language over all bytes; of languages with equal
    means the first in the order of their names. Rows that repeat an id are judged each, and texts of any length are read whole.
    """
    network = fit_language(docs, fit_docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for first, last, data, offsets in text_blocks(batch.column(2)) if network else ():
                pooled = network.pooled(data, offsets)
                best = pooled.argmax(1)
                for i, text in enumerate(batch.column(2)[first:last]):
                    text = text.as_py()
                    known = text is not None and any(map(str.isalpha, text))
                    names.append(network.languages[best[i]] if known else UNDETERMINED)
                    scores.append(float(min(1.0, pooled[i, best[i]])) if known else 0.0)
            if not network:
                names, scores = [UNDETERMINED] * len(batch), [0.0] * len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return mapped(rows, work, "doc_id long, held_out boolean, lang_pred string, score double")
