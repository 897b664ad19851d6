"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Each of ``TABLES`` tables rotates a vector twice pseudo-randomly (three rounds of sign flips and Hadamard
transform each) and takes the nearest signed axis of both as its bucket; ``PROBES`` next best buckets are
visited too. Pairs that meet are compared by cosine in double precision, each once: in the first table
where they meet. Equal vectors are one vector with a weight. A bucket with many vectors is compared in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import binaries, mapped, stored
from tessera.llm.components import components

THRESHOLD = 0.93
TABLES, PROBES, NEAREST = 8, 2, 3
#: Vectors of a bucket in one block; two blocks are a tile.
BLOCK = 1024
SEED = 20_231


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Walsh-Hadamard transform of rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def buckets(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """vectors x tables x (1 + probes) bucket numbers, a vector's own bucket first."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    near = min(NEAREST, width)
    pairs = np.array(list(product(range(near), repeat=2)))
    out = np.empty((len(x), tables, min(1 + probes, len(pairs))), np.int32)
    for t in range(tables):
        axes, size = [], []
        for f in range(2):
            rng = np.random.default_rng((SEED, t, f))
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            best = np.argsort(-np.abs(y), 1, kind="stable")[:, :near]
            value = np.take_along_axis(y, best, 1)
            axes.append(2 * best + (value > 0))
            size.append(np.abs(value))
        loss = (size[0][:, :1] - size[0])[:, pairs[:, 0]] + (size[1][:, :1] - size[1])[:, pairs[:, 1]]
        number = axes[0][:, pairs[:, 0]] * (2 * width) + axes[1][:, pairs[:, 1]]
        order = np.argsort(loss, 1, kind="stable")[:, : out.shape[2]]
        out[:, t] = np.take_along_axis(number, order, 1)
    return out


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs with bucket lists a and b of one table meet: the own bucket of one is in the list of the other."""
    return (a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)


def tile_links(v: np.ndarray, codes: np.ndarray, own: np.ndarray, block: np.ndarray, table: int, bucket: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of one tile that are counted here: unit vectors v, their codes, whether the bucket is their own, their blocks."""
    if block.min() == block.max():
        left = right = np.arange(len(v))
    else:
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    # A matrix product may differ from the pair's own sum in the last bits; the own sum decides.
    i, j = np.nonzero(v[left] @ v[right].T >= threshold - 1e-9)
    i, j = left[i], right[j]
    keep = own[i] | own[j]
    if left is right:
        keep &= i < j
    i, j = i[keep], j[keep]
    keep = np.einsum("ij,ij->i", v[i], v[j]) >= threshold
    mine, other = codes[i, table, 0], codes[j, table, 0]
    both = (mine[:, None] == codes[j, table]).any(1) & (other[:, None] == codes[i, table]).any(1)
    keep &= ~both | (np.minimum(mine, other) == bucket)
    for t in range(table):
        keep &= ~_meet(codes[i, t], codes[j, t])
    return i[keep], j[keep]


def _star(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n nodes reaches over pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, v): v the components as doubles, or null where the vector links with nothing."""
    for batch in batches:
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype(float)  # a null is not a number here
        size = np.diff(offsets)
        within = lambda what: np.diff(np.concatenate([[0], np.cumsum(what)])[offsets])
        valid = lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        good = valid & (size > 0) & (within(~np.isfinite(values)) == 0) & (within(values != 0) > 0)
        used = values[offsets[0] : offsets[-1]][np.repeat(good, size)]
        v = binaries(used.view(np.uint8), np.where(good, 8 * size, 0))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pc.if_else(pa.array(good), v, pa.scalar(None, pa.binary()))], ["vec_id", "label", "v"])


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), float).reshape(len(rows), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # squares stay in range
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, mark, label, dim, codes): the buckets that a distinct vector visits, table after table, its own first in each."""
    for batch in batches:
        raw = batch.column("v").to_pylist()
        sizes = np.array([len(x) for x in raw])
        for size in np.unique(sizes):
            for part in np.array_split(np.flatnonzero(sizes == size), 1 + (sizes == size).sum() // 1000):
                codes = buckets(_unit([raw[k] for k in part]))
                rows = batch.take(pa.array(part))
                offsets = np.arange(len(part) + 1, dtype=np.int32) * codes[0].size
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("rep"), rows.column("mark"), rows.column("label"), pa.array(np.full(len(part), size // 8, np.int32)), lists], ["rep", "mark", "label", "dim", "codes"])


def _tiles(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by tile to (a, b, links): b the smallest vector that a reaches in the tile, links the weight linked."""
        key, rows = None, []

        def solve(key: tuple, rows: list[tuple]) -> tuple | None:
            if len(rows) < 2:
                return None
            rep, weight, own, block, codes, v = zip(*rows, strict=True)
            unit = _unit(v)
            near = unit @ unit.T >= threshold - 1e-9
            np.fill_diagonal(near, False)
            if not near.any():  # as in most buckets
                return None
            rep, weight = np.array(rep), np.array(weight)
            order = np.argsort(rep, kind="stable")
            codes = np.array(codes, np.int32).reshape(len(rows), TABLES, -1)
            i, j = tile_links(unit[order], codes[order], np.array(own)[order], np.array(block)[order], key[2], key[3], threshold)
            if not len(i):
                return None
            rep, weight = rep[order], weight[order]
            total = np.bincount(i, weight[j], len(rep)) + np.bincount(j, weight[i], len(rep))
            low = _star(i, j, len(rep))
            used = total > 0
            return rep[used], rep[low[used]], total[used].astype(np.int64)

        def flush(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*done, strict=True)], ["a", "b", "links"])

        done = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:6] != key:
                    if rows and (found := solve(key, rows)):
                        done.append(found)
                    key, rows = row[:6], []
                rows.append(row[6:])
            if len(done) > 500:
                yield flush(done)
                done = []
        if rows and (found := solve(key, rows)):
            done.append(found)
        if done:
            yield flush(done)

    return work


def embedding_links(distinct: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links) from distinct vectors (rep, n, label, v): see _tiles.

    Vectors are hashed once; their buckets travel without them. A vector follows to those of its buckets that hold another one, once
    for each tile.
    """
    place = ["label", "dim", "t", "bucket"]
    distinct = distinct.withColumn("mark", F.xxhash64("v"))
    coded = stored(mapped(distinct.select("rep", "mark", "label", "v"), _hashed, "rep long, mark long, label string, dim int, codes array<int>"))
    visits = coded.select("rep", "mark", "label", "dim", F.posexplode("codes").alias("at", "bucket"), (F.size("codes") / TABLES).cast("int").alias("each"))
    visits = visits.select("rep", "mark", "label", "dim", F.expr("at div each").cast("int").alias("t"), "bucket", (F.col("at") % F.col("each") == 0).alias("own"))
    sizes = visits.groupBy(*place).agg(F.count("*").alias("m"), F.count_if("own").alias("k")).where("m > 1 AND k > 0").select(*place, F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = visits.join(sizes, place).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    with_ = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("with", with_).withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))
    keys = [*place, "low", "high"]
    vectors = distinct.select("rep", "mark", "n", "v").join(coded.select("rep", "mark", "codes"), ["rep", "mark"])
    rows = rows.drop("blocks", "with").join(vectors, ["rep", "mark"])
    rows = rows.select(*keys, "rep", "n", "own", "block", "codes", "v").repartition(*keys).sortWithinPartitions(*keys)
    return mapped(rows, _tiles(threshold), "a long, b long, links long")


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Rows with equal non-null labels and cosine of the threshold or more are linked; component_id is the smallest
    vec_id reachable, kept whether that is the row's own. A null or empty vector, one that is zero or holds null or
    a non-finite component, and a row without an id link with nothing. Vectors of different lengths aren't compared.
    Rows that repeat an id count as rows of their own. Labels of any type are compared by value. Vectors whose cosine is the
    threshold exactly link; extra columns are ignored.
    """
    label = F.col("label")
    if dict(vectors.dtypes)["label"] in ("float", "double"):
        label = label + F.lit(0.0)  # -0.0 equals 0.0
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id").isNotNull(), label.cast("string")).alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = mapped(rows, _clean, "vec_id long, label string, v binary").withColumn("mark", F.sha2("v", 256))
    distinct = stored(rows.where("v IS NOT NULL").groupBy("label", "mark").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    found = stored(embedding_links(distinct.select("rep", "n", "label", "v"), threshold))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    labels = components(found.select("a", "b")).select(F.col("node").alias("rep"), "component")
    known = distinct.select("label", "mark", "rep", "n").join(counts, "rep", "left").join(labels, "rep", "left")
    known = known.select("label", "mark", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "label", "mark").join(known, ["label", "mark"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
