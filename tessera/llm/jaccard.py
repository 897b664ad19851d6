"""Jaccard join of documents on word n-grams by rare-first prefix filtering.

A document is the set of its shingles' 64-bit hashes, and equal sets are one node. Frequencies are exact and come from a
shuffle that grows with the corpus (shared.py), twice: first over all sets, where a set is left out that has too few shingles in
common with any other to reach the threshold, then over the sets that are left, each once. All sets are ordered alike, rare
shingles first; two sets that reach the threshold then share a shingle within their prefixes. Pairs that meet in a prefix pass
the length and positional filters, are made distinct, and are verified once, the suffix filter before the whole intersection.

A group of documents that meet in one shingle isn't expanded into all its pairs. The member that has the fewest rarer shingles,
as a text has from which the others were edited, is held against each other member first; links found so far join members into
components, then one member of each further component is held against the rest, and at last members of different components.
A text whose edits leave it short of the threshold has more shingles of its own than the positional filter lets pass, so this
last step has few pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, folded, mapped, mix, packed, stored, text_blocks, unpacked, word_bounds, word_hashes
from tessera.llm.components import components
from tessera.llm.shared import ChunkTable, beside, buckets_of, chunk_blocks, kept_bytes, parts_of, several

#: Partners of one document that one task verifies.
MEMBERS = 200
#: Bytes of sets in one batch.
SET_BYTES = 4 << 20
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than the width are one shingle, no words none."""
    low = folded(data)
    starts, ends, first = word_bounds(low, offsets, _WORD)
    word = word_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    n = len(word) - width + 1
    step = np.uint64(0xD6E8FEB86659FD93)
    rolled = np.full(max(n, 0), width, np.uint64)
    for j in range(width):
        if n > 0:
            rolled = mix(rolled * step + word[j : j + n])
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                one = mix(one * step + word[j : j + 1])
            sets.append(one)
        else:
            sets.append(word[:0])
    return sets


def document_sets(docs: DataFrame, width: int, kept: int) -> DataFrame:
    """(chunk, doc_id, n, digest, hashes) of each row of docs (doc_id, text): size and digest of its set, and the packed set.

    hashes is null without shingles or id, and where a row of the same chunk has the same set. digest is null without shingles.
    """
    names = ["chunk", "doc_id", "n", "digest", "hashes"]

    def rows(chunk, ids, sizes, marks, sets) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(([chunk] * len(ids), ids, sizes, marks, sets), kinds, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            chunk += 1
            once: set[bytes] = set()
            ids, sizes, marks, sets, size = [], [], [], [], 0
            names_of = batch.column(0).to_pylist()
            for first, _, data, offsets in text_blocks(batch.column(1)):
                for i, found in enumerate(shingle_sets(data, offsets, width)):
                    mark = hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None
                    ids.append(names_of[first + i])
                    sizes.append(len(found))
                    marks.append(mark)
                    if mark is None or ids[-1] is None or mark in once:
                        sets.append(None)
                        continue
                    once.add(mark)
                    sets.append(packed(found, kept).tobytes())
                    size += len(sets[-1])
                    if size > SET_BYTES:
                        yield rows(chunk, ids, sizes, marks, sets)
                        ids, sizes, marks, sets, size = [], [], [], [], 0
            if ids:
                yield rows(chunk, ids, sizes, marks, sets)

    return mapped(docs, work, "chunk long, doc_id long, n long, digest binary, hashes binary")


def rechunked(sets: DataFrame) -> DataFrame:
    """(chunk, node, n, hashes): sets with chunks of their own, one for each Arrow batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            chunk = pa.array(np.full(len(batch), (TaskContext.get().partitionId() << 32) + k, np.int64))
            yield pa.RecordBatch.from_arrays([chunk, *batch.columns], ["chunk", "node", "n", "hashes"])

    return mapped(sets.select("node", "n", "hashes"), work, "chunk long, node long, n long, hashes binary")


def needed(n: int, num: int, den: int) -> int:
    """The least intersection of a set of n with any set that it links to."""
    return -(-num * n // den)


def survivors(sets: DataFrame, shared: DataFrame, parts: int, kept: int, num: int, den: int) -> DataFrame:
    """The rows of sets (chunk, node, n, digest, hashes) that hold enough shingles of other rows to link with any."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(kept)
        for batch in batches:
            keep = []
            for chunk, n, raw, df in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4), batch.column(5), strict=True):
                if df.is_valid:
                    table.see(chunk, raw.as_buffer(), df.as_buffer())
                    keep.append(False)
                else:
                    keep.append(int(np.count_nonzero(table.look_up(chunk, unpacked(raw.as_buffer(), kept)) > 1)) >= needed(n, num, den))
            yield batch.filter(pa.array(keep, pa.bool_())).select(list(range(5)))

    return mapped(beside(sets.select("chunk", "node", "n", "digest", "hashes"), shared, parts), work, "chunk long, node long, n long, digest binary, hashes binary")


def prefixes(sets: DataFrame, shared: DataFrame, parts: int, kept: int, num: int, den: int) -> DataFrame:
    """(token, node, n, pos): the rare-first prefix of each of the sets (chunk, node, n, hashes), without shingles of one set alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(kept)
        for batch in batches:
            tokens, nodes, sizes, places = [], [], [], []
            for chunk, node, n, raw, df in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4), strict=True):
                if df.is_valid:
                    table.see(chunk, raw.as_buffer(), df.as_buffer())
                    continue
                mine = unpacked(raw.as_buffer(), kept)
                often = table.look_up(chunk, mine)
                met = np.flatnonzero(often > 1)
                alone = len(mine) - len(met)
                length = n - needed(n, num, den) + 1
                order = met[np.lexsort((mine[met], often[met]))][: max(0, length - alone)]
                tokens.append(mine[order].view(np.int64))
                nodes.append(np.full(len(order), node, np.int64))
                sizes.append(np.full(len(order), n, np.int32))
                places.append(np.arange(alone, alone + len(order), dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, nodes, sizes, places)], ["token", "node", "n", "pos"])

    return mapped(beside(sets.select("chunk", "node", "n", "hashes"), shared, parts), work, "token long, node long, n int, pos int")


def may_reach(a: np.ndarray, b: np.ndarray, needed: int, depth: int = 3) -> bool:
    """Suffix filter: halve both sorted sets at the same value again and again; the parts bound the intersection."""
    if min(len(a), len(b)) < needed:
        return False
    if not depth or len(a) < 8 or len(b) < 8:
        return True
    middle = a[len(a) // 2]
    i, j = len(a) // 2, int(np.searchsorted(b, middle))
    left, right = min(i, j), min(len(a) - i, len(b) - j)
    if left + right < needed:
        return False
    return may_reach(a[:i], b[:j], needed - right, depth - 1) and may_reach(a[i:], b[j:], needed - left, depth - 1)


def verified(sets: DataFrame, pairs: DataFrame, kept: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets (node, hashes) reach the threshold.

    Each set is sent once for each pair in which it is b, and a's own set once for every MEMBERS of its pairs, so
    a document with very many partners is verified by many tasks.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("m"))
    members = pairs.join(groups, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("m")).cast("int").alias("salt"), F.lit(False).alias("lead"))
    leads = groups.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("salt"), F.lit(True).alias("lead"))
    places = stored(members.unionByName(leads))
    met = places.join(sets.select("node", "hashes"), "node").select("a", "salt", "lead", "node", "hashes")
    met = met.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("lead"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, leads = None, []
        for batch in batches:
            left, right = [], []
            for a, salt, lead, node, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                if (a, salt) != place:
                    place, leads = (a, salt), []
                mine = unpacked(raw.as_buffer(), kept)
                if lead:
                    leads.append(mine)
                    continue
                for other in leads:  # more than one only where an id is repeated
                    least = -(-num * (len(mine) + len(other)) // (den + num))
                    if may_reach(mine, other, least):
                        at = np.searchsorted(other, mine)
                        at[at == len(other)] = 0
                        if np.count_nonzero(other[at] == mine) >= least:
                            left.append(a)
                            right.append(node)
                            break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return mapped(met, work, "a long, b long")


def _near(num: int, den: int, left: str, right: str) -> str:
    """Length and positional filters for two sets of sizes n at the first token that they share, at pos in the common order.

    What stands before it in either set isn't in the other. At a later shared token a pair may fail: it has met before.
    """
    small, large = f"least({left}.n, {right}.n)", f"greatest({left}.n, {right}.n)"
    overlap = f"least({left}.n - {left}.pos, {right}.n - {right}.pos)"
    return f"{den}L * {small} >= {num}L * {large} AND {den + num}L * {overlap} >= {num}L * ({left}.n + {right}.n)"


def jaccard_links(sets: DataFrame, found: DataFrame, kept: int, num: int, den: int) -> DataFrame:
    """(node, component) of the nodes that link: sets (node, hashes) and their prefixes (token, node, n, pos).

    Each table that two steps read is stored, so joins on a token that very many sets share can be split.
    """
    tokens = stored(found.groupBy("token").agg(F.count("*").alias("g"), F.min(F.struct("pos", "node", "n")).alias("x")).where("g > 1").select("token", "x"))
    shared = stored(found.join(tokens.select("token"), "token", "left_semi"))
    y = F.struct("node", "n", "pos").alias("y")
    pairs = shared.select("token", y).join(tokens, "token").where(f"x.node <> y.node AND {_near(num, den, 'x', 'y')}")
    tried = stored(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    labels = stored(components(stored(verified(sets, tried, kept, num, den))))
    for last in (False, True):
        member = stored(shared.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"))
        sizes = member.groupBy("token", "c").agg(F.count("*").alias("m"))
        # Tokens whose members aren't one component yet, with the component of most of them.
        most = stored(sizes.groupBy("token").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("k")).where("k > 1").select("token", "main"))
        all_members, member = member, stored(member.join(most, "token"))
        discard(all_members)
        rest = member.where("c <> main")
        if last:
            pivots = rest.select("token", F.struct("node", "n", "pos", "c").alias("x"))
        else:
            pivots = stored(rest.groupBy("token", "c").agg(F.min(F.struct("pos", "node", "n", "c")).alias("x")).select("token", "x"))
        y = member.select("token", F.struct("node", "n", "pos", "c", "main").alias("y"))
        # Two members outside the main component would meet twice; the smaller id is x then.
        once = "(y.c = y.main OR x.node < y.node)" if last else "true"
        more = pivots.join(y, "token").where(f"x.c <> y.c AND {once} AND {_near(num, den, 'x', 'y')}")
        more = more.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        more = stored(more.join(tried, ["a", "b"], "left_anti"))
        links = verified(sets, more, kept, num, den).unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        links = stored(links)
        labels = stored(components(links))
        tried = tried.unionByName(more)
        for table in (links, member, most):
            discard(table)
    for table in (tokens, shared, tried):
        discard(table)
    return labels


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Documents whose distinct shingle sets have den * |intersection| >= num * |union| are linked; component_id is the
    smallest doc_id reachable by links. A null or empty text has no shingles and links with nothing. Rows that
    repeat an id are one node with every text of theirs. A row without an id stands alone, its component is null.
    Texts of any length are read whole; ties have no part, as a component has one smallest id. Extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = kept_bytes(docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0] // 2)  # a word has a byte and a space
    # Chunks follow from the files that are read, so what a lost executor held is made again alike.
    seen = document_sets(docs, width, kept).persist(StorageLevel.DISK_ONLY)
    sets = seen.where("hashes IS NOT NULL").withColumnRenamed("doc_id", "node")
    hashes = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts, buckets = parts_of(hashes), buckets_of(hashes)
    shared = stored(several(chunk_blocks(sets, buckets, kept), parts, kept), free=True)
    left = survivors(sets, shared, parts, kept, num, den)
    # Sets that several rows have: the smallest id stands for them.
    first = stored(seen.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1").select("digest", "rep"))
    same = stored(seen.select("doc_id", "n", "digest").join(first, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep")))
    left = left.groupBy("digest").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"), F.min("node").alias("own"))
    left = left.join(first, "digest", "left").select(F.coalesce("rep", "own").alias("node"), "n", "hashes")
    left = stored(rechunked(left), free=True)
    seen.unpersist()
    discard(shared)
    hashes = left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts, buckets = parts_of(hashes), buckets_of(hashes)
    shared = stored(several(chunk_blocks(left, buckets, kept), parts, kept, frequencies=True))
    found = stored(prefixes(left, shared, parts, kept, num, den), free=True)
    discard(shared)
    labels = jaccard_links(left, found, kept, num, den)
    for table in (left, found):
        discard(table)
    # An id that is repeated joins the sets of all its texts.
    twice = same.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc_id")
    both = same.where("n_shingles > 0").join(twice, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(both)
    labels = stored(components(links)).select(F.col("node").alias("rep"), "component")
    return same.join(labels, "rep", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the documents that aren't the smallest of their component; a row without an id stays."""
    out = jaccard_components(docs, width, num, den).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)
