"""Removal of byte strings that also start in an earlier document, by difference-cover suffix sorting.

Suffixes are dealt to workers by the anchor of their first 50 bytes: the 20-byte gram with the smallest hash
in it. Suffixes with equal 50-byte prefixes have equal anchors, so each worker sorts its own suffixes and
compares neighbours alone. Only anchors that occur in two documents are sorted at all, which a shuffle of sorted
hashes tells (shared.py); equal surroundings of an anchor are one text, with its smallest document, before they are dealt out.

A worker sorts by the difference cover modulo 3: sampled triples are sorted and named, the names are sorted
by recursion, the remaining suffixes follow from one character and the rank behind it, and both orders
are merged. Neighbours in the merged order are then compared over 50 bytes.

Texts travel in chunks, by a hash of id and text; a row is known by its id and the hash of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_VALUES, discard, mapped, mix, powers, span_hashes, stored, text_blocks, unused
from tessera.llm.shared import BLOCKS, ChunkTable, blocks, buckets_of, kept_bytes, parts_of, several

LENGTH = 50
GRAM = 20
#: Different surroundings of one anchor up to which they are sorted together; more are split by the bytes beside it.
SORTED_TOGETHER = 2048
#: Bytes that a worker sorts at once; names then fit in 21 bits.
SORT_BYTES = 1 << 19
#: Bytes of texts in one block, and about how many in a chunk.
BLOCK_BYTES, CHUNK_BYTES = 1 << 18, 1 << 20
_POSITION = np.uint64((1 << 26) - 1)


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of x (values from 1 below 2**21, length below 2**21) in sorted order."""
    n = len(x)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: x[i:].tolist()), np.int64)
    y = np.concatenate([np.asarray(x, np.int64), np.zeros(5, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    found, names = np.unique((y[sample] << 42) | (y[sample + 1] << 21) | y[sample + 2], return_inverse=True)
    if len(found) < len(sample):
        names = np.empty(len(sample), np.int64)
        names[suffix_array(np.searchsorted(found, (y[sample] << 42) | (y[sample + 1] << 21) | y[sample + 2]) + 1)] = np.arange(len(sample))
    rank = np.zeros(n + 5, np.int64)
    rank[sample] = names + 1
    one, two = one[one < n], two
    short = lambda i: (y[i] << 21) | rank[i + 1]
    long = lambda i: (y[i] << 42) | (y[i + 1] << 21) | rank[i + 2]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(short(zero))]
    in_order = np.concatenate([one, two])
    in_order = in_order[np.argsort(rank[in_order])]
    first = in_order % 3 == 1
    below = np.empty(len(in_order), np.int64)  # of the remaining suffixes
    below[first] = np.searchsorted(short(zero), short(in_order[first]))
    below[~first] = np.searchsorted(long(zero), long(in_order[~first]))
    out = np.empty(n, np.int64)
    place = np.arange(len(in_order)) + below
    out[place] = in_order
    rest = np.ones(n, bool)
    rest[place] = False
    out[rest] = zero
    return out


def anchored(data: np.ndarray, offsets: np.ndarray, places: bool = False) -> tuple[np.ndarray, ...]:
    """The 50-byte strings of some texts in runs that share an anchor: text, anchor hash, first start, end of the last (and the anchor's place)."""
    n, m = len(data), len(data) - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return (none, none.astype(np.uint64), none, none, none)[: 5 if places else 4]
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * power[:-1], out=sums[1:])
    gram = mix((sums[GRAM:] - sums[:m]) * inverse[:m])
    least = (gram & ~_POSITION) | (_POSITION - np.arange(m, dtype=np.uint64))  # of equal grams the last
    width, have = LENGTH - GRAM + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - LENGTH + 1]
    start = np.flatnonzero(np.arange(n - LENGTH + 1) + LENGTH <= offsets[text + 1])
    if not len(start):
        return (none, none.astype(np.uint64), none, none, none)[: 5 if places else 4]
    text, at = text[start], (_POSITION - (least[start] & _POSITION)).astype(np.int64)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    return (text[first], gram[at[first]], start[first], start[last] + LENGTH, at[first])[: 5 if places else 4]


def pieces(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of bytes with their offsets, the row of each part and where the part begins in its text.

    A text longer than the limit is read in parts that overlap by 49 bytes, so each 50-byte string is in one part.
    """
    for first, last, data, offsets in text_blocks(texts, limit):
        if last - first > 1 or len(data) <= limit:
            yield data, offsets, np.arange(first, last), np.zeros(last - first, np.int64)
        else:
            for at in range(0, len(data) - LENGTH + 1, limit):
                part = data[at : at + limit + LENGTH - 1]
                yield part, np.array([0, len(part)]), np.array([first]), np.array([at])


def in_chunks(docs: DataFrame, whole: DataFrame, parts: int, chunks: int, shared: DataFrame | None = None) -> DataFrame:
    """Texts (doc_id, key, text) chunk by chunk: (chunk, kind, doc_id, key, text, hashes, df).

    In each chunk kind 0 are shared hashes as of several(), kind 1 rows to leave out (doc_id, key), kind 2 texts.
    """
    chunk = lambda: F.pmod(F.xxhash64("doc_id", "key"), F.lit(chunks)).alias("chunk")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    kind = lambda k: F.lit(k).alias("kind")
    rows = docs.select(chunk(), kind(2), "doc_id", "key", "text", none("binary", "hashes"), none("binary", "df"))
    rows = rows.unionByName(whole.select(chunk(), kind(1), "doc_id", "key", none("string", "text"), none("binary", "hashes"), none("binary", "df")))
    if shared is not None:
        rows = rows.unionByName(shared.select("chunk", kind(0), none("long", "doc_id"), none("long", "key"), none("string", "text"), "hashes", "df"))
    return rows.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")


def chunk_texts(batches: Iterator[pa.RecordBatch], table: ChunkTable) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """(chunk, ids, keys, texts) runs of in_chunks(), without what is to be left out; shared hashes go to the table."""
    at, out = None, set()
    for batch in batches:
        chunk, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edge = np.flatnonzero((np.diff(chunk, prepend=chunk[:1] - 1) != 0) | (np.diff(kind, prepend=-1) != 0)).tolist()
        for a, b in zip(edge, [*edge[1:], len(batch)], strict=True):
            part = batch.slice(a, b - a)
            if chunk[a] != at:
                at, out = int(chunk[a]), set()
            if kind[a] == 0:
                for raw, df in zip(part.column(5), part.column(6), strict=True):
                    table.see(at, raw.as_buffer(), df.as_buffer())
                continue
            ids, keys = part.column(2).to_numpy(), part.column(3).to_numpy()
            if kind[a] == 1:
                out.update(zip(ids.tolist(), keys.tolist(), strict=True))
                continue
            if out:
                keep = np.array([x not in out for x in zip(ids.tolist(), keys.tolist(), strict=True)])
                part, ids, keys = part.filter(pa.array(keep)), ids[keep], keys[keep]
            if len(ids):
                yield at, ids, keys, part.column(4)


def anchor_blocks(texts: DataFrame, buckets: int, kept: int) -> DataFrame:
    """BLOCKS of the anchors of each chunk; an anchor counts once for each text that holds it."""
    short = np.uint64(64 - 8 * kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for chunk, _, _, texts in chunk_texts(batches, ChunkTable(kept)):
            if held and chunk != at:
                yield blocks(at, held, buckets, kept)
                held = []
            at = chunk
            rows, hashes = [], []
            for data, offsets, row, _ in pieces(texts):
                text, gram, _, _ = anchored(data, offsets)
                rows.append(row[text])
                hashes.append(gram >> short)
            rows, hashes = np.concatenate(rows), np.concatenate(hashes)
            order = np.lexsort((rows, hashes))
            rows, hashes = rows[order], hashes[order]
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
            if len(rows):
                held.append(hashes[fresh])
        if held:
            yield blocks(at, held, buckets, kept)

    return mapped(texts, work, BLOCKS)


def occurrences(texts: DataFrame, kept: int) -> DataFrame:
    """Shared anchors with their surroundings, each the union of the 50-byte strings that it anchors.

    Rows (anchor, mark, doc_id, key, start): each place of a surrounding. Rows (anchor, mark, around, at, least, most): once for
    each block of texts its bytes, the anchor's place in them, and the smallest and largest document there.
    """
    names = ["anchor", "mark", "doc_id", "key", "start", "around", "at", "least", "most"]
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.int32(), pa.int64(), pa.int64()]

    def rows(**columns) -> pa.RecordBatch:
        n = len(columns["anchor"])
        return pa.RecordBatch.from_arrays([pa.array(columns[x], k) if x in columns else pa.nulls(n, k) for x, k in zip(names, kinds, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, short = ChunkTable(kept), np.uint64(64 - 8 * kept)
        for chunk, ids, keys, texts in chunk_texts(batches, table):
            for data, offsets, row, begin in pieces(texts):
                text, gram, start, end, at = anchored(data, offsets, True)
                keep = table.look_up(chunk, gram >> short) > 1
                if not keep.any():
                    continue
                text, gram, start, end, at = text[keep], gram[keep], start[keep], end[keep], at[keep]
                anchor, mark = gram.view(np.int64), span_hashes(data, start, end).view(np.int64)
                doc = ids[row[text]]
                yield rows(anchor=anchor, mark=mark, doc_id=doc, key=keys[row[text]], start=start - offsets[text] + begin[text])
                order = np.lexsort((doc, mark, anchor))
                fresh = np.ones(len(order), bool)
                fresh[1:] = (np.diff(anchor[order]) != 0) | (np.diff(mark[order]) != 0)
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(order)) - 1
                one = order[first]
                raw = data.tobytes()
                around = [raw[s:e] for s, e in zip(start[one].tolist(), end[one].tolist(), strict=True)]
                yield rows(anchor=anchor[one], mark=mark[one], around=around, at=(at - start)[one], least=doc[one], most=doc[order[last]])

    return mapped(texts, work, "anchor long, mark long, doc_id long, key long, start long, around binary, at int, least long, most long")


def first_documents(around: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 50-byte string of some texts the smallest document that holds it: text, offset, document.

    least: the smallest document of each text.
    """
    size = np.array([len(x) for x in around])
    marks = np.cumsum(size + 1) - 1
    x = np.zeros(marks[-1] + 1, np.int64)
    inside = np.ones(len(x), bool)
    inside[marks] = False
    data = np.frombuffer(b"".join(around), np.uint8)
    x[inside] = data.astype(np.int64) + 1
    x[marks] = 257 + np.arange(len(marks))  # a mark of its own ends each text
    order = suffix_array(x)
    owner = np.repeat(np.arange(len(size)), size + 1)
    offset = np.arange(len(x)) - (marks - size)[owner]
    order = order[offset[order] + LENGTH <= size[owner[order]]]
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([x.astype(np.uint8), np.zeros(8, np.uint8)]), 8)
    eight = np.ascontiguousarray(words).view(np.uint64).ravel()
    fresh = np.zeros(len(order), bool)
    fresh[0] = True
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):  # neighbours that differ anywhere in 50 bytes
        part = eight[order + k]
        fresh[1:] |= part[1:] != part[:-1]
    start = np.flatnonzero(fresh)
    document = np.minimum.reduceat(least[owner[order]], start)[np.cumsum(fresh) - 1]
    return owner[order], offset[order], document


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (anchor, mark, around, least, most), each surrounding once, sorted by anchor to runs (anchor, mark, low, high, first) of offsets with one first document.

    least, most: the smallest and the largest document with that text. Runs that no document follows are left out.
    """
    names = ["anchor", "mark", "low", "high", "first"]

    def batch_of(anchor, mark, low, high, first) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((anchor, mark, low, high, first), kinds, strict=True)], names)

    def solve(anchor: np.ndarray, mark: np.ndarray, around: pa.Array, least: np.ndarray, most: np.ndarray) -> Iterator[pa.RecordBatch]:
        around = around.to_pylist()
        size = np.array([len(x) for x in around])
        edge = np.flatnonzero(np.diff(anchor, prepend=anchor[0] - 1))
        group = np.diff(np.append(edge, len(anchor)))
        alone = np.repeat(group == 1, group)  # one text around an anchor: every string has its smallest document
        k = np.flatnonzero(alone & (least < most))
        yield batch_of(anchor[k], mark[k], np.zeros(len(k), np.int32), (size[k] - LENGTH).astype(np.int32), least[k])
        k = np.flatnonzero(~alone)
        if len(k):
            text, offset, document = first_documents([around[i] for i in k.tolist()], least[k])
            order = np.lexsort((offset, text))
            text, offset, document = text[order], offset[order], document[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (document[1:] != document[:-1])
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(text)) - 1
            later = document[a] < most[k][text[a]]
            a, b = a[later], b[later]
            yield batch_of(anchor[k][text[a]], mark[k][text[a]], offset[a].astype(np.int32), offset[b].astype(np.int32), document[a])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        while at < len(batch):
            part = batch.slice(at, 2048)
            at += len(part)
            anchor = part.column(0).to_numpy(zero_copy_only=False)
            # Enough is held: solve it up to the anchor that this part goes on with.
            if held and size > SORT_BYTES // 2:
                other = anchor != held[-1].column(0)[-1].as_py()
                cut = int(np.argmax(other)) if other.any() else len(part)
                held.append(part.slice(0, cut))
                if cut < len(part):
                    yield from solve(*_columns(held))
                    held, size = [part.slice(cut)], part.slice(cut).nbytes
                continue
            held.append(part)
            size += part.nbytes
    if held:
        yield from solve(*_columns(held))


def _columns(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    return table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).combine_chunks(), table.column(3).to_numpy(), table.column(4).to_numpy()


def _crowded(each: DataFrame) -> DataFrame:
    """The anchors with more surroundings, each of which stands once, than are sorted together."""
    return stored(each.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > SORTED_TOGETHER).select("anchor"))


def _sorted_runs(each: DataFrame, parts: int) -> DataFrame:
    dealt = each.select("anchor", "mark", "around", "least", "most").repartition(parts, "anchor").sortWithinPartitions("anchor", "mark")
    return mapped(dealt, _runs, "anchor long, mark long, low int, high int, first long")


def _window_runs(each: DataFrame) -> DataFrame:
    """The same runs from each 50-byte string by itself, counted before it is dealt out; each surrounding stands once."""
    windows = each.select("anchor", "mark", "least", "most", "around", F.explode(F.sequence(F.lit(0), F.octet_length("around") - LENGTH)).alias("low"))
    windows = windows.select("anchor", "mark", "low", "least", "most", F.expr(f"substring(around, low + 1, {LENGTH})").alias("string"))
    first = stored(windows.groupBy("string").agg(F.min("least").alias("first")))
    return windows.join(first, "string").where("first < most").select("anchor", "mark", "low", F.col("low").alias("high"), "first")


def surroundings(found: DataFrame) -> DataFrame:
    """(anchor, mark, around, at, least, most): each surrounding once, however many chunks of the corpus hold it.

    Each task combines its own before anything is dealt out, so one that all chunks hold fills no task.
    """
    return found.groupBy("anchor", "mark").agg(F.first("around").alias("around"), F.first("at").alias("at"), F.min("least").alias("least"), F.max("most").alias("most"))


def first_runs(each: DataFrame, parts: int) -> DataFrame:
    """(anchor, mark, low, high, first): for each surrounding, runs of offsets whose 50-byte strings have ``first`` as smallest document.

    each: what surroundings() gives. The surroundings of a crowded anchor are cut in two: strings with 15 bytes or more before the anchor are dealt by those 15, the others by the 16 behind it.
    Equal strings stay together. Where that leaves a crowd still, each string is dealt by itself.
    """
    large = _crowded(each)
    if large.isEmpty():
        return _sorted_runs(each, parts)
    half = (LENGTH - GRAM) // 2
    once = each.join(large, "anchor", "left_semi")
    base = F.greatest(F.col("at") - half + 1, F.lit(0))
    cut = lambda start, size: F.substring(F.col("around"), start, size)
    before = F.when(F.col("at") >= half, F.struct(F.lit(0).alias("base"), cut(F.lit(1), F.col("at") - half + LENGTH).alias("part"), F.xxhash64("anchor", F.lit(0), cut(F.col("at") - half + 1, F.lit(half))).alias("place")))
    behind = F.struct(base.alias("base"), cut(base + 1, F.octet_length("around")).alias("part"), F.xxhash64("anchor", F.lit(1), cut(F.col("at") + GRAM + 1, F.lit(half + 1))).alias("place"))
    halves = once.select("anchor", "mark", "least", "most", F.explode(F.array(before, behind)).alias("h")).where(F.octet_length("h.part") >= LENGTH)
    halves = stored(halves.select("anchor", "mark", "least", "most", "h.base", "h.part", "h.place", F.xxhash64("h.part").alias("piece")))
    again = stored(halves.groupBy(F.col("place").alias("anchor"), F.col("piece").alias("mark")).agg(F.first("part").alias("around"), F.min("least").alias("least"), F.max("most").alias("most")))
    crowd = _crowded(again)
    runs = _sorted_runs(again.join(crowd, "anchor", "left_anti"), parts)
    if not crowd.isEmpty():
        runs = runs.unionByName(_window_runs(again.join(crowd, "anchor", "left_semi")))
    runs = stored(runs.select(F.col("anchor").alias("place"), F.col("mark").alias("piece"), "low", "high", "first"))
    back = halves.select("anchor", "mark", "base", "place", "piece").join(runs, ["place", "piece"])
    back = back.select("anchor", "mark", (F.col("base") + F.col("low")).alias("low"), (F.col("base") + F.col("high")).alias("high"), "first")
    return _sorted_runs(each.join(large, "anchor", "left_anti"), parts).unionByName(back)


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, key) of the documents whose whole text, of 50 bytes or more, is that of a document with a smaller id."""
    marks = docs.select("doc_id", "key", F.md5("text").alias("mark"))
    first = stored(marks.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("mark", "first"))
    return marks.join(first, "mark").where("first < doc_id").select("doc_id", "key").distinct()


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans): byte spans (low, high) of texts (doc_id, key, text) that hold strings of an earlier document; spans may overlap.

    key is a hash of the text. A whole copy of an earlier document is covered from end to end, and adds no earlier document.
    """
    docs = docs.where("doc_id IS NOT NULL AND octet_length(text) >= 50")
    whole = stored(copies(docs))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    anchors = size // (LENGTH - GRAM) * 2
    chunks, parts, kept = -(-size // CHUNK_BYTES) or 1, parts_of(anchors), kept_bytes(anchors)
    shared = stored(several(anchor_blocks(in_chunks(docs, whole, parts, chunks), buckets_of(anchors), kept), parts, kept), free=True)
    found = stored(occurrences(in_chunks(docs, whole, parts, chunks, shared), kept), free=True)
    once = stored(surroundings(found.where("around IS NOT NULL")), free=True)
    runs = stored(first_runs(once, parts), free=True)
    discard(once)
    hit = found.where("around IS NULL").select("anchor", "mark", "doc_id", "key", "start").join(runs, ["anchor", "mark"]).where("first < doc_id")
    span = lambda low, high: F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))
    spans = hit.select("doc_id", "key", span(F.col("start") + F.col("low"), F.col("start") + F.col("high") + LENGTH).alias("span"))
    spans = spans.unionByName(whole.select("doc_id", "key", span(F.lit(0), F.lit(1 << 62)).alias("span")))
    spans = stored(spans.groupBy("doc_id", "key").agg(F.collect_set("span").alias("spans")), free=True)
    for table in (shared, found, runs, whole):
        discard(table)
    return spans


def covered(spans: pa.ListArray, k: int, n: int) -> np.ndarray:
    """Which of n bytes the spans of row k cover."""
    a, b = spans.offsets[k].as_py(), spans.offsets[k + 1].as_py()
    change = np.zeros(n + 1, np.int64)
    fields = spans.values
    np.add.at(change, fields.field(0).to_numpy(zero_copy_only=False)[a:b], 1)
    np.add.at(change, np.minimum(fields.field(1).to_numpy(zero_copy_only=False)[a:b], n), -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    Removed is each byte covered by a 50-byte string that also starts in a document with a smaller id. A null
    text is empty. A row without an id is nobody's earlier document and keeps all. Rows that repeat an id are documents
    of their own, none of them earlier than the other. Texts of any length are read whole; extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            spans = batch.column(2)
            for k, (doc_id, text, cut) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), spans.is_valid().to_pylist(), strict=True)):
                raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                gone = covered(spans, k, len(raw)) if cut else np.zeros(len(raw), bool)
                edges = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                out.append((doc_id, len(raw), int(gone.sum()), edges, hashlib.sha256(raw[~gone].tobytes() if cut else raw.tobytes()).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    joined = rows.join(repeated_spans(rows), ["doc_id", "key"], "left").select("doc_id", "text", "spans")
    return mapped(joined, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes cut from text, whole characters only, and n_chars as the new length; columns as before.

    Nulls and repeated ids are taken as in remove_repeats.
    """
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    key, cut_by = unused("key", names), unused("spans", names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(len(names))
            cut = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist()
            for k in cut:
                raw = np.frombuffer(texts[k].encode(), np.uint8)
                lead = np.flatnonzero((raw & 0xC0) != 0x80)
                gone = np.minimum.reduceat(covered(spans, k, len(raw)), lead)
                texts[k] = raw[~np.repeat(gone, np.diff(np.append(lead, len(raw))))].tobytes().decode()
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            if size is not None and cut:
                lengths = batch.column(size).to_pylist()
                for k in cut:
                    lengths[k] = len(texts[k])
                columns[size] = pa.array(lengths, batch.column(size).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    spans = repeated_spans(rows).select(F.col("doc_id").alias(unused("id", names)), F.col("key").alias(key), F.col("spans").alias(cut_by))
    joined = docs.join(spans, (docs["doc_id"] == spans[unused("id", names)]) & (F.xxhash64(docs["text"]) == spans[key]), "left")
    return mapped(joined.select(*[docs[c] for c in names], cut_by), work, docs.schema)
