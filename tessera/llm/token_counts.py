"""Token counts that follow edits: a segment tree of pre-token runs for each document.

A leaf is a run of whole pre-tokens, cut where no token can cross: before a single space between two other characters,
between a letter and what isn't one, and within a run of letters of other scripts where no token of the vocabulary holds the two
bytes that meet. A document's count is the sum of its leaves. An edit re-encodes the leaves that it touches, with a
neighbour where the cut between them is gone, and updates the sums above them.

Trees outlive a batch of edits: token_trees() gives each document's leaves and counts, and edit_trees() takes and returns them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mapped
from tessera.llm.tokens import Encoder, encoder, vocabulary_files

LEAF = 256
EDITS = "array<struct<start:bigint,stop:bigint,replacement:string>>"
TREE = "doc_id long, leaves array<string>, tokens array<int>, n_reencoded long"


def safe(before: str, after: str, encode: Encoder | None = None) -> bool:
    """Whether no token crosses from one text to the next: before ends and after begins at the cut; two characters of after are read."""
    if not before or not after:
        return False
    x, y = before[-1], after[0]
    if y == " ":
        return not x.isspace() and len(after) > 1 and not after[1].isspace()
    if not x.isalpha() or (encode is not None and y in encode.special_marks):
        return False
    if not y.isalpha():
        return True
    # Contractions are of ASCII letters.
    return encode is not None and x > "\x7f" and y > "\x7f" and not encode.adjacent(x, y)


def leaves(text: str, size: int = LEAF, encode: Encoder | None = None) -> list[str]:
    """The text in runs of about ``size`` characters, each but the first beginning at a safe cut, a space if one is near."""
    out, start = [], 0
    while start < len(text):
        at = text.find(" ", start + size, start + size + 32)
        if at == -1 or not safe(text[at - 1], text[at : at + 2]):
            at = start + size
        while at < len(text) and not safe(text[at - 1], text[at : at + 2], encode):
            at += 1
        out.append(text[start:at])
        start = at
    return out


class TokenTree:
    """Sums of characters and tokens over the leaves of one text. ``encoded`` counts the characters encoded so far."""

    def __init__(self, text: str | list[str], encode: Encoder, size: int = LEAF, counts: list[int] | None = None):
        self.encode, self.leaf, self.encoded = encode, size, 0
        parts = leaves(text, size, encode) if isinstance(text, str) else text
        self.build(parts, counts if counts is not None else [self.measure(p) for p in parts])

    def build(self, parts: list[str], counts: list[int]) -> None:
        self.width = 1 << max(0, (max(1, len(parts)) - 1).bit_length())
        spare = self.width - len(parts)
        self.parts = parts + [""] * spare
        self.tokens, self.chars = [0] * self.width + counts + [0] * spare, [0] * self.width + list(map(len, self.parts))
        for k in range(self.width - 1, 0, -1):
            self.total(k)

    def measure(self, part: str) -> int:
        self.encoded += len(part)
        return self.encode.count(part) if part else 0

    def total(self, k: int) -> None:
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]

    def put(self, k: int, part: str, count: int) -> None:
        self.parts[k] = part
        k += self.width
        self.tokens[k], self.chars[k] = count, len(part)
        while k > 1:
            k //= 2
            self.total(k)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds this character (the last one for the text's end), and the place in it."""
        k = 1
        while k < self.width:
            k *= 2
            if at >= self.chars[k] and self.chars[k + 1]:
                at -= self.chars[k]
                k += 1
        return k - self.width, at

    def edit(self, start: int, stop: int, replacement: str) -> None:
        """Replace characters start to stop; places beyond the text are its end."""
        start = min(max(start, 0), self.chars[1])
        stop = min(max(stop, start), self.chars[1])
        first, a = self.find(start)
        last, b = self.find(max(start, stop - 1))
        b += stop > start
        text = self.parts[first][:a] + replacement + self.parts[last][b:]
        # Take in neighbours until both ends are cuts again.
        filled = lambda k, step: next((j for j in range(k + step, -1 if step < 0 else self.width, step) if self.parts[j]), None)
        while (left := filled(first, -1)) is not None and not safe(self.parts[left], text[:2], self.encode):
            first, text = left, self.parts[left] + text
        while (right := filled(last, 1)) is not None and not safe(text, self.parts[right][:2], self.encode):
            last, text = right, text + self.parts[right]
        new = leaves(text, self.leaf, self.encode)
        counts = [self.measure(p) for p in new]
        if len(new) > last - first + 1:  # the other leaves keep their counts
            parts, old = self.parts, self.tokens[self.width :]
            kept = [k for k in range(self.width) if parts[k] and not first <= k <= last]
            at = sum(k < first for k in kept)
            self.build([parts[k] for k in kept[:at]] + new + [parts[k] for k in kept[at:]], [old[k] for k in kept[:at]] + counts + [old[k] for k in kept[at:]])
            return
        room = last - first + 1 - len(new)
        for k, part, count in zip(range(first, last + 1), new + [""] * room, counts + [0] * room, strict=True):
            if part or self.parts[k]:
                self.put(k, part, count)

    def text(self) -> str:
        return "".join(self.parts)

    def state(self) -> tuple[list[str], list[int]]:
        """Leaves and their counts, from which the tree can be made again."""
        used = [k for k, p in enumerate(self.parts) if p]
        return [self.parts[k] for k in used], [self.tokens[self.width + k] for k in used]

    def apply(self, changes: list[dict | None] | None) -> int:
        """Edits in turn; the characters encoded for them."""
        read = self.encoded
        for change in changes or ():
            if change is not None:
                self.edit(change["start"] or 0, change["stop"] or 0, change["replacement"] or "")
        return self.encoded - read


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_TREE = pa.schema([("doc_id", pa.int64()), ("leaves", pa.list_(pa.string())), ("tokens", pa.list_(pa.int32())), ("n_reencoded", pa.int64())])
_COUNTS = pa.schema([(x, pa.int64()) for x in ("doc_id", "n_tokens", "n_leaves", "n_edited_tokens", "n_reencoded")])


def token_trees(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, leaves, tokens, n_reencoded) for every row of docs: the leaves of the text's tree and their counts, to be stored.

    The sum of tokens is the document's count. A null or empty text has no leaves; rows that repeat an id have a tree each.
    """
    files = files or vocabulary_files()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files)
        for batch in batches:
            yield _batch([(doc_id, *TokenTree(text.as_py() or "", encode).state(), 0) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)], _TREE)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, TREE)


def edit_trees(trees: DataFrame, edits: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """trees of token_trees() or of an earlier call after edits (doc_id, edits), one row for each id; n_reencoded: characters encoded for them.

    Ids without edits keep their trees, edits without a tree are ignored, and only leaves that an edit touches are encoded.
    """
    files = files or vocabulary_files()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files)
        for batch in batches:
            out = []
            for doc_id, parts, counts, changes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = TokenTree(parts, encode, counts=counts)
                read = tree.apply(changes)
                out.append((doc_id, *tree.state(), read))
            yield _batch(out, _TREE)

    known = edits.select("doc_id", F.col("edits").cast(EDITS).alias("edits"))
    return mapped(trees.select("doc_id", "leaves", "tokens").join(known, "doc_id", "left"), work, TREE)


def token_counts(docs: DataFrame, edits: Column | None = None, files: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_leaves, n_edited_tokens, n_reencoded) for every row of docs.

    edits: an array of (start, stop, replacement) in characters, applied in turn, each to the text that the one
    before left; null edits and a null text are none. n_edited_tokens is the count after them, n_reencoded the
    characters encoded for them. Places beyond the text are its end. Rows that repeat an id are counted each, texts of any length whole.
    """
    files = files or vocabulary_files()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files)
        for batch in batches:
            out = []
            for doc_id, text, changes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                tree = TokenTree(text.as_py() or "", encode)
                before, n_leaves = tree.tokens[1], sum(1 for p in tree.parts if p)
                read = tree.apply(changes)
                out.append((doc_id, before, n_leaves, tree.tokens[1], read))
            yield _batch(out, _COUNTS)

    none = F.lit(None).cast(EDITS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (none if edits is None else edits.cast(EDITS)).alias("edits"))
    return mapped(rows, work, "doc_id long, n_tokens long, n_leaves long, n_edited_tokens long, n_reencoded long")


def sample_edits(text: Column) -> Column:
    """Three edits for every text: a passage replaced at a third, twenty characters cut from the middle, an ending added."""
    n = F.length(F.coalesce(text, F.lit("")))
    edit = lambda start, stop, new: F.struct(start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"), F.lit(new).alias("replacement"))
    third, half = F.floor(n / 3), F.floor(n / 2)
    return F.array(edit(third, third + 12, " revised words, "), edit(half, half + 20, ""), edit(n + 1000, n + 1000, " The end."))
