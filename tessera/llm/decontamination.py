"""Benchmark decontamination with DataFrame functions alone.

Training documents are scanned once. Every window of a benchmark item is filed under its longest word, the anchor; a word that
is an anchor puts out its neighbourhood of at most 19 words, which a hash join compares with the windows of that anchor word by
word. The anchors travel as a hashed set inside the filter and the windows as a broadcast table, both only up to
``BROADCAST_WINDOWS``. For a larger benchmark the scan hashes every token window, drops those outside a filter of the
benchmark's hashes, and a shuffled join verifies the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, unused

WINDOW = 10
#: Windows of the benchmark up to which its anchors and windows are sent to every executor (about 200 bytes each).
BROADCAST_WINDOWS = 20_000
#: Longs of the filter for the hashes of more windows (8 MB).
FILTER_WORDS = 1 << 20
_SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def az_lower(text: Column) -> Column:
    """A-Z lower-cased, all other letters as they are; lower() does that for ASCII alone, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(az_lower(F.coalesce(text, F.lit(""))), f"[{_SEPARATORS}]+"), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, win, len, off, anchor): each window of each item, with its longest word (the first of equals) and that word's place."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window)))
    wins = items.select("item_id", "len", F.explode(F.expr("transform(sequence(1, size(w) - len + 1), i -> slice(w, i, len))")).alias("win")).distinct()
    longest = F.array_max(F.transform("win", lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))
    return wins.withColumn("a", longest).select("item_id", "win", "len", (-F.col("a.i")).alias("off"), F.col("a.x").alias("anchor"))


def _bits(hashes: DataFrame, n: int) -> Column:
    """A filter for so many 64-bit hashes (h) as an array of longs, as one value of the query; at most 8 MB, beyond which more passes in vain."""
    words = min(FILTER_WORDS, 1 << max(6, (n // 4).bit_length()))
    place = F.pmod("h", F.lit(64 * words))
    set_ = hashes.select((place / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    every = hashes.sparkSession.range(words).select(F.col("id").cast("int").alias("w")).join(set_, "w", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v")))), lambda x: x["v"]).alias("bits")).scalar()


def _passes(bits: Column, h: Column) -> Column:
    place = F.pmod(h, 64 * F.size(bits))
    return F.call_function("getbit", F.get(bits, (place / 64).cast("int")), (place % 64).cast("int")) == 1


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: (doc_id, n_words, hits, items), and the columns named in also.

    hits: sorted distinct positions of the words inside an occurrence of a window; items: ids of the items
    whose windows occur, sorted as strings. A null or empty text has no words. An item without words never
    hits; one with fewer words than the window is one window. An item whose id is null hits but isn't
    listed. Rows that repeat an id are judged each; texts of any length are read whole, extra columns are ignored.

    Windows up to ``broadcast_windows`` are looked up where the documents are read. Of more, each document window's hash is tried
    against a filter of their hashes there, and what passes is joined with the windows by hash and compared word by word.
    """
    wins = stored(item_windows(benchmark, window))
    n = wins.count()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *also, words(F.col("text")).alias("w"))
    rows = rows.withColumn("n_words", F.size("w"))
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    if n <= broadcast_windows:
        anchors = [x.anchor for x in wins.select("anchor").distinct().collect()]
        at = F.filter(up_to(F.col("n_words")), lambda i: F.get("w", i).isin(anchors))
        near = F.transform(at, lambda i: F.struct(i.alias("at"), F.get("w", i).alias("anchor"), F.least(i, F.lit(window - 1)).alias("before"), F.slice("w", F.greatest(i - (window - 1), F.lit(0)) + 1, F.least(i, F.lit(window - 1)) + window).alias("words")))
        found = rows.select("row", "doc_id", *also, "n_words", F.explode_outer(near).alias("x")).select("row", "doc_id", *also, "n_words", F.col("x.at").alias("at"), F.col("x.anchor").alias("word"), F.col("x.before").alias("before"), F.col("x.words").alias("words"))
        same = (F.col("word") == F.col("anchor")) & (F.col("before") >= F.col("off")) & F.expr("slice(words, before - off + 1, len) = win")
        hit = found.join(F.broadcast(wins), same, "left").withColumn("s", F.col("at") - F.col("off"))
    else:
        wins = wins.withColumn("h", F.xxhash64("win"))
        spot = lambda start, h, size: F.struct(start.cast("int").alias("s"), h.cast("long").alias("h"), size.cast("int").alias("size"))
        none = F.lit(None)
        spots = [F.array(spot(none, none, none))]  # one that stays, for rows without a hit
        for size in sorted(r.len for r in wins.select("len").distinct().collect()):  # of 1 to window words
            spots.append(F.transform(up_to(F.col("n_words") - (size - 1)), (lambda size: lambda i: spot(i, F.xxhash64(F.slice("w", i + 1, size)), F.lit(size)))(size)))
        every = rows.select("row", "doc_id", *also, "n_words", "w", F.explode(F.concat(*spots)).alias("x"))
        found = every.where(F.col("x.h").isNull() | _passes(_bits(wins.select("h"), n), F.col("x.h"))).select("row", "doc_id", *also, "n_words", "x.s", "x.h", F.slice("w", F.col("x.s") + 1, F.col("x.size")).alias("words"))
        hit = found.join(wins, (found["h"] == wins["h"]) & (found["words"] == wins["win"]), "left")
    spans = F.collect_set(F.when(F.col("len").isNotNull(), F.struct(F.col("s").alias("s"), (F.col("s") + F.col("len") - 1).alias("e"))))
    per_row = hit.groupBy("row", "doc_id", *also, "n_words").agg(spans.alias("spans"), F.array_sort(F.collect_set(F.when(F.col("len").isNotNull(), F.col("item_id")))).alias("items"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["e"])))))
    return per_row.select("doc_id", *also, "n_words", covered.alias("hits"), "items")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document."""
    n_hit = F.size("hits").cast("long")
    return find_contamination(docs, benchmark, window).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """The documents without benchmark passages, in the columns of docs.

    remove="documents" drops every document that holds one; remove="spans" cuts the hit words, each with
    the separators before it. Rows that repeat an id are dropped together, but words are cut only from rows with the text that
    holds them. A null id or text is kept.
    """
    if remove == "documents":
        hits = find_contamination(docs.select("doc_id", "text"), benchmark, window).where("size(hits) > 0 AND doc_id IS NOT NULL")
        return docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    mine, key = unused("hits", docs.columns), unused("key", docs.columns)
    mark = F.md5(F.col("text").cast("binary"))
    hits = find_contamination(docs.select("doc_id", "text", mark.alias(key)), benchmark, window, also=(key,)).where("size(hits) > 0 AND doc_id IS NOT NULL")
    cut = hits.groupBy("doc_id", key).agg(F.first("hits").alias(mine))  # equal texts have equal hits
    pieces = F.regexp_extract_all("text", F.lit(f"[{_SEPARATORS}]*[^{_SEPARATORS}]+"), F.lit(0))
    kept = F.concat(F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains(mine, i)), ""), F.regexp_extract("text", f"[{_SEPARATORS}]*\\z", 0))
    joined = docs.withColumn(key, mark).join(cut, ["doc_id", key], "left")
    return joined.select(*[F.when(F.col(mine).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns])
