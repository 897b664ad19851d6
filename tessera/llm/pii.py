"""Personal data found by base rules, and by lexical patterns that these induce.

Matches of the base rules are seeds. The one to three tokens before and the one or two behind an identifier are its patterns.
Strings that have the shape of an identifier without matching a rule are candidates; their patterns are noted too. Over the graph
of patterns and instances (an identifier, whatever its spelling) Spark then repeats two steps until nothing is added:

* a pattern is trusted for a kind if at least ``SUPPORT`` different known instances of the kind stand in it and its confidence
  reaches ``CONFIDENT``: known occurrences, divided by these, half of those of unknown candidates of that kind, and all
  others at which the pattern stands anywhere in the corpus;
* a candidate's score is 1 - (1 - l)(1 - r) with the best trusted pattern before (l) and behind it (r); one with a score is known.

Known instances only grow, so the steps end. How often a pattern stands in the corpus is counted over all texts, for patterns with
enough instances; those that even then can't reach the confidence leave the graph before the first step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, mapped, mix, stored, text_blocks, word_hashes
from tessera.llm.identifiers import CARD, EMAIL, IP, KINDS, PHONE, base_spans, candidate_spans, instance

#: Different known instances that a trusted pattern holds, and its least confidence.
SUPPORT, CONFIDENT = 3, 0.7
#: Tokens of a pattern before an identifier and behind it.
BEFORE, BEHIND = 3, 2
#: Bits of the filter for each pattern, and at most; beyond that more counts are shuffled in vain.
FILTER_BITS, MOST_BITS = 16, 1 << 26

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Small letters; all digits are one.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[48:58] = 48
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens (runs of letters, digits and bytes beyond ASCII; other visible bytes alone), and each row's first (one more at the end)."""
    inside, edge = _TOKEN[data], np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    seen = ~_SPACE[data]
    before, after = np.concatenate([[False], inside])[:-1], np.concatenate([inside, [False]])[1:]
    starts = np.flatnonzero(seen & (~inside | ~before | edge[:-1]))
    ends = np.flatnonzero(seen & (~inside | ~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the one, two, ... tokens that begin with each token, with the last bit clear."""
    plain = word_hashes(_PLAIN[data], starts, ends)
    out, low = [], ~np.uint64(1)
    last = mix(plain + np.uint64(1))
    for n in range(max(BEFORE, BEHIND)):
        if n:
            last = mix(last[: max(0, len(plain) - n)] * _ODD + plain[n:])
        out.append(last & low)
    return out


def _signed(hashes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(hashes).view(np.int64)


def contexts(hashes: list[np.ndarray], starts: np.ndarray, ends: np.ndarray, low: int, high: int, start: int, end: int) -> list[int]:
    """The patterns round bytes start:end of a row with tokens low:high; the last bit tells those behind from those before."""
    left, right = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(starts, end))
    out = [int(hashes[n - 1][left - n]) for n in range(1, BEFORE + 1) if left - n >= low]
    out += [int(hashes[n - 1][right]) | 1 for n in range(1, BEHIND + 1) if right + n <= high]
    return [h - (1 << 64) if h >> 63 else h for h in out]


_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_SEEN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("kinds", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.struct([("pattern", pa.int64()), ("stands", pa.int32())])))]))
_READ = "doc_id long, mark string, base array<struct<kind:int,start:int,end:int>>, seen array<struct<start:int,end:int,seed:boolean,kinds:int,instance:string,patterns:array<struct<pattern:long,stands:int>>>>"


def _places(hashes: list[np.ndarray], row: np.ndarray) -> Iterator[np.ndarray]:
    """The patterns at all places of rows with these first tokens: before a token, and behind one."""
    low, high = np.repeat(row[:-1], np.diff(row)), np.repeat(row[1:], np.diff(row))
    for n, each in enumerate(hashes, 1):
        at = np.arange(len(each))
        if n <= BEFORE:
            yield each[at + n < high[: len(at)]]
        if n <= BEHIND:
            yield each[(at > low[: len(at)]) & (at + n <= high[: len(at)])] | np.uint64(1)


def _standing(hashes: list[np.ndarray], row: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """How often each of the ascending patterns stands in the rows with these first tokens."""
    out = np.zeros(len(patterns), np.int64)
    for h in map(_signed, _places(hashes, row)):
        place = np.searchsorted(patterns, h)
        place[place == len(patterns)] = 0
        out += np.bincount(place[patterns[place] == h], minlength=len(patterns))
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text its base spans, and these and the candidates with their patterns.

    stands: how often the pattern stands in a block of texts, at its first note there; at further notes 0.
    """
    for batch in batches:
        for first, last, data, offsets in text_blocks(batch.column(2)):
            texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            base = [base_spans(text) for text in texts]
            seen = [[(s, e, True, 1 << k) for k, s, e in spans] + [(s, e, False, k) for s, e, k in candidate_spans(text, spans)] for text, spans in zip(texts, base, strict=True)]
            noted: list[list[dict]] = [[] for _ in texts]
            if any(seen):
                starts, ends, row = tokens(data, offsets)
                hashes = grams(data, starts, ends)
                for k, spans in enumerate(seen):
                    if spans:
                        at = offsets[k] + np.append(np.flatnonzero((data[offsets[k] : offsets[k + 1]] & 0xC0) != 0x80), offsets[k + 1] - offsets[k])
                        noted[k] = [{"start": s, "end": e, "seed": seed, "kinds": kinds, "instance": instance(texts[k][s:e], kinds), "patterns": contexts(hashes, starts, ends, row[k], row[k + 1], at[min(s, len(at) - 1)], at[min(e, len(at) - 1)])} for s, e, seed, kinds in spans]
                patterns = np.unique(np.array([p for notes in noted for x in notes for p in x["patterns"]], np.int64))
                stands = dict(zip(patterns.tolist(), _standing(hashes, row, patterns).tolist(), strict=True)) if len(patterns) else {}
                for notes in noted:
                    for x in notes:
                        x["patterns"] = [{"pattern": p, "stands": stands.pop(p, 0)} for p in x["patterns"]]
            found = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in base], _FOUND)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), found, pa.array(noted, _SEEN)], ["doc_id", "mark", "base", "seen"])


def _counts(bits: np.ndarray):
    mask = np.uint64(len(bits) * 8 - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pattern, n): how often patterns that the filter lets pass stand in some texts."""
        for batch in batches:
            passed = []
            for _, _, data, offsets in text_blocks(batch.column(0), 1 << 20):
                starts, ends, row = tokens(data, offsets)
                for h in _places(grams(data, starts, ends), row):
                    place = mix(h) & mask
                    passed.append(h[(bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1])
            found, n = np.unique(np.concatenate([*passed, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(found)), pa.array(n)], ["pattern", "n"])

    return work


def _filter(patterns: DataFrame) -> np.ndarray:
    """A bit for the hash of each pattern, in a table whose size follows their number up to MOST_BITS; Spark sets the bits, 8 KB at a time."""
    size = 1 << 16
    number = patterns.count()
    while size < min(FILTER_BITS * number, MOST_BITS):
        size *= 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(size - 1))
            word, bit = (place >> np.uint64(6)).astype(np.int32), np.uint64(1) << (place & np.uint64(63))
            first = np.flatnonzero(np.diff(word, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(_signed(np.bitwise_or.reduceat(bit, first)) if len(first) else np.zeros(0, np.int64))], ["word", "bits"])

    found = mapped(patterns, work, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def pattern_graph(docs: DataFrame, read: DataFrame) -> DataFrame | None:
    """(pattern, kind, instance, n, seed, total): the edges of patterns that may become trusted; total: how often the pattern stands in the corpus.

    None if no pattern has enough instances.
    """
    kinds = F.array(*[F.when(F.col("s.kinds").bitwiseAND(1 << k) != 0, F.lit(k)) for k in range(len(KINDS))])
    notes = read.select(F.explode("seen").alias("s")).select("s.instance", "s.seed", F.explode("s.patterns").alias("p"), F.array_compact(kinds).alias("kinds"))
    notes = notes.select("p.pattern", F.explode("kinds").alias("kind"), "instance", "seed", "p.stands")
    edges = stored(notes.groupBy("pattern", "kind", "instance").agg(F.count("*").alias("n"), F.bool_or("seed").alias("seed"), F.sum("stands").alias("stands")))
    # What a pattern's own blocks hold of it may be too much already; that leaves out all common words.
    enough = edges.groupBy("pattern", "kind").agg(F.count("*").alias("instances"), F.sum("n").alias("held"), F.sum("stands").alias("stands"))
    enough = stored(enough.where((F.col("instances") >= SUPPORT) & (F.col("held") >= CONFIDENT * F.col("stands"))).select("pattern", "kind", "held"))
    named = enough.select("pattern").distinct()
    if enough.isEmpty():
        discard(edges)
        discard(enough)
        return None
    stands = mapped(docs.select(F.col("text").cast("string").alias("text")), _counts(_filter(named)), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    able = enough.join(stands, "pattern").withColumn("total", F.greatest("total", "held")).where(F.col("held") >= CONFIDENT * F.col("total"))
    graph = stored(edges.drop("stands").join(able.select("pattern", "kind", "total"), ["pattern", "kind"]), free=True)
    discard(edges)
    discard(enough)
    return graph


def trusted_patterns(graph: DataFrame, known: DataFrame | None) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that seeds and known instances (instance, kind) make trusted."""
    sure = F.col("seed")
    if known is not None:
        graph = graph.join(known.select("instance", "kind", F.lit(True).alias("known")), ["instance", "kind"], "left")
        sure = F.col("seed") | F.col("known").isNotNull()
    each = graph.groupBy("pattern", "kind").agg(F.sum(F.when(sure, F.col("n")).otherwise(0)).alias("right"), F.count_if(sure).alias("support"), F.sum("n").alias("held"), F.first("total").alias("total"))
    confidence = F.col("right") / (F.col("total") - (F.col("held") - F.col("right")) / 2)
    return each.where(F.col("support") >= SUPPORT).select("pattern", "kind", confidence.alias("confidence")).where(F.col("confidence") >= CONFIDENT)


def scored_instances(graph: DataFrame, trusted: DataFrame) -> DataFrame:
    """(instance, kind, score) of the instances that stand in a trusted pattern."""
    before = F.col("pattern").bitwiseAND(F.lit(1).cast("long")) == 0
    side = lambda which: F.coalesce(F.max(F.when(which, F.col("confidence"))), F.lit(0.0))
    each = graph.join(trusted, ["pattern", "kind"]).groupBy("instance", "kind").agg(side(before).alias("l"), side(~before).alias("r"))
    return each.select("instance", "kind", (1 - (1 - F.col("l")) * (1 - F.col("r"))).alias("score"))


def discovered(docs: DataFrame, read: DataFrame) -> DataFrame | None:
    """(instance, kind, score) of all instances in trusted patterns, once no step adds any; None if there are none."""
    graph = pattern_graph(docs, read)
    if graph is None:
        return None
    known, number = None, 0
    while True:
        now = stored(scored_instances(graph, trusted_patterns(graph, known)))
        grown = now.count()
        if known is not None:
            discard(known)
        known = now
        if grown == number:
            break
        number = grown
    discard(graph)
    return known if number else None


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) for every row of docs (doc_id, text).

    The counts and base_sha256 are of the base rules' matches, spans lists these and what trusted patterns discovered as
    ``kind:start:end`` in code points, by kind and start; n_found counts the latter. A discovered span never overlaps a base one, and takes
    the kind of its higher score (ties: the kind listed first). A null text is empty and has no spans; equal texts have equal
    spans; repeated ids are rows of their own; an empty table gives an empty result; extra columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = stored(mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("mark"), text.alias("text")), _read, _READ))
    known = discovered(docs, read)
    out = read.select("doc_id", "mark", "base")
    if known is None:
        out = out.withColumn("more", F.array().cast("array<struct<kind:int,start:int,end:int>>"))
    else:
        spots = read.select("mark", F.explode("seen").alias("s")).where("NOT s.seed").select("mark", "s.start", "s.end", "s.kinds", "s.instance")
        spots = spots.join(known, "instance").where(F.expr("(kinds >> kind) & 1 = 1"))
        spots = spots.groupBy("mark", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        more = stored(spots.groupBy("mark").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more")))
        # The stored table's size is known when the join is planned: broadcast if small, else shuffled.
        out = out.join(more, "mark", "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        count(EMAIL).alias("n_email"),
        count(IP).alias("n_ip"),
        count(CARD).alias("n_card"),
        count(PHONE).alias("n_phone"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "more"))).alias("spans"),
        F.size("more").cast("long").alias("n_found"),
    )
