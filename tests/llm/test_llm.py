"""The ten operators on small tables: contracts by brute force, and nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.decontamination import contamination_report, decontaminate
from tessera.llm.embeddings import buckets, embedding_dedup
from tessera.llm.jaccard import drop_near_copies, jaccard_components, may_reach
from tessera.llm.language import BiGRU, fit_language, language
from tessera.llm.packing import CAPACITY, cuts, pack, packing_digest
from tessera.llm.quality import FactorisationMachine, features, keep_quality, quality
from tessera.llm.suffixes import first_documents, remove_repeats, suffix_array, without_repeats
from tessera.llm.token_counts import EDITS, TokenTree, edit_trees, sample_edits, token_counts, token_trees
from tessera.llm.tokens import encoder, vocabulary_files, vocabulary_path
from tessera.llm.toxicity import CharNB, toxicity
from tessera.llm.url_filter import host_verdicts, propagate, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, None, "s", len(t or "")) for k, t in enumerate(texts)], DOC)


def random_texts(seed=1, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(n)]
    out = list(base)
    for text in base[: n // 2]:
        w = text.split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    passage = " ".join(rng.choice(words) for _ in range(30))
    out += [base[0], base[0].upper(), None, "", "  \t\n ", "one", "one two three", "One two three", "é" * 60, "ab" * 400, passage + " " + base[3], base[4] + " x " + passage, "x" * 5000]
    return out


EDGES = [None, "", " ", "a", " \n", "ß Straße " * 50, "word " * 30_000]


# Token counts


def test_token_trees_follow_edits():
    encode = encoder(*vocabulary_files())
    count = lambda t: len(encode.tokenizer.encode(t, add_special_tokens=False).ids)
    rng = random.Random(4)
    piece = lambda n: "".join(rng.choice(["a", "b", " ", "the", "  ", "\n", "'s", "'", "s", "é", "的", "時間", "か", "e\u0301", "1", ".", " x", " wor", "<|endoftext|>"]) for _ in range(n))
    for _ in range(60):
        text = piece(rng.randint(0, 150))
        tree = TokenTree(text, encode, 16)
        for _ in range(5):
            a = rng.randint(0, len(text))
            b, new = rng.randint(a, min(len(text), a + rng.choice([0, 3, 40]))), piece(rng.choice([0, 1, 5, 60]))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text() == text
            if "<|endoftext|>" not in text and "<" not in text and "|" not in text:
                assert tree.tokens[1] == count(text)


def test_an_edit_encodes_little():
    encode = encoder(*vocabulary_files())
    tree = TokenTree("some words here " * 20_000, encode)
    before = tree.encoded
    tree.edit(100_000, 100_010, "new")
    assert tree.encoded - before < 2_000


@pytest.mark.parametrize("text", ["日本語の文章を一つにまとめた長い文字列" * 2_000, "\n".join(["line"] * 20_000), "a,b;c." * 10_000])
def test_leaves_in_any_script(text):
    encode = encoder(*vocabulary_files())
    count = lambda t: len(encode.tokenizer.encode(t, add_special_tokens=False).ids)
    tree = TokenTree(text, encode)
    assert max(map(len, tree.parts)) < 1_000 and tree.tokens[1] == count(text)
    before, half = tree.encoded, len(text) // 2
    tree.edit(half, half + 1, "x")
    assert tree.encoded - before < 2_000 and tree.tokens[1] == count(text[:half] + "x" + text[half + 1 :])


def test_a_large_insertion_encodes_itself_alone():
    encode = encoder(*vocabulary_files())
    tree = TokenTree("some words here " * 20_000, encode)
    before = tree.encoded
    tree.edit(100_000, 100_000, "new words " * 400)
    assert tree.encoded - before < 4_000 + 2_000
    assert tree.tokens[1] == len(encode.tokenizer.encode(tree.text(), add_special_tokens=False).ids)


def test_trees_outlive_a_batch_of_edits(spark):
    encode = encoder(*vocabulary_files())
    texts = ["some words here " * 500, "", None, "short"]
    trees = token_trees(docs_of(spark, texts))
    schema = f"doc_id long, edits {EDITS}"
    first = edit_trees(trees, spark.createDataFrame([(0, [(100, 110, "new")]), (1, [(0, 0, "begin")]), (7, [(0, 0, "x")])], schema))
    again = {r.doc_id: r for r in edit_trees(spark.createDataFrame(first.collect(), first.schema), spark.createDataFrame([(0, [(4000, 4000, " more")]), (3, None)], schema)).collect()}
    whole = texts[0][:100] + "new" + texts[0][110:]
    expected = {0: whole[:4000] + " more" + whole[4000:], 1: "begin", 2: "", 3: "short"}
    assert {k: "".join(r.leaves) for k, r in again.items()} == expected
    assert all(sum(r.tokens) == len(encode.tokenizer.encode(expected[k], add_special_tokens=False).ids) for k, r in again.items())
    assert 0 < again[0].n_reencoded < 2_000 and not again[1].n_reencoded


def test_token_counts_edges(spark):
    frame = docs_of(spark, EDGES).withColumn("n_tokens", F.lit(1))
    encode = encoder(*vocabulary_files())
    out = {r.doc_id: r for r in token_counts(frame, sample_edits(frame["text"])).collect()}
    assert [out[k].n_tokens for k in range(len(EDGES))] == [len(encode.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in EDGES]
    assert token_counts(frame.limit(0)).count() == 0
    assert sorted(r.n_tokens for r in token_counts(frame.unionByName(frame)).collect()) == sorted(2 * [r.n_tokens for r in out.values()])
    assert all(r.n_edited_tokens == r.n_tokens for r in token_counts(frame).collect())


# Jaccard join


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def linked(texts, width, num, den):
    sets = [shingles(t, width) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_components(spark, width, num):
    texts = random_texts()
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs_of(spark, texts).repartition(3), width, num, 100).collect()}
    assert [out[k] for k in range(len(texts))] == linked(texts, width, num, 100)


def test_jaccard_chains_within_one_common_group(spark):
    # Each text is near its neighbours alone, so no one of them links to all.
    words = [f"w{k}" for k in range(140)]
    texts = [" ".join(words[k : k + 60]) for k in range(0, 80, 3)]
    out = jaccard_components(docs_of(spark, texts), 4, 85, 100).collect()
    assert {r.doc_id: r.component_id for r in out} == {k: c for k, (_, c) in enumerate(linked(texts, 4, 85, 100))}


def test_long_words_made_by_a_rule_differ(spark):
    """Words on which sums of powers modulo 2**64 agree for any base."""
    texts = []
    for n in (9, 10, 11, 12):
        word = "".join("ab"[bin(k).count("1") % 2] for k in range(1 << n))
        texts += [word, word.translate(str.maketrans("ab", "ba"))]
    got = jaccard_components(docs_of(spark, texts), 4, 85, 100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(k, 1, k) for k in range(len(texts))]


def test_jaccard_edges(spark):
    frame = docs_of(spark, EDGES).withColumn("component_id", F.lit("mine"))
    frame = frame.unionByName(frame.where("doc_id = 6")).unionByName(frame.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    assert jaccard_components(frame).count() == len(EDGES) + 2
    assert jaccard_components(frame.limit(0)).count() == 0
    kept = drop_near_copies(docs_of(spark, ["a b c d e f"] * 5 + [None, None, ""]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 5, 6, 7] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_suffix_filter_never_drops_a_pair():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 80, rng.integers(1, 60))) for _ in range(2))
        assert may_reach(a, b, len(np.intersect1d(a, b)))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(5, 5), (1000, 999)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {k: 0 for k in range(301)} | {999: 999, 1000: 999}
    assert components(links.limit(0)).count() == 0


# Suffix dedup


def repeats(texts):
    first, out = {}, []
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i : i + 50], k) < k:
                gone[i : i + 50] = True
        out.append((len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return out


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in [*range(30), 100, 301, 302]:
        x = rng.integers(1, 4, n)
        assert suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_first_documents():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(3)) + "c" * rng.randint(45, 60) + "".join(rng.choice("ab") for _ in range(8)) for _ in range(30)]
    least = [rng.randrange(100) for _ in texts]
    seen = {}
    for t, d in zip(texts, least, strict=True):
        for i in range(len(t) - 49):
            seen[t[i : i + 50]] = min(d, seen.get(t[i : i + 50], d))
    text, offset, document = first_documents([t.encode() for t in texts], np.array(least))
    assert len(text) == sum(max(0, len(t) - 49) for t in texts)
    assert all(document[k] == seen[texts[text[k]][offset[k] : offset[k] + 50]] for k in range(len(text)))


def test_remove_repeats(spark, monkeypatch):
    from tessera.llm import suffixes

    texts = random_texts() + ["q" * 200, "z" + "q" * 120, "é" + "q" * 49, "q" * 49]
    frame = docs_of(spark, texts)
    for together in (2048, 3, 1, 0):  # crowded anchors are split by the bytes beside them, and then string by string
        monkeypatch.setattr(suffixes, "SORTED_TOGETHER", together)
        out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(frame.repartition(3)).collect()}
        assert [out[k] for k in range(len(texts))] == repeats(texts)


def test_rows_that_repeat_an_id(spark):
    passage = "a passage that is repeated here and is longer than fifty bytes in all"
    rows = [(1, passage), (2, passage), (2, "short"), (2, "x " + passage), (3, "y" * 80), (3, "y" * 80), (None, passage), (None, None), (4, "y" * 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("SPANS", F.lit("mine"))
    earlier = lambda i, gram: any(a is not None and rows[i][0] is not None and a < rows[i][0] and gram in (b or "") for a, b in rows)
    expected = []
    for i, (doc_id, text) in enumerate(rows):
        gone = [False] * len(text or "")
        for k in range(len(text or "") - 49):
            if earlier(i, text[k : k + 50]):
                gone[k : k + 50] = [True] * 50
        kept = "".join(c for c, g in zip(text or "", gone, strict=True) if not g)
        expected.append((doc_id, len(text or ""), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    out = [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in remove_repeats(frame).collect()]
    assert sorted(map(str, out)) == sorted(str(e[:4]) for e in expected)
    cut = without_repeats(frame)
    assert cut.columns == frame.columns and sorted(str((r.doc_id, r.text or "")) for r in cut.collect()) == sorted(str((e[0], e[4])) for e in expected)


def test_surroundings_that_all_chunks_hold(spark, monkeypatch):
    """A line that every chunk holds is one surrounding by the time that it is dealt out; so are all of a row that is repeated."""
    from tessera.llm import suffixes

    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 400)
    line = " ".join(f"Clause {k} of this licence stands in every document, word {k * k} for word, without end." for k in range(12))
    texts = [f"{k * 7919 % 1009} {line} {k * 104729 % 1013}" for k in range(300)]
    seen = []
    plain_surroundings = suffixes.surroundings

    def noted(found):
        once = plain_surroundings(found)
        seen.append((found.count(), once.count(), once.select("anchor", "mark").distinct().count()))
        return once

    monkeypatch.setattr(suffixes, "surroundings", noted)
    out = sorted(map(tuple, remove_repeats(docs_of(spark, texts)).collect()))
    assert [r[1:] for r in out] == repeats(texts)
    (found, once, different), *_ = seen
    assert once == different and once < found / 5
    same = docs_of(spark, texts[:2] + [texts[1]]).withColumn("doc_id", F.least("doc_id", F.lit(1)))
    rows = sorted(tuple(r) for r in remove_repeats(same).collect())
    assert rows[1] == rows[2] and rows[1][2] > 0


def test_partitions_are_bounded():
    from tessera.llm.shared import BUCKETS, MOST_PARTS, TASK_HASHES, buckets_of, parts_of

    assert parts_of(0) == 1 and buckets_of(1) == BUCKETS and parts_of(10**14) == MOST_PARTS
    for hashes in (10**6, 10**9, 10**14):
        assert hashes / buckets_of(hashes) <= TASK_HASHES / BUCKETS


def test_hashes_of_several_rows(spark):
    from tessera.llm.common import packed, unpacked
    from tessera.llm.shared import chunk_blocks, several

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, 8).astype(np.uint64) << np.uint64(40)) for _ in range(30)]
    rows = [(k // 7, bytearray(packed(x, 5).tobytes())) for k, x in enumerate(sets)]
    found = several(chunk_blocks(spark.createDataFrame(rows, "chunk long, hashes binary").coalesce(1), 3, 5), 3, 5, frequencies=True).collect()
    often = {int(h): sum(h in x for x in sets) for x in sets for h in x}
    got = {(r.chunk, int(h) << 24): int(n) for r in found for h, n in zip(unpacked(r.hashes, 5), np.frombuffer(r.df, np.uint32), strict=True)}
    assert got == {(k // 7, int(h)): often[int(h)] for k, x in enumerate(sets) for h in x if often[int(h)] > 1}


def test_repeats_in_long_texts_and_edges(spark, monkeypatch):
    from tessera.llm import suffixes

    monkeypatch.setattr(suffixes.pieces, "__defaults__", (1000,))
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh") for _ in range(4000))
    texts = [long, "x" + long[900:1100] + "y", long[:2500] + "!" + long[2600:]]
    out = sorted(map(tuple, remove_repeats(docs_of(spark, texts)).collect()))
    assert [r[1:] for r in out] == repeats(texts)
    frame = docs_of(spark, EDGES).withColumn("spans", F.lit(1))
    assert remove_repeats(frame).count() == len(EDGES) and remove_repeats(frame.limit(0)).count() == 0
    null = remove_repeats(frame.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(null) == len(EDGES) and not any(r.n_removed for r in null)
    cut = without_repeats(docs_of(spark, ["é" * 40 + "ab", "ß" + "é" * 40 + "ab"]))
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.collect()} == {0: ("é" * 40 + "ab", 42), 1: ("ß", 1)}


# Decontamination


def contamination(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    out = []
    for text in texts:
        w, hit, ids = words(text), set(), set()
        for item, body in items:
            v = words(body)
            n = min(10, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        ids.add(str(item))
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("limit", [20_000, 0])
def test_contamination(spark, limit):
    from tessera.llm.decontamination import find_contamination

    item = "The quick brown FOX jumps over the lazy dog while eleven É birds sing"
    items = [(1, item), (2, "short item"), (10, "Short; item"), (3, None), (4, "..."), (5, item.upper())]
    texts = ["x " + item.lower() + " y", "the quick, brown fox: jumps over the lazy dog while", "a short item here", "ÉSHORT item", None, "", "short_item short item", " ".join(item.split()[1:12]), "the quick brown fox jumps over the lazy dog"]
    docs = docs_of(spark, texts).withColumn("hits", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = contamination(texts, items)
    out = {r.doc_id: tuple(r)[1:] for r in contamination_report(docs, bench).collect()}
    assert [out[k] for k in range(len(texts))] == expected
    raw = {r.doc_id: len(r.hits) for r in find_contamination(docs, bench, broadcast_windows=limit).collect()}
    assert [raw[k] for k in range(len(texts))] == [e[1] for e in expected]
    kept = decontaminate(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, e in enumerate(expected) if not e[4]] and kept.columns == docs.columns
    spans = {r.doc_id: r.text for r in decontaminate(docs, bench, remove="spans").collect()}
    assert spans[2] == "a here" and spans[8] == texts[8] and spans[4] is None and spans[0] == "x é birds sing y"
    assert contamination_report(docs.limit(0), bench).count() == 0
    long = docs_of(spark, ["filler words of no kind " * 20_000 + item]).unionByName(docs_of(spark, ["filler words of no kind " * 20_000 + item]))
    raw = find_contamination(long, bench, broadcast_windows=limit).collect()
    assert [(r.n_words, len(r.hits)) for r in raw] == [(100_014, 14)] * 2
    assert not any(r.contaminated for r in contamination_report(docs, bench.limit(0)).collect())


# Classifiers


def test_words_are_cut_from_the_rows_that_hold_them(spark):
    window = "one two three four five six seven eight nine ten"
    clean = " ".join(f"w{k}" for k in range(14))
    rows = [(1, "x " + window), (1, clean), (1, "x " + window), (2, "a " + window + " b"), (3, clean), (None, window), (4, None)]
    frame = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], "doc_id long, text string, key string, hits int")
    items = spark.createDataFrame([("i", window)], "item_id string, text string")
    got = decontaminate(frame, items, remove="spans")
    assert got.columns == frame.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == [(0, window), (1, clean), (1, "x"), (1, "x"), (2, "a b"), (3, clean), (4, "")]
    left = decontaminate(frame, items)
    assert sorted(((r.doc_id or 0, r.text or "") for r in left.collect())) == [(0, window), (3, clean), (4, "")]


def labelled(spark, n=400):
    rng = random.Random(6)
    clean = ["the", "of", "and", "house", "river", "walks", "green", "stone"]
    rows, labels = [], []
    for k in range(n):
        w = [rng.choice(clean) for _ in range(rng.randint(20, 60))]
        toxic, bad = int(k % 5 == 0), int(k % 4 == 1)
        if toxic:
            w[3], w[10] = "moron", "scum"
        if bad:
            w = [x.upper() + "!!" for x in w]
        rows.append((k, " ".join(w), "en", "s", 1))
        labels.append((k, 1 - bad, toxic))
    docs = spark.createDataFrame([*rows, (n, None, None, None, None), (n + 1, "", None, None, None), (n + 2, "é" * 9, None, None, None)], DOC)
    return docs, spark.createDataFrame(labels + labels[:5] + [(None, 1, 1), (9999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("operator", "label", "held"), [(toxicity, "toxic", lambda k: zlib.crc32(str(k).encode()) % 5 == 0), (quality, "quality", lambda k: zlib.crc32(str(k).encode()) % 3 == 1)])
def test_classifiers(spark, operator, label, held):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r[label] for r in labels.where("doc_id < 400").collect() if r[label] is not None}
    out = operator(docs.withColumn("score", F.lit("mine")), labels).collect()
    assert len(out) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == held(r.doc_id) for r in out)
    tested = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.95
    assert operator(docs.limit(0), labels).count() == 0
    constant = operator(docs, labels.limit(0)).collect()
    assert {r.score for r in constant} == {0.5}


def test_factorisation_machine_equals_its_pairs():
    fm = FactorisationMachine()
    fm.w[:] = np.random.default_rng(1).normal(0, 0.1, fm.w.shape)
    data = np.frombuffer(b"One two two. THREE", np.uint8)
    words, bounds, bins = features(data, np.array([0, len(data)]))
    x = [(i, 1 / len(words)) for i in words] + [(i, 1.0) for i in bins[0]]
    pairs = sum(float(fm.v[a] @ fm.v[b]) * u * v for k, (a, u) in enumerate(x) for b, v in x[:k])
    assert abs(fm.raw(words, bounds, bins)[0][0] - (sum(fm.w[i] * v for i, v in x) + pairs)) < 1e-5


def test_scores_do_not_depend_on_the_block(spark):
    model = CharNB()
    model.weights[:] = np.random.default_rng(2).normal(0, 1, model.weights.shape)
    texts = [b"first text here", b"", b"x", "zweiter Text ß".encode()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    alone = [model.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(model.score(data, offsets), alone)


def test_toxicity_score_by_plain_loops():
    from tessera.llm.common import BASE, BYTE_VALUES
    from tessera.llm.toxicity import BUCKET_BITS, GRAMS

    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> shift)) * factor % 2**64
        return x

    model = CharNB()
    model.weights[:] = np.random.default_rng(2).normal(0, 1, model.weights.shape)
    model.bias = 0.3
    texts = ["First text, here!", "", "x", "zweiter Text ß " * 3]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    for text, score in zip(texts, model.score(data, offsets), strict=True):
        raw = bytes(c + 32 if 65 <= c < 91 else c for c in f" {text} ".encode())
        raw = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in raw)
        total = 0.0
        for g, n in enumerate(GRAMS):
            for k in range(len(raw) - n + 1):
                value = sum(int(BYTE_VALUES[raw[k + j]]) * int(BASE) ** j for j in range(n)) + n
                total += float(model.weights[g][mixed(value % 2**64) >> (64 - BUCKET_BITS)])
        assert abs(score - 1 / (1 + np.exp(-(0.3 + total / (len(text.encode()) + 2))))) < 1e-5


@pytest.mark.parametrize(("operator", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_repeated_rows_and_long_texts(spark, operator, label):
    docs, labels = labelled(spark)
    base = docs.where("doc_id in (5, 6)")
    long = base.where("doc_id = 6").select(F.lit(950).cast("long").alias("doc_id"), F.repeat(F.concat("text", F.lit(" ")), 3_000).alias("text"), "lang", "source", "n_chars")
    out = operator(docs.unionByName(base).unionByName(long), labels).collect()
    assert len(out) == 403 + 3
    by = {k: [r for r in out if r.doc_id == k] for k in (5, 6, 950)}
    assert by[5][0] == by[5][1] and by[6][0] == by[6][1] and len(by[950]) == 1 and 0 <= by[950][0].score <= 1
    if operator is toxicity:  # relative counts, so a text repeated many times scores about as it does once
        assert abs(by[950][0].score - by[6][0].score) < 0.1


def test_keep_quality_keeps_columns_and_clean_rows(spark):
    docs, labels = labelled(spark)
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum(k % 4 != 1 for k in ids if k < 400) >= 295 and sum(k % 4 == 1 for k in ids if k < 400) <= 5


# Embeddings


def test_embedding_links(spark, monkeypatch):
    from tessera.llm import embeddings

    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 64))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 64)) * 0.3, base[:5], base[:3] * 2.5])
    label = [int(k % 3) if k < 40 else int((k - 40) % 3) for k in range(len(x))]
    rows = [(k, [float(np.float32(v)) for v in x[k]], label[k]) for k in range(len(x))]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 64, 1), (903, [float("nan")] * 64, 1), (904, [1.0, None] * 32, 1), (905, rows[0][1], None), (906, [1.0], 1), (None, rows[0][1], 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("mine"))
    v = np.array([r[1] for r in rows])
    cos = (v @ v.T) / np.outer(*[np.linalg.norm(v, axis=1)] * 2)
    link = (cos >= 0.93) & (np.equal.outer(label, label)) & ~np.eye(len(v), dtype=bool)
    reach = [min([k, *np.flatnonzero(link[k])]) for k in range(len(v))]
    for _ in v:
        reach = [min([reach[k], *[reach[j] for j in np.flatnonzero(link[k])]]) for k in range(len(v))]
    for block in (1024, 2):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(frame).collect()}
        assert [out[k] for k in range(len(v))] == [(int(link[k].sum()), reach[k], reach[k] == k) for k in range(len(v))]
        assert all(out[k] == (0, k, True) for k in range(900, 907)) and out[None][0] == 0
    assert embedding_dedup(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("kind", "a", "b"), [("long", 1 << 40, 1), ("string", "left", "right"), ("double", 0.0, 1.5), ("boolean", True, False)])
def test_embedding_labels_of_any_type_and_repeated_ids(spark, kind, a, b):
    v, w = [1.0] * 16, [1.0, -1.0] * 8
    rows = [(1, v, a), (1, v, a), (2, v, b), (3, w, a), (4, w, a), (5, v, None)]
    if kind == "double":
        rows[1] = (1, v, -0.0)
    out = embedding_dedup(spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")).collect()
    assert sorted(map(tuple, out)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True)]


def test_hashing_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(1)[:, None] * a
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * noise
    x, y = buckets(a), buckets(b)
    met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)
    assert met.mean() > 0.9


# Language


def precise(net):
    for side in net.sides:
        side.e, side.u, side.o = side.e.astype(float), side.u.astype(float), side.o.astype(float)
    net.bias = np.array([0.2, -0.1, 0.0])
    return net


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    x, label = rng.integers(97, 102, (6, 3)).astype(np.uint8), np.array([0, 2, 1])
    net = precise(BiGRU(["a", "b", "c"], 3))
    _, grads = net.gradients(x, label)
    weights = [w for side in net.sides for w in side.weights()] + [net.bias]
    for w, g in zip(weights, grads, strict=True):
        for at in rng.permutation(np.flatnonzero(np.abs(g) > 1e-6))[:15]:
            old, step = w.flat[at], 1e-6
            w.flat[at] = old + step
            up = net.gradients(x, label)[0]
            w.flat[at] = old - step
            down = net.gradients(x, label)[0]
            w.flat[at] = old
            assert abs((up - down) / (2 * step) - g.flat[at]) < 1e-6


def test_network_by_plain_loops():
    net = precise(BiGRU(["a", "b", "c"], 3))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(side, text):
        h, out = np.zeros(3), []
        for c in text:
            a, b = side.e[c], h @ side.u
            z, r = sigmoid(a[:3] + b[:3]), sigmoid(a[3:6] + b[3:6])
            n = np.tanh(a[6:] + r * b[6:])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    texts = [b"hello", b"", "größe ".encode() * 40]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for text, pooled in zip(texts, net.pooled(data, offsets), strict=True):
        total = np.zeros(3)
        for k in range(0, len(text), 128):
            part = text[k : k + 128]
            for f, g in zip(states(net.sides[0], part), states(net.sides[1], part[::-1])[::-1], strict=True):
                p = np.exp(f @ net.sides[0].o + g @ net.sides[1].o + net.bias)
                total += p / p.sum()
        assert np.allclose(pooled, total / max(1, len(text)), atol=1e-5)


def test_language(spark):
    rng = random.Random(3)
    make = {"en": ["the", "of", "with", "things"], "de": ["der", "über", "nicht", "schön"], "fr": ["le", "où", "était", "aux"]}
    rows = [(k, " ".join(rng.choice(make[lang]) for _ in range(40)), lang, "s", 1) for k, lang in enumerate(rng.choice(list(make)) for _ in range(300))]
    docs = spark.createDataFrame([*rows, (900, None, "en", "s", 0), (901, "123 ...", "en", "s", 0), (902, "", None, "s", 0), (903, "½ ² ① Ⅷ 5", "en", "s", 0), (904, "the of with " * 20_000, "en", "s", 0), (904, "the of with " * 20_000, "en", "s", 0)], DOC).withColumn("lang_pred", F.lit(0))
    out = {r.doc_id: r for r in language(docs).collect()}
    assert all(out[k].lang_pred == "und" for k in (900, 901, 902, 903)) and out[904].lang_pred == "en"
    tested = [r for r in rows if out[r[0]].held_out]
    assert np.mean([out[r[0]].lang_pred == r[2] for r in tested]) > 0.95 and all(0 <= r.score <= 1 for r in out.values())
    assert language(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_learns_every_language(spark):
    rows = [(k, f"text {k}", f"l{k % 105:03d}", "s", 1) for k in range(1050)]
    network = fit_language(spark.createDataFrame(rows, DOC))
    assert network.languages == sorted({r[2] for r in rows})


def test_language_learns_from_whole_texts(spark):
    words = {"en": "the of with things ", "de": "der nicht und auch "}
    rows = [(k, "12 34 " * 350 + words[lang] * 110, lang, "s", 1) for k, lang in enumerate(["en", "de"] * 60)]
    out = {r.doc_id: r for r in language(spark.createDataFrame(rows, DOC)).collect()}
    tested = [r for r in rows if out[r[0]].held_out]
    assert tested and all(out[k].lang_pred == lang for k, _, lang, *_ in tested)


# Packing


def test_cuts_sum_up_and_fill_their_class():
    for n in [*range(0, 3000), 10_240]:
        parts = cuts(n)
        assert sum(parts) == n and len(parts) <= n // 1024 + 5
        assert all(p * (CAPACITY // p) >= CAPACITY - CAPACITY // p or p <= 64 for p in parts)


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    texts = random_texts() + ["two  spaces", " lead", "trail ", "a <|endoftext|> b", "word " * 5000]
    frame = docs_of(spark, texts).withColumn("length", F.lit("mine")).repartition(2)
    out = pack(frame).toPandas().sort_values(["sequence_id", "offset"])
    for _, part in out.groupby("sequence_id"):
        assert part.length.sum() <= CAPACITY and (part.offset == part.length.cumsum() - part.length).all()
    for k, part in out.sort_values("start").groupby("doc_id"):
        ids = [*tokenizer.encode(texts[k] or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(b"".join(part.ids), "<u4").tolist() == ids and (part.doc_tokens == len(ids)).all()
    sequences = out.groupby("sequence_id").length.sum()
    assert (CAPACITY - sequences).sum() < 4 * CAPACITY
    digest = packing_digest(frame).toPandas()
    assert sorted(digest.ids_crc32) == sorted(zlib.crc32(x) for x in out.ids)
    assert pack(frame.limit(0)).count() == 0
    twice = pack(frame.unionByName(frame)).toPandas()
    assert twice.length.sum() == 2 * out.length.sum()


# URL filter


def test_url_rules(spark):
    urls = {
        1: ("http://a.NET/x", "a.net", "/x", "net/", "block"),
        2: ("https://www.example.net/en/1?q", "www.example.net", "/en/1", "example.net/en/", "allow"),
        3: ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        4: ("http://x.org/fr/y#z", "x.org", "/fr/y", "org/fr/", "allow"),
        5: ("http://x.org/de", "x.org", "/de", None, "allow"),
        6: ("http://net", "net", "", None, "allow"),
        7: (None, "", "", None, "allow"),
        8: ("no scheme/net/", "", "", None, "allow"),
        9: ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        10: ("http://a.net?x=://b.org/fr/", "a.net", "", None, None),
    }
    pages = spark.createDataFrame([(k, u[0], None if k == 2 else "<a href='/x'>y</a>") for k, u in urls.items()], "page_id long, url string, html string").withColumn("host", F.lit(1))
    out = {r.page_id: tuple(r)[1:] for r in url_filter(pages.unionByName(pages)).collect()}
    for k, (_, host, path, rule, verdict) in urls.items():
        assert out[k][:3] == (host, path, rule) and (verdict is None or out[k][3] == verdict)
    assert url_filter(pages.limit(0)).count() == 0


def test_graph_decides_where_no_rule_does(spark):
    link = lambda *hosts: "".join(f"<a href='http://{h}/x'>y</a>" for h in hosts)
    rows = [(k, f"http://bad{k}.net/p", None) for k in range(4)]
    rows += [(10, "http://feeder.info/1", link(*(f"bad{k}.net" for k in range(4)))), (11, "http://plain.info/2" + "?q" * 50_000, "<p>no link" * 10_000), (12, "http://good.org/fr/x", link("near.info")), (13, "http://near.info/", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("linked", F.lit(1))
    out = {r.page_id: r.verdict for r in url_filter(frame).collect()}
    assert out == {0: "block", 1: "block", 2: "block", 3: "block", 10: "block", 11: "allow", 12: "allow", 13: "allow"}


def test_rank_against_power_iteration(spark):
    edges = [("a", "b", 1), ("b", "c", 2), ("b", "a", 1), ("c", "a", 1), ("d", "c", 3)]
    out = {r.host: r.score for r in propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([("a", 2.0), ("d", 1.0)], "host string, mass double"), rounds=200).collect()}
    seed = score = np.array([2.0, 0, 0, 1.0])
    m = np.array([[0, 1, 0, 0], [1 / 3, 0, 2 / 3, 0], [1, 0, 0, 0], [0, 0, 1, 0]])
    for _ in range(300):
        score = seed + 0.85 * score @ m
    assert np.allclose([out.get(h, 0) for h in "abcd"], score, atol=1e-4)


def test_rank_ends_converged_by_default(spark):
    edges = [("a", "b", 1), ("b", "a", 1)] + [(f"h{k:02d}", f"h{k + 1:02d}", 1) for k in range(30)]
    seeds = spark.createDataFrame([("a", 1.0), ("h00", 1.0)], "host string, mass double")
    out = {r.host: r.score for r in propagate(spark.createDataFrame(edges, "src string, dst string, n long"), seeds).collect()}
    assert abs(out["a"] - 1 / (1 - 0.85**2)) < 1e-4 and abs(out["b"] - 0.85 / (1 - 0.85**2)) < 1e-4
    assert all(abs(out[f"h{k:02d}"] - 0.85**k) < 1e-4 for k in range(31))


def test_distrust_flows_back_along_links(spark):
    judged = spark.createDataFrame([("bad", "block")] * 4 + [("feeder", None), ("good", "allow"), ("near", None)], "host string, ruled string")
    edges = spark.createDataFrame([("feeder", "bad", 5), ("good", "near", 1)], "src string, dst string, n long")
    out = {r.host: r.blocked for r in host_verdicts(judged, edges).collect()}
    assert out == {"bad": True, "feeder": True, "good": False, "near": False}


def test_queries_are_registered():
    from tessera.llm import registry

    assert [int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()] == list(range(1, 14))


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    whole = corpus_pipeline.run(spark, small)
    total = lambda d: tuple(d.agg(F.sum("length"), F.count_distinct("doc_id")).first())
    assert total(packed) == total(whole) and total(whole)[1] == docs.count()


@pytest.mark.parametrize("case", ["empty", "odd"])
def test_pipeline_on_odd_documents(spark, small, case):
    """Empty tables, null texts and ids, repeated ids and columns with clashing names pass through every stage."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0 if case == "empty" else 60)
    if case == "odd":
        odd = spark.createDataFrame([(1, None, None, None, None), (None, "text without an id", None, None, 1), (2, "a text with an id of its own, twice", "en", "s", 1), (2, "another text with the same id", "en", "s", 1)], docs.schema)
        docs = docs.unionByName(odd)
    for name in ("__spans", "__hits", "spans", "hits", "component_id", "key"):
        docs = docs.withColumn(name, F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, small)
        if "sequence_id" not in docs.columns:
            assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert (docs.count() == 0) == (case == "empty")
