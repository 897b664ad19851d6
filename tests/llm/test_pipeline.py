"""The pipeline against plain loops over its documents, and the toxicity model's ratios against counts by hand."""

import math
import re
from collections import Counter

import numpy as np

from tessera.llm.common import table
from tessera.llm.quality import quality
from tessera.llm.tokens import encoder, vocabulary_files
from tessera.llm.toxicity import GRAMS, LEAST_RATIO, LEAST_TEXTS, CharNB, gram_buckets

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_near_copies(texts):
    """The ids whose component of five-word shingles at 0.8 has no smaller id."""
    sets = {}
    for k, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(AZ))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [k for k in texts if find(k) == k]


def without_repeats(texts):
    """Texts without the characters whose bytes all stand in 50-byte strings of an earlier document."""
    first, out = {}, {}
    for k in sorted(texts):
        raw = texts[k].encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i : i + 50], k) < k:
                gone[i : i + 50] = True
        at, kept = 0, []
        for c in texts[k]:
            n = len(c.encode())
            if not gone[at : at + n].all():
                kept.append(c)
            at += n
        out[k] = "".join(kept)
    return out


def clean_of(texts, items):
    """The ids of texts that hold no window of ten words of an item, or a whole shorter one."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    windows = {}
    for item in items:
        w = words(item)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(n, set()).add(tuple(w[i : i + n]))
    held = lambda w: any(tuple(w[i : i + n]) in wanted for n, wanted in windows.items() for i in range(len(w) - n + 1))
    return [k for k, t in texts.items() if not held(words(t))]


def test_pipeline_by_plain_loops(spark, small):
    import corpus_pipeline

    docs = table(spark, small, "documents")
    good = {r.doc_id for r in quality(docs, table(spark, small, "labels")).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    steps = [{k: t for k, t in texts.items() if k in good}]
    steps.append({k: steps[-1][k] for k in without_near_copies(steps[-1])})
    steps.append(without_repeats(steps[-1]))
    steps.append({k: steps[-1][k] for k in clean_of(steps[-1], [r.text for r in table(spark, small, "benchmark").select("text").collect()])})
    assert len(texts) > len(steps[0]) > len(steps[1]) > len(steps[3]) and steps[1] != steps[2]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], steps, strict=True):
        docs = stage(spark, docs, small)
        rows = docs.collect()
        assert {r.doc_id: r.text or "" for r in rows} == want and len(rows) == len(want), name
        docs = spark.createDataFrame(rows, docs.schema)
    encode = encoder(*vocabulary_files()).tokenizer.encode
    tokens = {k: len(encode(t, add_special_tokens=False).ids) + 1 for k, t in steps[-1].items()}
    packed = corpus_pipeline.run(spark, small).collect()
    assert Counter({k: sum(r.length for r in packed if r.doc_id == k) for k in tokens}) == Counter(tokens) and {r.doc_id for r in packed} == set(tokens)


def test_log_count_ratios_by_hand():
    """Weights are zero but for grams that enough texts have and whose ratio is large; they follow the sign of the ratio of counts."""
    bad, fine = "you awful person", "a nice day out"
    texts = [f"{bad} {k}" for k in range(10)] + [f"{fine} {k}" for k in range(10)] + ["so so"] * 12 + ["rarely seen words here"] * 2
    y = np.array([1.0] * 10 + [0.0] * 10 + [1.0, 0.0] * 6 + [1.0] * 2)
    model = CharNB().fit(texts, y)
    for g, n in enumerate(GRAMS):
        held = []
        for text in texts:
            data = np.frombuffer(b" " + text.encode() + b" ", np.uint8)
            bucket, inside = gram_buckets(data, np.array([0, len(data)]), n)
            held.append(set(bucket[inside].tolist()))
        for b in set().union(*held):
            pos, neg = sum(b in h for h, c in zip(held, y, strict=True) if c == 1), sum(b in h for h, c in zip(held, y, strict=True) if c == 0)
            ratio = math.log(((pos + 0.5) / (y == 1).sum()) / ((neg + 0.5) / (y == 0).sum()))
            weight = float(model.weights[g][b])
            if pos + neg < LEAST_TEXTS or abs(ratio) < LEAST_RATIO - 1e-6:
                assert weight == 0.0
            elif abs(ratio) > LEAST_RATIO + 1e-6:
                assert weight * ratio > 0
        used = set().union(*held)
        assert not np.delete(model.weights[g], list(used)).any()
    score = lambda t: float(model.score(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0])
    assert score(bad) > 0.8 > 0.2 > score(fine)
