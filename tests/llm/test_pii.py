"""Personal data: base rules against plain patterns, the discovery against plain loops, and odd texts."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.identifiers import CARD, EMAIL, IP, KINDS, PHONE, base_spans, candidate_spans, instance, luhn
from tessera.llm.pii import BEFORE, BEHIND, CONFIDENT, SUPPORT, personal_data

DOC = "doc_id long, text string, lang string, source string, n_chars long"
RULES = {
    EMAIL: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    IP: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    CARD: r"[0-9]([\x20-]?[0-9])+",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {EMAIL: True, IP: kind == IP and all(int(p) <= 255 for p in m[0].split(".")), CARD: 13 <= len(digits) <= 19 and plain_luhn(digits), PHONE: 9 <= len(digits) <= 15}[kind]
            if fits:
                out.append((kind, *m.span()))
    return out


def plain_tokens(text):
    """(token, start, end), letters small and digits one."""
    return [(re.sub("[0-9]", "0", re.sub("[A-Z]", lambda c: c[0].lower(), m[0])), *m.span()) for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+|[^\x20\x09-\x0D]", text)]


def plain_patterns(tokens, start, end):
    words = [t for t, _, _ in tokens]
    left, right = sum(e <= start for _, _, e in tokens), sum(s < end for _, s, _ in tokens)
    out = [("<", *words[left - n : left]) for n in range(1, BEFORE + 1) if left >= n]
    return out + [(">", *words[right : right + n]) for n in range(1, BEHIND + 1) if right + n <= len(words)]


def plain_result(texts):
    """(base, all spans) of each text."""
    texts = [t or "" for t in texts]
    edges, seeds, held, total = defaultdict(Counter), set(), Counter(), Counter()
    spots = []
    for t, text in enumerate(texts):
        tokens = plain_tokens(text)
        words = [w for w, _, _ in tokens]
        for j in range(len(words)):
            for n in range(1, max(BEFORE, BEHIND) + 1):
                if n <= BEFORE and j + n < len(words):
                    total[("<", *words[j : j + n])] += 1
                if n <= BEHIND and j > 0 and j + n <= len(words):
                    total[(">", *words[j : j + n])] += 1
        base = plain_base(text)
        for start, end, kinds, seed in [(s, e, 1 << k, True) for k, s, e in base] + [(s, e, k, False) for s, e, k in candidate_spans(text, base)]:
            name = instance(text[start:end], kinds)
            for kind in range(len(KINDS)):
                if kinds >> kind & 1:
                    if seed:
                        seeds_of = [(p, kind, name) for p in plain_patterns(tokens, start, end)]
                        seeds.update(seeds_of)
                    else:
                        spots.append((t, start, end, kind, name))
                    for p in plain_patterns(tokens, start, end):
                        edges[p, kind][name] += 1
                        held[p, kind] += 1
    known = {}
    while True:
        trust = {}
        for (p, kind), names in edges.items():
            sure = [n for n in names if (p, kind, n) in seeds or (n, kind) in known]
            right = sum(names[n] for n in sure)
            all_ = max(total[p], held[p, kind])
            if len(sure) >= SUPPORT and right / (all_ - (held[p, kind] - right) / 2) >= CONFIDENT and held[p, kind] >= CONFIDENT * all_:
                trust[p, kind] = right / (all_ - (held[p, kind] - right) / 2)
        now = {}
        for (p, kind), c in trust.items():
            for name in edges[p, kind]:
                sides = now.setdefault((name, kind), [0, 0])
                sides[p[0] == ">"] = max(sides[p[0] == ">"], c)
        if len(now) == len(known):
            break
        known = now
    found = defaultdict(dict)
    for t, start, end, kind, name in spots:
        if (name, kind) in known:
            left, right = known[name, kind]
            found[t][start, end] = max(found[t].get((start, end), (-1, 0)), (1 - (1 - left) * (1 - right), -kind))
    return [(plain_base(text), sorted(plain_base(text) + [(-k, s, e) for (s, e), (_, k) in found[t].items()])) for t, text in enumerate(texts)]


def written(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def expected(texts):
    out = []
    for base, spans in plain_result(texts):
        n = Counter(k for k, _, _ in base)
        out.append((n[EMAIL], n[IP], n[CARD], n[PHONE], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base)))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(k, t, None, "s", len(t or "")) for k, t in enumerate(texts)], DOC)


def result(spark, texts, parts=3):
    rows = personal_data(frame(spark, texts).repartition(parts)).collect()
    return [tuple(r)[1:] for r in sorted(rows)]


@settings(max_examples=3000, deadline=None)
@given(st.text(st.sampled_from("a@.-_+ ()019éZ"), max_size=60) | st.text(st.sampled_from("0123456789.-+ "), max_size=80))
def test_base_rules_are_the_plain_patterns(text):
    assert base_spans(text) == plain_base(text)


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    rng = random.Random(1)
    for _ in range(500):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(13, 19)))
        assert luhn(digits) == plain_luhn(digits)


@pytest.mark.parametrize("piece", ["a", "1", "1.", "1 ", "(", "+1", "+", "@", "a@", "a@b", "(at) ", "a@b.", "0:", "é1", "1.1.1.x", "+1(((", "1 -", "a@b.c_"])
def test_long_runs_take_linear_time(piece):
    began = time.time()
    text = piece * (400_000 // len(piece))
    candidate_spans(text, base_spans(text))
    assert time.time() - began < 10


def planted(seed=3):
    """Texts in which two cues lead to identifiers, some of which no rule matches, and the rest of the words are random."""
    rng = random.Random(seed)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "né", "Über", "line", "7"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = []
    for k in range(12):
        texts.append(f"{some(8)} write me: user{k}@mail{k}.example.com, thanks {some(5)}")
        texts.append(f"{some(4)} call now +1 (555) 0{k:02d}-1{k:03d} at home {some(9)}")
    texts += [f"{some(5)} write me: bob{k}@localhost, thanks {some(3)}" for k in range(3)]
    texts += [f"{some(5)} write me: eve (at) example dot com, thanks", f"{some(2)} call now 0555 71{k} 4433 at home" if (k := 7) else ""]
    texts += [f"{some(6)} call now 020 7946 0{k}58 at home {some(2)}" for k in range(2)]
    texts += [f"{some(6)} ring 020 7946 0158 {some(2)}", f"{some(3)} order 4111111111111112 {some(2)}", f"{some(3)} code 12345678901234 {some(2)}", some(60)]
    texts += [f"see bob1@localhost or 10.0.0.1, {some(3)}", "10.0.0.300 and 1.2.3.4.5.6.7.8", "fe80::1 at ::1", None, "", " ", texts[0], texts[0]]
    rng.shuffle(texts)
    return texts


def test_patterns_discover_what_rules_miss(spark):
    texts = planted()
    got = result(spark, texts)
    assert got == expected(texts)
    found = {text[int(s) : int(e)] for text, row in zip(texts, got, strict=True) for kind, s, e in (x.split(":") for x in row[5].split(",") if x) if (KINDS.index(kind), int(s), int(e)) not in base_spans(text or "")}
    assert {"bob0@localhost", "bob1@localhost", "bob2@localhost", "020 7946 0058", "020 7946 0158"} <= found
    assert not any("4111111111111112" in x or "12345678901234" in x for x in found)


def test_patterns_learnt_from_what_was_discovered(spark):
    """Numbers that one cue makes known make another cue trusted, which finds further ones."""
    texts = [f"dial +44 20 7946 0{k:03d} today" for k in range(9)] + [f"dial 0207946{k:04d} today" for k in range(4)]
    texts += [f"desk 0207946{k:04d} upstairs" for k in range(4)] + ["desk 0315550000 upstairs", "lamp 0315550001 upstairs now"]
    got = result(spark, texts)
    assert got == expected(texts)
    assert got[17][5] == "phone:5:15"


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_by_plain_loops(spark, seed):
    rng = random.Random(seed)
    pieces = ["to", "to:", "mail", "(tel)", "+1 (234) 567-8901", "+4412345678", "4111 1111 1111 1111", "4111111111111112", "a@b.example", "x_y@host", "10.0.0.1", "10.0.0.999", "1:2:3:ab", "ann [at] b.example", "5551234567", "né", "-", "\n", "12/12/2024"]
    texts = [" ".join(rng.choice(pieces) + rng.choice(["", ",", str(rng.randint(0, 9))]) for _ in range(rng.randint(0, 14))) for _ in range(150)]
    assert result(spark, texts) == expected(texts)


def test_odd_documents(spark):
    texts = [None, "", " ", "x" * 3000, "1" * 3000, "a@b.cd " * 500, "\U0001f600 a@b.cd \U0001f600 é+12345678901"]
    got = result(spark, texts)
    assert got == expected(texts)
    long = ["x" * 3_000_000 + " a@b.cd", "1 " * 400_000, "a@b.cd " * 20_000]
    assert [r[:4] for r in result(spark, long)] == [(1, 0, 0, 0), (0, 0, 0, 0), (20_000, 0, 0, 0)]
    rows = [(1, "a@b.cd", "x", 9), (1, "a@b.cd", "y", 9), (1, "other", "y", 9), (None, "a@b.cd", None, 9)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, mark string, n_email int")
    got = personal_data(clash)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found"]
    assert sorted(((r.doc_id or 0, r.spans) for r in got.collect())) == [(0, "email:0:6"), (1, ""), (1, "email:0:6"), (1, "email:0:6")]
    empty = personal_data(clash.limit(0))
    assert empty.count() == 0 and empty.dtypes == got.dtypes
