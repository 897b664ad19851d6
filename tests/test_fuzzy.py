"""Similar texts by letter pairs: against all pairs, and how few pairs of a large block are tried."""

import random

import pytest

from tessera.functions.exact import ratio
from tessera.operators import fuzzy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def texts(seed, n, letters="abé"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(n)]
    out = list(base)
    for text in base:
        x = list(text)
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(x))
            x[k : k + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
        out.append("".join(x))
    return [(rng.randint(0, 1), t) for t in out] + [(0, None), (1, "aaaaaaa"), (1, "aaaaa")]


@pytest.mark.parametrize("most", [0, 1, 2])
def test_within_edits_against_all_pairs(rows, most):
    left, right = texts(most, 60), texts(most + 10, 60)
    got = fuzzy.within_edits(rows(left, "block int, text string"), rows(right, "block int, text string"), most).collect()
    want = {(k, a, b) for k, a in left for m, b in right if k == m and a is not None and b is not None and distance(a, b) <= most}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("least", [0.5, 0.7, 0.85, 1.0])
def test_alike_holds_all_similar_pairs(rows, least):
    left, right = texts(3, 70, "abcde"), texts(4, 70, "abcde") + texts(3, 40, "abcde")
    got = {tuple(r) for r in fuzzy.alike(rows(left, "block int, text string"), rows(right, "block int, text string"), least).collect()}
    want = {(k, a, b) for k, a in left for m, b in right if k == m and a and b and ratio(a, b) >= least}
    assert want <= got


def test_a_block_that_all_texts_are_in_is_split(rows):
    rng = random.Random(6)
    names = ["the " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(1500)]
    close = [n[:9] + "x" + n[10:] for n in names[:40]]
    left, right = [("the", n) for n in names + close], [("the", n) for n in names]
    frame = lambda data: rows(data, "block string, text string")
    tried = fuzzy.near_candidates(frame(left), frame(right), lambda n: fuzzy.F.lit(2), lambda a, b: fuzzy.F.abs(a - b) > 2).count()
    assert tried < len(left) * len(right) / 12
    found = {tuple(r)[1:] for r in fuzzy.within_edits(frame(left), frame(right), 2).collect()}
    assert {*zip(close, names, strict=False), *zip(names, names, strict=True)} <= found
