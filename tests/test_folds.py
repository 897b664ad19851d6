"""Folds over keys of any size: summaries against step by step, and keys cut over many tasks against one task."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import limits


def over(step, state, rows):
    for row in rows:
        state = step(state, *row)
    return state


def calls(rng, n, dense):
    at, out = 1000.0, []
    for _ in range(n):
        at += rng.choice([0.0, 0.5, 1.0, 5.0] if dense else [0.0, 3.0, 31.0, 12.5, 30.0])
        out.append((at, rng.random() < rng.choice([0.2, 0.8])))
    return out


@pytest.mark.parametrize("threshold, recovery", [(1, 30.0), (2, 30.0), (3, 4.0), (10, 30.0)])
@pytest.mark.parametrize("dense", [True, False])
def test_breaker_summaries_go_on_from_any_state(threshold, recovery, dense):
    rng = random.Random(threshold)
    fold = limits.breaker_fold(threshold, recovery)
    for _ in range(150):
        rows = calls(rng, rng.randint(1, 60), dense)
        first = rows[0][0]
        summary = fold.summary([list(x) for x in zip(*rows, strict=True)])
        states = [(0, "CLOSED", f, first - rng.choice([0.0, 40.0])) for f in range(threshold)] + [(0, "OPEN", threshold + rng.randint(0, 3), first - rng.choice([0.0, 0.5, 3.0, 29.5, 30.0, 31.0])) for _ in range(8)]
        for state in states:
            want, got = over(fold.step, state, rows), fold.follow(summary, state)
            assert got[1:3] == want[1:3] and (want[1] == "CLOSED" or got[3] == want[3])


def test_bucket_summaries_go_on_from_any_state():
    rng = random.Random(3)
    for _ in range(300):
        fill, capacity = rng.choice([(0.5, 4.0), (2.0, 1.0), (0.25, 2.0)])
        rows = [(c,) for c in sorted(rng.randint(0, 4000) / 16 for _ in range(rng.randint(1, 40)))]
        then = rng.choice([0.0, rows[0][0], rows[0][0] + 7.5])
        state = (0, 0.0, rng.choice([0.0, 0.5, 1.0, capacity]), then)
        want = over(lambda s, c: limits.bucket_next(s, c, fill, capacity), state, rows)
        got = limits.bucket_follow(limits.bucket_summary([r[0] for r in rows], fill, capacity), state, fill)
        assert got[2:] == pytest.approx(want[2:], abs=1e-9)


def test_average_summaries_go_on_from_any_state():
    rng = random.Random(4)
    for _ in range(300):
        values = [0.0] * rng.choice([0, 3, 4000]) + [rng.choice([0.0, 1.0, 250.5, 3.0]) for _ in range(rng.randint(1, 30))] + [0.0] * rng.choice([0, 4000])
        zero, a, b = limits.average_summary(values, 0.2)
        for start in (0.0, 1e-9, 7.0, 900.0):
            want = over(lambda s, x: limits.average_next(s, x, 0.2), (start,), [(x,) for x in values])[0]
            assert (zero if start == 0.0 else a * start + b) == pytest.approx(want, rel=1e-9, abs=1e-300)


@pytest.fixture(scope="module")
def many(spark):
    """One key with two thirds of all rows among many small ones; times and ids in no order."""
    rng = random.Random(8)
    data, n = [], 0
    for key, size in [("hot", 4000), ("warm", 900)] + [(f"k{j}", rng.randint(1, 30)) for j in range(60)] + [(None, 5)]:
        for at, ok in calls(rng, size, key == "hot"):
            data.append((key, n, at, ok, rng.choice([0.0, 12.5, 80.0, 3.25])))
            n += 1
    rng.shuffle(data)
    return spark.createDataFrame(data, "p string, o long, at double, ok boolean, x double").repartition(5)


QUERIES = {
    "breaker": lambda frame, **size: limits.breaker_states(frame, "p", "at", "o", 3, 30.0, **size),
    "bucket": lambda frame, **size: limits.bucket_waits(frame, "p", "at", "o", 0.25, 3.0, **size),
    "average": lambda frame, **size: limits.moving_average(frame, "p", "o", "x", **size),
}


@pytest.mark.parametrize("name", QUERIES)
def test_a_key_over_many_tasks_is_as_in_one(many, name):
    whole = sorted(map(tuple, QUERIES[name](many).collect()))
    assert len(whole) == 62
    cut = sorted(map(tuple, QUERIES[name](many, rows_of_a_task=150).collect()))
    assert [r[0] for r in cut] == [r[0] for r in whole]
    for a, b in zip(cut, whole, strict=True):
        assert a[1:] == pytest.approx(b[1:], abs=2e-3) if name != "breaker" else a == b
    assert QUERIES[name](many).dtypes == QUERIES[name](many, rows_of_a_task=150).dtypes


def test_no_task_gets_a_whole_key(many, monkeypatch):
    from tessera.operators import folds

    seen = []
    plain_cut = folds.cut

    def noted(frame):
        out = plain_cut(frame)
        seen.append({r.fold_part: r.n for r in out.groupBy("fold_part").agg(F.count("*").alias("n")).collect()})
        return out

    monkeypatch.setattr(folds, "cut", noted)
    QUERIES["breaker"](many, rows_of_a_task=150).collect()
    assert len(seen[0]) > 20 and max(seen[0].values()) < 1000


def test_folds_of_nothing(many):
    for query in QUERIES.values():
        assert query(many.limit(0)).count() == 0 and query(many.limit(0), rows_of_a_task=0).count() == 0
