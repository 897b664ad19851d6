"""Operators on small tables: resolver cases, changes, duplicates, components, limits, splits."""

import random

from pyspark.sql import functions as F

from tessera.operators import catalog, dedup, graph, limits, mutate
from tessera.operators.resolve import resolve
from tessera.plans.changes import split

FACT = "id long, entity_id long, field_name string, value string, source_id string, confidence double, positional_weight double"
LOCK = "entity_id long, field_name string, lock_state string"
VALUE = "entity_id long, field_name string, value string"


def decide(rows, facts, locks=(), current=(), targets=None):
    out = resolve(rows(list(facts), FACT), rows(list(locks), LOCK), rows(list(current), VALUE), targets=targets).collect()
    return {(r.entity_id, r.field_name): r for r in out}


def test_trust_of_one_fact(rows):
    r = decide(rows, [(1, 1, "title", "A", "SRC_MUSICBRAINZ", 0.95, 1.0)])[1, "title"]
    assert r.selected_value == "A" and abs(r.trust - 0.9025) < 1e-9


def test_locks_placeholders_and_missing_facts(rows):
    facts = [(1, 1, "title", "A", "SRC_MUSICBRAINZ", 1.0, 1.0), (2, 2, "title", "A", "SRC_LASTFM", 1.0, 1.0), (3, 3, "title", "A", "SRC_USER", 1.0, 1.0), (4, 4, "title", " none ", "SRC_USER", 1.0, 1.0)]
    locks = [(1, "title", "MANUAL"), (2, "title", "PROTECTED"), (3, "title", "PROTECTED")]
    current = [(k, "title", f"old {k}") for k in range(1, 6)]
    out = decide(rows, facts, locks, current, rows([(5, "title")], "entity_id long, field_name string"))
    assert [out[k, "title"].selected_value for k in range(1, 6)] == ["old 1", "old 2", "A", "old 4", "old 5"]
    assert out[5, "title"].reason == "No evidence facts available"


def test_ties_go_to_the_fact_seen_first_whatever_the_row_order(rows):
    facts = [(k, 1, "country", v, "SRC_MUSICBRAINZ", 0.5, 1.0) for k, v in ((3, "b"), (1, "c"), (2, "a"))]
    for seed in range(3):
        random.Random(seed).shuffle(facts)
        assert decide(rows, facts)[1, "country"].selected_value == "c"


def test_quality_and_state(spark, rows):
    schema = "id int, title string, artist_id long, album_id long, release_date string, isrc string, mbid string"
    data = [(1, "x", 1, 1, "2000", "i", "m"), (2, "x", None, None, None, None, None), (3, "x.mp3", None, None, None, None, None), (4, "x", None, None, None, "i", None)]
    score = catalog.quality_score(*map(F.col, ("title", "artist_id", "album_id", "release_date", "isrc", "mbid")))
    out = rows(data, schema).withColumn("q", score).select("id", "q", catalog.lifecycle_state(F.col("q"), F.col("isrc"), F.col("mbid")).alias("s")).orderBy("id").collect()
    assert [(r.q, r.s) for r in out] == [(1.0, "COMPLETE"), (0.20, "PARSED"), (0.05, "PARSED"), (0.30, "IDENTIFIED")]


def test_upsert_writes_nulls_and_keeps_other_columns(rows):
    table = rows([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    out = mutate.upsert(table, rows([(2, None), (3, "c")], "k int, v string"), ["k"], ["v"])
    assert sorted(map(tuple, out.collect())) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]


def test_insert_ignore_is_idempotent(rows):
    table, new = rows([(1, "a")], "k int, v string"), rows([(1, "z"), (2, "q"), (2, "p")], "k int, v string")
    once = mutate.insert_ignore(table, new, ["k"], [F.col("v")])
    twice = mutate.insert_ignore(once, new, ["k"], [F.col("v")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "p")]


def test_first_come_frees_the_keys_of_dropped_rows(rows):
    # 2 falls to 1 by a; 3 shares b with 2 alone, and so stays; 4 falls to 3 by c.
    data = [(1, "a", None), (2, "a", "b"), (3, "c", "b"), (4, "c", "d"), (5, None, None)]
    out = dedup.first_come(rows(data, "n int, x string, y string"), "n", ["x", "y"])
    assert sorted(r.n for r in out.collect()) == [1, 3, 5]


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7), (900, 900)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    out = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: find(x) for x in list(parent)}


def test_breaker_opens_rejects_and_recovers(rows):
    calls = [("p", k, float(at), ok) for k, (at, ok) in enumerate([(0, False), (1, False), (2, True), (40, False), (41, True), (80, True)])]
    frame = rows(calls, "p string, o int, at double, ok boolean")
    r = limits.breaker_states(frame, "p", "at", "o", threshold=2, recovery=30.0).first()
    assert (r.state, r.failures, r.rejected) == ("CLOSED", 0, 2)


def test_split_is_exact_and_stable(spark):
    frame = spark.range(1003).withColumnRenamed("id", "k")
    first, second = split(frame, "k", 70, 20), split(frame.repartition(7), "k", 70, 20)
    assert {r.split: r.n for r in first.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 702, "validation": 200, "test": 101}
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))


def test_search_takes_wildcards_as_they_are(rows):
    frame = rows([("50% off",), ("500 off",), ("a_b",), ("axb",)], "x string")
    assert [r.x for r in frame.where(catalog.containing("50%", "x")).collect()] == ["50% off"]
    assert [r.x for r in frame.where(catalog.containing("A_B", "x")).collect()] == ["a_b"]
