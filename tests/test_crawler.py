"""The crawler's loop against the same steps one after the other, with a stop in between and a step cut short."""

import json
import time

import pytest

from tessera.operators import crawl
from tessera.streaming import crawler

FRONTIER = "seed_id string, entity_name string, priority double, state string, created_seq long"


@pytest.fixture
def step(rows):
    ids = [f"{k:036d}" for k in range(5)]
    answer = lambda k: json.dumps({"release-groups": [{"id": f"g{k}", "title": f"First {k}"}, {"id": f"h{k}", "title": "Shared"}]})
    said = {
        "artist_search": rows([("name:New", json.dumps({"artists": [{"id": "id of new"}]}))], "key string, body string"),
        "discography": rows([(i, answer(k)) for k, i in enumerate(ids)], "key string, body string"),
        "genre_network": rows([], "key string, body string"),
        "similar": rows([], "key string, body string"),
        "albums": rows([], "name string, body string"),
    }
    none, likes = rows([], "candidate_id string"), rows([("rock", 0.9)], "genre string, score double")
    owned = rows([("x", "y")], "kt string, ka string")

    def take(frontier, candidates):
        known = none if candidates is None else candidates.select("candidate_id")
        return crawl.crawl_batch(frontier, said, known, owned, likes, n=1)

    take.start = rows([(i, f"Artist {k % 3}", 1.0 - k / 10, "PENDING", k) for k, i in enumerate(ids)] + [("name:New", "New", 0.95, "PENDING", 9)], FRONTIER)
    return take


def frontier_of(frame):
    return sorted(map(tuple, frame.select("seed_id", "entity_name", "priority", "state").collect()))


def test_the_loop_takes_the_steps_one_by_one(spark, step, tmp_path):
    want, frontier, found = [frontier_of(step.start)], step.start, None
    for _ in range(4):
        made = step(frontier, found)
        frontier = spark.createDataFrame(made["frontier"].collect(), FRONTIER)
        new = spark.createDataFrame(made["candidates"].collect(), made["candidates"].schema)
        found = new if found is None else found.unionByName(new)
        want.append(frontier_of(frontier))
    held = crawler.Frontier(spark, f"{tmp_path}/crawl")

    def run_until(version):
        query = crawler.crawl(step.start, step, f"{tmp_path}/crawl", f"{tmp_path}/mark", throttle=0.1, kept=100)
        end = time.time() + 120
        while not held.has(version) and time.time() < end and query.isActive:
            time.sleep(0.05)
        query.stop()

    run_until(2)
    # A step that was cut short: candidates are there, the frontier isn't marked.
    last = crawler._versions(spark, f"{tmp_path}/crawl")[-1]
    step(held.read(last), held.candidates(last))["candidates"].write.mode("overwrite").parquet(f"{tmp_path}/crawl/candidates/version={last + 1}")
    run_until(4)
    assert [frontier_of(held.read(v)) for v in range(5)] == want
    names = lambda frame: sorted((r.title, r.artist_name) for r in frame.collect())
    assert names(held.candidates(4)) == names(found) and found.count() > 3


def test_steps_are_taken_once_and_old_versions_go(spark, step, tmp_path):
    held = crawler.Frontier(spark, f"{tmp_path}/crawl")
    held.write(0, step.start)
    for number in (0, 0, 1, 1):
        held.take(number, step, kept=2)
    assert crawler._versions(spark, f"{tmp_path}/crawl") == [1, 2]
    with pytest.raises(ValueError, match="version 7"):
        held.take(7, step)
