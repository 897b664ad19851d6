"""A step of the crawler sends its few seeds to the answers; answers, frontier and known candidates grow and are not sent whole."""

from tessera.plans import registry


def test_growing_sides_are_not_broadcast(spark, small):
    plan = registry.queries()["ss03_crawl_candidates"](spark, small)._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in sent if any(f"[{key}#" in line for key in ("seed_id", "candidate_id", "kt", "rid"))]
    asked = [line for line in sent if "[key#" in line]
    assert len(asked) == 3 and all("BuildLeft" in line for line in asked)
