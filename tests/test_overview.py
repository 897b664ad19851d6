"""The overview's joins: files find their places before the wide rows of recordings come in."""

from tessera.plans.scans import overview
from tessera.sources.fixtures import Catalog


def test_places_are_joined_to_narrow_files(spark, small):
    frame = overview(Catalog(spark, small))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line and "n_nationkey" not in line and "n_regionkey" not in line]
    assert "asset_id" in joins[-1] and not any("asset_id" in line for line in joins[:-1])
