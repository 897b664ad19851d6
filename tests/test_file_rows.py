"""Files are dealt evenly before they are parsed, and what follows from a parsed file is worked out within its row."""

import random

from pyspark.sql import functions as F

from tessera.operators.taxonomy import genre_consensus, row_consensus
from tessera.plans.upkeep import parsed_files
from tessera.sources import media
from tessera.sources.fixtures import Catalog


def test_files_are_dealt_evenly(spark, small):
    files = Catalog(spark, small).media_files
    plan = files._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line and "n_nationkey" not in line and "n_regionkey" not in line]
    assert "Inner" in joins[0] and "LeftOuter" in joins[1] and len(joins) == 2  # names meet recordings before files do
    counts = [r["count"] for r in files.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) >= 4 * spark.sparkContext.defaultParallelism and max(counts) < 2 * sum(counts) / len(counts)


def test_skipped_columns_are_null_and_the_others_stay(spark, small):
    t = Catalog(spark, small)
    files = t.media_files.limit(40).localCheckpoint()
    whole, part = media.parse_media(files), media.parse_media(files, ("payload", "sha256_file", "duration"))
    rest = [c for c in whole.columns if c not in ("payload", "sha256_file", "duration")]
    key = lambda r: str(r)
    assert sorted(whole.select(*rest).collect(), key=key) == sorted(part.select(*rest).collect(), key=key)
    assert part.where("payload IS NOT NULL OR sha256_file IS NOT NULL OR duration IS NOT NULL").isEmpty()


def test_facts_are_made_within_a_file(spark, small):
    made = media.fan_out(parsed_files(Catalog(spark, small)).localCheckpoint())
    for name in ("recordings", "assets", "locations", "validation", "evidence"):
        plan = made[name]._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan, name


def test_consensus_within_a_row_is_that_of_groups(rows):
    dice = random.Random(5)
    words = ["Rock", "rock", "ROCK", "post rock", "Post-Rock", "free  jazz", "x", "77", "unclassified", "Unclassified", "IDM", " idm "]
    sources = ["SRC_EMBEDDED_TAGS", "SRC_USER", "SRC_OTHER"]
    entities = {k: [(f"genre{n:05d}", dice.choice(words), dice.choice([1.0, 0.75, 0.5625]), dice.choice(sources)) for n in range(dice.randrange(7))] for k in range(300)}
    artists = rows([(k, dice.choice(["The Strokes", "Nobody", None, "Black Sabbath"])) for k in entities], "entity_id int, artist string")
    tags = rows([(k, *tag) for k, found in entities.items() for tag in found], "entity_id int, seq string, tag string, weight double, source string")
    listed = rows(list(entities.items()), "entity_id int, listed array<struct<seq:string,tag:string,weight:double,source:string>>")
    one = {tuple(r) for r in genre_consensus(tags, artists).collect()}
    two = {tuple(r) for r in row_consensus(listed.join(artists, "entity_id")).select("entity_id", "genre", "subgenre", "confidence").collect()}
    assert one == two and len(one) == 300
