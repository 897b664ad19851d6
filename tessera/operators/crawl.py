"""The crawl frontier: seeds, states, and one batch of harvest, pop, expansion, admission and cooldown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.operators import discovery
from tessera.operators.graph import cut
from tessera.sources import payloads

FRONTIER = "seed_id string, entity_name string, priority double, state string, created_seq long"


def local_seeds(artists: DataFrame, recordings: DataFrame, validation: DataFrame) -> DataFrame:
    """(seed_id, entity_name): artists with an identifier and three recordings or more of quality 0.80 and up."""
    good = validation.where("quality_score >= 0.80").select(F.col("recording_id").alias("rid")).hint("merge")  # grows with the catalog
    tracks = recordings.select(F.col("id").alias("rid"), F.col("artist_id").alias("id")).join(good, "rid")
    counted = artists.where("musicbrainz_artist_id IS NOT NULL").join(tracks.hint("merge"), "id").groupBy(F.col("musicbrainz_artist_id").alias("seed_id"), F.col("name").alias("entity_name")).agg(F.count("*").alias("n"))
    return counted.where("n >= 3").groupBy("seed_id").agg(F.min("entity_name").alias("entity_name"))


def _added(frontier: DataFrame, seeds: DataFrame, priority: float) -> DataFrame:
    """The frontier with the seeds that it lacks, waiting, behind those that are there."""
    last = frontier.agg(F.coalesce(F.max("created_seq"), F.lit(0)).alias("last"))
    fresh = seeds.join(frontier.select("seed_id").hint("merge"), "seed_id", "left_anti").crossJoin(F.broadcast(last))  # one row
    return frontier.select("seed_id", "entity_name", "priority", "state", "created_seq").unionByName(fresh.select("seed_id", "entity_name", F.lit(priority).alias("priority"), F.lit("PENDING").alias("state"), (F.col("last") + 1).cast("long").alias("created_seq")))


def harvest(frontier: DataFrame, artists: DataFrame, recordings: DataFrame, validation: DataFrame) -> DataFrame:
    """The frontier with stuck seeds waiting again and local seeds added.

    If nothing waits then, every artist with an identifier is added; if there is none, five fixed seeds.
    """
    stuck = frontier.withColumn("state", F.when(F.col("state") == "ACTIVE", "PENDING").otherwise(F.col("state"))).withColumn("seed_id", F.col("seed_id").cast("string")).withColumn("created_seq", F.col("created_seq").cast("long"))
    rows = _added(stuck, local_seeds(artists, recordings, validation), 1.0)
    if not rows.where("state IN ('PENDING', 'ACTIVE')").limit(1).isEmpty():
        return rows
    every = artists.where("musicbrainz_artist_id <> ''").groupBy(F.col("musicbrainz_artist_id").alias("seed_id")).agg(F.min("name").alias("entity_name"))
    if every.limit(1).isEmpty():
        every = frontier.sparkSession.createDataFrame(list(fixed.FIRST_SEEDS.items()), "seed_id string, entity_name string")
    return _added(rows, every, 1.0)


def starters(candidates: DataFrame) -> DataFrame:
    """(candidate_id, title, artist_name, primary_genre, primary_subgenre, state, final_ccs) to add while fewer than ten candidates wait."""
    from tessera.functions.text import candidate_id

    spark = candidates.sparkSession
    rows = spark.createDataFrame(fixed.STARTERS, "title string, artist_name string, primary_genre string, primary_subgenre string")
    rows = rows.select(candidate_id(F.col("title"), F.col("artist_name")).alias("candidate_id"), "title", "artist_name", "primary_genre", "primary_subgenre", F.lit("QUEUED").alias("state"), F.lit(0.85).alias("final_ccs"))
    few = candidates.where("state IN ('NEW', 'QUEUED')").agg((F.count("*") < 10).alias("few")).where("few")
    return rows.join(candidates.select("candidate_id"), "candidate_id", "left_anti").crossJoin(F.broadcast(few)).drop("few")  # one row or none


def pop(frontier: DataFrame, n: int = 1) -> DataFrame:
    """The n waiting seeds next in line, as they stand."""
    return frontier.where("state = 'PENDING'").orderBy(F.desc("priority"), "created_seq", "seed_id").limit(n)


def mark(frontier: DataFrame, seeds: DataFrame) -> DataFrame:
    """The frontier with the states of seeds (seed_id, new_state)."""
    return frontier.join(seeds.select("seed_id", "new_state"), "seed_id", "left").withColumn("state", F.coalesce("new_state", "state")).drop("new_state").select(*frontier.columns)


def crawl_batch(frontier: DataFrame, answers: dict[str, DataFrame], known: DataFrame, owned: DataFrame, affinity: DataFrame, n: int = 1, target: str | None = None) -> dict[str, DataFrame]:
    """One step of the crawler over a harvested frontier: the next n seeds are expanded from stored answers, candidates admitted, seeds cooled down.

    answers, each (key, body): artist_search for seeds ``name:...`` (key the seed), discography, genre_network and similar by seed,
    albums by (name, body). A name that finds no identifier fails; one that does is replaced by it, of priority 1.5.
    frontier: the new frontier; candidates: the admitted; seeds: (seed_id, crawled_id, accepted found candidates) of this step.
    """
    # The step's seeds are n rows, found once and sent to the answers; answers and frontier grow and are never sent whole.
    seeds = cut(pop(frontier, n).select("seed_id", "entity_name"))
    by_name = seeds.where("seed_id LIKE 'name:%'").join(payloads.artist_ids(answers["artist_search"]).select(F.col("key").alias("seed_id"), "mbid").hint("merge"), "seed_id", "left")
    crawled = seeds.where("seed_id NOT LIKE 'name:%'").withColumn("mbid", F.col("seed_id")).unionByName(by_name).withColumn("ok", F.col("mbid").isNotNull())
    ok = F.broadcast(crawled.where("ok").select(F.col("mbid").alias("key"), "entity_name").distinct())
    found = payloads.discography(ok.join(answers["discography"], "key"))
    found = found.unionByName(payloads.genre_network(ok.join(answers["genre_network"], "key")))
    named = F.broadcast(ok.select(F.col("entity_name").alias("key")).distinct())
    found = found.unionByName(payloads.similar_albums(payloads.similar_artists(named.join(answers["similar"], "key")), answers["albums"])).drop("key")
    first = found.groupBy("title", "artist_name").agg(F.min_by("genre", F.struct("genre", "mbid")).alias("genre"), F.min("mbid").alias("mbid"))
    admitted = discovery.admit(first, known, owned, affinity, target)
    done = crawled.where("seed_id NOT LIKE 'name:%' OR NOT ok").select("seed_id", F.when(F.col("ok"), "COOLDOWN").otherwise("FAILED").alias("new_state"))
    renamed = crawled.where("seed_id LIKE 'name:%' AND ok")
    rest = mark(frontier, done).join(renamed.select("seed_id"), "seed_id", "left_anti")
    ids = renamed.groupBy(F.col("mbid").alias("seed_id")).agg(F.min("entity_name").alias("new_name"))
    rest = rest.join(ids, "seed_id", "left").withColumn("state", F.when(F.col("new_name").isNotNull(), "COOLDOWN").otherwise(F.col("state"))).drop("new_name")
    fresh = ids.join(frontier.select("seed_id").hint("merge"), "seed_id", "left_anti").select("seed_id", F.col("new_name").alias("entity_name"), F.lit(1.5).alias("priority"), F.lit("COOLDOWN").alias("state"), F.lit(None).cast("long").alias("created_seq"))
    return {"frontier": rest.select("seed_id", "entity_name", "priority", "state", "created_seq").unionByName(fresh), "candidates": admitted, "seeds": crawled.select("seed_id", F.col("mbid").alias("crawled_id"), "ok")}
