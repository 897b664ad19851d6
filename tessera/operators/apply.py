"""Decisions applied to the catalog: links, collisions, merges, issues, scores; purges and reclassification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import catalog
from tessera.operators.resolve import resolve
from tessera.operators.taxonomy import genre_consensus

ISSUE = ["entity_id", "issue_code", "severity", "status"]


def stable_id(key: Column) -> Column:
    """A number of 60 bits from a text, the same on every run."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def rescored(recordings: DataFrame) -> DataFrame:
    """Recordings with quality_score and state as their columns now give them."""
    score = catalog.quality_score(*map(F.col, ("title", "artist_id", "album_id", "release_date", "isrc", "musicbrainz_recording_id")))
    rows = recordings.withColumn("quality_score", score)
    return rows.withColumn("state", catalog.lifecycle_state(F.col("quality_score"), F.col("isrc"), F.col("musicbrainz_recording_id")))


def apply_decisions(recordings: DataFrame, artists: DataFrame, albums: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """The catalog after decisions (entity_id, field_name, selected_value), one for each entity and field.

    Decisions without a value, and those of unknown entities, are skipped. A code that another recording has, or that an
    entity of a smaller id takes too, is refused and opens an issue. An identifier that several recordings then share merges them
    into the smallest id. Names of artists and albums link to a known row by key, or to a new one.

    recordings: the new rows with quality_score and state; merged: (duplicate, target); opened and resolved: issues;
    applied: the decisions that took effect, with the old value; artists and albums: new rows (id, name) and (id, title, artist_id).
    """
    fields = ["title", "release_date", "original_release_date", "isrc", "musicbrainz_recording_id"]
    known = decisions.where("coalesce(selected_value, '') <> ''").join(recordings.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    codes = known.where("field_name = 'isrc'")
    first = codes.groupBy("selected_value").agg(F.min("entity_id").alias("first"))
    # Two holders are enough to tell whether another than the entity itself has the code.
    held = recordings.where("isrc <> ''").groupBy(F.col("isrc").alias("selected_value")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    clash = (F.col("first") != F.col("entity_id")) | F.coalesce((F.col("low") != F.col("entity_id")) | (F.col("high") != F.col("entity_id")), F.lit(False))
    refused = codes.join(first, "selected_value").join(held, "selected_value", "left").where(clash).select("entity_id", "field_name")
    taken = known.join(refused, ["entity_id", "field_name"], "left_anti")

    wide = taken.groupBy(F.col("entity_id").alias("id")).agg(*[F.max(F.when(F.col("field_name") == f, F.col("selected_value"))).alias(f"new_{f}") for f in [*fields, "artist", "album"]])
    rows = recordings.join(wide, "id", "left")

    keyed = artists.select(text.artist_key(F.col("name")).alias("artist_key"), "id").groupBy("artist_key").agg(F.min("id").alias("known_artist"))
    rows = rows.withColumn("artist_key", F.nullif(text.artist_key(F.col("new_artist")), F.lit(""))).join(keyed, "artist_key", "left")
    linked_artist = F.when(F.col("artist_key").isNotNull(), F.coalesce("known_artist", stable_id(F.col("artist_key"))))
    rows = rows.withColumn("old_artist", F.col("artist_id")).withColumn("artist_id", F.coalesce(linked_artist, F.col("artist_id")))

    titled = albums.select(F.lower("title").alias("album_key"), F.col("artist_id").alias("album_artist"), "id").groupBy("album_key", "album_artist").agg(F.min("id").alias("known_album"))
    rows = rows.withColumn("album_key", F.lower("new_album"))
    rows = rows.join(titled, (rows["album_key"] == titled["album_key"]) & rows["artist_id"].eqNullSafe(titled["album_artist"]), "left").drop(titled["album_key"])
    fresh_album = stable_id(F.concat_ws("|", "album_key", F.coalesce(F.col("artist_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("old_album", F.col("album_id")).withColumn("album_id", F.when(F.col("album_key").isNotNull(), F.coalesce("known_album", fresh_album)).otherwise(F.col("album_id")))

    old_value = F.when(F.col("f") == "artist", F.col("old_artist").cast("string")).when(F.col("f") == "album", F.col("old_album").cast("string"))
    for f in fields:
        old_value = old_value.when(F.col("f") == f, F.col(f))
    new_value = F.coalesce(*[F.when(F.col("f") == f, F.col(f"new_{f}")) for f in [*fields, "artist", "album"]])
    applied = rows.select("*", F.explode(F.array(*map(F.lit, [*fields, "artist", "album"]))).alias("f")).select(F.col("id").alias("entity_id"), F.col("f").alias("field_name"), old_value.alias("old_value"), new_value.alias("selected_value")).where("selected_value IS NOT NULL")
    new_artists = rows.where("artist_key IS NOT NULL AND known_artist IS NULL").groupBy(F.col("artist_id").alias("id")).agg(F.min("new_artist").alias("name"))
    new_albums = rows.where("album_key IS NOT NULL AND known_album IS NULL").groupBy(F.col("album_id").alias("id")).agg(F.min("new_album").alias("title"), F.min("artist_id").alias("artist_id"))

    decided = F.col("new_musicbrainz_recording_id").isNotNull()
    for f in fields:
        rows = rows.withColumn(f, F.coalesce(f"new_{f}", f))
    shared = rows.where("musicbrainz_recording_id <> ''").groupBy("musicbrainz_recording_id").agg(F.min("id").alias("target"), F.max(decided).alias("decided")).where("decided").drop("decided")
    rows = rows.join(shared, "musicbrainz_recording_id", "left")
    merged = rows.where("target <> id").select(F.col("id").alias("duplicate"), "target")
    result = rescored(rows.where("target IS NULL OR target = id").select(*[c for c in recordings.columns if c != "state"]))

    opened = refused.select("entity_id", F.lit("DUPLICATE_IDENTIFIER_COLLISION").alias("issue_code"), F.lit("WARNING").alias("severity"), F.lit("OPEN").alias("status"))
    code = F.when(F.col("field_name") == "isrc", "MISSING_ISRC").when(F.col("field_name") == "musicbrainz_recording_id", "MISSING_MBID")
    resolved = taken.select("entity_id", code.alias("issue_code")).where("issue_code IS NOT NULL").distinct()
    return {"recordings": result, "merged": merged, "opened": opened, "resolved": resolved, "applied": applied, "artists": new_artists, "albums": new_albums}


def settle_issues(issues: DataFrame, resolved: DataFrame, opened: DataFrame) -> DataFrame:
    """Issues with the open ones among resolved (entity_id, issue_code) closed, and those of opened added that aren't open."""
    hit = resolved.select("entity_id", "issue_code").distinct().withColumn("hit", F.lit(True))
    rows = issues.select(*ISSUE).join(hit, ["entity_id", "issue_code"], "left")
    rows = rows.withColumn("status", F.when((F.col("status") == "OPEN") & F.col("hit"), "RESOLVED").otherwise(F.col("status"))).select(*ISSUE)
    fresh = opened.select(*ISSUE).dropDuplicates(["entity_id", "issue_code"]).join(rows.where("status = 'OPEN'"), ["entity_id", "issue_code"], "left_anti")
    return rows.unionByName(fresh.select(*ISSUE))


def purge_codes(recordings: DataFrame, evidence: DataFrame, locks: DataFrame, issues: DataFrame) -> dict[str, DataFrame]:
    """The catalog without malformed recording codes among the facts.

    The field of each entity that had one is resolved anew from what is left: decisions. Its recording takes the choice, or
    none where no fact is left, and is scored again: recordings (the touched ones). Issues about its syntax close, and
    a missing code is closed or opened.
    """
    facts = evidence.where("field_name = 'isrc'")
    bad = text.normal_isrc(F.coalesce("value", F.lit(""))) == ""
    touched = facts.where(bad).select("entity_id", "field_name").distinct()
    left = facts.where(~bad).join(touched, ["entity_id", "field_name"], "left_semi")
    current = recordings.select(F.col("id").alias("entity_id"), F.lit("isrc").alias("field_name"), F.col("isrc").alias("value")).join(touched, ["entity_id", "field_name"], "left_semi")
    decisions = resolve(left, locks, current, targets=touched)
    some = left.select("entity_id").distinct().withColumn("some", F.lit(True))
    chosen = decisions.join(some, "entity_id", "left").select(F.col("entity_id").alias("id"), F.when(F.col("some"), F.nullif("selected_value", F.lit(""))).alias("code"))
    rows = rescored(recordings.join(chosen, "id").withColumn("isrc", F.col("code")).drop("code"))
    with_code = chosen.select(F.col("id").alias("entity_id"), F.col("code").isNotNull().alias("has"))
    resolved = touched.select("entity_id", F.lit("INVALID_ISRC_SYNTAX").alias("issue_code")).unionByName(with_code.where("has").select("entity_id", F.lit("MISSING_ISRC").alias("issue_code")))
    opened = with_code.where("NOT has").select("entity_id", F.lit("MISSING_ISRC").alias("issue_code"), F.lit("WARNING").alias("severity"), F.lit("OPEN").alias("status"))
    return {"evidence": evidence.where((F.col("field_name") != "isrc") | ~bad), "decisions": decisions, "recordings": rows, "issues": settle_issues(issues, resolved, opened)}


def reclassify(recordings: DataFrame, evidence: DataFrame, locks: DataFrame, artists: DataFrame, validation: DataFrame) -> DataFrame:
    """Recordings with genre and subgenre by consensus of their tags, scored again: those without a lock on either that have tags.

    The others stay as they are, state and the score that validation (recording_id, quality_score) has of them included.
    """
    locked = locks.where("field_name IN ('genre', 'subgenre')").select(F.col("entity_id").alias("id"))
    tags = evidence.where("field_name IN ('genre', 'subgenre') AND value <> ''").select("entity_id", F.col("id").alias("seq"), F.col("value").alias("tag"), F.col("confidence").alias("weight"), F.col("source_id").alias("source"))
    free = recordings.select("id", "artist_id").join(locked, "id", "left_anti").join(tags.select(F.col("entity_id").alias("id")), "id", "left_semi")
    names = artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist"))
    judged = genre_consensus(tags, free.join(names, "artist_id", "left").select(F.col("id").alias("entity_id"), "artist"))
    new = judged.select(F.col("entity_id").alias("id"), F.col("genre").alias("new_genre"), F.col("subgenre").alias("new_subgenre"), F.lit(True).alias("judged"))
    rows = recordings.join(new, "id", "left")
    for f in ("genre", "subgenre"):
        rows = rows.withColumn(f, F.when(F.col("judged"), F.col(f"new_{f}")).otherwise(F.col(f)))
    old = validation.select(F.col("recording_id").alias("id"), F.col("quality_score").alias("old_score"))
    rows = rescored(rows.withColumn("old_state", F.col("state"))).join(old, "id", "left")
    for f in ("score", "state"):
        new = "quality_score" if f == "score" else f
        rows = rows.withColumn(new, F.when(F.col("judged"), F.col(new)).otherwise(F.col(f"old_{f}")))
    return rows.select(*recordings.columns, *[c for c in ("quality_score",) if c not in recordings.columns])
