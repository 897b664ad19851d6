"""Views of the catalog: overview, issue queue, search, pages, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overview(recordings: DataFrame, artists: DataFrame, albums: DataFrame, assets: DataFrame, locations: DataFrame, validation: DataFrame) -> DataFrame:
    """A row for each recording, asset and available location; missing names and scores have defaults."""
    a = artists.select(F.col("id").alias("artist_id"), F.col("name").alias("a_name"))
    b = albums.select(F.col("id").alias("album_id"), F.col("title").alias("b_title"), F.col("original_release_date").alias("b_date"))
    f = assets.select(F.col("recording_id").alias("id"), "asset_id", "duration", "bitrate", "sample_rate", "channels", "format")
    # The condition on the right side goes before the outer join, so rows without a location stay.
    where = locations.where("is_available = 1").select("asset_id", "filepath")
    v = validation.select(F.col("recording_id").alias("id"), "quality_score")
    # Files find their places while they are narrow; the wide rows of recordings move once by their id.
    placed = f.join(where, "asset_id", "left").drop("asset_id")
    joined = recordings.join(a, "artist_id", "left").join(b, "album_id", "left").join(v, "id", "left").join(placed, "id", "left")
    return joined.select(
        "id",
        "title",
        F.coalesce("a_name", F.lit("Unknown Artist")).alias("artist_name"),
        F.coalesce("b_title", F.lit("Unknown Album")).alias("album_title"),
        F.col("release_date").alias("issue_release_date"),
        F.coalesce("b_date", "original_release_date", "release_date").alias("original_release_date"),
        "duration", "bitrate", "sample_rate", "channels", "format", "filepath", "isrc", "musicbrainz_recording_id", "acoustid_id", "state",
        F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"),
        F.coalesce("genre", F.lit("Unclassified")).alias("primary_genre"),
        F.coalesce("subgenre", F.lit("Unclassified")).alias("primary_subgenre"),
    )


def open_issues(issues: DataFrame, recordings: DataFrame) -> DataFrame:
    titles = recordings.select(F.col("id").alias("entity_id"), "title")
    return issues.where("status = 'OPEN'").join(titles, "entity_id", "left").select("id", "entity_id", F.coalesce("title", F.lit("Untitled Work")).alias("recording_title"), "issue_code", "severity", "status", "created_at")


def containing(text: str, *columns: str) -> Column:
    """Any of the columns holds the text, letter case aside."""
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in columns])


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that are set."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def page(rows: DataFrame, order: list[Column], number: int, size: int = 100) -> DataFrame:
    """Page ``number`` (from 0) of the ordered rows."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def quality_score(title: Column, artist_id: Column, album_id: Column, date: Column, isrc: Column, mbid: Column) -> Column:
    """Weighted presence of six parts; a file name for a title counts little."""
    from tessera.functions.fixed import AUDIO_SUFFIXES

    has = lambda c: c.isNotNull() & (c.cast("string") != "")
    file_name = reduce(lambda a, b: a | b, [F.lower(title).endswith(s) for s in AUDIO_SUFFIXES])
    # Summed in hundredths, so that every engine rounds alike.
    points = [
        F.when(has(title) & (F.trim(title) != "") & ~file_name, 20).when(has(title), 5),
        F.when(has(artist_id), 25),
        F.when(has(album_id), 20),
        F.when(has(date), 15),
        F.when(has(isrc) & (isrc != "NONE"), 10),
        F.when(has(mbid), 10),
    ]
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in points]) / 100


def lifecycle_state(score: Column, isrc: Column, mbid: Column) -> Column:
    has = lambda c: c.isNotNull() & (c != "")
    return F.when((score >= 1.0) & has(isrc) & has(mbid), "COMPLETE").when(score >= 0.80, "ENRICHED").when(has(mbid) | has(isrc), "IDENTIFIED").otherwise("PARSED")
