"""Declared tables: empty ones, and old frames brought to a declaration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {
    "core_artists": "id bigint, name string, normalized_name string, country string, region string, artist_type string, musicbrainz_artist_id string",
    "core_albums": "id bigint, artist_id bigint, title string, release_date string, original_release_date string, release_group_mbid string, barcode string",
    "core_recordings": "id bigint, artist_id bigint, album_id bigint, title string, release_date string, original_release_date string, isrc string, musicbrainz_recording_id string, acoustid_id string, track_number int, disc_number int, state string, genre string, subgenre string",
    "core_assets": "asset_id string, recording_id bigint, md5_file string, audio_stream_hash string, duration double, format string, bitrate int, sample_rate int, channels int, file_size bigint",
    "meta_evidence": "id bigint, entity_id bigint, field_name string, value string, evidence_class string, source_id string, run_id string, confidence double, observed_at timestamp, positional_weight double",
    "meta_decisions": "id bigint, run_id string, entity_id bigint, field_name string, old_value string, selected_value string, reason string, applied_at timestamp",
    "meta_locks": "entity_id bigint, field_name string, lock_state string",
    "meta_validation": "recording_id bigint, quality_score double",
    "sys_runs": "run_id string, parser_version string, config_hash string, started_at timestamp, finished_at timestamp",
}


#: Views over the declared tables.
VIEWS = ("vw_recording_overview", "vw_open_issues_queue")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def create_all(spark: SparkSession) -> None:
    """A view of each declared table that the session doesn't have yet."""
    for name in TABLES:
        if not spark.catalog.tableExists(name):
            empty(spark, name).createOrReplaceTempView(name)


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Each declared table that the database doesn't have yet, stored and empty."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def wipe(spark: SparkSession, database: str = "default", inbox: str | None = None, archives: list[str] | None = None) -> int:
    """Drop the declared tables of a database, and the session's views that have their names or read them, and declare them anew.

    With an inbox, the audio files below the archives go back to it, to be taken in again; how many there were is returned. Other
    tables and views stay.
    """
    from tessera.streaming.ingest import restore_files

    restored = restore_files(archives or [], inbox) if inbox else 0
    for name in [*TABLES, *VIEWS]:
        spark.catalog.dropTempView(name)
    for name in VIEWS:
        spark.sql(f"DROP VIEW IF EXISTS {database}.{name}")
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
    create_tables(spark, database)
    return restored


def conform(frame: DataFrame, declared: str, backfill: dict[str, Column] | None = None) -> DataFrame:
    """The frame with the declared columns in their order and types: missing ones are null, narrower ones are cast.

    backfill gives values for columns where they are null or empty. Columns that aren't declared stay at the end.
    A cast that would lose what is there is an error.
    """
    fields = T._parse_datatype_string(declared).fields
    there = {c.lower(): c for c in frame.columns}
    columns = []
    for field in fields:
        value = F.col(there[field.name.lower()]).cast(field.dataType) if field.name.lower() in there else F.lit(None).cast(field.dataType)
        if backfill and field.name in backfill:
            held = F.nullif(value, F.lit("")) if isinstance(field.dataType, T.StringType) else value
            value = F.coalesce(held, backfill[field.name].cast(field.dataType))
        columns.append(value.alias(field.name))
    names = {f.name.lower() for f in fields}
    return frame.select(*columns, *[F.col(c) for c in frame.columns if c.lower() not in names])
