"""Queries over upkeep: cluster facts, frontier, timelines, tracklists, dashboards' histograms, runs, ingestion, schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exact, text
from tessera.operators import crawl, ledger
from tessera.operators.graph import shared_folder, stored
from tessera.plans import duck
from tessera.plans.domain import GENRES, cluster_match
from tessera.plans.registry import catalog_query as q
from tessera.plans.scans import overview, scoped
from tessera.plans.totals import assets, histogram
from tessera.sources import files, media, schema
from tessera.sources.fixtures import Catalog
from tessera.streaming import store

# Functions and sources

_ALPHABET = text.CROCKFORD
_BITS = f"(SELECT p_partkey, 1700000000000 + p_partkey AS ms, md5(p_name || p_partkey) AS m FROM part)"
_CHARS = "list_aggregate(list_transform(range({n} - 1, -1, -1), lambda i: substr('" + _ALPHABET + "', CAST((({v}) >> CAST(5 * i AS BIGINT)) & 31 AS INT) + 1, 1)), 'string_agg', '')"
q("fn31_stable_ulid", f"SELECT p_partkey, {_CHARS.format(n=10, v='ms')} || {_CHARS.format(n=8, v="('0x' || substr(m, 1, 10))::BIGINT")} || {_CHARS.format(n=8, v="('0x' || substr(m, 11, 10))::BIGINT")} AS ulid FROM {_BITS} x")(
    lambda t: t.part.select("p_partkey", text.stable_ulid(F.col("p_partkey") + 1_700_000_000_000, F.concat("p_name", "p_partkey")).alias("ulid"))
)
q("src01_table_scan", "SELECT p_partkey, p_name FROM part")(lambda t: files.read_table(t.spark, f"{t.sf_dir}/part.parquet", schema="p_partkey bigint, p_name string"))
_OUT = "CASE WHEN p_partkey % 5 = 0 THEN 'no output' ELSE 'DURATION=' || p_size || chr(10) || 'FINGERPRINT=' || CASE WHEN p_partkey % 3 = 0 THEN 'short' ELSE p_name || '=' || p_brand END END"
q("src07_fingerprints", "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS duration, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 THEN p_name || '=' || p_brand END AS fingerprint FROM part")(
    lambda t: files.parsed_fingerprints(t.part.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "no output").otherwise(F.concat(F.lit("DURATION="), F.col("p_size").cast("string"), F.lit("\nFINGERPRINT="), F.when(F.col("p_partkey") % 3 == 0, "short").otherwise(F.concat("p_name", F.lit("="), "p_brand")))).alias("output"))).drop("output")
)
def taken_in(t: Catalog) -> DataFrame:
    """Figures of a batch of assets, seen while it is written."""
    rows = t.core_assets.select("asset_id", "format", "file_size")
    watched, seen = ledger.observed(rows, "assets", without_format=F.count_if(F.col("format").isNull()), bytes=F.sum("file_size"), largest=F.max("file_size"))
    watched.write.format("noop").mode("overwrite").save()
    return ledger.batch_figures(t.spark, [seen])


q("ss07_observed_batch", "SELECT 'assets' AS batch, unnest(['rows', 'without_format', 'bytes', 'largest']) AS metric, unnest([n, m, b, l]) AS n FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE format IS NULL) AS DOUBLE) AS m, CAST(sum(file_size) AS DOUBLE) AS b, CAST(max(file_size) AS DOUBLE) AS l FROM core_assets) x")(taken_in)
q("ss07_progress", "SELECT run_id, done, round(done / 0.5, 1) AS tps, CASE WHEN done = 0 THEN 0.0 ELSE round((total - done) / (done / 0.5), 3) END AS eta, CASE WHEN done > 0 AND total > done THEN CAST(CAST(floor((total - done) / (done / 0.5)) AS BIGINT) AS VARCHAR) || 's left' ELSE 'Finishing...' END AS finish, CAST(floor(done / total * 100) AS INT) AS stage_pct, CAST(floor(floor(done / total * 100) / 2) AS INT) AS total_pct FROM (SELECT CAST(s_suppkey AS VARCHAR) AS run_id, s_suppkey % 51 AS done, 50 AS total FROM supplier) x")(
    lambda t: ledger.progress(t.supplier.select(F.col("s_suppkey").cast("string").alias("run_id"), (F.col("s_suppkey") % 51).alias("done"), F.lit(50).alias("total"), F.lit(0.5).alias("seconds")))
)

# Facts of an album's official tracklist


def official(t: Catalog) -> tuple[DataFrame, DataFrame]:
    """Four official tracks and three tags for each album."""
    track = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("position")
    tracks = t.core_albums.select(F.col("id").alias("album_id"), track).withColumn("mbid", F.md5(F.concat(F.lit("official"), "album_id", "position").cast("binary"))).withColumn("isrc", F.when(F.col("position") % 2 == 1, F.concat(F.lit("USABC"), F.lpad((F.col("album_id") % 10_000_000).cast("string"), 7, "0"))))
    tags = t.core_albums.select(F.col("id").alias("album_id"), F.col("release_date").alias("first_date"), F.posexplode(F.array(F.lit("Post-Rock"), F.lit(" "), F.concat(F.lit("Style_"), (F.col("id") % 7).cast("string")))).alias("n", "tag"))
    return tracks, tags


def cluster_facts(t: Catalog) -> DataFrame:
    """Facts that an album's official list gives its tracks: tags that weigh 0.75 less from one to the next, its first date, and for a matched track identifier and code."""
    tracks, tags = official(t)
    own = t.core_recordings.select(F.col("id").alias("entity_id"), "album_id")
    weight = F.round(F.pow(F.lit(0.75), F.col("n")), 4)
    tagged = own.join(tags, "album_id").select("entity_id", F.lit("genre").alias("field_name"), exact.tag_alias("tag").alias("value"), (0.80 * weight).alias("confidence"), F.col("n").alias("token_index")).where("value <> ''")
    fact = lambda rows, field, value, confidence: rows.where(F.coalesce(F.col(value), F.lit("")) != "").select("entity_id", F.lit(field).alias("field_name"), F.col(value).alias("value"), F.lit(confidence).alias("confidence"), F.lit(0).alias("token_index"))
    dated = fact(own.join(tags.where("n = 0").select("album_id", "first_date"), "album_id"), "original_release_date", "first_date", 0.99)
    best = cluster_match(t).select(F.col("id").alias("entity_id"), "position").join(own, "entity_id").join(tracks, ["album_id", "position"])
    return tagged.unionByName(dated).unionByName(fact(best, "musicbrainz_recording_id", "mbid", 0.98)).unionByName(fact(best, "isrc", "isrc", 0.99))


q("dm17_cluster_facts")(cluster_facts)

# Frontier

_LOCAL = "SELECT a.musicbrainz_artist_id AS seed_id, min(a.name) AS entity_name FROM core_artists a JOIN core_recordings r ON r.artist_id = a.id JOIN meta_validation v ON v.recording_id = r.id WHERE a.musicbrainz_artist_id IS NOT NULL AND v.quality_score >= 0.80 GROUP BY a.id, a.musicbrainz_artist_id HAVING count(*) >= 3"
_OLD = "SELECT CAST(seed_id AS VARCHAR) AS seed_id, entity_name, priority, CASE state WHEN 'ACTIVE' THEN 'PENDING' ELSE state END AS state FROM sys_crawl_frontier"
q("dm25_seed_harvest", f"SELECT * FROM ({_OLD}) o UNION ALL SELECT seed_id, entity_name, 1.0, 'PENDING' FROM ({_LOCAL}) l WHERE seed_id NOT IN (SELECT CAST(seed_id AS VARCHAR) FROM sys_crawl_frontier)")(lambda t: crawl.harvest(t.sys_crawl_frontier, t.core_artists, t.core_recordings, t.meta_validation).drop("created_seq"))
q("dm25_idle_frontier", "SELECT musicbrainz_artist_id AS seed_id, min(name) AS entity_name, CAST(1.0 AS DOUBLE) AS priority, 'PENDING' AS state FROM core_artists WHERE musicbrainz_artist_id <> '' GROUP BY 1")(
    # Nothing waits and nobody has three good tracks: every artist with an identifier is a seed.
    lambda t: crawl.harvest(t.sys_crawl_frontier.where("false"), t.core_artists, t.core_recordings, t.meta_validation.where("false")).drop("created_seq")
)


def states(t: Catalog) -> DataFrame:
    """The frontier after a pop, with what became of the seeds that were active: done where they have a supplier of an even nation, else failed."""
    frontier = t.sys_crawl_frontier
    active = frontier.where("state = 'ACTIVE'").join(t.supplier.select(F.col("s_suppkey").alias("seed_id"), "s_nationkey"), "seed_id")
    ended = active.select("seed_id", F.when(F.col("s_nationkey") % 2 == 0, "COOLDOWN").otherwise("FAILED").alias("new_state"))
    return crawl.mark(crawl.mark(frontier, ended), crawl.pop(frontier, 3).select("seed_id", F.lit("ACTIVE").alias("new_state"))).select("seed_id", "state")


q("dm26_frontier_states", "SELECT seed_id, CASE WHEN state = 'ACTIVE' THEN CASE WHEN (SELECT s_nationkey FROM supplier WHERE s_suppkey = seed_id) % 2 = 0 THEN 'COOLDOWN' ELSE 'FAILED' END WHEN seed_id IN (SELECT seed_id FROM sys_crawl_frontier WHERE state = 'PENDING' ORDER BY priority DESC, created_seq, seed_id LIMIT 3) THEN 'ACTIVE' ELSE state END AS state FROM sys_crawl_frontier")(states)

# Views of one thing


def timeline(t: Catalog, entity: int) -> DataFrame:
    """Decisions and facts of an entity, newest first; a fact is the winning one where it is what the catalog shows."""
    shown = overview(t).where(F.col("id") == entity).select(
        F.explode(F.create_map(*[x for f, c in (("title", "title"), ("artist", "artist_name"), ("album", "album_title"), ("genre", "primary_genre"), ("subgenre", "primary_subgenre"), ("release_date", "issue_release_date"), ("original_release_date", "original_release_date"), ("isrc", "isrc"), ("musicbrainz_recording_id", "musicbrainz_recording_id")) for x in (F.lit(f), F.col(c))])).alias("field_name", "shown")
    ).distinct()
    facts = t.meta_evidence.where(F.col("entity_id") == entity).join(shown, "field_name", "left")
    same = F.lower(F.trim("value")) == F.lower(F.trim("shown"))
    badge = F.when(same & (F.trim("value") != ""), "WINNING FACT").otherwise("SUPERSEDED")
    rows = facts.select(F.lit("fact").alias("kind"), "id", "field_name", "value", F.col("source_id").alias("source"), badge.alias("status"), F.col("observed_at").alias("at"))
    decided = t.meta_decisions.where(F.col("entity_id") == entity).select(F.lit("decision").alias("kind"), "id", "field_name", F.col("selected_value").alias("value"), F.lit(None).cast("string").alias("source"), F.col("old_value").alias("status"), F.col("applied_at").alias("at"))
    return decided.unionByName(rows).orderBy("kind", F.desc("at"), F.desc("id"))


_SHOWN = "(SELECT DISTINCT f AS field_name, v AS shown FROM (SELECT unnest(['title', 'artist', 'album', 'genre', 'subgenre', 'release_date', 'original_release_date', 'isrc', 'musicbrainz_recording_id']) AS f, unnest([title, artist_name, album_title, primary_genre, primary_subgenre, issue_release_date, original_release_date, isrc, musicbrainz_recording_id]) AS v FROM vw_recording_overview WHERE id = 5) o)"
q("dm30_provenance", f"SELECT 'decision' AS kind, id, field_name, selected_value AS value, CAST(NULL AS VARCHAR) AS source, old_value AS status, applied_at AS at FROM meta_decisions WHERE entity_id = 5 UNION ALL SELECT 'fact', e.id, e.field_name, e.value, e.source_id, CASE WHEN lower(trim(e.value)) = lower(trim(s.shown)) AND trim(e.value) <> '' THEN 'WINNING FACT' ELSE 'SUPERSEDED' END, observed_at FROM meta_evidence e LEFT JOIN {_SHOWN} s ON s.field_name = e.field_name WHERE e.entity_id = 5")(lambda t: timeline(t, 5))


def tracklists(t: Catalog) -> DataFrame:
    """Every album's tracks in order: by disc, track (unnumbered last), title and id."""
    order = Window.partitionBy("album_id").orderBy("disc_number", F.coalesce("track_number", F.lit(999)), "title", "id")
    return t.core_recordings.where("album_id IS NOT NULL").select("album_id", F.row_number().over(order).alias("place"), "id", "title")


q("dm34_tracklists", "SELECT album_id, row_number() OVER (PARTITION BY album_id ORDER BY disc_number, coalesce(track_number, 999), title, id) AS place, id, title FROM core_recordings WHERE album_id IS NOT NULL")(tracklists)
q("dm34_artist_tracks", "SELECT r.id, r.title, coalesce(b.title, 'Unknown Album') AS album, r.release_date, coalesce(v.quality_score, 0.0) AS quality_score FROM core_recordings r LEFT JOIN core_albums b ON r.album_id = b.id LEFT JOIN meta_validation v ON v.recording_id = r.id WHERE r.artist_id = 44")(
    lambda t: scoped(t, False).where("artist_id = 44").join(t.core_albums.select(F.col("id").alias("album_id"), F.col("title").alias("b")), "album_id", "left").select("id", "title", F.coalesce("b", F.lit("Unknown Album")).alias("album"), "release_date", F.coalesce("quality_score", F.lit(0.0)).alias("quality_score")).orderBy("release_date", "id")
)

# Dashboards

_IN = "FROM core_recordings r LEFT JOIN meta_validation v ON v.recording_id = r.id"


def histograms(t: Catalog, incomplete: bool) -> DataFrame:
    """(figure, key, n): the dashboard's breakdowns of a scope, each with its own bound, ties by key."""
    r, a = scoped(t, incomplete), assets(t, incomplete)
    people = r.select("id", "artist_id").join(t.core_artists.select(F.col("id").alias("artist_id"), "artist_type", "country"), "artist_id")
    facts = t.meta_evidence.join(r.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    tags = facts.where("field_name IN ('genre', 'subgenre') AND source_id <> 'SRC_TAXONOMY'")
    kinds = [
        ("format", a, F.upper("format"), None),
        ("state", r, F.col("state"), None),
        ("channels", a, F.col("channels").cast("string"), None),
        ("sample_rate", a, F.col("sample_rate").cast("string"), 5),
        ("artist_type", people.where("artist_type IS NOT NULL"), F.col("artist_type"), None),
        ("genre", r, F.coalesce("genre", F.lit("Unclassified")), None),
        ("subgenre", r.where("coalesce(subgenre, 'Unclassified') <> 'Unclassified'"), F.col("subgenre"), None),
        ("decade", r, text.decade(F.coalesce("original_release_date", "release_date")), None),
        ("source", facts, F.col("source_id"), 8),
        ("raw_tag", tags, F.col("value"), 12),
        ("country", people.where("country <> ''"), F.upper("country"), 12),
        ("region", people.where("country <> ''"), text.region(F.col("country")), 6),
    ]
    parts = [histogram(rows, key, "key", top).select(F.lit(name).alias("figure"), "key", "n") for name, rows, key, top in kinds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _histograms_sql(where: str, missing: bool) -> str:
    scope = f"scope AS (SELECT r.* {_IN} {where})"
    # Assets of all recordings come with a scope of all.
    parts = [
        ("format", "upper(format)", "files", "TRUE", None),
        ("state", "state", "scope", "TRUE", None),
        ("channels", "CAST(channels AS VARCHAR)", "files", "TRUE", None),
        ("sample_rate", "CAST(sample_rate AS VARCHAR)", "files", "TRUE", 5),
        ("artist_type", "artist_type", "people", "artist_type IS NOT NULL", None),
        ("genre", "coalesce(genre, 'Unclassified')", "scope", "TRUE", None),
        ("subgenre", "subgenre", "scope", "coalesce(subgenre, 'Unclassified') <> 'Unclassified'", None),
        ("decade", duck.decade("coalesce(original_release_date, release_date)"), "scope", "TRUE", None),
        ("source", "source_id", "facts", "TRUE", 8),
        ("raw_tag", "value", "facts", "field_name IN ('genre', 'subgenre') AND source_id <> 'SRC_TAXONOMY'", 12),
        ("country", "upper(country)", "people", "country <> ''", 12),
        ("region", duck.region("country"), "people", "country <> ''", 6),
    ]
    one = lambda name, key, source, cond, top: f"(SELECT '{name}' AS figure, {key} AS key, count(*) AS n FROM {source} WHERE {cond} GROUP BY {key} ORDER BY n DESC, key NULLS LAST" + (f" LIMIT {top})" if top else ")")
    return f"WITH {scope}, files AS (SELECT a.* FROM core_assets a JOIN scope s ON a.recording_id = s.id), people AS (SELECT a.artist_type, a.country FROM scope s JOIN core_artists a ON a.id = s.artist_id), facts AS (SELECT * FROM meta_evidence WHERE entity_id IN (SELECT id FROM scope)) " + " UNION ALL ".join(one(*p) for p in parts)


q("dm37_histograms", _histograms_sql("", False))(lambda t: histograms(t, False))
q("dm37_histograms_incomplete", _histograms_sql("WHERE v.quality_score < 1.0", True))(lambda t: histograms(t, True))

# Runs

q(
    "dm41_run_ledger",
    "SELECT run_id, '4' AS parser_version, started_at, CASE WHEN run_id = '2024-01-03' THEN TIMESTAMP '2024-02-01 00:00:00' WHEN run_id < '2024-01-10' THEN NULL ELSE finished_at END AS finished_at FROM sys_runs UNION ALL SELECT 'new run', '5', TIMESTAMP '2024-02-01 00:00:00', NULL",
)(lambda t: run_ledger(t))


def run_ledger(t: Catalog) -> DataFrame:
    """Runs before the tenth are open; one is started twice, one ended."""
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    runs = t.sys_runs.select("run_id", F.lit("4").alias("parser_version"), F.lit("").alias("config_hash"), "started_at", F.when(F.col("run_id") >= "2024-01-10", F.col("finished_at")).alias("finished_at"))
    begun = ledger.start_run(ledger.start_run(runs, "new run", "5", "{}", at), "new run", "6", "{}", at)
    return ledger.finish_run(begun, "2024-01-03", at).drop("config_hash")


# Ingestion


def parsed_files(t: Catalog, *skipped: str) -> DataFrame:
    """The files of the assets, parsed from their bytes; skipped columns are null."""
    return media.parse_media(t.media_files.select("path", "content"), skipped)


#: What parsing gives, by the kind of a file. ``held``: the bytes that its stream's hash is of.
_SOUNDS = """sounds AS (SELECT *, md5(content) AS md5_file, md5(unhex(sound)) AS stream, octet_length(content) AS size, CASE WHEN kind = 'mp3' THEN title WHEN kind = 'flac' THEN title END AS tag_title, CASE WHEN kind = 'mp3' THEN artist END AS tag_artist, CASE WHEN kind = 'mp3' AND isrc NOT IN ('', 'NONE') THEN isrc END AS tag_isrc, CASE WHEN kind = 'mp3' THEN genre END AS tag_genre,
    CASE kind WHEN 'wav' THEN length(sound) / 4 / channels / sample_rate::DOUBLE WHEN 'flac' THEN 16 / 44100::DOUBLE WHEN 'mp3' THEN (1 + recording_id % 2) * 1152 / 44100::DOUBLE ELSE 0 END AS seconds FROM media_files)"""
q(
    "src06_media_files",
    f"""WITH {_SOUNDS} SELECT path, CASE kind WHEN 'none' THEN 'CORRUPTED' ELSE 'SUCCESS' END AS status, CASE WHEN kind <> 'none' THEN md5_file END AS md5_file, CASE WHEN kind <> 'none' THEN sha256(content) END AS sha256_file, CASE WHEN kind <> 'none' THEN stream END AS audio_stream_hash, CASE WHEN kind <> 'none' THEN seconds END AS duration, CASE WHEN kind <> 'none' THEN upper(kind) END AS format,
    CAST(CASE kind WHEN 'wav' THEN 16 * channels * sample_rate WHEN 'flac' THEN 926100 WHEN 'mp3' THEN 128000 WHEN 'ogg' THEN 0 END AS INT) AS bitrate, CAST(CASE kind WHEN 'wav' THEN sample_rate WHEN 'none' THEN NULL ELSE 44100 END AS INT) AS sample_rate, CAST(CASE kind WHEN 'wav' THEN channels WHEN 'flac' THEN 1 WHEN 'none' THEN NULL ELSE 2 END AS INT) AS channels, CASE WHEN kind <> 'none' THEN size END AS file_size,
    tag_title AS title, tag_artist AS artist, tag_isrc AS isrc, tag_genre AS genre FROM sounds""",
)(lambda t: parsed_files(t, "payload", "payload_hash").select("path", "status", "md5_file", "sha256_file", "audio_stream_hash", "duration", "format", "bitrate", "sample_rate", "channels", "file_size", *[F.element_at("tags", k).alias(k) for k in ("title", "artist", "isrc", "genre")]))


def fan_out(t: Catalog) -> DataFrame:
    """All rows that the parsed files give, as (kind, key, name, value)."""
    # Parsed once and stored by columns without those that no row below shows; then each file gives all its rows at once.
    unused = ("sha256_file", "duration", "format", "bitrate", "sample_rate", "channels", "payload")
    parsed = stored(parsed_files(t, *unused).drop(*unused))
    good = media.good_files(parsed)
    row = lambda kind, key, name, value: F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), name.alias("name"), value.alias("value"))
    fact = lambda f: row("evidence", "recording_id", f["field_name"], F.concat_ws("|", f["value"], f["source_id"], f["evidence_class"], F.round(f["confidence"], 4).cast("string"), f["token_index"].cast("string")))
    own = F.array(
        row("recordings", "recording_id", F.lit("PARSED"), F.substring_index("path", "/", -1)),
        row("assets", "asset_id", F.col("recording_id"), F.concat_ws("|", "md5_file", "audio_stream_hash", "file_size")),
        row("locations", "asset_id", F.lit("filepath"), F.col("path")),
        row("validation", "recording_id", F.lit("quality_score"), F.lit(str(media.START_QUALITY))),
    )
    plain = good.select(F.inline(F.concat(own, F.transform(media.plain_facts(), fact))))
    genres = media.genre_facts(good).select(F.inline(F.transform("facts", fact)))
    payloads = good.select("payload_hash").distinct().select(F.inline(F.array(row("payloads", "payload_hash", F.lit("payload"), F.lit("")))))
    return plain.unionByName(genres).unionByName(payloads)


_RAW = "CASE kind WHEN 'mp3' THEN concat_ws(', ', '\"TCON\": [\"' || genre || '\"]', '\"TIT2\": [\"' || title || '\"]', '\"TPE1\": [\"' || artist || '\"]', CASE WHEN isrc = '' THEN '\"TSRC\": []' ELSE '\"TSRC\": [\"' || isrc || '\"]' END) WHEN 'flac' THEN coalesce('\"TITLE\": [\"' || title || '\"]', '') ELSE '' END"
_FILES = f"{_SOUNDS}, files AS (SELECT md5_file, stream AS audio_stream_hash, size AS file_size, path, tag_title AS title, tag_isrc AS isrc, tag_artist AS artist, tag_genre AS genre, md5('recording' || md5_file || path) AS rec, md5('asset' || md5_file || path) AS aid, sha256('{{' || {_RAW} || '}}') AS payload FROM sounds WHERE kind <> 'none')"
_STEM = duck.space(duck.sub(duck.sub(duck.sub("trim(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', ''))", duck.fixed.SEED_PREFIX), duck.fixed.EDITION_NOISE), r"[._\-]", " "))
_GENRE_PARTS = "(SELECT rec AS entity_id, 'genre0000' || k AS id, list_extract(['post rock', 'free jazz', 'idm'], k + 1) AS value, list_extract([1.0, 0.75, 0.5625], k + 1) AS confidence, CAST(1 AS DOUBLE) AS weight, 'SRC_EMBEDDED_TAGS' AS source_id FROM files, (VALUES (0), (1), (2)) v(k) WHERE genre LIKE 'Post%' UNION ALL SELECT rec, 'genre00000', 'rock', 1.0, 1.0, 'SRC_EMBEDDED_TAGS' FROM files WHERE genre = 'Rock')"
_DOUBLE = "CAST(round({0}, 4) AS DOUBLE)"
q(
    "dm42_entity_fan_out",
    f"""WITH {_FILES}, derived AS (SELECT * FROM ({GENRES.format(source=_GENRE_PARTS, artists='(SELECT rec AS id, artist AS name FROM files WHERE genre IS NOT NULL)')}) g),
    facts AS (SELECT rec, 'title' AS f, trim(title) AS v, 'SRC_EMBEDDED_TAGS' AS s, 'LOCAL' AS c, 1.0::DOUBLE AS w, 0 AS k FROM files UNION ALL SELECT rec, 'artist', trim(artist), 'SRC_EMBEDDED_TAGS', 'LOCAL', 1.0, 0 FROM files UNION ALL SELECT rec, 'isrc', trim(isrc), 'SRC_EMBEDDED_TAGS', 'LOCAL', 1.0, 0 FROM files
      UNION ALL SELECT entity_id, 'genre', value, source_id, 'LOCAL', round(confidence, 4), CAST(right(id, 1) AS INT) FROM {_GENRE_PARTS} p
      UNION ALL SELECT rec, 'title', {_STEM}, 'SRC_PATH_SEED', 'LOCAL', 1.0, 0 FROM files UNION ALL SELECT rec, 'disc_number', coalesce(CAST(try_cast(regexp_extract(lower(path), {duck.lit(duck.fixed.DISC)}, 2) AS INT) AS VARCHAR), '1'), 'SRC_PATH_SEED', 'LOCAL', 1.0, 0 FROM files
      UNION ALL SELECT entity_id, 'genre', genre, 'SRC_TAXONOMY', 'DERIVED', confidence, 0 FROM derived UNION ALL SELECT entity_id, 'subgenre', subgenre, 'SRC_TAXONOMY', 'DERIVED', confidence, 0 FROM derived)
    SELECT 'recordings' AS kind, rec AS key, 'PARSED' AS name, regexp_extract(path, '([^/]*)$', 1) AS value FROM files UNION ALL SELECT 'assets', aid, rec, md5_file || '|' || audio_stream_hash || '|' || file_size FROM files UNION ALL SELECT 'locations', aid, 'filepath', path FROM files
    UNION ALL SELECT 'validation', rec, 'quality_score', '0.2' FROM files UNION ALL SELECT 'evidence', rec, f, v || '|' || s || '|' || c || '|' || CAST(w AS VARCHAR) || '|' || k FROM facts WHERE v <> '' UNION ALL SELECT DISTINCT 'payloads', payload, 'payload', '' FROM files""",
)(fan_out)

# Files written, and read again


def exported(t: Catalog) -> DataFrame:
    """The artists as an export in order, read back."""
    folder = f"{shared_folder(t.spark)}/export-{uuid.uuid4().hex}"
    files.write_export(t.core_artists.select("id", "name", "region"), folder, ["name", "id"])
    return files.read_table(t.spark, folder, "csv", "id bigint, name string, region string")


def reported(t: Catalog) -> DataFrame:
    """Lines of a report of recordings by genre."""
    figures = t.core_recordings.groupBy(F.coalesce("genre", F.lit("none")).alias("metric")).agg(F.count("*").alias("n"))
    return t.spark.createDataFrame(list(enumerate(files.markdown_report(figures, "Genres").split("\n"))), "line int, text string")


def taken_by_batch(t: Catalog) -> DataFrame:
    """The store after two batches of assets: those of one channel, then those of two, each against all before it."""
    names = t.core_recordings.select(F.col("id").alias("recording_id"), "title", "artist_id").join(t.core_artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist")), "artist_id", "left")
    rows = t.core_assets.join(names, "recording_id").select(F.col("asset_id").alias("path"), "md5_file", "audio_stream_hash", "duration", (F.col("recording_id") % 3000).cast("string").alias("fingerprint"), "title", "artist", "channels")
    folder = f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}"
    for batch in (0, 1):
        store.add_batch(rows.where(F.col("channels") == batch + 1).drop("channels"), batch, folder)
    return store.accepted_files(t.spark, folder).select("path", "batch")


q("snk08_export", "SELECT id, name, region FROM core_artists")(exported)
q("snk11_report", "WITH f AS (SELECT coalesce(genre, 'none') AS metric, count(*) AS n FROM core_recordings GROUP BY 1), l AS (SELECT 4 + row_number() OVER (ORDER BY metric) AS line, '| ' || metric || ' | ' || n || ' |' AS text FROM f) SELECT CAST(line - 1 AS INT) AS line, text FROM l UNION ALL SELECT * FROM (VALUES (0, '# Genres'), (1, ''), (2, '| metric | n |'), (3, '|---|---|')) h UNION ALL SELECT CAST(4 + count(*) AS INT), '' FROM f")(reported)
q("ss02_ingest_store")(taken_by_batch)

# Schemas

q("dm48_conform", f"SELECT id, name, coalesce(nullif(normalized_name, ''), {duck.artist_key('name')}) AS normalized_name, CAST(NULL AS VARCHAR) AS country, region, CAST(NULL AS VARCHAR) AS artist_type, musicbrainz_artist_id, 7 AS extra FROM (SELECT id, name, CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN normalized_name END AS normalized_name, region, musicbrainz_artist_id FROM core_artists) a")(
    # An old table: narrow ids, two columns short, keys not filled, one column of its own.
    lambda t: schema.conform(t.core_artists.select(F.col("id").cast("int").alias("id"), "name", F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.col("normalized_name")).alias("normalized_name"), "region", "musicbrainz_artist_id", F.lit(7).alias("extra")), schema.TABLES["core_artists"], {"normalized_name": text.artist_key(F.col("name"))})
)
