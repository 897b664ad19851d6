"""Queries over aggregates and the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import graph, limits
from tessera.plans import duck
from tessera.plans.registry import catalog_query as q
from tessera.plans.scans import overview, scoped
from tessera.sources.fixtures import Catalog

def assets(t: Catalog, incomplete: bool = False) -> DataFrame:
    """Assets of the recordings in scope."""
    keys = scoped(t, incomplete).select(F.col("id").alias("recording_id")) if incomplete else t.core_recordings.select(F.col("id").alias("recording_id"))
    return t.core_assets.join(keys, "recording_id")


_IN = "FROM core_assets a JOIN core_recordings r ON a.recording_id = r.id"
q("ag01_totals", f"SELECT count(*) AS n, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes, round(coalesce(sum(duration), 0), 3) AS seconds, round(avg(duration), 6) AS mean {_IN}")(
    lambda t: assets(t).agg(F.count("*").alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.round(F.coalesce(F.sum("duration"), F.lit(0)), 3).alias("seconds"), F.round(F.avg("duration"), 6).alias("mean"))
)

#: Conditions that the dashboard counts over recordings and over assets, each in one scan.
RECORDING_COUNTS = {
    "isrc": "isrc IS NOT NULL AND isrc <> '' AND isrc <> 'NONE'",
    "mbid": "musicbrainz_recording_id IS NOT NULL AND musicbrainz_recording_id <> ''",
    "acoustid": "acoustid_id IS NOT NULL AND acoustid_id <> ''",
    "no_isrc": "isrc IS NULL OR isrc = '' OR isrc = 'NONE'",
    "no_mbid": "musicbrainz_recording_id IS NULL OR musicbrainz_recording_id = ''",
    "no_album": "album_id IS NULL",
    "no_date": "release_date IS NULL OR release_date = ''",
    "deep_subgenre": "subgenre IS NOT NULL AND subgenre <> 'Unclassified'",
    "root_genre": "genre IS NOT NULL AND genre <> 'Unclassified'",
    "raw_tags": "(genre IS NULL OR genre = 'Unclassified') AND (subgenre IS NULL OR subgenre = 'Unclassified')",
    "q100": "quality_score >= 1.0",
    "q80": "quality_score >= 0.80 AND quality_score < 1.0",
    "q50": "quality_score >= 0.50 AND quality_score < 0.80",
    "q0": "quality_score < 0.50",
}
_LOSSY = "upper(format) NOT IN ('FLAC', 'WAV')"
ASSET_COUNTS = {
    "lossless": "upper(format) IN ('FLAC', 'WAV')",
    "hires": "sample_rate >= 88200",
    "cd_lossless": "sample_rate BETWEEN 44100 AND 48000 AND upper(format) IN ('FLAC', 'WAV')",
    "high_lossy": f"(bitrate >= 280000 OR (bitrate >= 280 AND bitrate <= 1000)) AND {_LOSSY}",
    "low_lossy": f"((bitrate < 280000 AND bitrate < 280) OR bitrate IS NULL) AND {_LOSSY}",
    "b256": f"(bitrate BETWEEN 220000 AND 279999 OR bitrate BETWEEN 220 AND 279) AND {_LOSSY}",
    "b_low": f"((bitrate < 220000 AND bitrate < 220) OR bitrate IS NULL) AND {_LOSSY}",
}


def counts(rows: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """All counts of conditional rows in one pass."""
    return rows.agg(*[F.count_if(F.expr(where)).alias(name) for name, where in conditions.items()])


def _counts_sql(conditions: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(f'count(*) FILTER (WHERE {w}) AS {n}' for n, w in conditions.items())} {source}"


_SCOPED = "FROM core_recordings r LEFT JOIN meta_validation v ON r.id = v.recording_id"
q("ag02_conditional_counts", _counts_sql(RECORDING_COUNTS, _SCOPED))(lambda t: counts(scoped(t, False), RECORDING_COUNTS))
q("ag02_incomplete_counts", _counts_sql(RECORDING_COUNTS, f"{_SCOPED} WHERE v.quality_score < 1.0"))(lambda t: counts(scoped(t, True), RECORDING_COUNTS))
q("ag02_asset_counts", _counts_sql(ASSET_COUNTS, _IN))(lambda t: counts(assets(t), ASSET_COUNTS))
q("ag03_quality_bands", "SELECT CASE WHEN quality_score >= 1.0 THEN 'full' WHEN quality_score >= 0.8 THEN 'high' WHEN quality_score >= 0.5 THEN 'middle' ELSE 'low' END AS band, count(*) AS n FROM meta_validation GROUP BY band")(
    lambda t: t.meta_validation.groupBy(F.when(F.col("quality_score") >= 1.0, "full").when(F.col("quality_score") >= 0.8, "high").when(F.col("quality_score") >= 0.5, "middle").otherwise("low").alias("band")).agg(F.count("*").alias("n"))
)


def histogram(rows: DataFrame, key, name: str, top: int | None = None) -> DataFrame:
    """Counts by key, most first; ties by key."""
    out = rows.groupBy(key.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(name))
    return out.limit(top) if top else out


q("ag04_formats", f"SELECT upper(a.format) AS format, count(*) AS n {_IN} GROUP BY upper(a.format)")(lambda t: histogram(assets(t), F.upper("format"), "format"))
q("ag05_states", "SELECT state, count(*) AS n FROM core_recordings GROUP BY state")(lambda t: histogram(t.core_recordings, F.col("state"), "state"))
q("ag05_channels", f"SELECT a.channels, count(*) AS n {_IN} GROUP BY a.channels")(lambda t: histogram(assets(t), F.col("channels"), "channels"))
q("ag05_sample_rates", f"SELECT a.sample_rate, count(*) AS n {_IN} GROUP BY a.sample_rate ORDER BY n DESC, sample_rate LIMIT 5")(lambda t: histogram(assets(t), F.col("sample_rate"), "sample_rate", 5))
q("ag05_artist_types", "SELECT ar.artist_type, count(*) AS n FROM core_artists ar JOIN core_recordings r ON ar.id = r.artist_id WHERE ar.artist_type IS NOT NULL GROUP BY ar.artist_type")(lambda t: histogram(with_artist(t).where("artist_type IS NOT NULL"), F.col("artist_type"), "artist_type"))


def with_artist(t: Catalog) -> DataFrame:
    return t.core_recordings.select("id", "artist_id").join(t.core_artists.withColumnRenamed("id", "artist_id"), "artist_id")


q("ag06_genres", "SELECT primary_genre, count(*) AS n FROM vw_recording_overview GROUP BY primary_genre")(lambda t: histogram(overview(t), F.col("primary_genre"), "primary_genre"))
q("ag06_subgenres", "SELECT primary_subgenre, count(*) AS n FROM vw_recording_overview WHERE primary_subgenre <> 'Unclassified' GROUP BY primary_subgenre")(lambda t: histogram(overview(t).where("primary_subgenre <> 'Unclassified'"), F.col("primary_subgenre"), "primary_subgenre"))
q("ag07_decades", f"SELECT {duck.decade('coalesce(original_release_date, release_date)')} AS decade, count(*) AS n FROM core_recordings GROUP BY decade")(lambda t: histogram(t.core_recordings, text.decade(F.coalesce("original_release_date", "release_date")), "decade"))
q("ag08_sources", "SELECT source_id, count(*) AS n FROM meta_evidence GROUP BY source_id ORDER BY n DESC, source_id LIMIT 8")(lambda t: histogram(t.meta_evidence, F.col("source_id"), "source_id", 8))
q("ag09_raw_tags", "SELECT value, count(*) AS n FROM meta_evidence WHERE field_name IN ('genre', 'subgenre') AND source_id <> 'SRC_TAXONOMY' GROUP BY value ORDER BY n DESC, value LIMIT 12")(lambda t: histogram(t.meta_evidence.where("field_name IN ('genre', 'subgenre') AND source_id <> 'SRC_TAXONOMY'"), F.col("value"), "value", 12))
_COUNTRY = "FROM core_artists ar JOIN core_recordings r ON ar.id = r.artist_id WHERE ar.country IS NOT NULL AND ar.country <> ''"
q("ag10_countries", f"SELECT upper(country) AS country, count(*) AS n {_COUNTRY} GROUP BY upper(country) ORDER BY n DESC, 1 LIMIT 12")(lambda t: histogram(with_artist(t).where("country <> ''"), F.upper("country"), "country", 12))
q("ag10_regions", f"SELECT {duck.region('country')} AS region, count(*) AS n {_COUNTRY} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 6")(lambda t: histogram(with_artist(t).where("country <> ''"), text.region(F.col("country")), "region", 6))
q("ag11_having", "SELECT a.name, count(*) AS n FROM core_artists a JOIN core_recordings r ON r.artist_id = a.id GROUP BY a.name HAVING count(*) >= 3")(lambda t: with_artist(t).groupBy("name").agg(F.count("*").alias("n")).where("n >= 3"))


def compilations(t: Catalog) -> DataFrame:
    """(album_id, artists, compilation): by three artists or more, or by name."""
    n = t.core_recordings.where("album_id IS NOT NULL").groupBy("album_id").agg(F.count_distinct("artist_id").alias("artists"))
    names = t.core_albums.select(F.col("id").alias("album_id"), "title", "artist_id").join(t.core_artists.select(F.col("id").alias("artist_id"), "name"), "artist_id", "left")
    flag = (F.col("artists") >= 3) | F.contains(F.lower("name"), F.lit("various")) | F.contains(F.lower("name"), F.lit("v.a.")) | F.contains(F.lower("title"), F.lit("compilation"))
    return n.join(names, "album_id").select("album_id", "artists", F.coalesce(flag, F.lit(False)).alias("compilation"))


COMPILATIONS = "SELECT n.album_id, n.artists, coalesce(n.artists >= 3 OR contains(lower(a.name), 'various') OR contains(lower(a.name), 'v.a.') OR contains(lower(b.title), 'compilation'), FALSE) AS compilation FROM (SELECT album_id, count(DISTINCT artist_id) AS artists FROM core_recordings WHERE album_id IS NOT NULL GROUP BY album_id) n JOIN core_albums b ON b.id = n.album_id LEFT JOIN core_artists a ON b.artist_id = a.id"
q("ag12_compilations", COMPILATIONS)(compilations)
q("ag13_distinct", "SELECT DISTINCT genre, subgenre FROM core_recordings")(lambda t: t.core_recordings.select("genre", "subgenre").distinct())
q("ag14_last_run", "SELECT run_id, count(*) AS facts FROM meta_evidence WHERE run_id = (SELECT max(run_id) FROM sys_runs) GROUP BY run_id")(lambda t: t.meta_evidence.join(t.sys_runs.agg(F.max("run_id").alias("run_id")), "run_id").groupBy("run_id").agg(F.count("*").alias("facts")))
q("ag15_genre_pairs", "SELECT genre, subgenre, count(*) AS n FROM core_recordings GROUP BY genre, subgenre")(lambda t: t.core_recordings.groupBy("genre", "subgenre").agg(F.count("*").alias("n")).orderBy(F.desc("n")))


def affinity(recordings: DataFrame) -> DataFrame:
    """(genre, n, factor, score): a genre's share of the most frequent one's count lifts its score to 1.2 times at most."""
    n = recordings.where("genre IS NOT NULL AND genre <> 'Unclassified'").groupBy(F.lower("genre").alias("genre")).agg(F.count("*").alias("n"))
    factor = 1.0 + F.col("n") / F.col("most") * 0.20
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("most")))).select("genre", "n", F.round(factor, 6).alias("factor"), F.round(F.least(F.lit(1.0), 0.80 * factor), 3).alias("score"))


AFFINITY = "SELECT genre, n, round(1.0 + CAST(n AS DOUBLE) / max(n) OVER () * 0.20, 6) AS factor, round(least(CAST(1.0 AS DOUBLE), 0.80 * (1.0 + CAST(n AS DOUBLE) / max(n) OVER () * 0.20)), 3) AS score FROM (SELECT lower(genre) AS genre, count(*) AS n FROM core_recordings WHERE genre IS NOT NULL AND genre <> 'Unclassified' GROUP BY lower(genre)) g"
q("ag16_affinity", AFFINITY)(lambda t: affinity(t.core_recordings))
q("ag17_cohort_figures", "SELECT count(*) AS n, round(sum(duration) / 3600, 6) AS hours, count(DISTINCT artist_name) AS artists, round(avg(quality_score), 6) AS quality FROM (SELECT * FROM vw_recording_overview WHERE quality_score >= 0.5 AND format IS NOT NULL ORDER BY id, filepath NULLS LAST, file_key(duration) LIMIT 200) x".replace(", file_key(duration)", ", duration, bitrate NULLS LAST, sample_rate"))(
    lambda t: cohort_figures(overview(t).where("quality_score >= 0.5 AND format IS NOT NULL"))
)


def cohort_figures(rows: DataFrame, preview: int = 200) -> DataFrame:
    """Figures of the first rows of a cohort."""
    first = rows.orderBy("id", F.asc_nulls_last("filepath"), "duration", F.asc_nulls_last("bitrate"), "sample_rate").limit(preview)
    return first.agg(F.count("*").alias("n"), F.round(F.sum("duration") / 3600, 6).alias("hours"), F.count_distinct("artist_name").alias("artists"), F.round(F.avg("quality_score"), 6).alias("quality"))


q("ag18_tag_consensus", f"SELECT entity_id, lower(trim(value)) AS tag, round(sum(confidence * {duck.tag_weight('source_id')}), 6) AS score FROM meta_evidence WHERE field_name = 'genre' GROUP BY entity_id, tag")(lambda t: tag_scores(t.meta_evidence))


def tag_scores(evidence: DataFrame) -> DataFrame:
    from tessera.operators.taxonomy import tag_weight

    return evidence.where("field_name = 'genre'").groupBy("entity_id", F.lower(F.trim("value")).alias("tag")).agg(F.round(F.sum(F.col("confidence") * tag_weight(F.col("source_id"))), 6).alias("score"))


q("ag19_family_trust", f"SELECT entity_id, field_name, value, round(sum(mean * prior), 9) AS trust FROM (SELECT entity_id, field_name, value, family, avg(confidence * positional_weight) AS mean, max(prior) AS prior FROM (SELECT *, {duck.family('source_id')} AS family, {duck.prior('field_name', duck.family('source_id'))} AS prior FROM meta_evidence) e GROUP BY entity_id, field_name, value, family) f GROUP BY entity_id, field_name, value")(lambda t: family_trust(t.meta_evidence))


def family_trust(evidence: DataFrame) -> DataFrame:
    from tessera.plans.scans import with_priors

    key = ["entity_id", "field_name", "value"]
    by_family = with_priors(evidence).groupBy(*key, "family").agg(F.avg(F.col("confidence") * F.col("positional_weight")).alias("mean"), F.max("prior").alias("prior"))
    return by_family.groupBy(*key).agg(F.round(F.sum(F.col("mean") * F.col("prior")), 9).alias("trust"))


@q(
    "ag20_latency_average",
    """WITH RECURSIVE seq AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    fold AS (SELECT user_id, n, CAST(value AS DOUBLE) AS ema FROM seq WHERE n = 1 UNION ALL SELECT s.user_id, s.n, CASE WHEN f.ema = 0 THEN s.value ELSE 0.2 * s.value + 0.8 * f.ema END FROM fold f JOIN seq s ON s.user_id = f.user_id AND s.n = f.n + 1)
    SELECT user_id, round(arg_max(ema, n), 6) AS ema FROM fold GROUP BY user_id""",
)
def latency_average(t: Catalog) -> DataFrame:
    return limits.moving_average(t.events, "user_id", "event_id", "value")


q("ag21_identifier_count", "SELECT id, round(least(1.0, greatest(0.20, 0.25 * ((coalesce(trim(mbid), '') <> '')::INT + (discogs_id IS NOT NULL)::INT + (coalesce(trim(wikidata_qid), '') <> '')::INT + (coalesce(trim(lastfm_name), '') <> '')::INT))), 2)::DOUBLE AS confidence FROM sys_authority_map")(lambda t: t.sys_authority_map.select("id", identifier_confidence("mbid", "discogs_id", "wikidata_qid", "lastfm_name").alias("confidence")))


def identifier_confidence(*columns: str):
    n = sum((F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").cast("int") for c in columns)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.20), 0.25 * n)), 2)


_EDGES = "SELECT 'e' || id AS a, mbid AS b FROM sys_authority_map WHERE mbid IS NOT NULL UNION SELECT 'e' || id, 'discogs:' || discogs_id FROM sys_authority_map WHERE discogs_id IS NOT NULL UNION SELECT 'e' || id, 'wiki:' || wikidata_qid FROM sys_authority_map WHERE wikidata_qid IS NOT NULL"


@q("ag22_components", f"WITH RECURSIVE links AS ({_EDGES}), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.seen = w.a) SELECT node, min(seen) AS component FROM reach GROUP BY node")
def authority_components(t: Catalog) -> DataFrame:
    m = t.sys_authority_map.select(F.concat(F.lit("e"), "id").alias("a"), F.explode(F.array("mbid", F.concat(F.lit("discogs:"), "discogs_id"), F.concat(F.lit("wiki:"), "wikidata_qid"))).alias("b")).where("b IS NOT NULL")
    return graph.components(m)


def dashboard(t: Catalog, incomplete: bool = False) -> DataFrame:
    """Every figure of the dashboard as (metric, n): two scans of the scoped tables."""
    r, a = counts(scoped(t, incomplete), RECORDING_COUNTS), counts(assets(t, incomplete), ASSET_COUNTS)
    long = lambda d: d.unpivot([], d.columns, "metric", "n")
    total = scoped(t, incomplete).agg(F.count("*").alias("tracks"))
    return long(total).unionByName(long(r)).unionByName(long(a))


def _dashboard_sql(where: str) -> str:
    recordings, files = {"tracks": "TRUE"} | RECORDING_COUNTS, ASSET_COUNTS
    inner = f"{_SCOPED} {where}"
    parts = [f"SELECT '{n}' AS metric, count(*) FILTER (WHERE {w}) AS n {inner}" for n, w in recordings.items()]
    parts += [f"SELECT '{n}' AS metric, count(*) FILTER (WHERE {w}) AS n FROM core_assets a JOIN core_recordings r ON a.recording_id = r.id LEFT JOIN meta_validation v ON r.id = v.recording_id {where}" for n, w in files.items()]
    return " UNION ALL ".join(parts)


q("dm37_dashboard", _dashboard_sql(""))(lambda t: dashboard(t))
q("dm37_dashboard_incomplete", _dashboard_sql("WHERE v.quality_score < 1.0"))(lambda t: dashboard(t, True))
q("dm40_diagnostics", "SELECT (SELECT count(*) FROM core_recordings r LEFT JOIN meta_validation v ON r.id = v.recording_id WHERE v.quality_score < 1.0 AND EXISTS (SELECT 1 FROM core_assets a JOIN core_asset_locations l ON a.asset_id = l.asset_id WHERE a.recording_id = r.id AND l.is_available = 1)) AS pending, (SELECT count(*) FROM core_recordings r WHERE EXISTS (SELECT 1 FROM core_assets a WHERE a.recording_id = r.id)) AS with_asset")(
    lambda t: scoped(t, True).join(t.core_assets.join(t.core_asset_locations.where("is_available = 1"), "asset_id", "left_semi").select(F.col("recording_id").alias("id")), "id", "left_semi").agg(F.count("*").alias("pending"))
    .crossJoin(t.core_recordings.join(t.core_assets.select(F.col("recording_id").alias("id")), "id", "left_semi").agg(F.count("*").alias("with_asset")))
)
q("dm47_scalar_figures", "SELECT count(*) FILTER (WHERE state = 'SNOOZED') AS snoozed, count(*) FILTER (WHERE state IN ('NEW', 'QUEUED')) AS queued FROM sys_discovery_candidates")(lambda t: t.sys_discovery_candidates.agg(F.count_if(F.col("state") == "SNOOZED").alias("snoozed"), F.count_if(F.col("state").isin("NEW", "QUEUED")).alias("queued")))
