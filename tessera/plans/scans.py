"""Queries over sources, filters, projections, joins, sorts and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fixed, text
from tessera.operators import catalog as views
from tessera.operators.fuzzy import within_edits
from tessera.plans import duck
from tessera.plans.registry import catalog_query as q
from tessera.sources.fixtures import Catalog

AS_OF = "2024-01-15 00:00:00"


def overview(t: Catalog) -> DataFrame:
    return views.overview(t.core_recordings, t.core_artists, t.core_albums, t.core_assets, t.core_asset_locations, t.meta_validation)


q("src02_overview", "SELECT * EXCLUDE (by_artist, on_album, own_date) FROM vw_recording_overview")(overview)
q("src03_open_issues", "SELECT i.*, coalesce(r.title, 'Untitled Work') AS recording_title FROM meta_issues i LEFT JOIN core_recordings r ON r.id = i.entity_id WHERE i.status = 'OPEN'")(
    lambda t: views.open_issues(t.meta_issues, t.core_recordings)
)


@q("src04_point_lookup", "SELECT id, coalesce(nullif(title, ''), 'Untitled') AS title, coalesce(nullif(genre, ''), 'Unclassified') AS genre, coalesce(track_number, 0) AS track_number FROM core_recordings WHERE id = 42")
def point_lookup(t: Catalog) -> DataFrame:
    r = t.core_recordings.where("id = 42")
    return r.select("id", text.or_default(F.col("title"), F.lit("Untitled")).alias("title"), text.or_default(F.col("genre"), F.lit("Unclassified")).alias("genre"), F.coalesce("track_number", F.lit(0)).alias("track_number"))


@q("src05_audio_paths", r"SELECT filepath FROM core_asset_locations WHERE regexp_matches(lower(filepath), '\.(mp3|flac|wav|m4a|ogg)$')")
def audio_paths(t: Catalog) -> DataFrame:
    return t.core_asset_locations.where(F.rlike(F.lower("filepath"), F.lit(r"\.(mp3|flac|wav|m4a|ogg)$"))).select("filepath")


@q("src08_payload_search", "SELECT conv_id, turn, text AS payload FROM conversations WHERE contains(lower(text), 'the') AND role = 'user' ORDER BY conv_id, turn LIMIT 5")
def payload_search(t: Catalog) -> DataFrame:
    """Payloads are stored gzipped; search the text, first five."""
    from tessera.functions.exact import gunzip, gzipped

    stored = t.conversations.where("role = 'user'").select("conv_id", "turn", gzipped("text").alias("data"))
    return stored.select("conv_id", "turn", gunzip("data").alias("payload")).where(F.contains(F.lower("payload"), F.lit("the"))).orderBy("conv_id", "turn").limit(5)


_BINDINGS = """'{"results":{"bindings":[{"item":{"value":"http://x/entity/Q' || CAST(n_nationkey AS STRING) || '"},"label":{"value":"' || n_name || '"}},{"item":{"value":"http://x/entity/Q0"},"label":{"value":"Zero"}}]}}'"""


@q("src10_flatten_bindings", "SELECT n_nationkey, 'Q' || CAST(n_nationkey AS VARCHAR) AS qid, n_name AS label FROM nation UNION ALL SELECT n_nationkey, 'Q0', 'Zero' FROM nation")
def flatten_bindings(t: Catalog) -> DataFrame:
    schema = "struct<results:struct<bindings:array<struct<item:struct<value:string>,label:struct<value:string>>>>>"
    rows = t.nation.select("n_nationkey", F.from_json(F.expr(_BINDINGS), schema).alias("j")).select("n_nationkey", F.explode("j.results.bindings").alias("b"))
    return rows.select("n_nationkey", F.element_at(F.split("b.item.value", "/"), -1).alias("qid"), F.col("b.label.value").alias("label"))


@q("src11_flatten_media", "SELECT p_partkey AS release, k AS position, p_name || ' ' || CAST(k AS VARCHAR) AS title, CASE WHEN k = 1 THEN 'I' || CAST(p_partkey AS VARCHAR) END AS isrc FROM part, (VALUES (1), (2)) AS v(k)")
def flatten_media(t: Catalog) -> DataFrame:
    raw = F.expr("""'{"media":[{"tracks":[{"position":1,"title":"' || p_name || ' 1","isrcs":["I' || p_partkey || '","X"]}]},{"tracks":[{"position":2,"title":"' || p_name || ' 2","isrcs":[]}]}]}'""")
    schema = "struct<media:array<struct<tracks:array<struct<position:int,title:string,isrcs:array<string>>>>>>"
    media = t.part.select(F.col("p_partkey").alias("release"), F.from_json(raw, schema).alias("j")).select("release", F.explode("j.media").alias("m"))
    return media.select("release", F.explode("m.tracks").alias("x")).select("release", "x.position", "x.title", F.get("x.isrcs", 0).alias("isrc"))


@q("src12_cache_lookup", "SELECT r.id, v.quality_score AS cached FROM core_recordings r LEFT JOIN meta_validation v ON r.id = v.recording_id")
def cache_lookup(t: Catalog) -> DataFrame:
    return t.core_recordings.select("id").join(t.meta_validation.select(F.col("recording_id").alias("id"), F.col("quality_score").alias("cached")), "id", "left")


# Filters


@q("flt01_search_any_case", "SELECT id, title FROM core_albums WHERE title ILIKE '%deluxe%' OR release_group_mbid ILIKE '%deluxe%'")
def search_any_case(t: Catalog) -> DataFrame:
    return t.core_albums.where(views.containing("deluxe", "title", "release_group_mbid")).select("id", "title")


@q("flt02_search_newest", "SELECT id, title FROM core_recordings WHERE title LIKE '%Song%' ORDER BY id DESC LIMIT 150")
def search_newest(t: Catalog) -> DataFrame:
    return t.core_recordings.where(F.col("title").like("%Song%")).orderBy(F.desc("id")).limit(150).select("id", "title")


@q("flt03_substring", "SELECT id, name FROM core_artists WHERE contains(lower(name), 'guest')")
def substring(t: Catalog) -> DataFrame:
    return t.core_artists.where(F.contains(F.lower("name"), F.lit("guest"))).select("id", "name")


@q("flt04_filter_builder", "SELECT id, primary_genre, format FROM vw_recording_overview WHERE quality_score >= 0.4 AND primary_genre = 'Jazz' AND upper(format) = 'FLAC' AND try_cast(substr(original_release_date, 1, 4) AS INT) BETWEEN 1980 AND 1999")
def filter_builder(t: Catalog) -> DataFrame:
    wanted = {"quality": 0.4, "genre": "Jazz", "format": "FLAC", "decade": (1980, 1999), "state": None}
    where = views.all_of(
        F.col("quality_score") >= wanted["quality"],
        F.col("primary_genre") == wanted["genre"],
        F.upper("format") == wanted["format"],
        text.year(F.col("original_release_date")).between(*wanted["decade"]),
        None if wanted["state"] is None else F.col("state") == wanted["state"],
    )
    return overview(t).where(where).select("id", "primary_genre", "format")


@q("flt05_issue_filter", "SELECT id, entity_id FROM meta_issues WHERE issue_code = 'MISSING_MBID' AND severity = 'WARNING'")
def issue_filter(t: Catalog) -> DataFrame:
    return t.meta_issues.where(views.all_of(F.col("issue_code") == "MISSING_MBID", F.col("severity") == "WARNING")).select("id", "entity_id")


_PENDING = "FROM core_recordings r LEFT JOIN meta_validation v ON r.id = v.recording_id JOIN core_assets a ON a.recording_id = r.id JOIN core_asset_locations l ON l.asset_id = a.asset_id WHERE (v.quality_score IS NULL OR v.quality_score < 1.0 OR r.musicbrainz_recording_id IS NULL OR r.isrc IS NULL) AND l.is_available = 1"


def pending(t: Catalog) -> DataFrame:
    """Rows of recordings, assets and available locations that still want work."""
    v = t.meta_validation.select(F.col("recording_id").alias("id"), "quality_score")
    a = t.core_assets.select(F.col("recording_id").alias("id"), "asset_id")
    rows = t.core_recordings.join(v, "id", "left").join(a, "id").join(t.core_asset_locations.where("is_available = 1"), "asset_id")
    return rows.where("quality_score IS NULL OR quality_score < 1.0 OR musicbrainz_recording_id IS NULL OR isrc IS NULL")


q("flt06_pending_work", f"SELECT r.id, l.filepath {_PENDING}")(lambda t: pending(t).select("id", "filepath"))
q("flt07_missing_code", "SELECT id FROM core_recordings WHERE coalesce(nullif(nullif(isrc, ''), 'NONE')) IS NULL")(lambda t: t.core_recordings.where(F.nullif(F.nullif("isrc", F.lit("")), F.lit("NONE")).isNull()).select("id"))
q("flt08_snooze_visibility", f"SELECT candidate_id FROM sys_discovery_candidates WHERE state NOT IN ('IGNORED', 'ACQUIRED') AND (state <> 'SNOOZED' OR snoozed_until IS NULL OR snoozed_until <= TIMESTAMP '{AS_OF}')")(lambda t: visible(t.sys_discovery_candidates, AS_OF).select("candidate_id"))


def visible(candidates: DataFrame, as_of: str) -> DataFrame:
    awake = (F.col("state") != "SNOOZED") | F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= F.lit(as_of).cast("timestamp"))
    return candidates.where(~F.col("state").isin("IGNORED", "ACQUIRED") & awake)


q("flt09_bands_and_lists", "SELECT asset_id FROM core_assets WHERE sample_rate BETWEEN 44100 AND 48000 AND upper(format) IN ('FLAC', 'WAV') AND channels NOT IN (3, 4)")(lambda t: t.core_assets.where(F.col("sample_rate").between(44100, 48000) & F.upper("format").isin("FLAC", "WAV") & ~F.col("channels").isin(3, 4)).select("asset_id"))
_BLOCKED = " OR ".join(f"contains(lower(title), '{w}')" for w in fixed.TITLE_BLOCKLIST)


def blocked(title: str):
    return F.exists(F.array(*map(F.lit, fixed.TITLE_BLOCKLIST)), lambda w: F.contains(F.lower(title), w))


q("flt10_blocklist", f"SELECT candidate_id, title FROM sys_discovery_candidates WHERE NOT ({_BLOCKED})")(lambda t: t.sys_discovery_candidates.where(~blocked("title")).select("candidate_id", "title"))
q("flt11_genre_gate", "SELECT candidate_id FROM sys_discovery_candidates WHERE contains(lower(primary_genre), 'jazz') OR contains(lower(title), 'jazz')")(lambda t: t.sys_discovery_candidates.where(F.contains(F.lower("primary_genre"), F.lit("jazz")) | F.contains(F.lower("title"), F.lit("jazz"))).select("candidate_id"))
q("flt12_scope_switch", "SELECT count(*) AS n FROM core_recordings r LEFT JOIN meta_validation v ON r.id = v.recording_id WHERE v.quality_score < 1.0")(lambda t: scoped(t, True).agg(F.count("*").alias("n")))


def scoped(t: Catalog, incomplete: bool) -> DataFrame:
    """Recordings with their score: all, or those below 1.0 (a missing score isn't below)."""
    rows = t.core_recordings.join(t.meta_validation.select(F.col("recording_id").alias("id"), "quality_score"), "id", "left")
    return rows.where("quality_score < 1.0") if incomplete else rows


# Projections

q("prj01_defaults", "SELECT id, coalesce(genre, subgenre, 'Unclassified') AS g, coalesce(track_number, 999) AS n FROM core_recordings")(lambda t: t.core_recordings.select("id", F.coalesce("genre", "subgenre", F.lit("Unclassified")).alias("g"), F.coalesce("track_number", F.lit(999)).alias("n")))
q("prj02_decade", f"SELECT id, {duck.decade('coalesce(original_release_date, release_date)')} AS decade FROM core_recordings")(lambda t: t.core_recordings.select("id", text.decade(F.coalesce("original_release_date", "release_date")).alias("decade")))
q("prj03_own_weight", "SELECT id, confidence * CASE WHEN entity_id = 7 THEN 1.6 ELSE 1.0 END AS w FROM meta_evidence")(lambda t: t.meta_evidence.select("id", (F.col("confidence") * F.when(F.col("entity_id") == 7, 1.6).otherwise(1.0)).alias("w")))
q("prj04_truthiness", "SELECT id, CASE WHEN title IS NULL OR title = '' THEN 'Untitled' ELSE title END AS title, CASE WHEN track_number IS NULL OR track_number = 0 THEN 1 ELSE track_number END AS track FROM core_recordings")(lambda t: t.core_recordings.select("id", text.or_default(F.col("title"), F.lit("Untitled")).alias("title"), F.when(F.coalesce("track_number", F.lit(0)) == 0, 1).otherwise(F.col("track_number")).alias("track")))


@q(
    "prj05_display_formats",
    """SELECT asset_id, CASE WHEN d <= 0 THEN '--:--' WHEN d >= 3600 THEN printf('%d:%02d:%02d', d // 3600, d % 3600 // 60, d % 60) ELSE printf('%02d:%02d', d // 60, d % 60) END AS clock,
    CAST(bitrate // 1000 AS VARCHAR) || ' kbps' AS rate, printf('%.1f kHz', CAST(sample_rate AS DOUBLE) / 1000) AS khz, printf('%.2f GB', CAST(file_size AS DOUBLE) / 1073741824) AS gb
    FROM (SELECT *, CAST(floor(duration * 60) AS INT) AS d FROM core_assets) AS x""",
)
def display_formats(t: Catalog) -> DataFrame:
    return t.core_assets.select("asset_id", text.clock(F.col("duration") * 60).alias("clock"), F.concat(F.floor(F.col("bitrate") / 1000).cast("string"), F.lit(" kbps")).alias("rate"), F.format_string("%.1f kHz", F.col("sample_rate") / 1000).alias("khz"), F.format_string("%.2f GB", F.col("file_size") / 1073741824).alias("gb"))


# Joins


@q("jn01_star", "SELECT r.id, a.name, b.title AS album, v.quality_score FROM core_recordings r LEFT JOIN core_artists a ON r.artist_id = a.id LEFT JOIN core_albums b ON r.album_id = b.id LEFT JOIN meta_validation v ON r.id = v.recording_id")
def star(t: Catalog) -> DataFrame:
    a = t.core_artists.select(F.col("id").alias("artist_id"), "name")
    b = t.core_albums.select(F.col("id").alias("album_id"), F.col("title").alias("album"))
    v = t.meta_validation.withColumnRenamed("recording_id", "id")
    return t.core_recordings.join(a, "artist_id", "left").join(b, "album_id", "left").join(v, "id", "left").select("id", "name", "album", "quality_score")


q("jn02_condition_in_on", "SELECT a.asset_id, l.filepath FROM core_assets a LEFT JOIN core_asset_locations l ON a.asset_id = l.asset_id AND l.is_available = 1")(lambda t: t.core_assets.join(t.core_asset_locations.where("is_available = 1"), "asset_id", "left").select("asset_id", "filepath"))
q("jn03_condition_in_where", "SELECT a.asset_id, l.filepath FROM core_assets a LEFT JOIN core_asset_locations l ON a.asset_id = l.asset_id WHERE l.is_available = 1")(lambda t: t.core_assets.join(t.core_asset_locations, "asset_id", "left").where("is_available = 1").select("asset_id", "filepath"))
q("jn04_inner", "SELECT a.name, count(*) AS n FROM core_recordings r JOIN core_artists a ON r.artist_id = a.id JOIN core_albums b ON r.album_id = b.id GROUP BY a.name")(
    lambda t: t.core_recordings.join(t.core_artists.select(F.col("id").alias("artist_id"), "name"), "artist_id").join(t.core_albums.select(F.col("id").alias("album_id")), "album_id").groupBy("name").agg(F.count("*").alias("n"))
)
_BAND = "SELECT DISTINCT a.recording_id FROM core_assets a JOIN core_assets b ON a.md5_file = b.md5_file AND abs(a.duration - b.duration) <= 2.0 AND a.asset_id <> b.asset_id"
q("jn05_band", _BAND)(lambda t: band(t.core_assets))


def band(assets: DataFrame) -> DataFrame:
    """Recordings whose asset has a twin: equal hash and at most two seconds apart."""
    b = assets.select("md5_file", F.col("duration").alias("d"), F.col("asset_id").alias("other"))
    return assets.join(b, "md5_file").where("abs(duration - d) <= 2.0 AND asset_id <> other").select("recording_id").distinct()


_HAS = "SELECT r.id FROM core_recordings r WHERE {} (SELECT 1 FROM core_assets a WHERE a.recording_id = r.id AND a.format = 'flac')"
q("jn06_semi", _HAS.format("EXISTS"))(lambda t: t.core_recordings.join(t.core_assets.where("format = 'flac'").select(F.col("recording_id").alias("id")), "id", "left_semi").select("id"))
q("jn07_anti", _HAS.format("NOT EXISTS"))(lambda t: t.core_recordings.join(t.core_assets.where("format = 'flac'").select(F.col("recording_id").alias("id")), "id", "left_anti").select("id"))
q("jn08_in_limited", "SELECT id, run_id FROM meta_decisions WHERE id IN (SELECT id FROM meta_decisions ORDER BY applied_at, id LIMIT 70)")(lambda t: t.meta_decisions.join(t.meta_decisions.orderBy("applied_at", "id").limit(70).select("id"), "id", "left_semi").select("id", "run_id"))
q("jn09_in_list", "SELECT candidate_id FROM sys_discovery_candidates WHERE seq IN (3, 14, 15, 92, 65, 35)")(lambda t: t.sys_discovery_candidates.join(t.spark.createDataFrame([(x,) for x in (3, 14, 15, 92, 65, 35)], "seq long"), "seq", "left_semi").select("candidate_id"))


@q(
    "jn10_scalar_per_field",
    "SELECT u.entity_id, (SELECT value FROM meta_evidence e WHERE e.entity_id = u.entity_id AND field_name = 'country' ORDER BY id LIMIT 1) AS country, (SELECT value FROM meta_evidence e WHERE e.entity_id = u.entity_id AND field_name = 'isrc' ORDER BY id LIMIT 1) AS isrc FROM (SELECT DISTINCT entity_id FROM meta_evidence) u",
)
def scalar_per_field(t: Catalog) -> DataFrame:
    first = lambda f: F.min_by(F.when(F.col("field_name") == f, F.col("value")), F.when(F.col("field_name") == f, F.col("id"))).alias(f)
    return t.meta_evidence.groupBy("entity_id").agg(first("country"), first("isrc"))


q("jn11_nested_scalar", "SELECT a.asset_id, (SELECT name FROM core_artists WHERE id = (SELECT artist_id FROM core_recordings WHERE id = a.recording_id)) AS name FROM core_assets a WHERE a.channels = 1")(
    lambda t: t.core_assets.where("channels = 1").join(t.core_recordings.select(F.col("id").alias("recording_id"), "artist_id"), "recording_id", "left").join(t.core_artists.select(F.col("id").alias("artist_id"), "name"), "artist_id", "left").select("asset_id", "name")
)


@q("jn12_siblings", "SELECT d.id AS donor, r.id AS sibling FROM core_recordings d JOIN core_recordings r ON r.album_id = d.album_id AND r.id <> d.id LEFT JOIN meta_validation v ON r.id = v.recording_id WHERE coalesce(v.quality_score, 0.0) < 1.0")
def siblings(t: Catalog) -> DataFrame:
    r = scoped(t, False).where("coalesce(quality_score, 0.0) < 1.0").select("album_id", F.col("id").alias("sibling"))
    return t.core_recordings.select("album_id", F.col("id").alias("donor")).join(r, "album_id").where("donor <> sibling").select("donor", "sibling")


OWNED = f"""
SELECT candidate_id FROM sys_discovery_candidates c WHERE release_group_mbid IN (SELECT musicbrainz_recording_id FROM core_recordings WHERE musicbrainz_recording_id IS NOT NULL UNION SELECT release_group_mbid FROM core_albums WHERE release_group_mbid IS NOT NULL)
OR EXISTS (SELECT 1 FROM core_recordings r JOIN core_artists a ON r.artist_id = a.id WHERE r.title <> '' AND {duck.alnum("r.title")} = {duck.alnum("c.title")} AND {duck.alnum("a.name")} = {duck.alnum("c.artist_name")})"""


def owned(t: Catalog) -> DataFrame:
    """Candidates in the library by either key: two semi joins, no OR in a join condition."""
    r = t.core_recordings
    ids = r.select(F.col("musicbrainz_recording_id").alias("release_group_mbid")).unionByName(t.core_albums.select("release_group_mbid")).where("release_group_mbid IS NOT NULL")
    names = r.where("title <> ''").join(t.core_artists.select(F.col("id").alias("artist_id"), "name"), "artist_id").select(text.alnum_key(F.col("title")).alias("kt"), text.alnum_key(F.col("name")).alias("ka"))
    c = t.sys_discovery_candidates.select("candidate_id", "release_group_mbid", text.alnum_key(F.col("title")).alias("kt"), text.alnum_key(F.col("artist_name")).alias("ka"))
    return c.join(ids, "release_group_mbid", "left_semi").select("candidate_id").unionByName(c.join(names, ["kt", "ka"], "left_semi").select("candidate_id")).distinct()


q("jn13_either_key", OWNED)(owned)


def fuzzy(t: Catalog, titles: int = 2, artists: int = 1) -> DataFrame:
    """Candidates whose title and artist are few edits from those of an album that begins with the same three letters."""
    key = lambda c: F.substring(text.alnum_key(F.col(c)), 1, 3)
    lib = t.core_albums.join(t.core_artists.select(F.col("id").alias("artist_id"), "name"), "artist_id", "left").select(key("title").alias("block"), F.col("title").alias("lib_title"), F.coalesce("name", F.lit("Unknown Artist")).alias("lib_artist")).distinct()
    c = t.sys_discovery_candidates.select("candidate_id", key("title").alias("block"), "title", "artist_name")
    # Albums of one artist hold few titles, so the artist decides first.
    named = lambda frame, column: frame.select(F.lit(0).alias("block"), F.col(column).alias("text"))
    near = within_edits(named(c, "artist_name"), named(lib, "lib_artist"), artists).select(F.col("a").alias("artist_name"), F.col("b").alias("lib_artist"))
    return c.join(near, "artist_name").join(lib, ["block", "lib_artist"]).where(F.levenshtein("title", "lib_title") <= titles).select("candidate_id").distinct()


q(
    "jn14_blocked_levenshtein",
    f"WITH lib AS (SELECT DISTINCT substr({duck.alnum('b.title')}, 1, 3) AS block, b.title AS lib_title, coalesce(a.name, 'Unknown Artist') AS lib_artist FROM core_albums b LEFT JOIN core_artists a ON b.artist_id = a.id) SELECT DISTINCT candidate_id FROM sys_discovery_candidates c JOIN lib ON block = substr({duck.alnum('c.title')}, 1, 3) WHERE abs(length(title) - length(lib_title)) <= 2 AND abs(length(artist_name) - length(lib_artist)) <= 1 AND levenshtein(title, lib_title) <= 2 AND levenshtein(artist_name, lib_artist) <= 1",
)(lambda t: fuzzy(t))
q("jn17_regions", f"SELECT id, {duck.region('country')} AS region FROM core_artists")(lambda t: t.core_artists.select("id", text.region(F.col("country")).alias("region")))
q("jn18_priors", f"SELECT id, {duck.family('source_id')} AS family, {duck.prior('field_name', duck.family('source_id'))} AS prior FROM meta_evidence")(lambda t: with_priors(t.meta_evidence).select("id", "family", "prior"))


def with_priors(evidence: DataFrame) -> DataFrame:
    from tessera.operators.resolve import family_of, prior_of

    return evidence.withColumn("family", family_of(F.col("source_id"))).withColumn("prior", prior_of(F.col("field_name"), F.col("family")))


@q("jn19_directory", "SELECT b.id, b.title, count(r.id) AS tracks, count(DISTINCT r.genre) AS genres FROM core_albums b LEFT JOIN core_recordings r ON r.album_id = b.id GROUP BY b.id, b.title")
def directory(t: Catalog) -> DataFrame:
    r = t.core_recordings.select(F.col("album_id").alias("id"), F.col("id").alias("rid"), "genre")
    return t.core_albums.select("id", "title").join(r, "id", "left").groupBy("id", "title").agg(F.count("rid").alias("tracks"), F.count_distinct("genre").alias("genres"))


@q("jn20_album_pool", "SELECT r.id, e.id AS fact FROM core_recordings r JOIN core_recordings s ON r.album_id = s.album_id JOIN meta_evidence e ON e.entity_id = s.id WHERE e.field_name = 'genre'")
def album_pool(t: Catalog) -> DataFrame:
    e = t.meta_evidence.where("field_name = 'genre'").select(F.col("entity_id").alias("sid"), F.col("id").alias("fact"))
    s = t.core_recordings.select("album_id", F.col("id").alias("sid")).join(e, "sid")
    return t.core_recordings.select("album_id", "id").join(s, "album_id").select("id", "fact")


@q("jn21_full_outer", "SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(n, 0) AS requests, coalesce(state, 'CLOSED') AS state FROM (SELECT source_id, count(*) AS n FROM meta_evidence WHERE source_id < 'SRC_L' GROUP BY source_id) a FULL JOIN (SELECT source_id, 'OPEN' AS state FROM meta_evidence WHERE source_id > 'SRC_E' GROUP BY source_id) b ON a.source_id = b.source_id")
def full_outer(t: Catalog) -> DataFrame:
    a = t.meta_evidence.where("source_id < 'SRC_L'").groupBy("source_id").agg(F.count("*").alias("n"))
    b = t.meta_evidence.where("source_id > 'SRC_E'").select("source_id").distinct().withColumn("state", F.lit("OPEN"))
    return a.join(b, "source_id", "full").select("source_id", F.coalesce("n", F.lit(0)).alias("requests"), F.coalesce("state", F.lit("CLOSED")).alias("state"))


# Sorts, limits, sets

q("so01_null_default", "SELECT id FROM core_recordings WHERE album_id = (SELECT min(album_id) FROM core_recordings) ORDER BY disc_number, coalesce(track_number, 999), title, id")(lambda t: t.core_recordings.join(t.core_recordings.agg(F.min("album_id").alias("album_id")), "album_id").orderBy("disc_number", F.coalesce("track_number", F.lit(999)), "title", "id").select("id"))
q("so02_count_then_name", "SELECT a.name, count(r.id) AS n FROM core_artists a LEFT JOIN core_recordings r ON r.artist_id = a.id GROUP BY a.name ORDER BY n DESC, a.name LIMIT 50")(lambda t: t.core_artists.join(t.core_recordings.select(F.col("artist_id").alias("id"), F.col("id").alias("rid")), "id", "left").groupBy("name").agg(F.count("rid").alias("n")).orderBy(F.desc("n"), "name").limit(50))
q("so03_top_k", "SELECT id, title FROM core_recordings ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 200")(lambda t: t.core_recordings.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(200).select("id", "title"))
q("so04_offset", "SELECT id FROM meta_issues WHERE status = 'OPEN' ORDER BY created_at, id LIMIT 1 OFFSET 17")(lambda t: t.meta_issues.where("status = 'OPEN'").orderBy("created_at", "id").offset(17).limit(1).select("id"))
q("so05_queue_pop", "SELECT seed_id, entity_name FROM sys_crawl_frontier WHERE state = 'PENDING' ORDER BY priority DESC, created_seq, seed_id LIMIT 1")(lambda t: t.sys_crawl_frontier.where("state = 'PENDING'").orderBy(F.desc("priority"), "created_seq", "seed_id").limit(1).select("seed_id", "entity_name"))
q("so06_score_slice", "SELECT candidate_id, final_ccs FROM sys_discovery_candidates ORDER BY final_ccs DESC, candidate_id LIMIT 25")(lambda t: t.sys_discovery_candidates.orderBy(F.desc("final_ccs"), "candidate_id").limit(25).select("candidate_id", "final_ccs"))
q("st01_union_of_ids", "SELECT musicbrainz_recording_id AS id FROM core_recordings WHERE musicbrainz_recording_id IS NOT NULL UNION SELECT release_group_mbid FROM core_albums WHERE release_group_mbid IS NOT NULL UNION SELECT barcode FROM core_albums WHERE barcode IS NOT NULL")(
    lambda t: t.core_recordings.select(F.col("musicbrainz_recording_id").alias("id")).unionByName(t.core_albums.select(F.explode(F.array("release_group_mbid", "barcode")).alias("id"))).where("id IS NOT NULL").distinct()
)
q("st02_union_all", "SELECT c_name AS name, 'a' AS via FROM customer UNION ALL SELECT s_name, 'b' FROM supplier UNION ALL SELECT p_name, 'c' FROM part WHERE p_size = 7")(
    lambda t: t.customer.select(F.col("c_name").alias("name"), F.lit("a").alias("via")).unionByName(t.supplier.select(F.col("s_name").alias("name"), F.lit("b").alias("via"))).unionByName(t.part.where("p_size = 7").select(F.col("p_name").alias("name"), F.lit("c").alias("via")))
)
q("st03_distinct_union", "SELECT primary_genre AS genre FROM sys_discovery_candidates UNION SELECT genre FROM core_recordings WHERE genre IS NOT NULL")(lambda t: t.sys_discovery_candidates.select(F.col("primary_genre").alias("genre")).union(t.core_recordings.where("genre IS NOT NULL").select("genre")).distinct().orderBy("genre"))
q("st04_tag_union", "SELECT id, list_sort(list_distinct(list_concat([coalesce(genre, '-')], [coalesce(subgenre, '-'), 'Rock']))) AS tags FROM core_recordings")(lambda t: t.core_recordings.select("id", F.array_sort(F.array_union(F.array(F.coalesce("genre", F.lit("-"))), F.array(F.coalesce("subgenre", F.lit("-")), F.lit("Rock")))).alias("tags")))

# Windows

q("wn02_current_value", "SELECT entity_id, field_name, value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY confidence DESC, id DESC) AS n FROM meta_evidence) x WHERE n = 1")(lambda t: t.meta_evidence.groupBy("entity_id", "field_name").agg(F.max_by("value", F.struct("confidence", "id")).alias("value")))
q("wn03_best_identifier", "SELECT entity_id, value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, id DESC) AS n FROM meta_evidence WHERE field_name = 'isrc' AND source_id IN ('SRC_MUSICBRAINZ', 'SRC_DEEZER', 'SRC_EMBEDDED_TAGS') AND confidence >= 0.8) x WHERE n = 1")(
    lambda t: t.meta_evidence.where("field_name = 'isrc' AND source_id IN ('SRC_MUSICBRAINZ', 'SRC_DEEZER', 'SRC_EMBEDDED_TAGS') AND confidence >= 0.8").groupBy("entity_id").agg(F.max_by("value", F.struct("confidence", "id")).alias("value"))
)
q("wn05_first_donor", "SELECT album_id, min(id) AS donor FROM core_recordings WHERE album_id IS NOT NULL AND genre IS NOT NULL GROUP BY album_id")(lambda t: t.core_recordings.where("album_id IS NOT NULL AND genre IS NOT NULL").groupBy("album_id").agg(F.min("id").alias("donor")))
q("wn06_best_donor", "SELECT album_id, id AS donor, quality_score FROM (SELECT r.album_id, r.id, v.quality_score, row_number() OVER (PARTITION BY r.album_id ORDER BY v.quality_score DESC, r.id) AS n FROM core_recordings r JOIN meta_validation v ON r.id = v.recording_id WHERE v.quality_score >= 0.9 AND r.album_id IS NOT NULL) x WHERE n = 1")(
    lambda t: scoped(t, False).where("quality_score >= 0.9 AND album_id IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("album_id").orderBy(F.desc("quality_score"), "id"))).where("n = 1").select("album_id", F.col("id").alias("donor"), "quality_score")
)
q("wn07_positional_decay", "SELECT p_partkey, unnest(range(0, len(string_split(p_name, ' ')))) AS pos, unnest(string_split(p_name, ' ')) AS token, round(power(0.75, unnest(range(0, len(string_split(p_name, ' '))))), 4) AS weight FROM part")(lambda t: t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "token")).select("p_partkey", F.col("pos").cast("long").alias("pos"), "token", F.round(F.pow(F.lit(0.75), "pos"), 4).alias("weight")))
q("wn08_winning_status", "SELECT e.id, CASE WHEN lower(trim(e.value)) = lower(trim(w.value)) THEN 'WINNING' ELSE 'SUPERSEDED' END AS status FROM meta_evidence e JOIN (SELECT entity_id, field_name, arg_max(value, id) AS value FROM meta_evidence GROUP BY entity_id, field_name) w ON e.entity_id = w.entity_id AND e.field_name = w.field_name")(
    lambda t: t.meta_evidence.join(t.meta_evidence.groupBy("entity_id", "field_name").agg(F.max_by("value", "id").alias("w")), ["entity_id", "field_name"]).select("id", F.when(F.lower(F.trim("value")) == F.lower(F.trim("w")), "WINNING").otherwise("SUPERSEDED").alias("status"))
)
q("wn10_page", "SELECT id FROM core_recordings ORDER BY id LIMIT 100 OFFSET 300")(lambda t: views.page(t.core_recordings.select("id"), [F.col("id")], 3))
