"""Queries over the domain: functions, resolution, taxonomy, propagation, discovery, research, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fixed, text
from tessera.operators import catalog as views
from tessera.operators import dedup, discovery, propagate
from tessera.operators import resolve as consensus
from tessera.operators.taxonomy import genre_consensus
from tessera.operators.fuzzy import alike
from tessera.operators.graph import cut
from tessera.plans import duck
from tessera.plans.registry import catalog_query as q
from tessera.plans.scans import AS_OF, OWNED, overview, owned, scoped, visible
from tessera.plans.totals import AFFINITY, COMPILATIONS, affinity, compilations
from tessera.sources.fixtures import Catalog

# Functions

_TITLES = "SELECT id, title FROM core_recordings"
q("fn03_edition_noise", f"SELECT id, {duck.edition('title')} AS clean FROM core_recordings")(lambda t: t.core_recordings.select("id", text.strip_edition_noise(F.col("title")).alias("clean")))
q("fn04_canonical_title", f"SELECT id, NOT regexp_matches(coalesce(title, ''), {duck.lit(fixed.EDITION_WORD)}) AS canonical FROM core_albums")(lambda t: t.core_albums.select("id", text.is_canonical_title(F.col("title")).alias("canonical")))
q("fn05_featured_artist", f"SELECT id, {duck.sanitize('name')} AS clean FROM core_artists")(lambda t: t.core_artists.select("id", text.sanitize_artist(F.col("name")).alias("clean")))
q("fn06_artist_key", f"SELECT id, {duck.artist_key('name')} AS key FROM core_artists")(lambda t: t.core_artists.select("id", text.artist_key(F.col("name")).alias("key")))
_STEM = duck.space(duck.sub(duck.sub(duck.sub("trim(regexp_replace(regexp_extract(filepath, '([^/]*)$', 1), '\\.[^.]*$', ''))", fixed.SEED_PREFIX), fixed.EDITION_NOISE), r"[._\-]", " "))
q("fn07_path_seed", f"SELECT asset_id, {_STEM} AS seed FROM core_asset_locations")(lambda t: t.core_asset_locations.select("asset_id", text.path_seed(F.col("filepath")).alias("seed")))
q("fn08_disc_number", f"SELECT asset_id, coalesce(try_cast(regexp_extract(lower(filepath), {duck.lit(fixed.DISC)}, 2) AS INT), 1) AS disc FROM core_asset_locations")(lambda t: t.core_asset_locations.select("asset_id", text.disc_number(F.col("filepath")).alias("disc")))
q("fn10_alnum_key", f"SELECT doc_id, md5({duck.alnum('text')}) AS key FROM documents")(lambda t: t.documents.select("doc_id", F.md5(text.alnum_key(F.col("text")).cast("binary")).alias("key")))
q("fn12_dates", f"SELECT id, {duck.date('value')} AS d FROM meta_evidence WHERE field_name = 'release_date'")(lambda t: t.meta_evidence.where("field_name = 'release_date'").select("id", text.normal_date(F.col("value")).alias("d")))
q("fn13_isrc", f"SELECT id, {duck.isrc('isrc')} AS code FROM core_recordings")(lambda t: t.core_recordings.select("id", text.normal_isrc(F.col("isrc")).alias("code")))
q("fn14_mbid", f"SELECT id, CASE WHEN regexp_extract(x, {duck.lit(fixed.UUID)}) <> '' THEN lower(regexp_extract(x, {duck.lit(fixed.UUID)})) ELSE substr(trim(x), 1, 64) END AS mbid FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'http://x/' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) ELSE coalesce(m, '') END AS x FROM (SELECT id, coalesce(musicbrainz_recording_id, '') AS m FROM core_recordings) a) b")(
    lambda t: t.core_recordings.select("id", F.coalesce("musicbrainz_recording_id", F.lit("")).alias("m")).select("id", text.normal_mbid(F.when(F.col("id") % 2 == 0, F.expr("concat('http://x/', substr(m, 1, 8), '-', substr(m, 9, 4), '-', substr(m, 13, 4), '-', substr(m, 17, 4), '-', substr(m, 21, 12))")).otherwise(F.col("m"))).alias("mbid"))
)
q("fn15_generic_text", f"SELECT id, {duck.text('value')} AS v FROM meta_evidence")(lambda t: t.meta_evidence.select("id", text.normal_text(F.col("value")).alias("v")))
q("fn16_title_case", f"SELECT id, {duck.title('value')} AS v FROM meta_evidence WHERE field_name = 'genre'")(lambda t: t.meta_evidence.where("field_name = 'genre'").select("id", text.title_case(F.col("value")).alias("v")))
q("fn18_split_tags", "SELECT id, CAST(p - 1 AS INT) AS pos, parts[p] AS tag FROM (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS p FROM (SELECT id, string_split(genre || ';' || coalesce(subgenre, 'x') || ',Live/Rock', ',') AS raw, regexp_split_to_array(genre || ';' || coalesce(subgenre, 'x') || ',Live/Rock', '[;|\\x00\\r\\n,/]+') AS parts FROM core_recordings WHERE genre IS NOT NULL) a) b")(
    lambda t: t.core_recordings.where("genre IS NOT NULL").select("id", F.posexplode(F.split(F.concat("genre", F.lit(";"), F.coalesce("subgenre", F.lit("x")), F.lit(",Live/Rock")), fixed.TAG_DELIMITERS)).alias("pos", "tag"))
)
SEARCH_TITLE = duck.space("replace(replace(" + duck.sub(duck.sub(duck.sub(duck.sub(duck.sub(duck.unquote("replace(replace(trim(coalesce(title, '')), '’', ''''), '`', '''')"), r"[–—\-]", " "), r"(?i)\bPart\s+I\s*[\-–—]?\s*V\b", "Part 1-5"), r"(?i)\bPart\s+VI\s*[\-–—]?\s*IX\b", "Part 6-9"), fixed.SEARCH_NOISE), r"(?i)\s+(feat\.?|ft\.?)\s+.*$") + ", '/', ' '), '&', 'and')")
q("fn19_search_title", f"SELECT id, {SEARCH_TITLE} AS title FROM core_recordings")(lambda t: t.core_recordings.select("id", text.search_title(F.col("title")).alias("title")))
CORE_TITLE = duck.space(duck.sub("trim(" + duck.sub("trim(" + duck.sub(SEARCH_TITLE, r"\s*[(\[{].*?[)\]}]\s*", " ") + ")", r"\s*:\s*.*$") + ")", r"\.+$"))
q("fn20_core_title", f"SELECT id, {CORE_TITLE} AS core FROM core_recordings")(lambda t: t.core_recordings.select("id", text.core_title(F.col("title")).alias("core")))
q("fn21_query_text", f"SELECT id, {duck.space(duck.sub('coalesce(title, NULL, ' + duck.lit('') + ')', r'[+\-&|!(){}\[\]^~*?:\\/]', ' '))} AS clean FROM core_recordings")(lambda t: t.core_recordings.select("id", text.query_text(F.col("title")).alias("clean")))
q("fn22_ids", "SELECT candidate_id, 'cand_' || substr(md5(title || artist_name), 1, 10) AS cid, sha256(title || '|' || artist_name) AS hash FROM sys_discovery_candidates")(lambda t: t.sys_discovery_candidates.select("candidate_id", text.candidate_id(F.col("title"), F.col("artist_name")).alias("cid"), F.sha2(F.concat_ws("|", "title", "artist_name").cast("binary"), 256).alias("hash")))
q("fn22_query_hash", "SELECT p_partkey, sha256('fmt=json&name=' || p_name) AS hash FROM part")(lambda t: t.part.select("p_partkey", text.query_hash(F.create_map(F.lit("name"), F.col("p_name"), F.lit("token"), F.lit("s"), F.lit("fmt"), F.lit("json"))).alias("hash")))
q("fn23_year", "SELECT id, try_cast(substr(coalesce(original_release_date, release_date), 1, 4) AS INT) AS y FROM core_recordings")(lambda t: t.core_recordings.select("id", text.year(F.coalesce("original_release_date", "release_date")).alias("y")))
q("fn24_clamp_round", "SELECT p_partkey, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, p_retailprice / 2000.0::DOUBLE)), 3) AS s FROM part")(lambda t: t.part.select("p_partkey", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p_retailprice") / 2000.0)), 3).alias("s")))
q("fn25_artist_fallback", f"SELECT id, {duck.fallback('name', 1)} AS genre, {duck.fallback('name', 2)} AS subgenre FROM (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'The Strokes' WHEN 1 THEN 'Canned Heat' WHEN 2 THEN 'Caravan' WHEN 3 THEN 'Patti Smith' WHEN 4 THEN NULL ELSE c_name END AS name FROM customer) x")(
    lambda t: t.customer.select(F.col("c_custkey").alias("id"), F.expr("CASE c_custkey % 6 WHEN 0 THEN 'The Strokes' WHEN 1 THEN 'Canned Heat' WHEN 2 THEN 'Caravan' WHEN 3 THEN 'Patti Smith' WHEN 4 THEN NULL ELSE c_name END").alias("name")).select("id", text.fallback_genres(F.col("name"))[0].alias("genre"), text.fallback_genres(F.col("name"))[1].alias("subgenre"))
)
q("fn26_step_functions", "SELECT p_partkey, CAST(CASE WHEN p_size - 1 = 0 THEN 1.0 WHEN p_size - 1 < 5 THEN 0.85 WHEN p_size - 1 < 20 THEN 0.65 ELSE 0.35 END AS DOUBLE) AS deficit, CAST(CASE WHEN p_size >= 30 THEN 0.4 WHEN p_size >= 15 THEN 0.6 WHEN p_size >= 5 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS saturation FROM part")(lambda t: t.part.select("p_partkey", text.deficit(F.col("p_size") - 1).alias("deficit"), text.saturation(F.col("p_size")).alias("saturation")))
q("fn27_snooze_until", f"SELECT seq, TIMESTAMP '{AS_OF}' + to_days(CAST(seq % 30 AS INT)) AS snoozed_until FROM sys_discovery_candidates")(lambda t: t.sys_discovery_candidates.select("seq", (F.lit(AS_OF).cast("timestamp") + F.make_interval(days=(F.col("seq") % 30).cast("int"))).alias("snoozed_until")))
q("fn28_json", """SELECT event_id, '{"type":"' || event_type || '","k":' || regexp_extract(props, '([0-9]+)', 1) || '}' AS j, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events""")(lambda t: t.events.select("event_id", "event_type", F.from_json("props", "k int").alias("p")).select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("p.k").alias("k"))).alias("j"), F.col("p.k").alias("k")))
q("fn29_inception", "SELECT id, try_cast(substr(d, 1, 4) AS INT) AS y FROM (SELECT id, coalesce(release_date, 'unknown') AS d FROM core_recordings) x")(lambda t: t.core_recordings.select("id", text.year(F.coalesce("release_date", F.lit("unknown"))).alias("y")))
q("fn30_uri_tail", "SELECT page_id, list_last(string_split(url, '/')) AS tail FROM pages")(lambda t: t.pages.select("page_id", F.element_at(F.split("url", "/"), -1).alias("tail")))
q("fn01_exact_functions", r"SELECT p_partkey, trim(p_name) AS nfc, lower(p_name) AS folded, trim(regexp_replace(lower(trim(p_name)), '[\s\-_]+', ' ', 'g')) AS alias, trim(regexp_replace(regexp_replace(lower(p_name), '[^\w\s-]', '', 'g'), '[-\s]+', '_', 'g'), '_') AS slug FROM part")(lambda t: exact_functions(t))
q("fn09_similarity")(lambda t: similarities(t))


def exact_functions(t: Catalog) -> DataFrame:
    """Unicode-exact forms: composed, folded, alias, slug; the table's names are ASCII."""
    from tessera.functions import exact

    return t.part.select("p_partkey", exact.nfc("p_name").alias("nfc"), exact.casefold("p_name").alias("folded"), exact.tag_alias("p_name").alias("alias"), exact.slug("p_name").alias("slug"))


def similarities(t: Catalog) -> DataFrame:
    """Likeness of two texts in both orders."""
    from tessera.functions import exact

    return t.part.select("p_partkey", exact.similarity("p_name", "p_type").alias("ab"), exact.similarity("p_type", "p_name").alias("ba"))


# Resolution

_FIRST_CURRENT = "(SELECT entity_id, field_name, arg_max(value, struct_pack(a := confidence, b := id)) AS old_value FROM meta_evidence GROUP BY entity_id, field_name)"


def passes(source: str = "meta_evidence") -> str:
    """SQL of the candidates (cands) of facts in a table."""
    return f"""
facts AS (SELECT *, trim(value) AS raw, {duck.normalise('field_name', 'trim(value)')} AS norm, {duck.family('source_id')} AS family FROM {source} WHERE coalesce(trim(value), '') <> '' AND upper(trim(value)) NOT IN ('NONE', 'NULL')),
by_family AS (SELECT entity_id, field_name, norm, family, avg(confidence * positional_weight) * max({duck.prior('field_name', 'family')}) AS score, min(id) AS first_id, arg_min(raw, id) AS raw FROM facts WHERE norm <> '' GROUP BY entity_id, field_name, norm, family),
cands AS (SELECT entity_id, field_name, norm, greatest(0.01, round(sum(score), 9)) AS trust, list_sort(list(family)) AS families, min(first_id) AS first_id, CASE WHEN field_name IN ('genre', 'subgenre') THEN norm ELSE arg_min(raw, first_id) END AS value FROM by_family GROUP BY entity_id, field_name, norm)"""


def resolution(source: str = "meta_evidence", current: str = _FIRST_CURRENT, targets: str | None = None) -> str:
    """SQL of one decision for each entity and field of a table of facts, and of targets."""
    seen = f"(SELECT entity_id, field_name, bool_or(source_id = 'SRC_USER') AS by_user FROM {source} GROUP BY entity_id, field_name)"
    wanted = seen if targets is None else f"(SELECT entity_id, field_name, by_user FROM {targets} g LEFT JOIN {seen} s USING (entity_id, field_name))"
    return f"""WITH {passes(source)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY trust DESC, len(families) DESC, first_id) AS n FROM cands),
won AS (SELECT * FROM ranked WHERE n = 1),
lost AS (SELECT entity_id, field_name, list(struct_pack(value := value, families := families) ORDER BY n) AS rest FROM ranked WHERE n > 1 GROUP BY entity_id, field_name),
rows AS (SELECT e.entity_id, e.field_name, l.lock_state, cur.old_value, won.value AS won, won.trust, won.families, lost.rest,
    CASE WHEN l.lock_state = 'MANUAL' THEN 'Field locked as MANUAL by user' WHEN l.lock_state = 'PROTECTED' AND NOT coalesce(e.by_user, FALSE) THEN 'Field is PROTECTED and no user evidence present'
      WHEN e.by_user IS NULL THEN 'No evidence facts available' WHEN won.value IS NULL THEN 'All evidence values were invalid or placeholders' END AS kept
  FROM {wanted} e LEFT JOIN meta_locks l ON e.entity_id = l.entity_id AND e.field_name = l.field_name LEFT JOIN {current} cur ON e.entity_id = cur.entity_id AND e.field_name = cur.field_name
  LEFT JOIN won ON e.entity_id = won.entity_id AND e.field_name = won.field_name LEFT JOIN lost ON e.entity_id = lost.entity_id AND e.field_name = lost.field_name)
SELECT entity_id, field_name, old_value, CASE WHEN kept IS NULL THEN won ELSE old_value END AS selected_value, CASE WHEN kept IS NULL THEN trust END AS trust,
  coalesce(kept, 'Selected \'\'' || won || '\'\' (Trust weight: ' || printf('%.2f', round(trust + 1e-7, 2)) || ', Families: [' || array_to_string(families, ', ') || '])') AS reason,
  CASE WHEN kept IS NULL AND rest IS NOT NULL THEN CAST(to_json(rest) AS VARCHAR) ELSE '[]' END AS rejected FROM rows"""


_PASS = passes()
q("dm01_candidates", f"WITH {_PASS} SELECT entity_id, field_name, norm, value, trust, array_to_string(families, ',') AS families, first_id FROM cands")(lambda t: consensus.candidates(t.meta_evidence).withColumn("families", F.array_join("families", ",")))


def current_values(t: Catalog) -> DataFrame:
    return t.meta_evidence.groupBy("entity_id", "field_name").agg(F.max_by("value", F.struct("confidence", "id")).alias("value"))


@q("dm01_resolve_field", resolution())
def resolve_field(t: Catalog) -> DataFrame:
    return consensus.resolve(t.meta_evidence, t.meta_locks, current_values(t))


q("wn01_winner", f"WITH {_PASS} SELECT entity_id, field_name, value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY trust DESC, len(families) DESC, first_id) AS n FROM cands) c WHERE n = 1")(
    lambda t: consensus.candidates(t.meta_evidence).withColumn("n", F.row_number().over(Window.partitionBy("entity_id", "field_name").orderBy(F.desc("trust"), F.desc(F.size("families")), "first_id"))).where("n = 1").select("entity_id", "field_name", "value")
)
q("dm02_normalisers", f"SELECT id, {duck.normalise('field_name', 'value')} AS norm FROM meta_evidence")(lambda t: t.meta_evidence.select("id", text.normalise(F.col("field_name"), F.col("value")).alias("norm")))
q("dm03_artist_rule")(lambda t: artist_rule(t))


def artist_facts(t: Catalog) -> DataFrame:
    """Facts about recordings' artists: what the catalog has, what was proposed, and what a tenth of the users said."""
    fact = lambda rows, source, confidence: rows.select("id", "entity_id", F.lit("artist").alias("field_name"), "value", F.lit(source).alias("source_id"), F.lit(confidence).alias("confidence"), F.lit(1.0).alias("positional_weight"))
    named = t.core_recordings.join(t.core_artists.select(F.col("id").alias("artist_id"), F.col("name").alias("value")), "artist_id").select((F.col("id") * 3).alias("id"), F.col("id").alias("entity_id"), "value")
    asked = t.meta_proposals.where("field_name IN ('artist', 'album')").select((F.col("entity_id") * 3 + 1).alias("id"), "entity_id", F.col("selected_value").alias("value"))
    said = asked.where("entity_id % 10 = 1").withColumn("id", F.col("id") + 1)
    return fact(named, "SRC_EMBEDDED_TAGS", 0.9).unionByName(fact(asked, "SRC_LASTFM", 0.8)).unionByName(fact(said, "SRC_USER", 0.8))


def artist_rule(t: Catalog) -> DataFrame:
    """Candidates of the field artist, penalised where they are unlike the artist of the recording and no user said them."""
    names = t.core_recordings.select(F.col("id").alias("entity_id"), "artist_id").join(t.core_artists.select(F.col("id").alias("artist_id"), F.lower("name").alias("reference")), "artist_id")
    return consensus.candidates(artist_facts(t), references=names.select("entity_id", "reference"))


q("dm04_trust_priors", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{k}', CAST({v} AS DOUBLE))" for f, table in fixed.FIELD_PRIORS.items() for k, v in table.items()) + ") p(field_name, family, prior)")(lambda t: t.spark.createDataFrame([(f, k, v) for f, table in fixed.FIELD_PRIORS.items() for k, v in table.items()], "field_name string, family string, prior double"))
q("dm08_purge_codes", f"WITH {_PASS} SELECT entity_id, count(*) FILTER (WHERE {duck.isrc('value')} = '') AS purged, count(*) FILTER (WHERE {duck.isrc('value')} <> '') AS kept FROM meta_evidence WHERE field_name = 'isrc' GROUP BY entity_id")(
    lambda t: t.meta_evidence.where("field_name = 'isrc'").withColumn("code", text.normal_isrc(F.col("value"))).groupBy("entity_id").agg(F.count_if(F.col("code") == "").alias("purged"), F.count_if(F.col("code") != "").alias("kept"))
)
q("dm28_manual_override", "SELECT entity_id, field_name, arg_max(trim(value), id) AS selected_value FROM meta_evidence WHERE source_id = 'SRC_USER' AND field_name = 'country' AND trim(value) <> '' AND lower(trim(value)) NOT IN ('none', 'null') AND NOT EXISTS (SELECT 1 FROM meta_locks l WHERE l.entity_id = meta_evidence.entity_id AND l.field_name = 'country' AND l.lock_state = 'MANUAL') GROUP BY entity_id, field_name")(
    lambda t: override(t)
)


def override(t: Catalog) -> DataFrame:
    """A user's last fact decides alone, unless the field is locked by hand."""
    facts = consensus.usable(t.meta_evidence.where("source_id = 'SRC_USER' AND field_name = 'country'"))
    last = facts.groupBy("entity_id", "field_name").agg(F.max_by("id", "id").alias("id"))
    one = t.meta_evidence.join(last.select("id"), "id", "left_semi").join(t.meta_locks.where("lock_state = 'MANUAL'"), ["entity_id", "field_name"], "left_anti")
    return consensus.resolve(one, t.meta_locks, current_values(t)).select("entity_id", "field_name", "selected_value")


q("dm43_evidence_fetch", "SELECT id, value FROM meta_evidence WHERE entity_id = 5 AND field_name = 'genre'")(lambda t: t.meta_evidence.where("entity_id = 5 AND field_name = 'genre'").select("id", "value"))
q("dm44_current_value", "SELECT r.id, 'title' AS field_name, r.title AS value FROM core_recordings r UNION ALL SELECT r.id, 'artist', a.name FROM core_recordings r LEFT JOIN core_artists a ON r.artist_id = a.id UNION ALL SELECT r.id, 'album', b.title FROM core_recordings r LEFT JOIN core_albums b ON r.album_id = b.id")(
    lambda t: t.core_recordings.join(t.core_artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist")), "artist_id", "left").join(t.core_albums.select(F.col("id").alias("album_id"), F.col("title").alias("album")), "album_id", "left").select("id", "title", "artist", "album").unpivot("id", ["title", "artist", "album"], "field_name", "value")
)
q("dm45_lock_map", "SELECT e.entity_id, e.field_name, coalesce(l.lock_state, 'AUTOMATIC') AS lock_state FROM (SELECT DISTINCT entity_id, field_name FROM meta_evidence) e LEFT JOIN meta_locks l ON e.entity_id = l.entity_id AND e.field_name = l.field_name")(lambda t: t.meta_evidence.select("entity_id", "field_name").distinct().join(t.meta_locks, ["entity_id", "field_name"], "left").select("entity_id", "field_name", F.coalesce("lock_state", F.lit("AUTOMATIC")).alias("lock_state")))

# Duplicates

_DEDUP = f"""SELECT i.asset_id, CASE WHEN i.md5_file IN (SELECT md5_file FROM core_assets WHERE channels = 1) THEN 'FILE_DUPLICATE' WHEN i.audio_stream_hash IN (SELECT audio_stream_hash FROM core_assets WHERE channels = 1 AND file_size % 40 = 0) THEN 'STREAM_DUPLICATE'
 WHEN EXISTS (SELECT 1 FROM core_assets p WHERE p.channels = 1 AND CAST(p.recording_id % 3000 AS VARCHAR) = i.fingerprint AND abs(p.duration - i.duration) <= 2.0) THEN 'FINGERPRINT_DUPLICATE'
 WHEN EXISTS (SELECT 1 FROM sys_discovery_candidates c WHERE c.title <> '' AND lower(c.title) = lower(trim(i.title)) AND {duck.artist_key('c.artist_name')} = {duck.artist_key('i.artist')}) THEN 'TITLE_ARTIST_DUPLICATE' END AS label
 FROM (SELECT a.*, CAST(a.recording_id % 3000 AS VARCHAR) AS fingerprint, r.title, ar.name AS artist FROM core_assets a JOIN core_recordings r ON a.recording_id = r.id LEFT JOIN core_artists ar ON r.artist_id = ar.id WHERE a.channels = 2) i"""


@q("dm12_duplicates", _DEDUP)
def duplicates(t: Catalog) -> DataFrame:
    fp = (F.col("recording_id") % 3000).cast("string").alias("fingerprint")
    titles = t.core_recordings.select(F.col("id").alias("recording_id"), "title", "artist_id").join(t.core_artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist")), "artist_id", "left")
    incoming = t.core_assets.where("channels = 2").select("*", fp)
    store = t.core_assets.where("channels = 1")
    files = store.select("md5_file", F.when(F.col("file_size") % 40 == 0, F.col("audio_stream_hash")).alias("audio_stream_hash"))
    return dedup.evaluate(incoming, files, store.select(fp, "duration"), t.sys_discovery_candidates.select("title", F.col("artist_name").alias("artist")), titles)


q("wn09_first_come")(lambda t: dedup.first_come(t.core_assets.select("asset_id", "md5_file", F.concat_ws("/", "audio_stream_hash", "duration").alias("stream")), "asset_id", ["md5_file", "stream"]))

# Taxonomy

GENRES = f"""WITH tags AS (SELECT entity_id, id AS seq, value AS tag, confidence * weight AS w, source_id, {duck.space("lower(value)")} AS clean FROM {{source}}),
scores AS (SELECT entity_id, clean, round(sum(w * {duck.tag_weight('source_id')}), 6) AS score, min(seq) AS first, coalesce(arg_min(trim(tag), seq) FILTER (WHERE tag <> lower(tag)), arg_min(trim(tag), seq)) AS spelled FROM tags WHERE length(clean) >= 2 AND NOT regexp_matches(clean, '^[0-9]+$') GROUP BY entity_id, clean),
top AS (SELECT *, {duck.title('spelled')} AS title, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, first) AS n FROM scores),
best AS (SELECT entity_id, max(title) FILTER (WHERE n = 1) AS one, max(title) FILTER (WHERE n = 2) AS two, max(score) FILTER (WHERE n = 1) AS score FROM top GROUP BY entity_id),
x AS (SELECT a.id AS entity_id, {duck.fallback('a.name', 1)} AS main, {duck.fallback('a.name', 2)} AS sub, one, two, score FROM {{artists}} a LEFT JOIN best ON best.entity_id = a.id),
y AS (SELECT *, CASE WHEN one IS NULL OR lower(one) = 'unclassified' THEN main ELSE one END AS genre FROM x),
z AS (SELECT *, CASE WHEN one IS NULL THEN sub WHEN two IS NOT NULL AND lower(two) <> 'unclassified' AND lower(two) <> lower(genre) THEN two ELSE sub END AS second FROM y)
SELECT entity_id, genre, CASE WHEN one IS NOT NULL AND lower(second) = lower(genre) THEN CASE WHEN lower(sub) <> lower(genre) THEN sub ELSE 'Alternative Rock' END ELSE second END AS subgenre, CASE WHEN one IS NULL THEN CAST(0.5 AS DOUBLE) ELSE round(least(0.99::DOUBLE, greatest(0.40::DOUBLE, 0.40 + score * 0.10)), 2) END AS confidence FROM z"""


@q("dm13_genre_consensus", GENRES.format(source="(SELECT *, 1.0 AS weight FROM meta_evidence WHERE field_name = 'genre')", artists="core_artists"))
def genres(t: Catalog) -> DataFrame:
    tags = t.meta_evidence.where("field_name = 'genre'").select("entity_id", F.col("id").alias("seq"), F.col("value").alias("tag"), F.col("confidence").alias("weight"), F.col("source_id").alias("source"))
    return genre_consensus(tags, t.core_artists.select(F.col("id").alias("entity_id"), F.col("name").alias("artist")))


q("wn04_top_two", "SELECT entity_id, max(tag) FILTER (WHERE n = 1) AS one, max(tag) FILTER (WHERE n = 2) AS two FROM (SELECT entity_id, value AS tag, row_number() OVER (PARTITION BY entity_id ORDER BY round(sum(confidence), 6) DESC, value) AS n FROM meta_evidence WHERE field_name = 'genre' GROUP BY entity_id, value) x GROUP BY entity_id")(
    lambda t: t.meta_evidence.where("field_name = 'genre'").groupBy("entity_id", "value").agg(F.round(F.sum("confidence"), 6).alias("s")).withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("s"), "value"))).groupBy("entity_id").agg(F.max(F.when(F.col("n") == 1, F.col("value"))).alias("one"), F.max(F.when(F.col("n") == 2, F.col("value"))).alias("two"))
)


def pooled_tags(t: Catalog) -> DataFrame:
    """Genre facts of a recording: its album's unless that is a compilation, its own weighing 1.6 there; else its own."""
    r = t.core_recordings.select("id", "album_id")
    e = t.meta_evidence.where("field_name = 'genre' AND coalesce(value, '') <> ''").select(F.col("entity_id").alias("sid"), F.col("id").alias("seq"), F.col("value").alias("tag"), "confidence", F.col("source_id").alias("source"))
    shared = compilations(t).where("NOT compilation").select("album_id")
    pooled = r.join(shared, "album_id").join(r.select("album_id", F.col("id").alias("sid")), "album_id").join(e, "sid")
    alone = r.join(shared, "album_id", "left_anti").join(e, F.col("id") == F.col("sid"))
    weight = F.col("confidence") * F.when(F.col("id") == F.col("sid"), 1.6).otherwise(1.0)
    columns = [F.col("id").alias("entity_id"), "seq", "tag", "source"]
    return pooled.select(*columns, weight.alias("weight")).unionByName(alone.select(*columns, F.col("confidence").alias("weight")))


_POOL = f"(SELECT r.id AS entity_id, e.id, e.value, e.confidence, e.source_id, CASE WHEN e.entity_id = r.id THEN 1.6 ELSE 1.0 END AS weight FROM core_recordings r JOIN core_recordings s ON r.album_id = s.album_id JOIN meta_evidence e ON e.entity_id = s.id WHERE e.field_name = 'genre' AND e.value <> '' AND r.album_id IN (SELECT album_id FROM ({COMPILATIONS}) c WHERE NOT compilation) UNION ALL SELECT r.id, e.id, e.value, e.confidence, e.source_id, 1.0 FROM core_recordings r JOIN meta_evidence e ON e.entity_id = r.id WHERE e.field_name = 'genre' AND e.value <> '' AND (r.album_id IS NULL OR r.album_id NOT IN (SELECT album_id FROM ({COMPILATIONS}) c WHERE NOT compilation)))"
_TAGGED = "(SELECT r.id, a.name FROM core_recordings r LEFT JOIN core_artists a ON r.artist_id = a.id)"


@q("dm14_album_pooled_genre", GENRES.format(source=_POOL, artists=_TAGGED))
def album_genre(t: Catalog) -> DataFrame:
    artists = t.core_recordings.select(F.col("id").alias("entity_id"), "artist_id").join(t.core_artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist")), "artist_id", "left").select("entity_id", "artist")
    return genre_consensus(pooled_tags(t), artists)


# Propagation

_DONORS = "SELECT * FROM (SELECT r.album_id, r.id AS donor, a.name AS artist, b.title AS album, r.release_date, b.original_release_date, r.genre, r.subgenre, c.compilation, row_number() OVER (PARTITION BY r.album_id ORDER BY v.quality_score DESC, r.id) AS n FROM core_recordings r JOIN meta_validation v ON v.recording_id = r.id JOIN (" + COMPILATIONS + ") c ON c.album_id = r.album_id LEFT JOIN core_artists a ON a.id = r.artist_id LEFT JOIN core_albums b ON b.id = r.album_id WHERE v.quality_score >= 0.9) d WHERE n = 1 AND genre IS NOT NULL AND genre <> 'Unclassified'"


@q(
    "dm16_sibling_facts",
    f"SELECT s.id AS entity_id, f.field_name, f.value, f.confidence FROM core_recordings s LEFT JOIN meta_validation v ON v.recording_id = s.id JOIN (SELECT album_id, donor, 'album' AS field_name, album AS value, 0.92::DOUBLE AS confidence FROM ({_DONORS}) d UNION ALL SELECT album_id, donor, 'release_date', release_date, 0.92 FROM ({_DONORS}) d UNION ALL SELECT album_id, donor, 'original_release_date', original_release_date, 0.99 FROM ({_DONORS}) d UNION ALL SELECT album_id, donor, 'genre', genre, 0.85 FROM ({_DONORS}) d UNION ALL SELECT album_id, donor, 'subgenre', nullif(subgenre, 'Unclassified'), 0.85 FROM ({_DONORS}) d UNION ALL SELECT album_id, donor, 'artist', artist, 0.92 FROM ({_DONORS}) d WHERE NOT compilation) f ON f.album_id = s.album_id AND f.donor <> s.id WHERE coalesce(v.quality_score, 0.0) < 1.0 AND coalesce(f.value, '') <> '' AND NOT EXISTS (SELECT 1 FROM meta_locks l WHERE l.entity_id = s.id AND l.field_name = f.field_name AND l.lock_state IN ('MANUAL', 'PROTECTED'))",
)
def sibling_facts(t: Catalog) -> DataFrame:
    rows = scoped(t, False)
    best = rows.where("quality_score >= 0.9").join(compilations(t).select("album_id", "compilation"), "album_id").withColumn("n", F.row_number().over(Window.partitionBy("album_id").orderBy(F.desc("quality_score"), "id"))).where("n = 1")
    best = best.join(t.core_artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist")), "artist_id", "left").drop("original_release_date")
    donors = best.join(t.core_albums.select(F.col("id").alias("album_id"), F.col("title").alias("album"), "original_release_date"), "album_id", "left").select("album_id", F.col("id").alias("donor"), "artist", "album", "release_date", "original_release_date", "genre", "subgenre", "compilation")
    return propagate.sibling_facts(donors, rows.where("coalesce(quality_score, 0.0) < 1.0").select("album_id", F.col("id").alias("entity_id")), t.meta_locks)


q("dm18_evidence_buffer", "SELECT entity_id, field_name, source_id, value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name, source_id, lower(trim(value)) ORDER BY id) AS n FROM (SELECT id, entity_id, field_name, source_id, trim(value) AS value, least(greatest(confidence * 2 - 0.3, 0.0), 1.0) AS confidence FROM meta_evidence WHERE id % 2 = 0) a WHERE coalesce(value, '') <> '' AND upper(value) NOT IN ('NONE', 'NULL', 'UNKNOWN')) b WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM meta_evidence k WHERE k.id % 2 = 1 AND k.entity_id = b.entity_id AND k.field_name = b.field_name AND k.source_id = b.source_id AND lower(trim(k.value)) = lower(b.value))")(
    lambda t: propagate.buffer_facts(t.meta_evidence.where("id % 2 = 0").withColumn("confidence", F.col("confidence") * 2 - 0.3), t.meta_evidence.where("id % 2 = 1"))
)

# Discovery


@q("dm19_ownership_sweep", f"SELECT candidate_id, CASE WHEN state NOT IN ('ACQUIRED', 'IGNORED') AND candidate_id IN ({OWNED}) THEN 'ACQUIRED' ELSE state END AS state FROM sys_discovery_candidates")
def ownership_sweep(t: Catalog) -> DataFrame:
    from tessera.operators.mutate import update_keys

    return update_keys(t.sys_discovery_candidates, owned(t), ["candidate_id"], {"state": F.lit("ACQUIRED")}, unless=F.col("state").isin("ACQUIRED", "IGNORED")).select("candidate_id", "state")


_SCORES = """SELECT candidate_id, v_rel, v_graph, v_def, p_sat, fatigue, round(round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({rel} * v_rel + {coll} * 0.78 + {graph} * v_graph + {def_} * v_def) * p_sat * fatigue)), 9), 3) AS ccs, round(round(0.04 + (1.0 - v_graph) * 0.10, 9), 3) AS margin FROM (SELECT c.candidate_id,
 CASE WHEN coalesce(c.primary_genre, '') IN ('', 'Unclassified') THEN 0.40::DOUBLE WHEN coalesce(g.n, 0) = 0 THEN 0.30 ELSE round(least(1.0::DOUBLE, 0.40 + CAST(g.n AS DOUBLE) / 100 * 0.40 + CASE WHEN coalesce(c.primary_subgenre, '') IN ('', 'Unclassified') THEN 0 ELSE CAST(coalesce(s.n, 0) AS DOUBLE) / 20 * 0.20 END), 2) END AS v_rel,
 CASE WHEN coalesce(trim(c.release_group_mbid), '') <> '' THEN 0.25::DOUBLE ELSE 0.20 END AS v_graph,
 CASE WHEN coalesce(c.primary_subgenre, '') IN ('', 'Unclassified') THEN 0.50::DOUBLE WHEN coalesce(s.n, 0) = 0 THEN 1.0 WHEN s.n < 5 THEN 0.85 WHEN s.n < 20 THEN 0.65 ELSE 0.35 END AS v_def,
 CASE WHEN coalesce(a.n, 0) >= 30 THEN 0.40::DOUBLE WHEN a.n >= 15 THEN 0.60 WHEN a.n >= 5 THEN 0.80 ELSE 1.0 END AS p_sat, CASE WHEN p.candidate_id IS NOT NULL THEN 0.9::DOUBLE ELSE 1.0 END AS fatigue
 FROM sys_discovery_candidates c LEFT JOIN (SELECT primary_genre, count(*) AS n FROM vw_recording_overview GROUP BY primary_genre) g ON g.primary_genre = c.primary_genre LEFT JOIN (SELECT primary_subgenre, count(*) AS n FROM vw_recording_overview GROUP BY primary_subgenre) s ON s.primary_subgenre = c.primary_subgenre
 LEFT JOIN (SELECT lower(artist_name) AS artist_name, count(*) AS n FROM vw_recording_overview GROUP BY 1) a ON a.artist_name = lower(trim(c.artist_name)) LEFT JOIN sys_discovery_scores p ON p.candidate_id = c.candidate_id) x"""


def _strategy(name: str) -> str:
    w = discovery.weights(name)
    told = f"""CAST(to_json(struct_pack(active_strategy := '{name}', scores := struct_pack(v_rel := v_rel, v_coll := 0.78::DOUBLE, v_graph := v_graph, v_def := v_def), penalties := struct_pack(p_sat := p_sat, fatigue := fatigue), uncertainty_margin := margin)) AS VARCHAR)"""
    return f"SELECT *, {told} AS explanation FROM ({_scores(name, w)}) e"


def _scores(name: str, w: dict[str, float]) -> str:
    return _SCORES.format(rel=f"{w['rel']!r}::DOUBLE", coll=f"{w['coll']!r}::DOUBLE", graph=f"{w['graph']!r}::DOUBLE", def_=f"{w['def']!r}::DOUBLE")


for _name in fixed.STRATEGIES:
    q(f"dm21_scores_{_name.lower().replace(' ', '_')}", _strategy(_name))(lambda t, name=_name: discovery.score_candidates(t.sys_discovery_candidates, overview(t), t.sys_discovery_scores, strategy=name))
q("dm22_strategies", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{k}', CAST({v} AS DOUBLE))" for s, w in fixed.STRATEGIES.items() for k, v in w.items()) + ") s(strategy, part, weight)")(lambda t: t.spark.createDataFrame([(s, k, v) for s, w in fixed.STRATEGIES.items() for k, v in w.items()], "strategy string, part string, weight double"))
_TOP = f"SELECT candidate_id, ccs FROM ({_strategy('Balanced Curator')}) z WHERE candidate_id IN (SELECT candidate_id FROM sys_discovery_candidates WHERE state NOT IN ('IGNORED', 'ACQUIRED') AND (state <> 'SNOOZED' OR snoozed_until IS NULL OR snoozed_until <= TIMESTAMP '{AS_OF}')) AND candidate_id NOT IN (SELECT candidate_id FROM sys_discovery_candidates c WHERE release_group_mbid IN (SELECT musicbrainz_recording_id FROM core_recordings WHERE musicbrainz_recording_id IS NOT NULL UNION SELECT release_group_mbid FROM core_albums WHERE release_group_mbid IS NOT NULL) OR EXISTS (SELECT 1 FROM core_recordings r JOIN core_artists a ON r.artist_id = a.id WHERE r.title <> '' AND {duck.alnum('r.title')} = {duck.alnum('c.title')} AND {duck.alnum('a.name')} = {duck.alnum('c.artist_name')})) ORDER BY ccs DESC, candidate_id LIMIT 50"


@q("dm23_discovery", _TOP)
def discover(t: Catalog) -> DataFrame:
    """Visible candidates that aren't owned, scored, the best fifty."""
    open_ = visible(t.sys_discovery_candidates, AS_OF).join(owned(t), "candidate_id", "left_anti")
    return discovery.score_candidates(open_, overview(t), t.sys_discovery_scores).select("candidate_id", "ccs").orderBy(F.desc("ccs"), "candidate_id").limit(50)


_BLOCK = " OR ".join(f"contains(lower(p_name), '{w}')" for w in fixed.TITLE_BLOCKLIST)


@q("dm24_admission", f"SELECT DISTINCT 'cand_' || substr(md5(p_name || p_brand), 1, 10) AS candidate_id, p_name AS title, p_brand AS artist_name, g AS genre, coalesce(f.score, 0.8) AS ccs FROM (SELECT p_name, p_brand, min(CASE p_type WHEN 'ECONOMY' THEN 'Rock' WHEN 'SMALL' THEN 'Jazz' ELSE 'Noise' END) AS g FROM part GROUP BY p_name, p_brand) x LEFT JOIN ({AFFINITY}) f ON f.genre = lower(g) WHERE NOT ({_BLOCK})")
def admission(t: Catalog) -> DataFrame:
    genre = F.when(F.col("p_type") == "ECONOMY", "Rock").when(F.col("p_type") == "SMALL", "Jazz").otherwise("Noise")
    found = t.part.groupBy(F.col("p_name").alias("title"), F.col("p_brand").alias("artist_name")).agg(F.min(genre).alias("genre"))
    lib = t.core_recordings.join(t.core_artists.select(F.col("id").alias("artist_id"), "name"), "artist_id").where("title <> ''").select(text.alnum_key(F.col("title")).alias("kt"), text.alnum_key(F.col("name")).alias("ka"))
    return discovery.admit(found, t.sys_discovery_candidates, lib, affinity(t.core_recordings))


q("dm20_exact_ownership", "SELECT c.candidate_id, c.release_group_mbid IN (SELECT release_group_mbid FROM core_albums WHERE release_group_mbid IS NOT NULL) AS by_id FROM sys_discovery_candidates c WHERE c.release_group_mbid IS NOT NULL")(lambda t: t.sys_discovery_candidates.where("release_group_mbid IS NOT NULL").join(t.core_albums.where("release_group_mbid IS NOT NULL").select("release_group_mbid", F.lit(True).alias("own")).distinct(), "release_group_mbid", "left").select("candidate_id", F.coalesce("own", F.lit(False)).alias("by_id")))
q("dm20_fuzzy_ownership")(lambda t: fuzzy_owned(t, t.core_recordings.select("title", "artist_id").where("title <> ''")))


def fuzzy_owned(t: Catalog, recordings: DataFrame | None = None) -> DataFrame:
    """Candidates close to an album of the library by title (0.85) and artist (0.70), whatever letters these begin with.

    recordings: (title, artist_id) of what else is in the library.
    """
    from tessera.functions.exact import alnum, similarity

    works = t.core_albums.select("title", "artist_id")
    works = works if recordings is None else works.unionByName(recordings.distinct())
    lib = works.join(t.core_artists.select(F.col("id").alias("artist_id"), "name"), "artist_id", "left").select(F.col("title").alias("lib_title"), F.coalesce("name", F.lit("Unknown Artist")).alias("lib_artist")).distinct()
    c = t.sys_discovery_candidates.select("candidate_id", "title", "artist_name")
    # Different titles are few, so they are compared once each, and so are the artists behind those that agree.
    spelled = lambda frame, column: cut(frame.select(F.col(column).alias("spelled")).distinct().select("spelled", F.lit(0).alias("block"), alnum("spelled").alias("text")))
    mine, theirs = spelled(c, "title"), spelled(works, "title")
    titles = alike(mine, theirs, 0.85).join(mine.select(F.col("spelled").alias("title"), F.col("text").alias("a")), "a").join(theirs.select(F.col("spelled").alias("lib_title"), F.col("text").alias("b")), "b").where(similarity("title", "lib_title") >= 0.85)
    titles = cut(titles.select("title", "lib_title"))
    # What is asked of each artist of a title is asked once, whoever has it, and one album that is near answers it.
    asked = cut(c.join(titles.select("title", "lib_title"), "title").select("lib_title", "artist_name").where("artist_name IS NOT NULL").distinct())
    held = cut(lib.join(asked.select("lib_title").distinct(), "lib_title", "left_semi").select("lib_title", "lib_artist"))
    answered = None
    for letters in (64, 12, 8, 4):  # the likeliest first: an artist that begins alike
        start = lambda column: F.substring(text.alnum_key(F.col(column)), 1, letters).alias("start")  # noqa: B023, E731
        left = asked if answered is None else asked.join(answered, ["lib_title", "artist_name"], "left_anti")
        likely = held.groupBy("lib_title", start("lib_artist")).agg(F.min("lib_artist").alias("lib_artist"))
        tried = left.withColumn("start", start("artist_name")).join(likely, ["lib_title", "start"]).where(similarity("artist_name", "lib_artist") >= 0.70)
        tried = tried.select("lib_title", "artist_name")
        answered = cut(tried if answered is None else answered.unionByName(tried))
    # The others are held against every artist of the title that shares rare letter pairs with them.
    left = cut(asked.join(answered, ["lib_title", "artist_name"], "left_anti"))
    if not left.isEmpty():
        block = lambda frame, column: frame.select(F.col("lib_title").alias("block"), alnum(column).alias("text"))
        held = held.join(left.select("lib_title").distinct(), "lib_title", "left_semi")
        found = alike(block(left, "artist_name"), block(held, "lib_artist"), 0.70).withColumnRenamed("block", "lib_title")
        spelled_by = lambda frame, column, as_: frame.select("lib_title", column, alnum(column).alias(as_))
        tried = found.join(spelled_by(left, "artist_name", "a"), ["lib_title", "a"]).join(spelled_by(held, "lib_artist", "b"), ["lib_title", "b"]).where(similarity("artist_name", "lib_artist") >= 0.70)
        answered = answered.unionByName(tried.select("lib_title", "artist_name").distinct())
    near_titles = titles.select("title", "lib_title").join(answered, "lib_title").select("title", "artist_name").distinct()
    return c.join(near_titles, ["title", "artist_name"], "left_semi").select("candidate_id").distinct()


q("jn15_cluster_match")(lambda t: cluster_match(t))


def cluster_match(t: Catalog) -> DataFrame:
    """Best official track for each local one of an album: 0.7 title similarity, 0.3 same position, from 0.4 up."""
    from tessera.functions.exact import similarity

    official = t.core_albums.select(F.col("id").alias("album_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("position")).withColumn("official", F.concat(F.lit("Song "), (F.col("album_id") * F.col("position") % 500).cast("string")))
    pairs = t.core_recordings.join(official, "album_id").withColumn("score", 0.70 * similarity("title", "official") + F.when(F.col("track_number") == F.col("position"), 0.30).otherwise(0.0))
    best = pairs.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "position")))
    return best.where("n = 1 AND score >= 0.40").select("id", "official", "position", "score")


q("jn16_ranked_match")(lambda t: ranked_match(t))


def ranked_match(t: Catalog) -> DataFrame:
    """Best remote candidate for each track: similarities from 0.4 up, more than 60 s apart never, more than 15 s worse by 0.1; the first tier with a hit.

    The remote candidates of track k are the titled recordings k, k + 400, ..., k + 1600.
    """
    from tessera.functions.exact import similarity

    local = t.core_recordings.where("title <> ''").select("id", "title", text.search_title(F.col("title")).alias("clean"), text.core_title(F.col("title")).alias("core"), (F.col("id") % 300).alias("seconds"))
    remote = t.core_recordings.where("title <> ''").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(4)))).select((F.col("id") - 400 * F.col("step")).alias("id"), F.col("id").alias("remote"), F.col("title").alias("r_title"), (F.col("id") % 300).alias("r_seconds"), (F.col("id") % 3).alias("tier"))
    gap = F.abs(F.col("seconds") - F.col("r_seconds"))
    pairs = local.join(remote, "id").where(gap <= 60).withColumn("sim", F.greatest(similarity("clean", "r_title"), similarity("core", "r_title"))).where("sim >= 0.40")
    scored = pairs.withColumn("score", 0.50 * F.col("sim") + 0.50 * 0.85 - F.when(gap > 15, 0.10).otherwise(0.0))
    return scored.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("tier", F.desc("score"), "remote"))).where("n = 1").select("id", "remote", "tier", "score")


# Frontier, research, audit

q("dm31_provenance_search", "SELECT r.id, r.title FROM core_recordings r LEFT JOIN core_artists a ON r.artist_id = a.id WHERE CAST(r.id AS VARCHAR) ILIKE '%12%' OR r.title ILIKE '%12%' OR a.name ILIKE '%12%' ORDER BY r.id LIMIT 50")(lambda t: t.core_recordings.join(t.core_artists.select(F.col("id").alias("artist_id"), "name"), "artist_id", "left").withColumn("key", F.col("id").cast("string")).where(views.containing("12", "key", "title", "name")).orderBy("id").limit(50).select("id", "title"))
q("dm32_cohort", "SELECT id, title FROM vw_recording_overview WHERE quality_score >= 0.7 AND upper(format) = 'MP3' ORDER BY id, title LIMIT 200")(lambda t: overview(t).where((F.col("quality_score") >= 0.7) & (F.upper("format") == "MP3")).orderBy("id", "title").limit(200).select("id", "title"))
q("dm33_browse", "SELECT id, title, artist_name FROM vw_recording_overview WHERE (title ILIKE '%song%' OR artist_name ILIKE '%song%' OR album_title ILIKE '%song%') AND quality_score >= 0.5 ORDER BY id, title, artist_name LIMIT 100 OFFSET 100")(lambda t: views.page(overview(t).where(views.containing("song", "title", "artist_name", "album_title") & (F.col("quality_score") >= 0.5)).select("id", "title", "artist_name"), [F.col("id"), F.col("title"), F.col("artist_name")], 1))
q("dm34_discography", "SELECT b.id, b.title, count(r.id) AS tracks FROM core_albums b LEFT JOIN core_recordings r ON r.album_id = b.id WHERE b.artist_id = 44 GROUP BY b.id, b.title")(lambda t: t.core_albums.where("artist_id = 44").select("id", "title").join(t.core_recordings.select(F.col("album_id").alias("id"), F.col("id").alias("rid")), "id", "left").groupBy("id", "title").agg(F.count("rid").alias("tracks")))
q("dm35_inspector", "SELECT r.id, r.title, a.name, b.title AS album, v.quality_score FROM core_recordings r LEFT JOIN core_artists a ON r.artist_id = a.id LEFT JOIN core_albums b ON r.album_id = b.id LEFT JOIN meta_validation v ON v.recording_id = r.id WHERE r.id = 77")(
    lambda t: scoped(t, False).where("id = 77").join(t.core_artists.select(F.col("id").alias("artist_id"), "name"), "artist_id", "left").join(t.core_albums.select(F.col("id").alias("album_id"), F.col("title").alias("album")), "album_id", "left").select("id", "title", "name", "album", "quality_score")
)
q("dm36_run_history", "SELECT run_id, started_at FROM sys_runs ORDER BY started_at DESC, run_id DESC LIMIT 20")(lambda t: t.sys_runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(20).select("run_id", "started_at"))
q("dm36_audit_diff", "SELECT id, field_name, value FROM meta_evidence WHERE run_id = '2024-01-05' ORDER BY id DESC LIMIT 200")(lambda t: t.meta_evidence.where("run_id = '2024-01-05'").orderBy(F.desc("id")).limit(200).select("id", "field_name", "value"))
q("dm38_candidates_by_state", "SELECT c.candidate_id, coalesce(s.v_rel, 0.0) AS v_rel FROM sys_discovery_candidates c LEFT JOIN sys_discovery_scores s ON c.candidate_id = s.candidate_id WHERE c.state = 'NEW' ORDER BY c.final_ccs DESC, c.candidate_id LIMIT 250")(lambda t: t.sys_discovery_candidates.where("state = 'NEW'").join(t.sys_discovery_scores.select("candidate_id", "v_rel"), "candidate_id", "left").orderBy(F.desc("final_ccs"), "candidate_id").limit(250).select("candidate_id", F.coalesce("v_rel", F.lit(0.0)).alias("v_rel")))
q("dm50_provider_health", "SELECT coalesce(m.source_id, b.source_id) AS provider, coalesce(m.n, 0) AS requests, coalesce(m.mean, 0.0) AS mean, CASE WHEN b.bad >= 20 THEN 'OPEN' ELSE 'CLOSED' END AS state FROM (SELECT source_id, count(*) AS n, round(avg(confidence), 6) AS mean FROM meta_evidence GROUP BY source_id) m FULL JOIN (SELECT source_id, count(*) AS bad FROM meta_evidence WHERE value = 'broken' GROUP BY source_id) b ON m.source_id = b.source_id")(
    lambda t: t.meta_evidence.groupBy("source_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean")).join(t.meta_evidence.where("value = 'broken'").groupBy("source_id").agg(F.count("*").alias("bad")), "source_id", "full").select(F.col("source_id").alias("provider"), F.coalesce("n", F.lit(0)).alias("requests"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(F.col("bad") >= 20, "OPEN").otherwise("CLOSED").alias("state"))
)
