"""Queries over decisions as they change the catalog: application, purge, reclassification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import apply
from tessera.plans import duck
from tessera.plans.changes import SCORE, STATE
from tessera.plans.domain import GENRES, resolution
from tessera.plans.registry import catalog_query as q
from tessera.sources.fixtures import Catalog

_SCORED = "SELECT x.*, {state} AS state FROM (SELECT y.*, {score} AS quality_score FROM {source} y) x"


def rescored(source: str) -> str:
    """SQL of rows with score and state."""
    return _SCORED.format(source=source, score=f"CAST({SCORE} AS DOUBLE)", state=STATE.replace("score ", "quality_score "))


def _id(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 15))::BIGINT"


_APPLY = f"""
asked AS (SELECT entity_id, field_name, selected_value AS v FROM meta_proposals WHERE selected_value <> '' AND entity_id IN (SELECT id FROM core_recordings)),
refused AS (SELECT entity_id FROM (SELECT *, min(entity_id) OVER (PARTITION BY v) AS first FROM asked WHERE field_name = 'isrc') c
  WHERE first <> entity_id OR EXISTS (SELECT 1 FROM core_recordings r WHERE r.isrc = c.v AND r.id <> c.entity_id)),
taken AS (SELECT * FROM asked WHERE field_name <> 'isrc' OR entity_id NOT IN (SELECT entity_id FROM refused)),
wide AS (PIVOT taken ON field_name IN ('title', 'artist', 'album', 'isrc', 'musicbrainz_recording_id') USING max(v) GROUP BY entity_id),
people AS (SELECT {duck.artist_key('name')} AS k, min(id) AS known FROM core_artists GROUP BY 1),
linked AS (SELECT r.*, w.title AS n_title, w.artist AS n_artist, w.album AS n_album, w.isrc AS n_isrc, w.musicbrainz_recording_id AS n_mbid,
    CASE WHEN {duck.artist_key('w.artist')} <> '' THEN coalesce(people.known, {_id(duck.artist_key('w.artist'))}) ELSE r.artist_id END AS new_artist
  FROM core_recordings r LEFT JOIN wide w ON w.entity_id = r.id LEFT JOIN people ON people.k = {duck.artist_key('w.artist')}),
placed AS (SELECT l.*, CASE WHEN n_album IS NULL THEN l.album_id ELSE coalesce((SELECT min(b.id) FROM core_albums b WHERE lower(b.title) = lower(n_album) AND b.artist_id IS NOT DISTINCT FROM l.new_artist), {_id("lower(n_album) || '|' || coalesce(CAST(l.new_artist AS VARCHAR), '')")}) END AS new_album FROM linked l),
fresh AS (SELECT id, coalesce(n_title, title) AS title, new_artist AS artist_id, new_album AS album_id, release_date, coalesce(n_isrc, isrc) AS isrc, coalesce(n_mbid, musicbrainz_recording_id) AS musicbrainz_recording_id, n_mbid FROM placed),
pointed AS (SELECT *, CASE WHEN musicbrainz_recording_id <> '' AND max(n_mbid) OVER (PARTITION BY musicbrainz_recording_id) IS NOT NULL THEN min(id) OVER (PARTITION BY musicbrainz_recording_id) ELSE id END AS target FROM fresh)"""


def applied(t: Catalog) -> dict[str, DataFrame]:
    return apply.apply_decisions(t.core_recordings, t.core_artists, t.core_albums, t.meta_proposals)


_COLUMNS = ["id", "title", "artist_id", "album_id", "isrc", "musicbrainz_recording_id", "quality_score", "state"]
q("dm07_apply_decisions", f"WITH {_APPLY} SELECT * REPLACE (CAST(artist_id AS VARCHAR) AS artist_id, CAST(album_id AS VARCHAR) AS album_id) FROM (SELECT {', '.join(_COLUMNS)} FROM ({rescored('(SELECT * FROM pointed WHERE target = id)')}) z) ids")(
    # Ids as text: a nullable number of 60 bits loses digits where it is read as a float.
    lambda t: applied(t)["recordings"].select(*[F.col(c).cast("string").alias(c) if c in ("artist_id", "album_id") else c for c in _COLUMNS])
)
q("dm07_collisions", f"WITH {_APPLY} SELECT entity_id, 'DUPLICATE_IDENTIFIER_COLLISION' AS issue_code, 'WARNING' AS severity, 'OPEN' AS status FROM refused")(lambda t: applied(t)["opened"])
q("dm07_merges", f"WITH {_APPLY} SELECT id AS duplicate, target FROM pointed WHERE target <> id")(lambda t: applied(t)["merged"])
q("dm07_log", f"WITH {_APPLY} SELECT p.id AS entity_id, k.field_name, CASE k.field_name WHEN 'title' THEN p.title WHEN 'artist' THEN CAST(p.artist_id AS VARCHAR) WHEN 'album' THEN CAST(p.album_id AS VARCHAR) WHEN 'isrc' THEN p.isrc ELSE p.musicbrainz_recording_id END AS old_value, k.v AS selected_value FROM taken k JOIN placed p ON p.id = k.entity_id")(lambda t: applied(t)["applied"])
q(
    "dm07_issues",
    f"WITH {_APPLY}, told AS (SELECT entity_id, CASE field_name WHEN 'isrc' THEN 'MISSING_ISRC' ELSE 'MISSING_MBID' END AS code FROM taken WHERE field_name IN ('isrc', 'musicbrainz_recording_id')), old AS (SELECT entity_id, issue_code, severity, CASE WHEN status = 'OPEN' AND EXISTS (SELECT 1 FROM told WHERE told.entity_id = i.entity_id AND told.code = i.issue_code) THEN 'RESOLVED' ELSE status END AS status FROM meta_issues i) SELECT * FROM old UNION ALL SELECT DISTINCT entity_id, 'DUPLICATE_IDENTIFIER_COLLISION', 'WARNING', 'OPEN' FROM refused",
)(lambda t: issues_after(t))


def issues_after(t: Catalog) -> DataFrame:
    done = applied(t)
    return apply.settle_issues(t.meta_issues, done["resolved"], done["opened"])


# Purge of malformed codes

_TOUCHED = f"touched AS (SELECT DISTINCT entity_id FROM meta_evidence WHERE field_name = 'isrc' AND {duck.isrc('value')} = '')"
_LEFT = f"(SELECT * FROM meta_evidence WHERE field_name = 'isrc' AND {duck.isrc('value')} <> '' AND entity_id IN (SELECT entity_id FROM touched))"
_PURGED = f"{_TOUCHED}, remaining AS {_LEFT}, chosen AS ({resolution('remaining', current='(SELECT id AS entity_id, ' + repr('isrc') + ' AS field_name, isrc AS old_value FROM core_recordings)', targets='(SELECT entity_id, ' + repr('isrc') + ' AS field_name FROM touched)')}), codes AS (SELECT entity_id, CASE WHEN entity_id IN (SELECT entity_id FROM remaining) THEN nullif(selected_value, '') END AS code FROM chosen)"
q("dm08_purge_and_resolve", f"WITH {_PURGED} SELECT * FROM chosen")(lambda t: purged(t)["decisions"])
q("dm08_purged_recordings", f"WITH {_PURGED} SELECT id, isrc, quality_score, state FROM ({rescored('(SELECT r.* EXCLUDE (isrc, state), c.code AS isrc FROM core_recordings r JOIN codes c ON c.entity_id = r.id)')}) z")(lambda t: purged(t)["recordings"].select("id", "isrc", "quality_score", "state"))
q(
    "dm08_purge_issues",
    f"WITH {_PURGED}, old AS (SELECT i.entity_id, issue_code, severity, CASE WHEN status = 'OPEN' AND (issue_code = 'INVALID_ISRC_SYNTAX' OR (issue_code = 'MISSING_ISRC' AND c.code IS NOT NULL)) AND c.entity_id IS NOT NULL THEN 'RESOLVED' ELSE status END AS status FROM meta_issues i LEFT JOIN codes c ON c.entity_id = i.entity_id) SELECT * FROM old UNION ALL SELECT entity_id, 'MISSING_ISRC', 'WARNING', 'OPEN' FROM codes WHERE code IS NULL AND entity_id NOT IN (SELECT entity_id FROM old WHERE issue_code = 'MISSING_ISRC' AND status = 'OPEN') AND entity_id IN (SELECT id FROM core_recordings UNION SELECT entity_id FROM touched)",
)(lambda t: purged(t)["issues"])


def purged(t: Catalog) -> dict[str, DataFrame]:
    return apply.purge_codes(t.core_recordings, t.meta_evidence, t.meta_locks, t.meta_issues)


# Reclassification of the library

_FREE = "(SELECT r.id, a.name FROM core_recordings r LEFT JOIN core_artists a ON r.artist_id = a.id WHERE r.id NOT IN (SELECT entity_id FROM meta_locks WHERE field_name IN ('genre', 'subgenre')) AND r.id IN (SELECT entity_id FROM meta_evidence WHERE field_name IN ('genre', 'subgenre') AND value <> ''))"
_TAGS = "(SELECT *, 1.0 AS weight FROM meta_evidence WHERE field_name IN ('genre', 'subgenre') AND value <> '')"
q(
    "dm15_reclassify",
    f"WITH judged AS ({GENRES.format(source=_TAGS, artists=_FREE)}), anew AS (SELECT * FROM ({rescored('(SELECT r.* EXCLUDE (genre, subgenre, state), j.genre, j.subgenre FROM core_recordings r JOIN judged j ON j.entity_id = r.id)')}) z) SELECT id, genre, subgenre, quality_score, state FROM anew UNION ALL SELECT r.id, r.genre, r.subgenre, v.quality_score, r.state FROM core_recordings r LEFT JOIN meta_validation v ON v.recording_id = r.id WHERE r.id NOT IN (SELECT entity_id FROM judged)",
)(lambda t: apply.reclassify(t.core_recordings, t.meta_evidence, t.meta_locks, t.core_artists, t.meta_validation).select("id", "genre", "subgenre", "quality_score", "state"))
