"""Queries over changes of tables: upserts, inserts, updates, deletes, merges, exports, rollback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import catalog as views
from tessera.operators import mutate
from tessera.plans.registry import catalog_query as q
from tessera.sources.fixtures import Catalog

_NEW = "SELECT o_orderkey AS recording_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 0.5 END AS quality_score FROM orders WHERE o_orderkey % 5 = 0"


@q("snk01_upsert", f"SELECT coalesce(v.recording_id, n.recording_id) AS recording_id, CASE WHEN n.recording_id IS NOT NULL THEN n.quality_score ELSE v.quality_score END AS quality_score FROM meta_validation v FULL JOIN ({_NEW}) n ON v.recording_id = n.recording_id")
def upsert(t: Catalog) -> DataFrame:
    new = t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("recording_id"), F.when(F.col("o_orderkey") % 4 != 0, 0.5).alias("quality_score"))
    return mutate.upsert(t.meta_validation, new, ["recording_id"], ["quality_score"])


@q("snk02_insert_ignore", "SELECT entity_id, field_name, lock_state FROM meta_locks UNION ALL SELECT entity_id, field_name, 'MANUAL' FROM (SELECT DISTINCT entity_id, field_name FROM meta_evidence WHERE source_id = 'SRC_USER') e WHERE NOT EXISTS (SELECT 1 FROM meta_locks l WHERE l.entity_id = e.entity_id AND l.field_name = e.field_name)")
def insert_ignore(t: Catalog) -> DataFrame:
    rows = t.meta_evidence.where("source_id = 'SRC_USER'").select("entity_id", "field_name", F.lit("MANUAL").alias("lock_state"), "id")
    return mutate.insert_ignore(t.meta_locks, rows, ["entity_id", "field_name"], [F.col("id")])


q("snk03_update", "SELECT candidate_id, CASE WHEN release_group_mbid IN (SELECT release_group_mbid FROM core_albums) AND state NOT IN ('ACQUIRED', 'IGNORED') THEN 'ACQUIRED' ELSE state END AS state FROM sys_discovery_candidates")(
    lambda t: mutate.update_keys(t.sys_discovery_candidates, t.core_albums.where("release_group_mbid IS NOT NULL"), ["release_group_mbid"], {"state": F.lit("ACQUIRED")}, unless=F.col("state").isin("ACQUIRED", "IGNORED")).select("candidate_id", "state")
)
q("snk04_delete", "SELECT id FROM meta_evidence WHERE NOT coalesce(field_name = 'isrc' AND value = 'broken', FALSE)")(lambda t: mutate.delete_where(t.meta_evidence, F.expr("field_name = 'isrc' AND value = 'broken'")).select("id"))
_PRIORITY = "SELECT seed_id, round(CASE WHEN entity_name IN (SELECT s_name FROM supplier WHERE s_suppkey % 3 = 0) THEN greatest(0.1, priority - 0.20) ELSE priority + 0.25 END, 6)::DOUBLE AS priority FROM sys_crawl_frontier"


@q("snk05_feedback", _PRIORITY)
def feedback(t: Catalog) -> DataFrame:
    down = t.supplier.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("entity_name"), F.lit(True).alias("down"))
    return t.sys_crawl_frontier.join(down, "entity_name", "left").select("seed_id", F.round(F.when(F.col("down"), F.greatest(F.lit(0.1), F.col("priority") - 0.20)).otherwise(F.col("priority") + 0.25), 6).alias("priority"))


q("snk06_keep_newest", "SELECT id FROM meta_decisions ORDER BY applied_at DESC, id DESC LIMIT 500")(lambda t: mutate.keep_newest(t.meta_decisions, [F.desc("applied_at"), F.desc("id")], 500).select("id"))


def twins(recordings: DataFrame) -> DataFrame:
    """(duplicate, target): recordings with the identifier of one with a smaller id."""
    keep = recordings.where("musicbrainz_recording_id IS NOT NULL").groupBy("musicbrainz_recording_id").agg(F.min("id").alias("target"))
    return recordings.join(keep, "musicbrainz_recording_id").where("id <> target").select(F.col("id").alias("duplicate"), "target")


_TWINS = "SELECT r.id AS duplicate, k.target FROM core_recordings r JOIN (SELECT musicbrainz_recording_id, min(id) AS target FROM core_recordings WHERE musicbrainz_recording_id IS NOT NULL GROUP BY musicbrainz_recording_id) k ON r.musicbrainz_recording_id = k.musicbrainz_recording_id WHERE r.id <> k.target"


@q("snk07_merge_entities", f"SELECT 'asset' AS kind, coalesce(k.target, a.recording_id) AS entity, count(*) AS n FROM core_assets a LEFT JOIN ({_TWINS}) k ON a.recording_id = k.duplicate GROUP BY 2 UNION ALL SELECT 'fact', coalesce(k.target, e.entity_id), count(DISTINCT (field_name, source_id, coalesce(value, ''))) FROM meta_evidence e LEFT JOIN ({_TWINS}) k ON e.entity_id = k.duplicate GROUP BY 2")
def merge(t: Catalog) -> DataFrame:
    moved = mutate.merge_entities({"asset": (t.core_assets, "recording_id"), "fact": (t.meta_evidence, "entity_id")}, twins(t.core_recordings))
    facts = moved["fact"].dropDuplicates(["entity_id", "field_name", "source_id", "value"])
    one = lambda d, c, kind: d.groupBy(F.col(c).alias("entity")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "entity", "n")
    return one(moved["asset"], "recording_id", "asset").unionByName(one(facts, "entity_id", "fact"))


@q("snk09_nested_export", "SELECT genre, string_agg(subgenre || ' (' || n || ' tracks)', '; ' ORDER BY n DESC, subgenre) AS styles FROM (SELECT genre, subgenre, count(*) AS n FROM core_recordings WHERE genre IS NOT NULL AND subgenre IS NOT NULL GROUP BY genre, subgenre) g GROUP BY genre")
def nested_export(t: Catalog) -> DataFrame:
    n = t.core_recordings.where("genre IS NOT NULL AND subgenre IS NOT NULL").groupBy("genre", "subgenre").agg(F.count("*").alias("n"))
    styles = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "subgenre")))
    text = F.transform(styles, lambda x: F.concat(x["subgenre"], F.lit(" ("), (-x["less"]).cast("string"), F.lit(" tracks)")))
    return n.groupBy("genre").agg(F.array_join(text, "; ").alias("styles"))


q("snk10_tag_lines", "SELECT value || chr(9) || count(*) AS line FROM meta_evidence WHERE field_name = 'genre' AND value IS NOT NULL GROUP BY value")(lambda t: t.meta_evidence.where("field_name = 'genre' AND value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")).select(F.concat_ws("\t", "value", "n").alias("line")))


def split(rows: DataFrame, key: str, train: int, validation: int, blocks: int = 4096) -> DataFrame:
    """Assign exact shares of rows to train, validation and test in the order of a hash of the key.

    Ranks come from counts of hash blocks and the order within a block, so no task sorts all rows.
    """
    mark = F.md5(F.col(key).cast("string").cast("binary"))
    marked = rows.withColumn("__m", mark).withColumn("__b", F.conv(F.substring(mark, 1, 3), 16, 10).cast("int") % blocks)
    sizes = marked.groupBy("__b").agg(F.count("*").alias("__c"))
    before = F.broadcast(sizes.withColumn("__before", F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).withColumn("__all", F.sum("__c").over(Window.partitionBy())))  # at most 4096 rows
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("__m", key)) + F.coalesce("__before", F.lit(0))
    ranked = marked.join(before, "__b").withColumn("__n", rank)
    a, b = F.floor(F.col("__all") * train / 100), F.floor(F.col("__all") * validation / 100)
    return ranked.select(*rows.columns, F.when(F.col("__n") <= a, "train").when(F.col("__n") <= a + b, "validation").otherwise("test").alias("split"))


q("snk12_split", "SELECT id, CASE WHEN n <= floor(c * 70 / 100) THEN 'train' WHEN n <= floor(c * 70 / 100) + floor(c * 20 / 100) THEN 'validation' ELSE 'test' END AS split FROM (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) AS n, count(*) OVER () AS c FROM core_recordings) x")(lambda t: split(t.core_recordings.select("id"), "id", 70, 20))

# Operators of the domain that change tables

SCORE = "(CASE WHEN title IS NOT NULL AND trim(title) <> '' AND NOT regexp_matches(lower(title), '\\.(mp3|flac|wav|m4a|ogg)$') THEN 20 WHEN coalesce(title, '') <> '' THEN 5 ELSE 0 END + CASE WHEN artist_id IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN album_id IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN coalesce(release_date, '') <> '' THEN 15 ELSE 0 END + CASE WHEN coalesce(isrc, '') <> '' AND isrc <> 'NONE' THEN 10 ELSE 0 END + CASE WHEN coalesce(musicbrainz_recording_id, '') <> '' THEN 10 ELSE 0 END) / 100.0"
STATE = "CASE WHEN score >= 1.0 AND coalesce(isrc, '') <> '' AND coalesce(musicbrainz_recording_id, '') <> '' THEN 'COMPLETE' WHEN score >= 0.80 THEN 'ENRICHED' WHEN coalesce(musicbrainz_recording_id, '') <> '' OR coalesce(isrc, '') <> '' THEN 'IDENTIFIED' ELSE 'PARSED' END"


def scored(recordings: DataFrame) -> DataFrame:
    """(id, score, state) of recordings."""
    score = views.quality_score(*map(F.col, ("title", "artist_id", "album_id", "release_date", "isrc", "musicbrainz_recording_id")))
    return recordings.withColumn("score", score).select("id", "score", views.lifecycle_state(F.col("score"), F.col("isrc"), F.col("musicbrainz_recording_id")).alias("state"))


q("dm05_quality_score", f"SELECT id, CAST({SCORE} AS DOUBLE) AS score FROM core_recordings")(lambda t: scored(t.core_recordings).select("id", "score"))
q("dm06_lifecycle_state", f"SELECT id, {STATE} AS state FROM (SELECT *, {SCORE} AS score FROM core_recordings) x")(lambda t: scored(t.core_recordings).select("id", "state"))


def get_or_create(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, id, created): id of each distinct name in known (id, name) by key, or a new one by a stable hash."""
    from tessera.functions.text import artist_key

    ids = known.select(artist_key(F.col("name")).alias("key"), "id").groupBy("key").agg(F.min("id").alias("id"))
    rows = names.select("name").distinct().withColumn("key", artist_key(F.col("name"))).where("key <> ''").join(ids, "key", "left")
    return rows.select("name", F.coalesce(F.col("id").cast("string"), F.md5(F.col("key").cast("binary"))).alias("id"), F.col("id").isNull().alias("created"))


def _goc_sql() -> str:
    from tessera.plans import duck

    key = duck.artist_key("name")
    return f"SELECT n.name, coalesce(CAST(k.id AS VARCHAR), md5(n.key)) AS id, k.id IS NULL AS created FROM (SELECT DISTINCT artist_name AS name, {duck.artist_key('artist_name')} AS key FROM sys_discovery_candidates) n LEFT JOIN (SELECT {key} AS key, min(id) AS id FROM core_artists GROUP BY 1) k ON n.key = k.key WHERE n.key <> ''"


q("dm09_get_or_create_artist", _goc_sql())(lambda t: get_or_create(t.sys_discovery_candidates.select(F.col("artist_name").alias("name")), t.core_artists))
q("dm10_get_or_create_album", "SELECT c.candidate_id, coalesce(g.id, a.id) AS album_id FROM sys_discovery_candidates c LEFT JOIN (SELECT release_group_mbid, min(id) AS id FROM core_albums WHERE release_group_mbid IS NOT NULL GROUP BY 1) g ON c.release_group_mbid = g.release_group_mbid LEFT JOIN (SELECT lower(b.title) AS title, r.name, min(b.id) AS id FROM core_albums b JOIN core_artists r ON b.artist_id = r.id GROUP BY 1, 2) a ON lower(c.title) = a.title AND c.artist_name = a.name")(
    lambda t: t.sys_discovery_candidates.join(t.core_albums.where("release_group_mbid IS NOT NULL").groupBy("release_group_mbid").agg(F.min("id").alias("g")), "release_group_mbid", "left").withColumn("k", F.lower("title"))
    .join(t.core_albums.join(t.core_artists.select(F.col("id").alias("artist_id"), F.col("name").alias("artist_name")), "artist_id").groupBy(F.lower("title").alias("k"), "artist_name").agg(F.min("id").alias("a")), ["k", "artist_name"], "left").select("candidate_id", F.coalesce("g", "a").alias("album_id"))
)


def _demographics_sql() -> str:
    from tessera.plans import duck

    return f"SELECT id, country, region FROM (SELECT a.id, coalesce(e.value, a.country) AS country, CASE WHEN e.value IS NOT NULL THEN {duck.region('e.value')} ELSE a.region END AS region FROM core_artists a LEFT JOIN (SELECT entity_id, arg_max(value, id) AS value FROM meta_evidence WHERE field_name = 'country' AND trim(value) <> '' AND lower(value) <> 'none' GROUP BY entity_id) e ON a.id = e.entity_id) x"


@q("dm11_demographics", _demographics_sql())
def demographics(t: Catalog) -> DataFrame:
    from tessera.functions.text import region

    e = t.meta_evidence.where("field_name = 'country' AND trim(value) <> '' AND lower(value) <> 'none'").groupBy(F.col("entity_id").alias("id")).agg(F.max_by("value", "id").alias("value"))
    return t.core_artists.join(e, "id", "left").select("id", F.coalesce("value", "country").alias("country"), F.when(F.col("value").isNotNull(), region(F.col("value"))).otherwise(F.col("region")).alias("region"))


def rollback(recordings: DataFrame, decisions: DataFrame, locks: DataFrame, run_from: str) -> DataFrame:
    """Recordings with genre and subgenre as before the runs, except where a field is locked by hand."""
    first = decisions.where((F.col("run_id") >= run_from) & F.col("field_name").isin("genre", "subgenre")).groupBy("entity_id", "field_name").agg(F.min_by("old_value", "id").alias("old"))
    free = first.join(locks.where("lock_state = 'MANUAL'"), ["entity_id", "field_name"], "left_anti")
    wide = free.groupBy(F.col("entity_id").alias("id")).agg(*[F.max(F.when(F.col("field_name") == f, F.struct("old"))).alias(f"__{f}") for f in ("genre", "subgenre")])
    return recordings.join(wide, "id", "left").select("id", *[F.when(F.col(f"__{f}").isNotNull(), F.col(f"__{f}.old")).otherwise(F.col(f)).alias(f) for f in ("genre", "subgenre")])


_OLD = "(SELECT entity_id, arg_min(old_value, id) AS old FROM meta_decisions d WHERE run_id >= '2024-01-20' AND field_name = '{0}' AND NOT EXISTS (SELECT 1 FROM meta_locks l WHERE l.entity_id = d.entity_id AND l.field_name = d.field_name AND l.lock_state = 'MANUAL') GROUP BY entity_id) {0}s"
q("dm29_rollback", f"SELECT r.id, coalesce(genres.old, r.genre) AS genre, coalesce(subgenres.old, r.subgenre) AS subgenre FROM core_recordings r LEFT JOIN {_OLD.format('genre')} ON r.id = genres.entity_id LEFT JOIN {_OLD.format('subgenre')} ON r.id = subgenres.entity_id")(lambda t: rollback(t.core_recordings, t.meta_decisions, t.meta_locks, "2024-01-20"))
q("dm27_issue_sweep", "SELECT r.id AS entity_id, code AS issue_code, severity FROM core_recordings r LEFT JOIN meta_validation v ON r.id = v.recording_id, (VALUES ('LOW_QUALITY_INDEX', 'CRITICAL'), ('MISSING_MBID', 'WARNING'), ('MISSING_ISRC', 'WARNING')) c(code, severity) WHERE ((code = 'LOW_QUALITY_INDEX' AND v.quality_score < 0.5) OR (code = 'MISSING_MBID' AND coalesce(r.musicbrainz_recording_id, '') = '') OR (code = 'MISSING_ISRC' AND coalesce(r.isrc, '') IN ('', 'NONE'))) AND NOT EXISTS (SELECT 1 FROM meta_issues i WHERE i.entity_id = r.id AND i.issue_code = code AND i.status = 'OPEN')")(
    lambda t: sweep(t)
)


def sweep(t: Catalog) -> DataFrame:
    """Issues that recordings have and that aren't open yet."""
    from tessera.plans.scans import scoped

    issue = lambda where, code, severity: F.when(F.expr(where), F.struct(F.lit(code).alias("issue_code"), F.lit(severity).alias("severity")))
    found = F.array(issue("quality_score < 0.5", "LOW_QUALITY_INDEX", "CRITICAL"), issue("coalesce(musicbrainz_recording_id, '') = ''", "MISSING_MBID", "WARNING"), issue("coalesce(isrc, '') IN ('', 'NONE')", "MISSING_ISRC", "WARNING"))
    rows = scoped(t, False).select(F.col("id").alias("entity_id"), F.explode(F.array_compact(found)).alias("x")).select("entity_id", "x.*")
    return rows.join(t.meta_issues.where("status = 'OPEN'"), ["entity_id", "issue_code"], "left_anti")


q("dm49_resolve_issue", "SELECT id, CASE WHEN entity_id = 15 AND status = 'OPEN' THEN 'RESOLVED' ELSE status END AS status FROM meta_issues")(lambda t: mutate.update_where(t.meta_issues, (F.col("entity_id") == 15) & (F.col("status") == "OPEN"), {"status": F.lit("RESOLVED")}).select("id", "status"))
q("dm46_cache_flush", "SELECT run_id, started_at FROM sys_runs WHERE run_id = '2024-01-03'")(lambda t: mutate.delete_where(t.sys_runs, F.col("run_id") != "2024-01-03").select("run_id", "started_at"))
q("dm39_state_hash", "SELECT md5((SELECT max(run_id) FROM sys_runs) || '|' || (SELECT count(*) FROM core_recordings) || '|' || (SELECT count(*) FROM meta_evidence)) AS state")(
    lambda t: t.sys_runs.agg(F.max("run_id").alias("r")).crossJoin(t.core_recordings.agg(F.count("*").alias("n"))).crossJoin(t.meta_evidence.agg(F.count("*").alias("m"))).select(F.md5(F.concat_ws("|", "r", "n", "m").cast("binary")).alias("state"))
)
