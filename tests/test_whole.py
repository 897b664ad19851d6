"""Queries without SQL, over whole tables, by brute force."""

from tessera.plans import registry

def test_first_come_over_all_assets(spark, small):
    from tessera.sources.fixtures import Catalog

    seen, kept = set(), []
    for a in sorted(Catalog(spark, small).core_assets.collect(), key=lambda a: a.asset_id):
        keys = {("file", a.md5_file), ("stream", a.audio_stream_hash, a.duration)}
        if not keys & seen:
            seen |= keys
            kept.append(a.asset_id)
    assert sorted(r.asset_id for r in registry.queries()["wn09_first_come"](spark, small).collect()) == kept


def test_cluster_match_over_all_albums(spark, small):
    from tessera.functions.exact import ratio
    from tessera.sources.fixtures import Catalog

    t = Catalog(spark, small)
    albums = {a.id for a in t.core_albums.collect()}
    expected = {}
    for r in t.core_recordings.where("album_id IS NOT NULL").collect():
        if r.album_id in albums:
            names = [(k, f"Song {r.album_id * k % 500}") for k in range(1, 5)]
            score, k, name = min(((-(0.70 * ratio(r.title, name) + (0.30 if r.track_number == k else 0.0)), k, name) for k, name in names))
            if -score >= 0.40:
                expected[r.id] = (name, k, round(-score, 9))
    found = registry.queries()["jn15_cluster_match"](spark, small).collect()
    assert {r.id: (r.official, r.position, round(r.score, 9)) for r in found} == expected and len(found) == len(expected)


def test_ranked_match_over_all_recordings(spark, small):
    from pyspark.sql import functions as F

    from tessera.functions import text
    from tessera.functions.exact import ratio
    from tessera.sources.fixtures import Catalog

    rows = Catalog(spark, small).core_recordings.where("title <> ''").select("id", "title", text.search_title(F.col("title")).alias("clean"), text.core_title(F.col("title")).alias("core")).collect()
    known = {r.id: r for r in rows}
    expected = {}
    for r in rows:
        ranked = []
        for remote in range(r.id, r.id + 2000, 400):
            gap = abs(r.id % 300 - remote % 300)
            if remote in known and gap <= 60:
                sim = max(ratio(r.clean, known[remote].title), ratio(r.core, known[remote].title))
                if sim >= 0.40:
                    ranked.append((remote % 3, -(0.50 * sim + 0.50 * 0.85 - (0.10 if gap > 15 else 0.0)), remote))
        if ranked:
            tier, score, remote = min(ranked)
            expected[r.id] = (remote, tier, round(-score, 9))
    found = registry.queries()["jn16_ranked_match"](spark, small).collect()
    assert {r.id: (r.remote, r.tier, round(r.score, 9)) for r in found} == expected and len(found) == len(expected)


def test_fuzzy_ownership_takes_any_title(rows):
    from types import SimpleNamespace

    from tessera.plans.domain import fuzzy_owned
    from tessera.plans.scans import fuzzy

    t = SimpleNamespace(
        core_albums=rows([(1, 1, "Blue Train")], "id int, artist_id int, title string"),
        core_artists=rows([(1, "Coltrane")], "id int, name string"),
        sys_discovery_candidates=rows([("a", "Blue Trains", "Coltrane"), ("b", "Red Train", "Coltrane")], "candidate_id string, title string, artist_name string"),
    )
    assert [r.candidate_id for r in fuzzy_owned(t).collect()] == ["a"]
    assert [r.candidate_id for r in fuzzy(t).collect()] == ["a"]


def test_similarity_of_all_parts(spark, small):
    from tessera.functions.exact import ratio

    parts = {r.p_partkey: r for r in spark.read.parquet(f"{small}/part.parquet").collect()}
    for r in registry.queries()["fn09_similarity"](spark, small).collect():
        assert (r.ab, r.ba) == (ratio(parts[r.p_partkey].p_name, parts[r.p_partkey].p_type), ratio(parts[r.p_partkey].p_type, parts[r.p_partkey].p_name))


def test_artist_rule_over_all_recordings(spark, small):
    from collections import defaultdict

    from pyspark.sql import functions as F

    from tessera.functions import fixed, text
    from tessera.functions.exact import ratio
    from tessera.plans.domain import artist_facts
    from tessera.sources.fixtures import Catalog

    t = Catalog(spark, small)
    names = {r.id: r.name.lower() for r in t.core_artists.collect()}
    reference = {r.id: names.get(r.artist_id) for r in t.core_recordings.collect()}
    groups = defaultdict(lambda: defaultdict(list))
    for r in artist_facts(t).withColumn("norm", text.normalise(F.col("field_name"), F.trim("value"))).collect():
        if (r.value or "").strip() and r.value.strip().upper() not in ("NONE", "NULL") and r.norm:
            groups[r.entity_id, r.norm][fixed.SOURCE_FAMILIES[r.source_id]].append(r.confidence)
    expected = {}
    for (entity, norm), families in groups.items():
        score = sum(sum(c) / len(c) * fixed.FIELD_PRIORS["artist"].get(f, fixed.MISSING_PRIOR) for f, c in families.items())
        unlike = reference.get(entity) is not None and ratio(norm, reference[entity]) < 0.40 and "USER_OVERRIDE" not in families
        expected[entity, norm] = max(0.01, round(score - 0.30 * unlike, 9))
    found = registry.queries()["dm03_artist_rule"](spark, small).collect()
    assert {(r.entity_id, r.norm): round(r.trust, 9) for r in found} == {k: round(v, 9) for k, v in expected.items()} and len(found) == len(expected)
    assert 0.01 in expected.values()
