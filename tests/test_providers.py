"""Answers without SQL twins by plain loops, and the crawler on hand-made rows."""

import json

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.exact import ratio
from tessera.operators import apply, crawl
from tessera.plans import providers, upkeep
from tessera.sources import payloads
from tessera.sources.fixtures import Catalog


def cleaned(frame, **columns):
    return {r.key: r for r in frame.select("key", *[c.alias(n) for n, c in columns.items()]).collect()}


def test_fingerprint_matches(spark, small):
    lookups = providers.fingerprint_lookups(Catalog(spark, small))
    mine = cleaned(lookups, artist=text.sanitize_artist(F.col("artist")), title=text.core_title(F.col("title")))
    names = {r.x: r.y for r in lookups.select(F.explode(F.array("artist", F.lit(None))).alias("x")).select("x", text.sanitize_artist(F.col("x")).alias("y")).distinct().collect()}
    expected = {}
    for r in lookups.collect():
        answer, best, alone = json.loads(r.body), None, None
        for n, result in enumerate(answer["results"] if answer["status"] == "ok" else ()):
            if alone is None or result["score"] > alone[0]:
                alone = (result["score"], result["id"])
            for rec in result.get("recordings") or ():
                artist = rec["artists"][0]["name"]
                like = ratio(mine[r.key].artist, names.get(artist, artist)) if mine[r.key].artist else 0.85
                score = result["score"] * (0.35 * like + 0.35 * ratio(mine[r.key].title, rec["title"]) + 0.30 * result["score"])
                if best is None or score > best[0] + 1e-12:
                    best = (score, result["id"], rec["id"])
        if best:
            expected[r.key] = (best[1], best[2], round(best[0], 9))
        elif alone:
            expected[r.key] = (alone[1], None, None)
    found = payloads.fingerprint_matches(lookups).collect()
    assert {r.key: (r.acoustid, r.mbid, round(r.score, 9) if r.score is not None else None) for r in found} == expected and len(found) == len(expected)


def test_search_hits(spark, small):
    t = Catalog(spark, small)
    tracks = {r.key: r for r in providers.searched(t).collect()}
    expected = {}
    for r in sorted(providers.search_answers(t).collect(), key=lambda r: r.tier):
        if r.key in expected:
            continue
        best, track = None, tracks[r.key]
        for hit in json.loads(r.body).get("recordings") or ():
            gap = abs(track.seconds - hit["length"] / 1000) if track.seconds else 0
            like, by = ratio(track.title, hit["title"]), ratio(track.artist, hit["artist-credit"][0]["name"]) if track.artist else 0.85
            score = 0.5 * like + 0.5 * by - (0.10 if gap > 15 else 0)
            if gap <= 60 and like >= 0.40 and by >= 0.40 and (best is None or score > best[0]):
                best = (score, hit["id"])
        if best:
            expected[r.key] = (r.tier, best[1], round(best[0], 9))
    found = payloads.best_hits(providers.searched(t), payloads.search_hits(providers.search_answers(t))).collect()
    assert {r.key: (r.tier, r.mbid, round(r.score, 9)) for r in found} == expected and len(found) == len(expected)


def test_answers_of_other_kinds_give_nothing(rows):
    odd = rows([("a", None), ("b", ""), ("c", "[1]"), ("d", '{"results": 5}'), ("e", "{}")], "key string, body string")
    for parse in (payloads.recordings_by_code, payloads.recording, payloads.release_groups, payloads.tracklists, payloads.track_codes, payloads.store_tracks, payloads.release_search, payloads.top_tags, payloads.genre_network, payloads.similar_artists, payloads.artist_ids, payloads.genre_seeds):
        assert parse(odd).count() == 0
    assert all(r.qid is None for r in payloads.artist_facts(odd).collect())


def test_cluster_facts(spark, small):
    from tessera.plans.domain import cluster_match

    t = Catalog(spark, small)
    tracks, tags = upkeep.official(t)
    official = {(r.album_id, r.position): r for r in tracks.collect()}
    albums = {r.id: r for r in t.core_albums.collect()}
    matched = {r.id: r.position for r in cluster_match(t).collect()}
    expected = set()
    for r in t.core_recordings.collect():
        if r.album_id not in albums:
            continue
        expected |= {(r.id, "genre", "post rock", 0.8), (r.id, "genre", f"style {r.album_id % 7}", round(0.8 * 0.5625, 9)), (r.id, "original_release_date", albums[r.album_id].release_date, 0.99)}
        if r.id in matched:
            track = official[r.album_id, matched[r.id]]
            expected.add((r.id, "musicbrainz_recording_id", track.mbid, 0.98))
            if track.isrc:
                expected.add((r.id, "isrc", track.isrc, 0.99))
    found = upkeep.cluster_facts(t).collect()
    assert {(r.entity_id, r.field_name, r.value, round(r.confidence, 9)) for r in found} == expected and len(found) == len(expected)


FRONTIER = "seed_id string, entity_name string, priority double, state string, created_seq long"


def test_harvest_and_starters(rows):
    artists = rows([(1, "A", "m1"), (2, "B", "m2"), (3, "C", None)], "id int, name string, musicbrainz_artist_id string")
    recordings = rows([(k, 1 + k % 2) for k in range(5)], "id int, artist_id int")
    good = rows([(k, 0.8) for k in range(5)], "recording_id int, quality_score double")
    old = rows([("m1", "A", 0.5, "ACTIVE", 4)], FRONTIER)
    state = lambda f: {r.seed_id: (r.state, r.priority) for r in f.collect()}
    assert state(crawl.harvest(old, artists, recordings, good)) == {"m1": ("PENDING", 0.5)}
    assert state(crawl.harvest(old.limit(0), artists, recordings, good)) == {"m1": ("PENDING", 1.0)}
    assert state(crawl.harvest(old.limit(0), artists, recordings, good.limit(0))) == {"m1": ("PENDING", 1.0), "m2": ("PENDING", 1.0)}
    assert len(state(crawl.harvest(old.limit(0), artists.limit(0), recordings, good))) == 5
    few = rows([("c", "NEW")] * 9, "candidate_id string, state string")
    assert crawl.starters(few).count() == 8 and crawl.starters(few.union(few)).count() == 0


def test_crawl_batch(rows):
    long = "x" * 36
    frontier = rows([(long, "Known", 2.0, "PENDING", 1), ("name:Lost", "Lost", 1.9, "PENDING", 2), ("name:New", "New", 1.8, "PENDING", 3), ("later", "Later", 0.1, "PENDING", 4)], FRONTIER)
    said = {
        "artist_search": rows([("name:Lost", '{"artists": []}'), ("name:New", '{"artists": [{"id": "id of new"}]}')], "key string, body string"),
        "discography": rows([(long, json.dumps({"release-groups": [{"id": "g1", "title": "First"}, {"id": "g2", "title": "Live in Town"}, {"id": "g3", "title": "Owned"}]}))], "key string, body string"),
        "genre_network": rows([("id of new", json.dumps({"results": {"bindings": [{"title": {"value": "Near"}, "similarArtistLabel": {"value": "Neighbour"}, "genreLabel": {"value": "Rock"}}]}}))], "key string, body string"),
        "similar": rows([("Known", json.dumps({"similarartists": {"artist": [{"name": "Twin"}]}}))], "key string, body string"),
        "albums": rows([("Twin", json.dumps({"topalbums": {"album": [{"name": "Best", "mbid": "short"}]}}))], "name string, body string"),
    }
    known = rows([("cand_x",)], "candidate_id string")
    owned = rows([("owned", "known")], "kt string, ka string")
    out = crawl.crawl_batch(frontier, said, known, owned, rows([("rock", 0.96)], "genre string, score double"), n=3)
    assert {r.seed_id: r.state for r in out["frontier"].collect()} == {long: "COOLDOWN", "name:Lost": "FAILED", "id of new": "COOLDOWN", "later": "PENDING"}
    assert {(r.title, r.artist_name, r.genre, r.ccs) for r in out["candidates"].collect()} == {("First", "Known", "Discography", 0.8), ("Near", "Neighbour", "Rock", 0.96), ("Best", "Twin", "Similar", 0.8)}


def test_applied_decisions(rows):
    recording = "id long, title string, artist_id long, album_id long, release_date string, original_release_date string, isrc string, musicbrainz_recording_id string, state string"
    recordings = rows([(1, "a", None, None, None, None, "I1", "m1", "PARSED"), (2, "b", 5, None, None, None, None, None, "PARSED"), (3, "c", None, None, None, None, None, "m1", "PARSED"), (4, "d", None, None, None, None, None, "m9", "PARSED"), (5, "e", None, None, None, None, None, "m9", "PARSED")], recording)
    decisions = rows([(2, "isrc", "I1"), (3, "isrc", "I7"), (4, "isrc", "I7"), (2, "musicbrainz_recording_id", "m1"), (1, "artist", "The Known"), (2, "album", "Record"), (3, "title", ""), (9, "title", "nobody")], "entity_id long, field_name string, selected_value string")
    out = apply.apply_decisions(recordings, rows([(5, "Known")], "id long, name string"), rows([(7, 5, "record")], "id long, artist_id long, title string"), decisions)
    assert {r.id: (r.artist_id, r.album_id, r.isrc, r.musicbrainz_recording_id) for r in out["recordings"].collect()} == {1: (5, None, "I1", "m1"), 4: (None, None, None, "m9"), 5: (None, None, None, "m9")}
    assert sorted(map(tuple, out["merged"].collect())) == [(2, 1), (3, 1)]
    assert sorted(r.entity_id for r in out["opened"].collect()) == [2, 4]
    assert {(r.entity_id, r.field_name, r.old_value, r.selected_value) for r in out["applied"].collect()} == {(3, "isrc", None, "I7"), (2, "musicbrainz_recording_id", None, "m1"), (1, "artist", None, "The Known"), (2, "album", None, "Record")}
    assert out["artists"].count() == out["albums"].count() == 0


def test_decision_hash_follows_its_facts(rows):
    from tessera.operators.resolve import decision_hash

    frame = rows([("f", [(2, "b"), (1, None)], "x"), ("f", [(1, None), (2, "b")], "x"), ("f", [(1, "a")], None)], "field string, facts array<struct<id:int,value:string>>, chosen string")
    found = [r.h for r in frame.select(decision_hash(F.col("field"), F.col("facts"), F.col("chosen"), "5", "c").alias("h")).collect()]
    assert found[0] == found[1] != found[2] and len(found[0]) == 64
