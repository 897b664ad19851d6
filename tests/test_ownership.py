"""Fuzzy ownership against all pairs, and that artists whom a likely album answers are held against no others."""

from types import SimpleNamespace

from tessera.functions.exact import ratio
from tessera.plans import domain


def test_against_all_pairs(rows, monkeypatch):
    people = [(k, f"Customer#{k:06d}") for k in range(40)] + [(40, "Aurora Sky"), (41, "Zz")]
    albums = [(k, f"Album {1990 + k % 3}") for k, _ in people]
    wanted = [(f"c{k}", f"Album {1990 + k % 4} x"[: 10 + k % 2], f"Customer#{k * 7:06d}") for k in range(30)] + [("d0", "Album 1991", "urora Sky"), ("d1", "Album 1990", "Nobody"), ("d2", "Album 1990", None), ("d3", "Other", "Customer#000001")]
    asked, plain = [], domain.alike
    monkeypatch.setattr(domain, "alike", lambda left, right, least: asked.append(left.distinct().count()) or plain(left, right, least))
    t = SimpleNamespace(core_artists=rows(people, "id long, name string"), core_albums=rows(albums, "artist_id long, title string"), sys_discovery_candidates=rows(wanted, "candidate_id string, title string, artist_name string"))
    got = {r.candidate_id for r in domain.fuzzy_owned(t).collect()}
    names = dict(people)
    block = lambda x: x.replace(" ", "").lower()[:3]
    assert got == {c for c, title, who in wanted if any(block(title) == block(a) and ratio(title, a) >= 0.85 and ratio(who, names[k]) >= 0.70 for k, a in albums)}
    assert "d0" in got and "d1" not in got and len(asked) == 2 and asked[1] <= 6


def test_titles_that_begin_otherwise_and_recordings_are_found(rows):
    names = {1: "Aurora Sky", 2: "ΟΔΟΣ", 3: "Brass Ring"}
    albums = [(1, "The Quiet Harbour"), (2, "ΝΥΧΤΕΣ ΤΗΣ ΠΟΛΗΣ"), (3, "Ab")]
    tracks = [("Second Lantern Song", 1), ("Loose Ends Forever", None), ("", 3)]
    wanted = [("first letter", "A Quiet Harbour", "Aurora Sky"), ("one more", "1 The Quiet Harbour", "Aurora Sky"), ("sigma", "Ν.ΥΧΤΕΣ ΤΗΣ ΠΟΛΗΣ", "οδοσ"), ("recording", "Xecond Lantern Song", "Aurora Skye"), ("unknown", "Loose Ends Forever", "unknown artist"), ("other artist", "Second Lantern Song", "Brass Ring"), ("short", "Ac", "Brass Ring"), ("empty", "", "Brass Ring"), ("none", None, "Brass Ring")]
    t = SimpleNamespace(core_artists=rows(list(names.items()), "id long, name string"), core_albums=rows(albums, "artist_id long, title string"), sys_discovery_candidates=rows(wanted, "candidate_id string, title string, artist_name string"))
    found = lambda *more: {r.candidate_id for r in domain.fuzzy_owned(t, *more).collect()}
    frame = rows(tracks, "title string, artist_id long")
    held = [(title, names[k]) for k, title in albums]
    near = lambda: {c for c, title, who in wanted if any(ratio(title, x) >= 0.85 and ratio(who, y) >= 0.70 for x, y in held)}
    assert found() == near() == {"first letter", "one more", "sigma"}
    held += [(title, names.get(k, "Unknown Artist")) for title, k in tracks]
    assert found(frame) == near() == {"first letter", "one more", "sigma", "recording", "unknown"}
