"""Readers, writers, reports, media and schemas on small folders."""

import hashlib
import os
import struct
import wave

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, media, schema
from tessera.streaming import ingest


def test_tables_in_every_format(spark, rows, tmp_path):
    frame = rows([(1, "a"), (2, None)], "k int, v string")
    for kind in files.FORMATS:
        path = f"{tmp_path}/{kind}"
        frame.write.option("header", "true").format(kind).save(path)
        out = files.read_table(spark, path, kind, None if kind in ("parquet", "orc") else "k int, v string")
        assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        files.read_table(spark, f"{tmp_path}/csv", "csv")
    with pytest.raises(ValueError):
        files.read_table(spark, f"{tmp_path}/csv", "xml")


def test_exports(spark, rows, tmp_path):
    frame = rows([(3, "c", "test"), (1, "a", "train"), (2, "b,", "train")], "k int, v string, split string")
    files.write_export(frame, f"{tmp_path}/out", ["k"])
    assert [tuple(r) for r in spark.read.option("header", "true").csv(f"{tmp_path}/out").orderBy("k").collect()] == [("1", "a", "train"), ("2", "b,", "train"), ("3", "c", "test")]
    files.write_lines(frame.select("k", "v"), f"{tmp_path}/lines")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/lines").collect()) == ["1\ta", "2\tb,", "3\tc"]
    files.write_splits(frame, f"{tmp_path}/splits")
    assert spark.read.json(f"{tmp_path}/splits").where("split = 'train'").count() == 2
    files.check_shares(70, 20, 10)
    with pytest.raises(ValueError):
        files.check_shares(70, 20, 20)


def test_fingerprint_output(rows):
    assert files.fingerprint("DURATION=12\nFINGERPRINT=AQAAabcdef=1\nnoise") == {"DURATION": "12", "FINGERPRINT": "AQAAabcdef=1"}
    assert "FINGERPRINT" not in files.fingerprint("FINGERPRINT=short")
    out = files.parsed_fingerprints(rows([("DURATION=12\r\nFINGERPRINT=AQAAabcdef=1",), ("",), (None,)], "output string")).collect()
    assert [(r.duration, r.fingerprint) for r in out] == [(12.0, "AQAAabcdef=1"), (None, None), (None, None)]


def test_reports(rows):
    figures = rows([("b", 2), ("a", 1)], "metric string, n int")
    assert files.markdown_report(figures, "T").splitlines()[4:] == ["| a | 1 |", "| b | 2 |"]
    with pytest.raises(ValueError):
        files.markdown_report(figures, "T", most=1)
    runs = rows([("r", "2024-01-01", None)], "run_id string, started_at string, finished_at string")
    decisions = rows([(k, "r", 7, "genre", f"old {k}", f"new {k}") for k in range(40)], "id int, run_id string, entity_id int, field_name string, old_value string, selected_value string")
    report = files.run_report(runs, decisions, "r")
    assert "decisions: 40, the first 30 below" in report and report.count("* `genre` of 7") == 30 and "finished: not yet" in report
    assert "unknown" in files.run_report(runs, decisions, "x")
    library = files.library_report(rows([(1,), (2,)], "id int"), rows([(0.5,)], "quality_score double"), rows([("mp3",), (None,)], "format string"), rows([("Rock",), ("Rock",)], "primary_genre string"))
    assert "* Rock: 2 (100.0 %)" in library and "* UNKNOWN: 1 (50.0 %)" in library and "mean quality: 50.0 %" in library


def test_catalog_of_views(spark, rows):
    rows([(1,)], "k int").createOrReplaceTempView("some_view")
    assert "some_view" in {r.name for r in files.table_sizes(spark).collect()}
    files.drop_views(spark, ["some_view"])
    assert "some_view" not in {r.name for r in files.table_sizes(spark).collect()}


def id3(frames, version=3):
    body = b"".join(n.encode() + (struct.pack(">I", len(t) + 1) if version == 3 else bytes([0, 0, (len(t) + 1) >> 7, (len(t) + 1) & 127])) + b"\0\0" + b"\3" + t for n, t in frames)
    return b"ID3" + bytes([version, 0, 0, 0, 0, len(body) >> 7, len(body) & 127]) + body + b"sound" * 3000


def flac(comments):
    block = struct.pack("<I", 0) + struct.pack("<I", len(comments)) + b"".join(struct.pack("<I", len(c)) + c for c in comments)
    return b"fLaC" + bytes([0]) + (4).to_bytes(3, "big") + b"info" + bytes([132]) + len(block).to_bytes(3, "big") + block + b"frames"


def test_media_parser_and_fan_out(spark, rows, tmp_path):
    with wave.open(f"{tmp_path}/x.wav", "wb") as sound:
        sound.setnchannels(1), sound.setsampwidth(2), sound.setframerate(8000), sound.writeframes(b"\1\2" * 8000)
    with open(f"{tmp_path}/x.wav", "rb") as file:
        tone = file.read()
    contents = {
        "/m/cd 2/03 - Song_One.mp3": id3([("TIT2", b"Song One"), ("TPE1", b"A\0B"), ("TCON", b"Post-Rock; free  jazz"), ("TXXX", b"subgenre\0Shoegaze"), ("TYER", b"none")]),
        "/m/four.MP3": id3([("TIT2", "Größe".encode())], 4),
        "/m/song.flac": flac([b"title=Two", b"GENRE=Rock", b"genre=Jazz", b"ISRC="]),
        "/m/x.wav": tone,
        "/m/broken.ogg": b"OggS\x03vorbis\xff\xff",
        "/m/empty.mp3": b"",
    }
    parsed = media.parse_media(rows([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary"))
    out = {r.path: r for r in parsed.collect()}
    one = out["/m/cd 2/03 - Song_One.mp3"]
    assert one.tags == {"title": "Song One", "artist": "A ; B", "genre": "Post-Rock; free  jazz", "subgenre": "Shoegaze"}
    assert out["/m/four.MP3"].tags == {"title": "Größe"} and out["/m/song.flac"].tags == {"title": "Two", "genre": "Rock ; Jazz"}
    assert one.md5_file == hashlib.md5(contents[one.path]).hexdigest() and one.audio_stream_hash == hashlib.md5(contents[one.path][8192:]).hexdigest()
    sound = out["/m/x.wav"]
    assert (sound.duration, sound.sample_rate, sound.channels) == (1.0, 8000, 1) and sound.audio_stream_hash == hashlib.md5(b"\1\2" * 8000).hexdigest()
    assert out["/m/empty.mp3"].status == "CORRUPTED" and out["/m/broken.ogg"].tags == {}
    made = media.fan_out(parsed)
    facts = {(r.field_name, r.value, r.source_id, r.confidence) for r in made["evidence"].join(made["recordings"].where("title LIKE '%Song_One%'").select(F.col("id").alias("entity_id")), "entity_id").collect()}
    assert {("genre", "post rock", "SRC_EMBEDDED_TAGS", 1.0), ("genre", "free jazz", "SRC_EMBEDDED_TAGS", 0.75), ("subgenre", "shoegaze", "SRC_EMBEDDED_TAGS", 1.0), ("disc_number", "2", "SRC_PATH_SEED", 1.0), ("title", "Song One", "SRC_PATH_SEED", 1.0)} <= facts
    assert {f for f, _, source, _ in facts if source == "SRC_TAXONOMY"} == {"genre", "subgenre"}
    assert [made[k].count() for k in ("recordings", "assets", "locations", "validation")] == [5] * 4


def test_wipe_drops_tables_and_views_and_declares_them_anew(spark, tmp_path):
    spark.sql(f"CREATE DATABASE wiped LOCATION '{tmp_path}/wiped'")
    try:
        schema.create_tables(spark, "wiped")
        spark.sql("INSERT INTO wiped.sys_runs (run_id) VALUES ('r')")
        spark.sql("CREATE TABLE wiped.other USING parquet AS SELECT 1 AS k")
        spark.sql("CREATE VIEW wiped.vw_open_issues_queue AS SELECT run_id FROM wiped.sys_runs")
        spark.sql("SELECT 1 AS k").createOrReplaceTempView("meta_locks")
        os.makedirs(f"{tmp_path}/archive/x")
        with open(f"{tmp_path}/archive/x/a.mp3", "w") as out:
            out.write("x")
        schema.create_tables(spark, "wiped")
        assert spark.table("wiped.sys_runs").count() == 1
        assert schema.wipe(spark, "wiped", f"{tmp_path}/inbox", [f"{tmp_path}/archive"]) == 1
        tables = {x.name for x in spark.catalog.listTables("wiped") if not x.isTemporary}
        assert tables == {*schema.TABLES, "other"} and spark.table("wiped.sys_runs").count() == 0
        assert spark.table("wiped.meta_locks").columns == ["entity_id", "field_name", "lock_state"] and os.listdir(f"{tmp_path}/inbox") == ["a.mp3"]
        assert not spark.catalog.tableExists("meta_locks")
    finally:
        spark.sql("DROP DATABASE wiped CASCADE")


def test_declared_schemas(spark, rows):
    assert schema.empty(spark, "meta_locks").columns == ["entity_id", "field_name", "lock_state"]
    schema.create_all(spark)
    assert spark.table("sys_runs").count() == 0
    schema.create_all(spark)
    files.drop_views(spark, list(schema.TABLES))
    old = rows([(1, None, 9), (2, "k", 9)], "ID int, key string, extra int")
    out = schema.conform(old, "id bigint, key string, more double", {"key": F.concat(F.lit("k"), "ID")})
    assert out.dtypes == [("id", "bigint"), ("key", "string"), ("more", "double"), ("extra", "int")]
    assert sorted(map(tuple, out.collect())) == [(1, "k1", None, 9), (2, "k", None, 9)]


def test_moved_and_restored_files(tmp_path):
    inbox, archive = f"{tmp_path}/in", f"{tmp_path}/archive"
    os.makedirs(inbox)
    for k in range(2):
        with open(f"{inbox}/a.mp3", "w") as out:
            out.write(str(k))
        assert os.path.exists(ingest.move_file(f"{inbox}/a.mp3", archive))
    assert len(os.listdir(archive)) == 2 and ingest.move_file(f"{inbox}/a.mp3", archive) == ""
    with open(f"{archive}/notes.txt", "w") as out:
        out.write("x")
    assert ingest.restore_files([archive, f"{tmp_path}/none"], inbox) == 2 and os.listdir(archive) == ["notes.txt"]
