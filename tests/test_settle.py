"""The settling folder: files that grow, that are given up, that come back, and a restart."""

import os
import time

import pytest

from tessera.streaming import settle


def put(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as out:
        out.write(text)


@pytest.fixture
def reader(tmp_path, monkeypatch):
    """A reader whose clock the test turns."""
    clock = [1000.0]
    monkeypatch.setattr(settle.time, "time", lambda: clock[0])
    out = settle.SettledReader({"path": f"{tmp_path}/in"})
    out.clock = clock
    return out


def poll(reader, start, later):
    reader.clock[0] += later
    end = reader.latestOffset()
    return end, sorted(os.path.basename(f[0]) for p in reader.partitions(start, end) for f in p.files)


def test_a_file_waits_until_two_looks_agree(reader, tmp_path):
    at = reader.initialOffset()
    put(f"{tmp_path}/in/a.mp3", "one")
    put(f"{tmp_path}/in/sub/b.FLAC", "two")
    put(f"{tmp_path}/in/c.txt", "text")
    put(f"{tmp_path}/in/empty.wav", "")
    at, found = poll(reader, at, 0)
    assert found == []
    put(f"{tmp_path}/in/a.mp3", " and more", "a")
    at, found = poll(reader, at, 0.6)
    assert found == ["b.FLAC"]
    at, found = poll(reader, at, 0.2)  # too early
    assert found == []
    at, found = poll(reader, at, 0.4)
    assert found == ["a.mp3"]
    assert poll(reader, at, 5)[1] == []


def test_a_file_that_never_settles_is_given_up(reader, tmp_path):
    at, seen = reader.initialOffset(), []
    for k in range(30):
        put(f"{tmp_path}/in/a.mp3", "x", "a")
        if k == 3:
            put(f"{tmp_path}/in/b.mp3", "whole")
        at, found = poll(reader, at, 0.5)
        seen += found
    assert seen == ["b.mp3"] and [d[2] for p, d in reader.done.items() if p.endswith("a.mp3")] in ([], [False])


def test_files_that_go_leave_the_offset_and_may_come_again(reader, tmp_path):
    at = reader.initialOffset()
    put(f"{tmp_path}/in/a.mp3", "one")
    at, _ = poll(reader, at, 0)
    at, found = poll(reader, at, 1)
    assert found == ["a.mp3"]
    os.remove(f"{tmp_path}/in/a.mp3")
    at, _ = poll(reader, at, 1)
    assert at == {"done": {}}
    put(f"{tmp_path}/in/a.mp3", "two")
    at, _ = poll(reader, at, 1)
    assert poll(reader, at, 1)[1] == ["a.mp3"]


def test_a_restart_releases_nothing_twice(reader, tmp_path, monkeypatch):
    at = reader.initialOffset()
    put(f"{tmp_path}/in/a.mp3", "one")
    at, _ = poll(reader, at, 0)
    at, found = poll(reader, at, 1)
    put(f"{tmp_path}/in/b.mp3", "two")
    again = settle.SettledReader({"path": f"{tmp_path}/in"})
    again.clock = reader.clock
    assert again.partitions(at, at) == []  # as Spark begins where a stream ended
    seen = []
    for _ in range(4):
        at, found = poll(again, at, 1)
        seen += found
    assert seen == ["b.mp3"]


def test_the_source_as_a_stream(spark, tmp_path):
    put(f"{tmp_path}/in/a.mp3", "one")
    put(f"{tmp_path}/in/b.mp3", "grows")
    batches = {}  # a batch that was cut off before its commit comes again under its number
    keep = lambda frame, batch: batches.__setitem__(batch, [(os.path.basename(r.path), bytes(r.content).decode(), r.length) for r in frame.collect()])
    rows = lambda: sorted(r for found in list(batches.values()) for r in found)
    start = lambda: settle.watch_settled(spark, f"{tmp_path}/in", 0.3, 30).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/mark").trigger(processingTime="200 milliseconds").start()

    def until(n):
        end = time.time() + 60
        while len(rows()) < n and time.time() < end:
            time.sleep(0.1)

    run = start()
    until(1)
    put(f"{tmp_path}/in/c.ogg", "three")
    until(3)
    run.stop()
    run = start()
    put(f"{tmp_path}/in/d.mp3", "four")
    until(4)
    time.sleep(1)
    run.stop()
    assert rows() == [("a.mp3", "one", 3), ("b.mp3", "grows", 5), ("c.ogg", "three", 5), ("d.mp3", "four", 4)]
