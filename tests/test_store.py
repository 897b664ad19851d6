"""The store of files against one loop over all batches; batches run again, and what of the store a batch reads."""

import random

import pytest

from tessera.operators import dedup
from tessera.streaming import store as stores

SCHEMA = "path string, md5_file string, audio_stream_hash string, duration double, fingerprint string, title string, artist string"


def batches(seed, n=3, size=60):
    rng = random.Random(seed)
    out, k = [], 0
    for _ in range(n):
        rows = []
        for _ in range(size):
            rows.append((f"/in/{k:04d}.mp3", f"m{rng.randrange(120)}", f"s{rng.randrange(150)}", rng.choice([0.0, None, 100.0, 101.5, 103.0, 200.0]), rng.choice([None, "", f"f{rng.randrange(25)}"]), rng.choice([None, " ", f"Song {rng.randrange(30)}"]), rng.choice([None, "", "The Band", "Band", "Other"])))
            k += 1
        rng.shuffle(rows)
        out.append(rows)
    return out


def plain(groups, artist_key):
    """(accepted paths, {path: label}) of files in order."""
    accepted, labels, held = [], {}, []
    for rows in groups:
        for path, md5, stream, duration, heard, title, artist in sorted(rows):
            heard = heard.strip() if heard and heard.strip() and duration and duration > 0 else None
            titled = (title.strip().lower(), artist_key[artist]) if title and title.strip() and artist and artist.strip() else None
            label = None
            if any(h[0] == md5 for h in held):
                label = "FILE_DUPLICATE"
            elif any(h[1] == stream for h in held):
                label = "STREAM_DUPLICATE"
            elif heard and any(h[2] == heard and abs(h[3] - duration) <= 2.0 for h in held):
                label = "FINGERPRINT_DUPLICATE"
            elif titled and any(h[4] == titled for h in held):
                label = "TITLE_ARTIST_DUPLICATE"
            if label:
                labels[path] = label
            else:
                accepted.append(path)
                held.append((md5, stream, heard, duration, titled))
    return accepted, labels


KEYS = {"The Band": "band", "Band": "band", "Other": "other", "": None, None: None}


def read(spark, store):
    accepted = sorted(r.path for r in stores.accepted_files(spark, store).collect())
    labels = {r.path: r.label for r in spark.read.parquet(f"{store}/duplicates").collect()}
    return accepted, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_against_one_loop(spark, tmp_path, seed):
    groups, store = batches(seed), f"{tmp_path}/store"
    for k, rows in enumerate(groups):
        stores.add_batch(spark.createDataFrame(rows, SCHEMA).repartition(3), k, store)
    want = plain(groups, KEYS)
    assert read(spark, store) == want and len(set(want[1].values())) == 4
    before = sorted(map(tuple, spark.read.parquet(f"{store}/keys").collect()), key=str)
    for k in (2, 1):  # run again, the last and one before it
        stores.add_batch(spark.createDataFrame(groups[k], SCHEMA), k, store)
    assert read(spark, store) == want
    assert sorted(map(tuple, spark.read.parquet(f"{store}/keys").collect()), key=str) == before


def test_a_batch_reads_the_buckets_of_its_keys(spark, tmp_path):
    store = f"{tmp_path}/store"
    rows = batches(5, 1, 200)[0]
    stores.add_batch(spark.createDataFrame(rows, SCHEMA), 0, store)
    everything = stores.held_keys(spark, store, list(range(stores.BUCKETS)), 1)
    there = sorted(r.bucket for r in everything.select("bucket").distinct().collect())
    few = stores.held_keys(spark, store, there[:2], 1)
    plan = few._sc._jvm.PythonSQLUtils.explainString(few._jdf.queryExecution(), "formatted")
    filters = next(line for line in plan.splitlines() if line.startswith("PartitionFilters"))
    assert "bucket" in filters and "batch" in filters
    assert sorted(r.bucket for r in few.select("bucket").distinct().collect()) == there[:2] and len(there) > 10
    assert stores.held_keys(spark, store, there, 0).count() == 0


def test_the_store_behind_a_stream(spark, tmp_path):
    groups, store = batches(7, 2, 30), f"{tmp_path}/store"
    for rows in groups:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stores.ingest(spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in"), store, f"{tmp_path}/mark").awaitTermination()
    assert read(spark, store) == plain(groups, KEYS)


def test_the_query_over_all_assets(spark, small):
    from pyspark.sql import functions as F

    from tessera.functions import text
    from tessera.plans import registry
    from tessera.sources.fixtures import Catalog

    t = Catalog(spark, small)
    names = {r.id: r for r in t.core_recordings.select("id", "title", "artist_id").collect()}
    artists = {r.id: (r.name, r.key) for r in t.core_artists.select("id", "name", text.artist_key(F.col("name")).alias("key")).collect()}
    groups = [[], []]
    for r in t.core_assets.collect():
        track = names[r.recording_id]
        groups[r.channels - 1].append((r.asset_id, r.md5_file, r.audio_stream_hash, float(r.duration) if r.duration is not None else None, str(r.recording_id % 3000), track.title, artists.get(track.artist_id, (None,))[0]))
    accepted, _ = plain(groups, {**dict(artists.values()), None: None})
    first = {row[0] for row in groups[0]}
    got = registry.queries()["ss02_ingest_store"](spark, small).collect()
    assert sorted((r.path, r.batch) for r in got) == sorted((p, int(p not in first)) for p in accepted)


def test_a_batch_stores_few_rows_besides_its_files(spark, tmp_path, monkeypatch):
    """The keys of files are not stored anew for each step; only what is accepted or may come first is."""
    sizes, plain_cut = [], dedup.cut

    def counted(frame):
        out = plain_cut(frame)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(stores, "cut", counted)
    monkeypatch.setattr(dedup, "cut", counted)
    frame = spark.range(5000).selectExpr("concat('/in/', 10000 + id) AS path", "concat('m', id % 900) AS md5_file", "concat('s', id % 20) AS audio_stream_hash", "1.0D AS duration", "'' AS fingerprint", "'' AS title", "'' AS artist")
    stores.add_batch(frame, 0, f"{tmp_path}/store")
    assert stores.accepted_files(spark, f"{tmp_path}/store").count() == 20 and sum(sizes) < 1000
    assert spark.read.parquet(f"{tmp_path}/store/duplicates").groupBy("label").count().count() == 2
