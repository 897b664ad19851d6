"""Streams run to their end over small folders."""

import os

from pyspark.sql import functions as F

from tessera.streaming import ingest


def write(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(f"{folder}/{name.replace('_', '.')}", "w") as out:
            out.write(text)


def test_ingest_keeps_each_content_once(spark, tmp_path):
    source, store, mark = f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/mark"
    write(source, a_mp3="one", b_FLAC="one", c_txt="text", d_wav="two")
    ingest.ingest(ingest.watch_files(spark, source), store, mark).awaitTermination()
    write(source, e_ogg="two", f_ogg="three")
    ingest.ingest(ingest.watch_files(spark, source), store, mark).awaitTermination()
    rows = spark.read.parquet(store).collect()
    assert len(rows) == 3 and len({r.md5_file for r in rows}) == 3
    assert ingest.scan_files(spark, source).count() == 5


def test_windowed_counts_on_a_stream_are_those_of_the_table(spark, small, tmp_path):
    table = spark.read.parquet(f"{small}/events.parquet")
    table.coalesce(2).write.parquet(f"{tmp_path}/events")
    stream = ingest.event_counts(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/events"))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/m").start()
    run.awaitTermination()
    total = lambda d: d.agg(F.sum("n")).first()[0]
    assert total(spark.table("counts")) == total(ingest.event_counts(table)) == table.count()


def test_feedback_moves_priorities(rows):
    frontier = rows([("a", 0.5), ("b", 0.5), ("c", 0.2)], "entity_name string, priority double")
    feedback = rows([("a", "accept"), ("b", "snooze"), ("c", "ignore")], "entity_name string, action string")
    out = {r.entity_name: round(r.priority, 6) for r in ingest.apply_feedback(frontier, feedback).collect()}
    assert out == {"a": 0.75, "b": 0.3, "c": 0.1}


def test_the_stream_archives_what_it_has_taken_and_reports_progress(spark, tmp_path):
    log = ingest.ProgressLog()
    spark.streams.addListener(log)
    try:
        source, archive = f"{tmp_path}/in", f"{tmp_path}/archive"
        write(source, a_mp3="one")
        for name in ("b_mp3", "c_mp3"):
            ingest.ingest(ingest.watch_files(spark, source, archive=archive), f"{tmp_path}/store", f"{tmp_path}/mark").awaitTermination()
            write(source, **{name: name})
        ingest.ingest(ingest.watch_files(spark, source, archive=archive), f"{tmp_path}/store", f"{tmp_path}/mark").awaitTermination()
        assert any(files for _, _, files in os.walk(archive))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(log)
    kinds = [r.kind for r in log.table(spark).collect()]
    assert kinds.count("started") == 3 and "progress" in kinds and "failed" not in kinds


def test_first_seen_without_a_store(spark, tmp_path):
    source = f"{tmp_path}/in"
    write(source, a_mp3="one", b_mp3="one", c_mp3="two")
    stream = ingest.first_seen(ingest.watch_files(spark, source))
    run = stream.writeStream.format("memory").queryName("first_seen").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/m").start()
    run.awaitTermination()
    assert spark.table("first_seen").count() == 2
