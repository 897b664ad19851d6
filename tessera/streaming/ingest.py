"""Structured Streaming: watched folders, deduplicated ingestion, feedback, windowed counts."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tessera.operators import mutate

AUDIO = r"\.(mp3|flac|wav|m4a|ogg)$"


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, md5_file, size) of the audio files below a folder, letter case of the suffix aside."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.rlike(F.lower("path"), F.lit(AUDIO))).select("path", F.md5("content").alias("md5_file"), F.col("length").alias("size"))


def watch_files(spark: SparkSession, folder: str, per_trigger: int = 1000, archive: str | None = None) -> DataFrame:
    """A stream of the audio files that appear below a folder; files appear whole (written elsewhere, then moved)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder).where(F.rlike(F.lower("path"), F.lit(AUDIO))).select("path", F.md5("content").alias("md5_file"), F.col("length").alias("size"), F.col("modificationTime").alias("seen_at"))


def move_file(source: str, folder: str, name: str | None = None) -> str:
    """Move a file into a folder, under a new name where the name is taken; the new path, or an empty text where the file is gone."""
    import os
    import shutil
    import uuid

    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, name or os.path.basename(source))
    if os.path.exists(target):
        stem, suffix = os.path.splitext(target)
        target = f"{stem}_{uuid.uuid4().hex[:6]}{suffix}"
    try:
        return shutil.move(source, target)  # across devices it copies and deletes
    except FileNotFoundError:
        return ""


def restore_files(folders: list[str], inbox: str) -> int:
    """Move the audio files below archive folders back to the inbox, to be taken in anew; how many."""
    import os
    import re

    found = [os.path.join(top, name) for folder in folders for top, _, names in os.walk(folder) for name in names if re.search(AUDIO, name.lower())]
    return sum(move_file(path, inbox) != "" for path in found)


class ProgressLog(StreamingQueryListener):
    """Keeps the last events of streams as (kind, name, batch, rows, rate), oldest first; ``table`` gives them as rows."""

    def __init__(self, most: int = 1000):
        self.events: deque = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        self.events.append(("started", event.name, None, None, None))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.events.append(("progress", p.name, p.batchId, p.numInputRows, float(p.processedRowsPerSecond or 0.0)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.events.append(("failed" if event.exception else "finished", None, None, None, None))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.events), "kind string, name string, batch long, rows long, rate double")


def ingest_batch(batch: DataFrame, store: DataFrame) -> DataFrame:
    """The store with the batch's files that it doesn't have, of equal files the first path."""
    return mutate.insert_ignore(store, batch, ["md5_file"], [F.col("path")])


def ingest(stream: DataFrame, store: str, checkpoint: str, available_now: bool = True):
    """Append new files to a Parquet store, each content once. A batch that is run again adds nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        columns = ["path", "md5_file", "size"]
        try:
            known = spark.read.parquet(store).select("md5_file")
        except Exception as missing:  # the first batch finds no store
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            known = spark.createDataFrame([], "md5_file string")
        mutate.first_of(rows.select(*columns), ["md5_file"], [F.col("path")]).join(known, "md5_file", "left_anti").select(*columns).write.mode("append").parquet(store)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def first_seen(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Files whose content wasn't seen within the lateness, without a store."""
    return stream.withWatermark("seen_at", lateness).dropDuplicatesWithinWatermark(["md5_file"])


def apply_feedback(frontier: DataFrame, feedback: DataFrame) -> DataFrame:
    """Frontier with the priorities of a batch of feedback (entity_name, action): accept +0.25, snooze -0.20, ignore -0.40, not below 0.1."""
    step = F.when(F.col("action") == "accept", 0.25).when(F.col("action") == "snooze", -0.20).when(F.col("action") == "ignore", -0.40).otherwise(0.0)
    change = feedback.groupBy("entity_name").agg(F.sum(step).alias("d"))
    moved = F.when(F.col("d") < 0, F.greatest(F.lit(0.1), F.col("priority") + F.col("d"))).otherwise(F.col("priority") + F.col("d"))
    return frontier.join(change, "entity_name", "left").select(*[F.coalesce(moved, F.col("priority")).alias(c) if c == "priority" else F.col(c) for c in frontier.columns])


def event_counts(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events and their values by type and time window (beyond the catalog's own operators); the same on a stream and a table."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    counts = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
