"""A watched folder as a stream source: a file is released once its size has stopped to change."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

AUDIO = r"\.(mp3|flac|wav|m4a|ogg)$"
#: Seconds between two looks at a file, and after which one that still changes is given up.
SETTLE, GIVE_UP = 0.5, 12.0


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, float]]):
        super().__init__(files)
        self.files = files


class SettledReader(DataSourceStreamReader):
    """Looks at the folder once a trigger, and hands the released files to as many tasks as their bytes ask for.

    The offset names the files that are released or given up and still in the folder, by size and time, so that it stays as small as
    the inbox; a file that is moved away leaves it, and one that is written anew is another file. What a restart
    forgets is only how long a waiting file has waited.
    """

    def __init__(self, options: dict):
        self.folder = os.path.abspath(options["path"])
        self.pattern = re.compile(options.get("pattern", AUDIO), re.IGNORECASE)
        self.settle, self.give_up = float(options.get("settle", SETTLE)), float(options.get("giveup", GIVE_UP))
        self.bytes_of_a_task = int(options.get("bytesofatask", 64 << 20))
        self.waiting: dict[str, tuple[int, float, float]] = {}  # size, when first seen, when that size was first seen
        self.done: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {"done": {}}

    def _look(self, now: float) -> None:
        present = {}
        for top, _, names in os.walk(self.folder):
            for name in names:
                if self.pattern.search(name):
                    path = os.path.join(top, name)
                    try:
                        info = os.stat(path)
                    except OSError:
                        continue
                    present[path] = (info.st_size, info.st_mtime)
        self.done = {p: d for p, d in self.done.items() if p in present and list(present[p]) == d[:2]}
        self.waiting = {p: w for p, w in self.waiting.items() if p in present and p not in self.done}
        for path, (size, changed) in present.items():
            if path in self.done:
                continue
            before, first, since = self.waiting.get(path, (None, now, now))
            if size != before:
                since = now
            if now - first >= self.give_up:
                self.done[path] = [size, changed, False]
            elif before == size and size > 0 and now - since >= self.settle:
                self.done[path] = [size, changed, True]
            else:
                self.waiting[path] = (size, first, since)
                continue
            self.waiting.pop(path, None)

    def latestOffset(self) -> dict:
        self._look(time.time())
        return {"done": dict(sorted(self.done.items()))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if not self.done:  # Spark begins with the offset that was reached before, as both start and end
            self.done = dict(end["done"])
        old = start["done"]
        out, held, size = [], [], 0
        for path, (length, changed, whole) in end["done"].items():
            if whole and old.get(path) != [length, changed, whole]:
                held.append((path, length, changed))
                size += length
                if size >= self.bytes_of_a_task:
                    out.append(_Files(held))
                    held, size = [], 0
        return [*out, _Files(held)] if held else out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        for path, _, changed in partition.files:
            try:
                with open(path, "rb") as file:
                    content = file.read()
            except OSError:  # taken away since
                continue
            columns = [pa.array([path]), pa.array([content], pa.binary()), pa.array([len(content)], pa.int64()), pa.array([int(changed * 1_000_000)], pa.timestamp("us", tz="UTC"))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "content", "length", "modificationTime"])

    def commit(self, end: dict) -> None:
        pass


class SettledFiles(DataSource):
    """Format ``settled_files``: path, and settle, giveup, pattern, bytesOfATask."""

    @classmethod
    def name(cls) -> str:
        return "settled_files"

    def schema(self) -> str:
        return "path string, content binary, length long, modificationTime timestamp"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SettledReader({k.lower(): v for k, v in self.options.items()})


def watch_settled(spark: SparkSession, folder: str, settle: float = SETTLE, give_up: float = GIVE_UP) -> DataFrame:
    """(path, content, length, modificationTime) of the audio files below a folder that the driver and all executors share.

    A file comes once two looks at least ``settle`` seconds apart find the same size above zero, and never if it hasn't come within
    ``give_up`` seconds. The stream looks once a trigger, so it runs on a processing time of about half a second.
    """
    spark.dataSource.register(SettledFiles)
    return spark.readStream.format("settled_files").option("settle", settle).option("giveup", give_up).load(folder)
